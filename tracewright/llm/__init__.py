"""Operators of a training-data pipeline; their queries are in ``tracewright.llm.queries``."""
