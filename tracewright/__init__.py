"""Process mining over desktop event logs, written as Spark DataFrame operators."""

__version__ = "0.1.0"
