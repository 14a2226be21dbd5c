"""Every operator as a query over the driver tables."""

from __future__ import annotations


def registry():
    """Name -> entry, in inventory order."""
    from tracewright.catalog import base
    from tracewright.catalog import (aggregates, boundaries, functions, joins, models, profiles,  # noqa: F401
                                     rows, sampling, sequences, sources)
    return dict(sorted(base.REGISTRY.items()))
