"""Reading vector columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null, empty or zero nor with a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_bytes(vector: Column) -> Column:
    """Components as little-endian doubles; equal vectors have equal bytes (-0.0 counts as 0.0)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if v is None else (np.array(v, np.float64) + 0.0).tobytes() for v in batch.to_pylist()], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(vector)


def stacked(column: list[bytes], kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def by_group(work: Callable, columns: int) -> Callable:
    """A mapInArrow function that calls ``work(key, rows)`` for each run of equal values of the first
    column and yields what it returns (a RecordBatch or None); rows arrive sorted by that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns[:columns])):
                if key != now and rows:
                    if (out := work(now, rows)) is not None:
                        yield out
                    rows = []
                now = key
                rows.append(row)
        if rows and (out := work(now, rows)) is not None:
            yield out

    return run
