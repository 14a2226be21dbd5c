"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most so many rows and bytes, so a task's memory
#: does not depend on how long the texts of a partition are.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the session's Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(n).cast("long"))


def tokenizer_file(name: str, path: str | None = None) -> bytes:
    """Content of a public vocabulary file, read once on the driver (each is under 2 MB)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(name)
    with open(os.fspath(path), "rb") as f:
        return f.read()


def trimmed() -> None:
    """Give memory that a worker process no longer uses back to the system.

    Workers stay for the tasks of later stages; without this each would hold the most it has ever used.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


_kept: dict[tuple, object] = {}


def kept(key: tuple | None, make=None):
    """What a worker process keeps between tasks: one object, made anew when another key asks.

    An operator that keeps nothing calls it with None, so that what an earlier stage kept is released.
    """
    if key not in _kept and _kept:
        _kept.clear()
        trimmed()
    if key is None:
        return None
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


@contextmanager
def uncollected():
    """Work that makes very many small objects and no cycles, without scans for cycles meanwhile."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def list_array(values: np.ndarray, lengths: Sequence[int], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from its flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def words(text: str | None) -> list[bytes]:
    r"""Lower-cased (A-Z only) runs of ``[^\x20\x09-\x0D]``; none for null."""
    return text.encode().lower().split() if text else []


def running_before(df: DataFrame, key: str, chunk: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of ``key``, rows ordered by (chunk, order).

    Two levels: sums inside (key, chunk), and a carry from a table with one row per (key, chunk),
    so that a key holding a third of all rows is not sorted in one task.
    """
    inner = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = (df.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
             .select(key, chunk, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_carry")))
    return (df.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(carry, [key, chunk]).withColumn(name, F.col("_own") + F.col("_carry")).drop("_own", "_carry"))
