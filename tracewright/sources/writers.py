"""Sinks.  Every table is a directory of part files written by the executors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewright.functions.text import map_json
from tracewright.operators.relations import CheckFailed


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write a derived table."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def iso_millis(c) -> Column:
    """UTC ISO-8601 text with milliseconds and Z of a microsecond count."""
    ts = F.timestamp_micros(c)
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def write_segments_jsonl(df: DataFrame, path: str, keys: list[str], start: str = "segment_start", end: str = "segment_end") -> DataFrame:
    """Segments as JSON lines with ISO times; read back to check keys and count."""
    out = df.withColumn(start, iso_millis(F.col(start))).withColumn(end, iso_millis(F.col(end)))
    for c, t in df.dtypes:
        if t.startswith("map"):
            out = out.withColumn(c, map_json(c))
    written = Observation()
    out.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(path)
    back = df.sparkSession.read.schema(out.schema).json(path)
    found = back.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("dups")).first()
    if found["rows"] != written.get["rows"] or found["dups"]:
        raise CheckFailed(f"re-read of {path}: {found['rows']} rows, {found['dups']} duplicate keys")
    return back


def write_bundle(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Named tables side by side, one directory each."""
    return {name: write_table(df, f"{path.rstrip('/')}/{name}", fmt) for name, df in tables.items()}
