"""From points to segments: merging, cutting, stitching, checking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.timeline import (as_list, floor_div, islands, rank_in_buckets, with_next,
                                            with_previous)
from tracewright.session import cut_lineage


def event_order(events: DataFrame, key, ts: str, seq: str, chunk: int, name: str = "position") -> DataFrame:
    """Chronological position in the session, missing times and numbers last."""
    last = F.lit(2 ** 62).cast("long")
    return rank_in_buckets(events, key, F.coalesce(floor_div(F.col(ts), chunk), last),
                           [F.col(ts).asc_nulls_last(), F.col(seq).asc_nulls_last()], name)


def with_index(df: DataFrame, key, ts: str, chunk: int, start: int = 1, tie: Sequence[str] = (),
               name: str = "index") -> DataFrame:
    """Running index per key."""
    out = rank_in_buckets(df, key, floor_div(F.col(ts), chunk), [F.col(c) for c in (ts, *tie)], name)
    return out if start == 1 else out.withColumn(name, F.col(name) + (start - 1))


def with_gap(df: DataFrame, key, ts: str, chunk: int, tie: Sequence[str] = (), name: str = "gap") -> DataFrame:
    """Step from the previous row of the key."""
    out = with_previous(df, key, ts, {"_prev_ts": ts}, chunk, tie)
    return out.withColumn(name, F.col(ts) - F.col("_prev_ts")).drop("_prev_ts")


def merge_points(df: DataFrame, key, ts: str, score: str, gap: int | str, chunk: int) -> DataFrame:
    """One point per chain of steps <= gap: the highest score, the earliest on a tie."""
    key = as_list(key)
    return (islands(df, key, ts, gap, chunk).groupBy(*key, "island")
            .agg(F.max_by(ts, F.struct(F.col(score), -F.col(ts))).alias("predicted_ts"),
                 F.max(score).alias("score"), F.count(F.lit(1)).alias("cluster_size"))
            .drop("island"))


def segments_from_boundaries(bounds: DataFrame, sessions: DataFrame, key, ts: str, chunk: int,
                             first_index: int = 1) -> DataFrame:
    """Contiguous segments from the boundary points strictly inside a session."""
    key = as_list(key)
    inner = (bounds.select(*key, ts).join(sessions, key)
             .filter((F.col(ts) > F.col("session_start")) & (F.col(ts) < F.col("session_end"))).select(*key, ts))
    ends = sessions.select(*key, F.explode(F.array("session_start", "session_end")).alias(ts))
    points = inner.unionByName(ends).distinct()
    cut = cut_lineage(with_next(cut_lineage(points), key, ts, {"segment_end": ts}, chunk)
                      .filter(F.col("segment_end") > F.col(ts)).withColumnRenamed(ts, "segment_start"))
    return with_index(cut, key, "segment_start", chunk, first_index, name="segment_index")


def check_contiguous(segs: DataFrame, key, start: str, end: str, index: str, chunk: int) -> DataFrame:
    """Per key: empty, overlapping, gapped segments and wrong indexes."""
    key = as_list(key)
    seen = with_index(with_previous(segs, key, start, {"_prev_end": end}, chunk), key, start, chunk, name="_pos")
    first = seen.groupBy(*key).agg(F.min(index).alias("_base"))
    prev = F.col("_prev_end")
    return (seen.join(first, key).groupBy(*key)
            .agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col(end) <= F.col(start)).alias("empty"),
                 F.count_if(prev > F.col(start)).alias("overlaps"), F.count_if(prev < F.col(start)).alias("gaps"),
                 F.count_if(F.col(index) != F.col("_pos") + F.col("_base") - 1).alias("wrong_index")))


def stitch(fragments: DataFrame, key, start: str, end: str, chunk: int, process: str = "process_code",
           case: str = "case_id", order: str = "fragment_id") -> DataFrame:
    """Join fragments of one logical execution.

    A fragment continues the previous one of its session when the process is the same, the
    case ids agree or one is blank, and either side declares the continuation.
    """
    key = as_list(key)
    cols = [process, case, "continues_to_next"]
    seen = with_previous(fragments.filter(F.col(start).isNotNull()), key, start,
                         {f"_p_{c}": c for c in cols}, chunk, tie=(order,))
    blank = F.coalesce(F.trim(case), F.lit("")) == ""
    blank_before = F.coalesce(F.trim(f"_p_{case}"), F.lit("")) == ""
    joins = (F.col(process).eqNullSafe(F.col(f"_p_{process}"))
             & (blank | blank_before | (F.col(case) == F.col(f"_p_{case}")))
             & (F.coalesce("_p_continues_to_next", F.lit(False)) | F.coalesce("continues_from_prev", F.lit(False))))
    heads = seen.withColumn("_head", F.when(~F.coalesce(joins, F.lit(False)), F.struct(F.col(start), F.col(order))))
    labelled = _carry_last(heads, key, start, order, "_head", chunk)
    by_order = F.array_sort(F.collect_list(F.struct(F.col(start), F.col(order).alias("id"))))
    return (labelled.groupBy(*key, "_head")
            .agg(F.min_by(process, F.struct(start, order)).alias(process),
                 F.min_by(case, F.struct(start, order)).alias(case),
                 F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("fragment_count"),
                 F.transform(by_order, lambda x: x["id"]).alias("fragment_ids"))
            .withColumn("complete", F.coalesce(F.col(end) >= F.col(start), F.lit(False))).drop("_head"))


def _carry_last(df: DataFrame, key, ts: str, tie: str, name: str, chunk: int) -> DataFrame:
    """Fill a column with its last non-null value along the key."""
    from pyspark.sql import Window

    from tracewright.operators.timeline import CHUNK, add_chunk
    order = F.struct(ts, tie)
    rows = add_chunk(df, ts, chunk)
    edge = (rows.groupBy(*key, CHUNK)
            .agg(F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias("_l"))
            .withColumn("_c", F.last("_l", ignorenulls=True).over(
                Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)))
            .select(*key, CHUNK, "_c"))
    w = Window.partitionBy(*key, CHUNK).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn(name, F.last(name, ignorenulls=True).over(w)).join(edge, [*key, CHUNK], "left")
            .withColumn(name, F.coalesce(name, "_c")).select(*df.columns))


def boundaries_from_intervals(df: DataFrame, key, start: str, end: str, keep: Sequence[str]) -> DataFrame:
    """Start and end points of intervals, one per (key, time): ends before starts."""
    key = as_list(key)
    points = df.select(*key, F.explode(F.array(
        F.struct(F.col(start).alias("ts"), F.lit("start").alias("event"), *keep),
        F.struct(F.col(end).alias("ts"), F.lit("end").alias("event"), *keep))).alias("_p")).select(*key, "_p.*")
    body = F.struct("event", *keep)
    return (points.filter(F.col("ts").isNotNull()).groupBy(*key, "ts")
            .agg(F.min(body).alias("_b")).select(*key, "ts", "_b.*"))


def ranked_ids(df: DataFrame, by, bucket: Column, order: Sequence[Column], prefix: str, width: int = 3,
               name: str = "id") -> DataFrame:
    """Rank and a stable id such as ``PF001``."""
    out = rank_in_buckets(df, by, bucket, order, "rank")
    return out.withColumn(name, F.format_string(f"{prefix}%0{width}d", F.col("rank")))
