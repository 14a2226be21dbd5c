"""Interval joins.  Every theta condition is local in time inside one key, so it becomes an
equi join on (key, time bucket) with a residual range test; a hot key is spread over its
buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.columns import ratio
from tracewright.operators.timeline import as_list, asof, floor_div

BUCKET = "_bucket"


def _spread(df: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    """One copy of a row per time bucket it touches."""
    return df.withColumn(BUCKET, F.explode(F.sequence(floor_div(low, width), floor_div(high, width))))


def interval_hits(events: DataFrame, segs: DataFrame, key, ts: str, start: str, end: str,
                  bucket: int, margin: int = 0) -> DataFrame:
    """All (event, segment) pairs with start - margin <= ts <= end + margin."""
    key = as_list(key)
    low, high = F.col(start) - margin, F.col(end) + margin
    left = events.withColumn(BUCKET, floor_div(F.col(ts).cast("long"), bucket))
    right = _spread(segs.filter(F.col(start) <= F.col(end)), low, high, bucket)
    return (left.join(right, [*key, BUCKET])
            .filter((F.col(ts) >= low) & (F.col(ts) <= high)).drop(BUCKET))


def assign_events(events: DataFrame, segs: DataFrame, key, ts: str, event_id: str, seg_id: str,
                  start: str, end: str, bucket: int, policy: str, margin: int = 0) -> DataFrame:
    """Attach events to segments under an explicit rule for the interval ends.

    ``closed``                  every segment holding the event, both ends included (J01; with
                                ``margin`` J07)
    ``first``                   as closed, the earliest segment wins (J05)
    ``nearest_edge``            as closed, the segment whose edge is nearest wins; ``tied`` marks
                                events with two equally near segments (J04)
    ``half_open_last_closed``   start <= ts < end, the last segment of a key also holds its end;
                                for segments that do not overlap (J02)
    """
    key = as_list(key)
    if policy in ("closed", "first", "nearest_edge"):
        hits = interval_hits(events, segs, key, ts, start, end, bucket, margin)
        if policy == "closed":
            return hits
        seg_cols = [c for c in segs.columns if c not in key]
        seg = F.struct(*seg_cols)
        ev_cols = [c for c in events.columns if c not in (*key, event_id)]
        keep = [F.first(c).alias(c) for c in ev_cols]
        if policy == "first":
            best = hits.groupBy(*key, event_id).agg(
                F.min_by(seg, F.struct(start, end, seg_id)).alias("_seg"), *keep)
            return best.select(*key, event_id, *ev_cols, "_seg.*")
        edge = F.least(F.col(ts) - F.col(start), F.col(end) - F.col(ts))
        ranked = hits.withColumn("_edge", edge)
        best = ranked.groupBy(*key, event_id).agg(
            F.min_by(seg, F.struct("_edge", start, seg_id)).alias("_seg"), F.min("_edge").alias("edge_distance"),
            *keep)
        ties = (ranked.groupBy(*key, event_id, "_edge").agg(F.count(F.lit(1)).alias("_n"))
                .groupBy(*key, event_id).agg((F.min_by("_n", "_edge") > 1).alias("tied")))
        return (best.join(ties, [*key, event_id])
                .select(*key, event_id, *ev_cols, "_seg.*", "edge_distance", "tied"))
    if policy == "half_open_last_closed":
        final = segs.groupBy(*key).agg(F.max(end).alias("_final"))
        marked = segs.join(final, key).withColumn("_closed", F.col(end) == F.col("_final")).drop("_final")
        return _latest_start(events, marked, key, ts, seg_id, start, end, bucket,
                             lambda s: (F.col(ts) < s[end]) | (s["_closed"] & (F.col(ts) == s[end])))
    raise ValueError(f"unknown policy {policy!r}")


def _latest_start(events, segs, key, ts, seg_id, start, end, chunk, inside) -> DataFrame:
    seg_cols = [c for c in segs.columns if c not in key and c != "_closed"]
    extra = ["_closed"] if "_closed" in segs.columns else []
    points = segs.select(*key, F.col(start).alias(ts), F.struct(*seg_cols, *extra).alias("_seg"),
                         F.struct(F.col(end), F.col(seg_id)).alias("_tie"))
    hit = asof(events, points, key, ts, ["_seg"], chunk, prev="_hit", nxt=None, tie="_tie")
    s = F.col("_hit")["_seg"]
    return (hit.filter(F.col("_hit").isNotNull() & inside(s))
            .select(*events.columns, *[s[c].alias(c) for c in seg_cols]))


def assign_with_end_fallback(events: DataFrame, segs: DataFrame, key, ts: str, event_id: str,
                             seg_id: str, start: str, end: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Half-open assignment; an event left over goes to the last segment ending exactly at it.

    Returns the assigned events with the rule that placed them, and a one-row reconciliation
    in which assigned + unassigned + without_time = total.
    """
    key = as_list(key)
    timed = events.filter(F.col(ts).isNotNull())
    inside = _latest_start(timed, segs, key, ts, seg_id, start, end, chunk,
                           lambda s: F.col(ts) < s[end]).withColumn("policy", F.lit("HALF_OPEN"))
    rest = timed.join(inside.select(*key, event_id), [*key, event_id], "left_anti")
    seg_cols = [c for c in segs.columns if c not in key]
    ends = (segs.groupBy(*key, F.col(end).alias(ts))
            .agg(F.max_by(F.struct(*seg_cols), F.struct(start, seg_id)).alias("_seg")))
    at_end = (rest.join(ends, [*key, ts])
              .select(*events.columns, "_seg.*").withColumn("policy", F.lit("EXACT_END")))
    assigned = inside.unionByName(at_end)
    counts = events.agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col(ts).isNull()).alias("without_time"))
    placed = assigned.agg(F.count_if(F.col("policy") == "HALF_OPEN").alias("half_open"),
                          F.count_if(F.col("policy") == "EXACT_END").alias("exact_end"))
    summary = counts.crossJoin(placed).withColumn(  # two one-row tables
        "unassigned", F.col("total") - F.col("without_time") - F.col("half_open") - F.col("exact_end"))
    return assigned, summary


def window_join(anchors: DataFrame, events: DataFrame, key, ts: str, anchor_ts: str,
                before: int, after: int, bucket: int | None = None) -> DataFrame:
    """Events in the closed window [anchor - before, anchor + after] with a signed offset."""
    key = as_list(key)
    width = int(bucket or max(before + after, 1))
    left = _spread(anchors, F.col(anchor_ts) - before, F.col(anchor_ts) + after, width)
    right = events.withColumn(BUCKET, floor_div(F.col(ts).cast("long"), width))
    offset = F.col(ts) - F.col(anchor_ts)
    return (left.join(right, [*key, BUCKET]).drop(BUCKET)
            .filter(offset.between(-before, after)).withColumn("offset", offset))


def overlaps(a: DataFrame, b: DataFrame, key, a_start: str, a_end: str, b_start: str, b_end: str,
             bucket: int) -> DataFrame:
    """Pairs of intervals sharing more than a point, with overlap length and IoU.

    Both sides are copied to the buckets they touch; a pair is emitted only in the bucket
    where its overlap begins, so nothing needs de-duplication.
    """
    key = as_list(key)
    left = _spread(a.filter(F.col(a_start) < F.col(a_end)), F.col(a_start), F.col(a_end), bucket)
    right = _spread(b.filter(F.col(b_start) < F.col(b_end)), F.col(b_start), F.col(b_end), bucket)
    low = F.greatest(a_start, b_start)
    high = F.least(a_end, b_end)
    union = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return (left.join(right, [*key, BUCKET])
            .filter((low < high) & (floor_div(low, bucket) == F.col(BUCKET))).drop(BUCKET)
            .withColumn("overlap", high - low)
            .withColumn("iou", (high - low) / union.cast("double")))


def best_overlap(pred: DataFrame, truth: DataFrame, key, pred_id: str, truth_id: str,
                 pred_span: tuple[str, str], truth_span: tuple[str, str], bucket: int,
                 min_iou: float = 0.5) -> DataFrame:
    """Best-IoU truth of every prediction, kept from ``min_iou`` on."""
    key = as_list(key)
    pairs = overlaps(pred, truth, key, *pred_span, *truth_span, bucket)
    rest = [c for c in truth.columns if c not in (*key, truth_id)]
    best = pairs.filter(F.col("iou") >= min_iou).groupBy(*key, pred_id).agg(
        F.max_by(F.struct(truth_id, *rest), F.struct("iou", -F.col(truth_span[0]), -F.col(truth_id))).alias("_t"),
        F.max("iou").alias("iou"))
    return best.select(*key, pred_id, "_t.*", "iou")


def overlap_fraction(segs: DataFrame, truth: DataFrame, key, seg_id: str, seg_span: tuple[str, str],
                     truth_span: tuple[str, str], bucket: int) -> DataFrame:
    """Overlap of each segment with all truth rows, its share, and any/majority labels.

    Overlapping truth rows count more than once, as in the source rule.
    """
    key = as_list(key)
    start, end = seg_span
    sums = (overlaps(segs, truth.select(*key, *truth_span), key, start, end, *truth_span, bucket)
            .groupBy(*key, seg_id).agg(F.sum("overlap").alias("overlap")))
    out = segs.join(sums, [*key, seg_id], "left").na.fill({"overlap": 0})
    share = ratio(F.col("overlap"), F.col(end) - F.col(start))
    return (out.withColumn("overlap_share", share)
            .withColumn("any_label", (F.col("overlap") > 0).cast("int"))
            .withColumn("majority_label", (F.col("overlap_share") >= 0.5).cast("int")))


def map_intervals(a: DataFrame, b: DataFrame, key, a_id: str, b_id: str, a_span: tuple[str, str],
                  b_span: tuple[str, str], bucket: int, min_best: float = 0.9,
                  min_margin: float = 0.1) -> DataFrame:
    """Map intervals between two tables (J17): equal end points first, else the best overlap.

    ``ambiguous`` marks a best ratio below ``min_best`` that leads the second by less than
    ``min_margin``; ``reused`` marks a target chosen twice, so the map is not one-to-one.
    """
    key = as_list(key)
    (a0, a1), (b0, b1) = a_span, b_span
    same = (b.groupBy(*key, b0, b1).agg(F.min(b_id).alias(b_id), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == 1).drop("_n"))
    exact = (a.join(same, [a[k] == same[k] for k in key] + [a[a0] == same[b0], a[a1] == same[b1]])
             .select(*[a[k] for k in key], a_id, b_id)
             .withColumn("method", F.lit("EXACT_TIMESTAMP")).withColumn("ratio", F.lit(1.0))
             .withColumn("ambiguous", F.lit(False)))
    rest_a = a.join(exact, [*key, a_id], "left_anti")
    rest_b = b.join(exact, [*key, b_id], "left_anti")
    pairs = overlaps(rest_a.select(*key, a_id, a0, a1), rest_b.select(*key, b_id, b0, b1),
                     key, a0, a1, b0, b1, bucket)
    top = F.struct("iou", "overlap", F.col(b_id))
    best = pairs.groupBy(*key, a_id).agg(F.max(top).alias("_best"))
    second = (pairs.join(best, [*key, a_id]).filter(F.col(b_id) != F.col("_best")[b_id])
              .groupBy(*key, a_id).agg(F.max("iou").alias("_second")))
    near = (best.join(second, [*key, a_id], "left")
            .select(*key, a_id, F.col("_best")[b_id].alias(b_id),
                    F.lit("TIMESTAMP_OVERLAP").alias("method"), F.col("_best")["iou"].alias("ratio"),
                    F.coalesce((F.col("_best")["iou"] < min_best)
                               & (F.col("_best")["iou"] - F.col("_second") < min_margin),
                               F.lit(False)).alias("ambiguous")))
    both = exact.unionByName(near)
    uses = both.groupBy(*key, b_id).agg((F.count(F.lit(1)) > 1).alias("reused"))
    return both.join(uses, [*key, b_id]).select(*key, a_id, b_id, "method", "ratio", "ambiguous", "reused")
