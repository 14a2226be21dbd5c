"""Nearest-neighbour labels and context, all built on the as-of helper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.timeline import CHUNK, as_list, asof, floor_div
from tracewright.session import by_all_keys, staged


def _distances(ts: str) -> tuple[Column, Column]:
    return F.col(ts) - F.col("prev")[ts], F.col("next")[ts] - F.col(ts)


def nearest(left: DataFrame, right: DataFrame, key, ts: str, values: list[str], chunk: int,
            tie: str | None = None) -> DataFrame:
    """Nearest right row of every left row (earlier on a tie) as struct ``near`` and ``distance``."""
    back, ahead = _distances(ts)
    both = asof(left, right, key, ts, values, chunk, tie=tie)
    choose_prev = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    return (both.withColumn("near", F.when(choose_prev, F.col("prev")).otherwise(F.col("next")))
            .withColumn("distance", F.when(choose_prev, back).otherwise(ahead)).drop("prev", "next"))


def nearest_within(left: DataFrame, right: DataFrame, key, ts: str, values: list[str], tol: int,
                   chunk: int, tie: str | None = None) -> DataFrame:
    """Nearest right row within the tolerance, many-to-one."""
    near = nearest(left, right, key, ts, values, chunk, tie)
    ok = F.col("distance") <= tol
    return (near.withColumn("near", F.when(ok, F.col("near")))
            .withColumn("distance", F.when(ok, F.col("distance")))
            .withColumn("detected", F.coalesce(ok, F.lit(False))))


def label_nearest(cands: DataFrame, gt: DataFrame, key, ts: str, chunk: int, name: str = "label") -> DataFrame:
    """1 on the single candidate nearest to each truth point (first on a tie), else 0."""
    key = as_list(key)
    hit = (nearest(gt.select(*key, ts).distinct(), cands.select(*key, ts), key, ts, [], chunk)
           .filter(F.col("near").isNotNull())
           .select(*key, F.col("near")[ts].alias(ts)).distinct().withColumn(name, F.lit(1)))
    return cands.join(hit, [*key, ts], "left").na.fill({name: 0})


def label_within(cands: DataFrame, gt: DataFrame, key, ts: str, tol: int, chunk: int,
                 name: str = "label") -> DataFrame:
    """1 when a truth point lies within the tolerance."""
    near = nearest(cands, gt.select(*as_list(key), ts).distinct(), key, ts, [], chunk)
    return near.withColumn(name, F.coalesce(F.col("distance") <= tol, F.lit(False)).cast("int")).drop(
        "near", "distance")


def exclude_near(events: DataFrame, anchors: DataFrame, key, ts: str, w: int, chunk: int) -> DataFrame:
    """Events farther than ``w`` from every anchor and not within ``w`` of the key's edges."""
    key = as_list(key)
    edges = events.groupBy(*key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    inner = events.join(edges, key).filter(F.col(ts).between(F.col("_lo") + w, F.col("_hi") - w))
    return label_within(inner.drop("_lo", "_hi"), anchors, key, ts, w, chunk, "_near").filter(
        "_near = 0").drop("_near")


def nearest_features(items: DataFrame, marks: dict[str, DataFrame], key, ts: str, values: list[str],
                     chunk: int) -> DataFrame:
    """For every item the nearest mark of each kind and its distance.

    Items and marks of all kinds are sorted once; every kind carries its last mark before and its first
    mark after a row along, inside a chunk by windows, across chunks by a table with a row for each chunk.
    On a tie of distance the earlier mark is the nearest; of marks of one time the smallest by ``values``.
    """
    key, kinds = as_list(key), list(marks)
    rest = [c for c in items.columns if c not in key]
    payload = F.struct(F.col(ts).alias(ts), *[F.col(v) for v in values])
    points = None
    for number, table in enumerate(marks.values()):
        one = table.select(*key, F.col(ts).alias("_ts"), F.lit(number).alias("_kind"), payload.alias("_mark"))
        points = one if points is None else points.unionByName(one)
    points = points.groupBy(*key, "_ts").agg(*[F.min(F.when(F.col("_kind") == k, F.col("_mark"))).alias(f"_m{k}") for k in range(len(kinds))])
    merged = (items.select(*key, F.col(ts).alias("_ts"), F.struct(*rest).alias("_item")).unionByName(points, allowMissingColumns=True)
              .withColumn(CHUNK, floor_div(F.col("_ts").cast("long"), chunk)))
    rows = staged(merged, "marks")
    across = Window.partitionBy(*key).orderBy(CHUNK)
    before, after = across.rowsBetween(Window.unboundedPreceding, -1), across.rowsBetween(1, Window.unboundedFollowing)
    edges = rows.groupBy(*key, CHUNK).agg(*[f(f"_m{k}").alias(f"{name}{k}") for k in range(len(kinds)) for name, f in (("_lo", F.min), ("_hi", F.max))])
    edges = edges.select(*[F.col(c).alias(f"_e_{c}") for c in (*key, CHUNK)], *[F.last(f"_hi{k}", True).over(before).alias(f"_b{k}") for k in range(len(kinds))],
                         *[F.first(f"_lo{k}", True).over(after).alias(f"_a{k}") for k in range(len(kinds))])
    same = F.lit(True)
    for c in (*key, CHUNK):
        same = same & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    # frames by range: marks of an item's own time are seen on the way up and on the way down
    up, down = (Window.partitionBy(*key, CHUNK).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("_ts").asc(), F.col("_ts").desc()))
    carried = by_all_keys(rows).select("*", *[F.last(f"_m{k}", True).over(up).alias(f"_p{k}") for k in range(len(kinds))],
                                       *[F.last(f"_m{k}", True).over(down).alias(f"_n{k}") for k in range(len(kinds))])
    found = carried.filter(F.col("_item").isNotNull()).join(edges, same, "left")
    out = [*key, *[F.col("_item")[c].alias(c) for c in rest]]
    for k, name in enumerate(kinds):
        p, n = F.coalesce(f"_p{k}", f"_b{k}"), F.coalesce(f"_n{k}", f"_a{k}")
        to_p, to_n = F.col("_ts") - p[ts], n[ts] - F.col("_ts")
        use_p = to_n.isNull() | (to_p <= to_n)
        out += [F.when(use_p, p).otherwise(n).alias(f"nearest_{name}"), F.when(use_p, to_p).otherwise(to_n).alias(f"{name}_distance")]
    return found.select(*out)


def bracket(intervals: DataFrame, events: DataFrame, key, start: str, end: str, ts: str,
            values: list[str], chunk: int) -> DataFrame:
    """Last event at or before the start and first at or after the end, with deltas."""
    key = as_list(key)
    at_start = asof(intervals.withColumn(ts, F.col(start)), events, key, ts, values, chunk,
                    prev="before", nxt=None)
    both = asof(at_start.withColumn(ts, F.col(end)), events, key, ts, values, chunk, prev=None, nxt="after")
    return (both.withColumn("before_delta", F.col(start) - F.col("before")[ts])
            .withColumn("after_delta", F.col("after")[ts] - F.col(end)).drop(ts))


def near_edges(events: DataFrame, segs: DataFrame, key, ts: str, seg_id: str, start: str, end: str,
               max_dist: int, chunk: int) -> DataFrame:
    """Events strictly nearer than ``max_dist`` to a segment edge: which edge and how far."""
    key = as_list(key)
    edges = segs.select(*key, seg_id, F.explode(F.array(
        F.struct(F.lit("END").alias("edge"), F.col(end).alias(ts)),
        F.struct(F.lit("START").alias("edge"), F.col(start).alias(ts)))).alias("_e")).select(*key, seg_id, "_e.*")
    edges = edges.withColumn("_tie", F.struct("edge", seg_id))
    near = nearest(events, edges, key, ts, [seg_id, "edge"], chunk, tie="_tie")
    return near.filter(F.col("distance") < max_dist).select(
        *events.columns, F.col("near")[seg_id].alias(seg_id), F.col("near")["edge"].alias("edge"), "distance")
