"""Ordered computations inside a key that stay balanced when one key is huge.

A window partitioned by the key alone sorts a whole key in one task.  The helpers
here partition by (key, time chunk) instead and pass what must cross a chunk edge
through a table with one row per (key, chunk).  That table is bounded by the time
span divided by the chunk width, never by the number of events.

Times are integers (any unit); ``chunk`` is a width in the same unit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import by_all_keys

CHUNK = "_chunk"


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def floor_div(value: Column | str, width: int) -> Column:
    """Exact integer floor division, also below zero."""
    c = F.col(value) if isinstance(value, str) else value
    w = F.lit(int(width)).cast("long")
    return ((c - F.pmod(c, w)) / w).cast("long")


def add_chunk(df: DataFrame, ts: str, chunk: int) -> DataFrame:
    return by_all_keys(df).withColumn(CHUNK, floor_div(F.col(ts).cast("long"), chunk))


def in_groups(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole groups in one partition each, rows sorted by group and order.

    The shuffle is on a hash of the group, not on the group columns: a shuffle on the columns
    could be dropped because a join below already has them, and an adaptive change of that join
    would then tear groups apart, since what follows states no requirement of its own.
    """
    return df.repartition(F.xxhash64(*group)).sortWithinPartitions(*group, *order)


def _local(key: list[str], order: Sequence[Column]):
    return Window.partitionBy(*key, CHUNK).orderBy(*order)


def _across(key: list[str], descending: bool = False):
    c = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
    return Window.partitionBy(*key).orderBy(c)


def _edge(extreme, extreme_by, packed: Column, ts: str, values: dict[str, str], order) -> Column:
    """Values of the outermost row of a chunk; for times alone a plain extreme is enough and
    aggregates by hash, without sorting the rows first."""
    if set(values.values()) == {ts}:
        return F.struct(*[extreme(F.col(ts)).alias(new) for new in values])
    return extreme_by(packed, F.struct(*order))


def with_previous(df: DataFrame, key, ts: str, values: dict[str, str], chunk: int,
                  tie: Sequence[str] = ()) -> DataFrame:
    """Add, for each ``new: source`` pair, the source value of the previous row of the key."""
    key = as_list(key)
    order = [F.col(c) for c in (ts, *tie)]
    packed = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    rows = add_chunk(df, ts, chunk)
    edges = (rows.groupBy(*key, CHUNK)
             .agg(_edge(F.max, F.max_by, packed, ts, values, order).alias("_last"))
             .withColumn("_carry", F.lag("_last").over(_across(key)))
             .select(*key, CHUNK, "_carry"))
    out = (rows.withColumn("_prev", F.lag(packed).over(_local(key, order)))
           .join(edges, [*key, CHUNK], "left")
           .withColumn("_prev", F.coalesce("_prev", "_carry")))
    return out.select(*df.columns, *[F.col("_prev")[new].alias(new) for new in values])


def with_next(df: DataFrame, key, ts: str, values: dict[str, str], chunk: int,
              tie: Sequence[str] = ()) -> DataFrame:
    """Mirror image of :func:`with_previous`."""
    key = as_list(key)
    order = [F.col(c) for c in (ts, *tie)]
    packed = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    rows = add_chunk(df, ts, chunk)
    edges = (rows.groupBy(*key, CHUNK)
             .agg(_edge(F.min, F.min_by, packed, ts, values, order).alias("_first"))
             .withColumn("_carry", F.lead("_first").over(_across(key)))
             .select(*key, CHUNK, "_carry"))
    out = (rows.withColumn("_next", F.lead(packed).over(_local(key, order)))
           .join(edges, [*key, CHUNK], "left")
           .withColumn("_next", F.coalesce("_next", "_carry")))
    return out.select(*df.columns, *[F.col("_next")[new].alias(new) for new in values])


def asof(left: DataFrame, right: DataFrame, key, ts: str, values: Sequence[str], chunk: int,
         prev: str | None = "prev", nxt: str | None = "next", tie: str | None = None) -> DataFrame:
    """Attach to every left row the nearest right row at or before it and at or after it.

    ``right`` is first reduced to one row per (key, ts), the smallest ``tie`` winning.
    The attached structs hold ``ts`` and ``values`` of the right row; null when there is none.
    """
    key = as_list(key)
    payload = F.struct(F.col(ts).alias(ts), *[F.col(v) for v in values])
    pick = F.col(tie) if tie else F.struct(*[F.col(v) for v in values]) if values else F.col(ts)
    points = (right.groupBy(*key, ts).agg(F.min_by(payload, pick).alias("_right"))
              .select(*key, F.col(ts).alias("_ts"), "_right"))
    rest = [c for c in left.columns if c not in key]
    merged = (by_all_keys(left).select(*key, F.col(ts).alias("_ts"), F.struct(*rest).alias("_left"))
              .unionByName(points, allowMissingColumns=True)
              .withColumn(CHUNK, floor_div(F.col("_ts").cast("long"), chunk)))
    is_left = F.col("_left").isNotNull().cast("int")
    # the many left rows only tell which chunks exist, a hash aggregate over two columns;
    # picking rows is left to the right side, which is smaller
    edges = (merged.filter(F.col("_right").isNotNull()).groupBy(*key, CHUNK)
             .agg(F.max_by("_right", "_ts").alias("_hi"), F.min_by("_right", "_ts").alias("_lo")))
    marks = merged.select(*key, CHUNK).distinct().join(edges, [*key, CHUNK], "left")
    back = _across(key).rowsBetween(Window.unboundedPreceding, -1)
    fore = _across(key).rowsBetween(1, Window.unboundedFollowing)
    marks = marks.select(*key, CHUNK,
                         F.last("_hi", ignorenulls=True).over(back).alias("_from_before"),
                         F.first("_lo", ignorenulls=True).over(fore).alias("_from_after"))
    rows = merged.join(marks, [*key, CHUNK], "left")
    up = _local(key, [F.col("_ts"), is_left]).rowsBetween(Window.unboundedPreceding, 0)
    down = _local(key, [F.col("_ts").desc(), is_left]).rowsBetween(Window.unboundedPreceding, 0)
    if prev:
        rows = rows.withColumn("_p", F.coalesce(F.last("_right", ignorenulls=True).over(up), "_from_before"))
    if nxt:
        rows = rows.withColumn("_n", F.coalesce(F.last("_right", ignorenulls=True).over(down), "_from_after"))
    rows = rows.filter(F.col("_left").isNotNull())
    cols = [*key, *[F.col("_left")[c].alias(c) for c in rest]]
    if prev:
        cols.append(F.col("_p").alias(prev))
    if nxt:
        cols.append(F.col("_n").alias(nxt))
    return rows.select(*cols)


def islands(df: DataFrame, key, ts: str, gap: int | str, chunk: int, closed: bool = True,
            name: str = "island", tie: Sequence[str] = ()) -> DataFrame:
    """Label chains of rows; a chain breaks where the step exceeds ``gap``.

    The label is the time of the first row of the chain.  ``closed=False`` breaks
    at a step equal to ``gap`` too.  ``gap`` may name a key column holding the limit.
    """
    key = as_list(key)
    order = [F.col(c) for c in (ts, *tie)]
    t = F.col(ts).cast("long")

    limit = F.col(gap) if isinstance(gap, str) else F.lit(gap)

    def breaks(step: Column) -> Column:
        return step > limit if closed else step >= limit

    w = _local(key, order)
    rows = (add_chunk(df, ts, chunk)
            .withColumn("_lag", F.lag(t).over(w))
            .withColumn("_start", F.when(breaks(t - F.col("_lag")), t))
            .withColumn("_run", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    c = _across(key)
    heads = (rows.groupBy(*key, CHUNK)
             .agg(F.min(t).alias("_first"), F.max(t).alias("_last"), F.max("_start").alias("_inner"))
             .withColumn("_before", F.lag("_last").over(c))
             .withColumn("_head", F.when(F.col("_before").isNull()
                                         | breaks(F.col("_first") - F.col("_before")), F.col("_first")))
             .withColumn("_tail", F.coalesce("_inner", "_head"))
             .withColumn("_carried", F.last("_tail", ignorenulls=True)
                         .over(c.rowsBetween(Window.unboundedPreceding, -1)))
             .select(*key, CHUNK, F.coalesce("_head", "_carried").alias("_base")))
    out = rows.join(heads, [*key, CHUNK], "left")
    return out.select(*df.columns, F.coalesce("_run", "_base").alias(name))


def rank_in_buckets(df: DataFrame, by, bucket: Column, order: Sequence[Column],
                    name: str = "rank") -> DataFrame:
    """1-based position of each row of a group without sorting the group in one task.

    ``bucket`` must not decrease along ``order``; rows are numbered inside a bucket and
    shifted by the counts of the buckets before it.
    """
    by = as_list(by)
    rows = by_all_keys(df).withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return (rows.withColumn("_local", local)
            .join(offsets, [*by, "_bucket"])
            .select(*df.columns, (F.col("_local") + F.col("_offset")).cast("long").alias(name)))


def hash_bucket(col: Column) -> Column:
    """First four hex digits of an md5 text: 65,536 even buckets that keep its order."""
    return F.substring(col, 1, 4)


#: Steps of a value bucket per doubling: enough to spread scores in [0, 1) or times within one doubling.
STEPS = 1 << 14


def value_bucket(col: Column) -> Column:
    """Monotone bucket of a number: ``STEPS`` per doubling on both sides of zero, zero by itself."""
    c = col.cast("double")
    size = F.floor(F.log2(F.least(F.abs(c), F.lit(1.7e308))) * STEPS) + F.lit(1100 * STEPS)  # above 0 down to the smallest double
    return F.when(c == 0, F.lit(0)).otherwise(F.signum(c) * size).cast("long")


#: Buckets that a group's values are dealt in by ``exact_quantiles``: SPREAD times SPREAD.
SPREAD = 16


def data_bucket(rows: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """Add a bucket that does not decrease with ``col``, of about equal size within each group.

    Edges are approximate percentiles of the group's own values, one row per group; wherever the values
    lie, they spread.  A value finds its bucket in two steps of ``SPREAD`` comparisons.
    """
    n = SPREAD * SPREAD
    edges = F.percentile_approx(col, [i / n for i in range(n)], 20 * n).alias("_edges")
    if by:
        placed = rows.join(rows.groupBy(*by).agg(edges).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_edges"),
                           _same(by, [f"_by{i}" for i in range(len(by))])).drop(*[f"_by{i}" for i in range(len(by))])
    else:
        placed = rows.crossJoin(rows.agg(edges))  # one row
    coarse = F.greatest(F.size(F.filter(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.col("_edges")[i * SPREAD] <= F.col(col))), F.lit(1)) - 1
    fine = F.size(F.filter(F.slice("_edges", F.col("_coarse") * SPREAD + 1, F.lit(SPREAD)), lambda e: e <= F.col(col)))
    return placed.withColumn("_coarse", coarse).withColumn(name, (F.col("_coarse") * SPREAD + fine).cast("long")).drop("_edges", "_coarse")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def exact_quantiles(df: DataFrame, by, col: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, without gathering a group anywhere.

    Values are counted first, so repeats collapse map-side; positions come from bucket
    counts, and only the values covering a wanted position reach the final aggregate.
    """
    by = as_list(by)
    counted = by_all_keys(df).filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = data_bucket(counted, by, "_v", "_bucket")
    per_bucket = counted.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_m"))
    g = Window.partitionBy(*by)
    shifted = per_bucket.select(
        *by, "_bucket", F.sum("_m").over(g).alias("_total"),
        F.coalesce(F.sum("_m").over(g.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_skip"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (counted.withColumn("_upto", F.sum("_n").over(inside))
              .join(shifted, [*by, "_bucket"])
              .withColumn("_hi", F.col("_skip") + F.col("_upto") - 1)
              .withColumn("_lo", F.col("_hi") - F.col("_n") + 1))
    aggs, keep = [], F.lit(False)
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("_total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        at_low = (F.col("_lo") <= low) & (low <= F.col("_hi"))
        at_high = (F.col("_lo") <= high) & (high <= F.col("_hi"))
        keep = keep | at_low | at_high
        below, above = F.max(F.when(at_low, F.col("_v"))), F.max(F.when(at_high, F.col("_v")))
        aggs.append((below + (above - below) * F.max(pos - low)).alias(name))
    return placed.filter(keep).groupBy(*by).agg(*aggs)
