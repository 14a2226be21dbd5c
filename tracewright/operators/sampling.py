"""Ordering, top-k and reproducible sampling.

Random draws order by ``md5(seed|id)``, so they repeat on any engine and any cluster, and a
rank over a group of any size is made in hash buckets instead of one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.timeline import as_list, hash_bucket, rank_in_buckets
from tracewright.session import release, staged


def draw(id: str, seed: int) -> Column:
    """Reproducible pseudo-random text of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string")))


def order_rows(df: DataFrame, keys: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """Multi-key sort with nulls last."""
    return df.orderBy(*[F.col(k).desc_nulls_last() if k in descending else F.col(k).asc_nulls_last() for k in keys])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of an order."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, by, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group."""
    w = Window.partitionBy(*as_list(by)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def diverse_top_k(df: DataFrame, by, distinct_on: str, order: Sequence[Column], k: int, backfill: bool = False) -> DataFrame:
    """Best rows of each group, one per value of ``distinct_on``; optionally filled up with the
    next best repeats (T04)."""
    by = as_list(by)
    inner = Window.partitionBy(*by, distinct_on).orderBy(*order)
    if not backfill:
        best = df.withColumn("_d", F.row_number().over(inner)).filter(F.col("_d") == 1)
        return top_k_per(best, by, order, k).drop("_d")
    # at most k repeats of one value can ever be used
    best = df.withColumn("_d", F.row_number().over(inner)).filter(F.col("_d") <= k)
    return top_k_per(best, by, [(F.col("_d") > 1).cast("int"), *order], k).withColumn(
        "backfilled", F.col("_d") > 1).drop("_d")


def representative(df: DataFrame, by, score: Column, id: str) -> DataFrame:
    """Row with the highest score per group, the smallest id on a tie."""
    by = as_list(by)
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(score.alias("s"), -F.col(id))).alias("_r")).select(
        *by, "_r.*")


def representative_timeline(patterns: DataFrame, phases: DataFrame, session: str, segment: str, phase_order: str) -> DataFrame:
    """Phases, in order, of the representative segment of each recurring pattern."""
    chosen = patterns.filter(F.col("recurrence") == "RECURRING").select(
        "signature", F.col("representative_session").alias(session), F.col("representative_segment").alias(segment))
    return chosen.join(phases, [session, segment]).orderBy("signature", phase_order)


def matched_controls(valid: DataFrame, anchors: DataFrame, key, id: str, seed: int = 42) -> DataFrame:
    """Per key as many valid rows as there are anchors, drawn reproducibly."""
    key = as_list(key)
    want = anchors.groupBy(*key).agg(F.count(F.lit(1)).alias("_want"))
    rows = valid.join(want, key).withColumn("_h", draw(id, seed))
    ranked = rank_in_buckets(rows, key, hash_bucket(F.col("_h")), [F.col("_h")], "_r")
    return ranked.filter(F.col("_r") <= F.col("_want")).drop("_r", "_want", "_h")


def split_by_key(df: DataFrame, key: str, fracs: Sequence[tuple[str, float]] = (("train", 0.70), ("validation", 0.15), ("test", 0.15)),
                 seed: int = 42) -> DataFrame:
    """Whole keys assigned to splits in exact proportions."""
    keys = df.select(key).distinct().withColumn("_h", draw(key, seed))
    total = keys.agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_in_buckets(keys, [], hash_bucket(F.col("_h")), [F.col("_h")], "_r").crossJoin(total)  # one row
    split, upto = F.lit(fracs[-1][0]), 0.0
    cases = None
    for name, frac in fracs[:-1]:
        upto += frac
        cond = F.col("_r") <= F.round(F.col("_n") * upto)
        cases = F.when(cond, name) if cases is None else cases.when(cond, name)
    return df.join(ranked.select(key, cases.otherwise(split).alias("split")), key)


def stratified_quotas(counts: DataFrame, stratum: str, frac: float) -> DataFrame:
    """Quota of each stratum for a sample of round(frac * rows): proportional, at least one,
    then repaired to the exact total (T07).

    A surplus is taken unit by unit from the currently largest quota, a shortfall goes to the
    stratum with the most rows left.  Both are the top units of falling sequences, so they are
    ranked rather than looped over.  The number of strata is the number of labels.
    """
    total = counts.agg(F.sum("rows").alias("_all"))
    share = F.round(F.round(F.col("_all") * frac) * F.col("rows") / F.col("_all"))
    raw = counts.crossJoin(total).withColumn("target", F.round(F.col("_all") * frac).cast("long")).withColumn(  # one row
        "quota", F.greatest(share, F.lit(1)).cast("long"))
    diff = raw.agg(F.sum("quota").alias("_sum"))
    raw = raw.crossJoin(diff).withColumn("_over", F.col("_sum") - F.col("target"))  # one row
    steps = F.when(F.col("_over") != 0, F.sequence(F.lit(0).cast("long"), F.abs(F.col("_over")) - 1)).otherwise(
        F.array().cast("array<long>"))
    level = F.when(F.col("_over") > 0, F.col("quota")).otherwise(F.col("rows") - F.col("quota"))
    units = (raw.select(stratum, "_over", "quota", level.alias("_level"), F.explode(steps).alias("_j"))
             .withColumn("_value", F.col("_level") - F.col("_j"))
             .filter((F.col("_over") < 0) | (F.col("_value") > 1))
             .withColumn("_r", F.row_number().over(Window.orderBy(F.col("_value").desc(), stratum)))
             .filter(F.col("_r") <= F.abs(F.col("_over"))))
    moved = units.groupBy(stratum).agg(F.count(F.lit(1)).alias("_moved"))
    fixed = raw.join(moved, stratum, "left").na.fill({"_moved": 0}).withColumn(
        "quota", F.col("quota") - F.signum("_over").cast("long") * F.col("_moved"))
    return fixed.select(stratum, "rows", "quota")


def stratified_sample(df: DataFrame, stratum: str, id: str, frac: float, seed: int = 42, seeds: Column | None = None,
                      variant: str | None = None, session: str | None = None) -> DataFrame:
    """Stratified sample by quota (T07): seed rows first, then rows of variants (+100) and
    sessions (+50) the seeds do not cover, then a reproducible draw."""
    is_seed = F.coalesce(seeds, F.lit(False)) if seeds is not None else F.lit(False)
    rows = df.withColumn("_seed", is_seed).withColumn("_h", draw(id, seed))
    bonus = F.lit(0)
    for col, points in ((variant, 100), (session, 50)):
        if col:
            seen = rows.filter("_seed").select(stratum, col).distinct().withColumn(f"_seen_{col}", F.lit(True))
            rows = rows.join(seen, [stratum, col], "left")
            bonus = bonus + F.when(F.col(f"_seen_{col}").isNull(), points).otherwise(0)
    rows = rows.withColumn("_rank_key", F.concat(F.when(F.col("_seed"), F.lit("0")).otherwise(F.lit("1")),
                                                 F.lpad((F.lit(150) - bonus).cast("string"), 3, "0"), F.col("_h")))
    quotas = stratified_quotas(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("rows")), stratum, frac)
    ranked = rank_in_buckets(rows, stratum, F.substring("_rank_key", 1, 8), [F.col("_rank_key"), F.col(id)], "sample_rank")
    return (ranked.join(quotas.select(stratum, "quota"), stratum)
            .filter((F.col("sample_rank") <= F.col("quota")) | F.col("_seed"))
            .select(*df.columns, F.col("_seed").alias("is_seed"), "sample_rank"))


def select_spaced(cands: DataFrame, key, ts: str, item: str, app: str, score: str, near_transition: str,
                  near_event: str, k: int = 5, spacing: int = 1_000_000, per_app: int = 2) -> DataFrame:
    """Up to k items per segment in priority order with a minimum spacing.

    Near a transition first, then near an event, then at most ``per_app`` of one application,
    then the items nearest 15, 50 and 85 percent of the span.  Each round picks one item of
    every segment with an aggregate that combines map-side, so no segment is ever gathered.  What is
    chosen is written after each round: a round reads it twice, and plans of rounds on rounds would double.
    """
    key = as_list(key)
    cols = F.struct(F.col(ts).alias("ts"), F.col(item).alias("item"), F.col(app).alias("app"), F.col(score).alias("score"))
    tier = F.when(F.col(near_transition), 1).when(F.col(near_event), 2).otherwise(3)
    base = staged(cands.select(*key, ts, item, app, score, tier.alias("_tier")), "items")
    span = base.groupBy(*key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    shape = "array<struct<ts:bigint,item:bigint,app:string,score:double,pass:int>>"
    chosen = staged(span.withColumn("_sel", F.array().cast(shape)), "chosen")

    def open_rows():
        rows = base.join(chosen, key).filter(F.size("_sel") < k)
        return rows.filter(~F.exists("_sel", lambda s: F.abs(s["ts"] - F.col(ts)) < spacing))

    def add(best, pass_of):
        nonlocal chosen
        pick = F.struct(F.col("_b.c.ts").cast("long").alias("ts"), F.col("_b.c.item").cast("long").alias("item"),
                        F.col("_b.c.app").alias("app"), F.col("_b.c.score").cast("double").alias("score"),
                        pass_of.cast("int").alias("pass"))
        grown = F.when(F.col("_b").isNotNull(), F.concat("_sel", F.array(pick))).otherwise(F.col("_sel"))
        last, chosen = chosen, staged(chosen.join(best, key, "left").select(*key, "_lo", "_hi", grown.alias("_sel")), "chosen")
        release(last)

    same_app = F.size(F.filter("_sel", lambda s: s["app"].eqNullSafe(F.col(app))))
    for _ in range(k):
        rows = open_rows().filter((F.col("_tier") < 3) | (same_app < per_app))
        order = F.struct(F.col("_tier").alias("t"), (-F.col(score)).alias("s"), F.col(ts).alias("ts"),
                         F.col(item).alias("i"), cols.alias("c"))
        add(rows.groupBy(*key).agg(F.min(order).alias("_b")), F.col("_b.t"))
    for part in (0.15, 0.50, 0.85):
        target = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part
        order = F.struct(F.abs(F.col(ts) - target).alias("d"), (-F.col(score)).alias("s"), F.col(ts).alias("ts"),
                         F.col(item).alias("i"), cols.alias("c"))
        add(open_rows().groupBy(*key).agg(F.min(order).alias("_b")), F.lit(4))
    release(base)
    ordered = F.array_sort("_sel")
    return (chosen.select(*key, F.posexplode(ordered).alias("_p", "_s"))
            .select(*key, (F.col("_p") + 1).alias("selection_order"), F.col("_s.ts").alias(ts), F.col("_s.item").alias(item),
                    F.col("_s.app").alias(app), F.col("_s.score").alias(score), F.col("_s.pass").alias("selection_pass")))
