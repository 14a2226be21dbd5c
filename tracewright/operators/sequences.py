"""Sequences of labels inside a key: collapsing, transitions, folding, pattern mining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions.columns import first_match
from tracewright.operators.folding import absorbed, fold_phases  # noqa: F401
from tracewright.operators.timeline import (as_list, exact_quantiles, floor_div, in_groups, rank_in_buckets,
                                            with_next, with_previous)
from tracewright.session import cut_lineage


def collapse(df: DataFrame, key, ts: str, value: str, chunk: int, tie: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose value differs from the previous row of the key."""
    seen = with_previous(df.filter(F.col(value).isNotNull() & (F.col(value) != "")), key, ts, {"_pv": value},
                         chunk, tie)
    return seen.filter(~F.col(value).eqNullSafe(F.col("_pv"))).drop("_pv")


def transitions(df: DataFrame, key, ts: str, value: str, chunk: int, tie: Sequence[str] = ()) -> DataFrame:
    """(from, to) steps between collapsed values, in time order."""
    steps = with_next(collapse(df, key, ts, value, chunk, tie), key, ts, {"to": value, "to_ts": ts}, chunk, tie)
    important = F.lit(False)
    for a, b in vocab.IMPORTANT_TRANSITIONS:
        important = important | ((F.col("from") == a) & (F.col("to") == b))
    return (steps.filter(F.col("to").isNotNull())
            .select(*as_list(key), F.col(ts), F.col(value).alias("from"), "to", "to_ts")
            .withColumn("important", important))


def ordered_distinct(df: DataFrame, key, order: str, value: str, limit: int | None = None,
                     name: str = "values") -> DataFrame:
    """Distinct values in order of first appearance.

    Repeats collapse before the shuffle; with a limit only the first ones reach the list.
    """
    key = as_list(key)
    firsts = (df.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
              .groupBy(*key, value).agg(F.min(order).alias("_o")))
    if limit is not None:
        w = Window.partitionBy(*key).orderBy("_o", value)
        firsts = firsts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    packed = F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v"))))
    return firsts.groupBy(*key).agg(F.transform(packed, lambda x: x["v"]).alias(name))


def bounded_sequence(df: DataFrame, key, ts: str, value: str, chunk: int, limit: int,
                     tie: Sequence[str] = (), name: str = "sequence") -> DataFrame:
    """Collapsed sequence cut to ``limit`` items: head, "...", tail (W08 + T09).

    Only the kept items are ever gathered, so the length of a segment does not matter.
    """
    key = as_list(key)
    seq = cut_lineage(collapse(df.select(*key, ts, value, *tie), key, ts, value, chunk, tie))
    pos = rank_in_buckets(seq, key, floor_div(F.col(ts), chunk), [F.col(c) for c in (ts, *tie)], "_i")
    total = seq.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    left, right = limit // 2, limit - limit // 2
    kept = pos.join(total, key).filter((F.col("_n") <= limit) | (F.col("_i") <= left) | (F.col("_i") > F.col("_n") - right))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("v")))), lambda x: x["v"])
    out = kept.groupBy(*key).agg(arr.alias("_a"), F.max("_n").alias("sequence_length"))
    full = F.concat(F.slice("_a", 1, left), F.array(F.lit("...")), F.slice("_a", left + 1, right))
    return out.select(*key, "sequence_length",
                      F.when(F.col("sequence_length") <= limit, F.col("_a")).otherwise(full).alias(name))


# --- phase folding -----------------------------------------------------------------------

def phase_table(folded: DataFrame, key, ts: str, order: str, chunk: int) -> DataFrame:
    """One row per phase with its size, span and position in the segment."""
    key = as_list(key)
    phases = (folded.groupBy(*key, "phase_ts", "phase_order_id")
              .agg(F.first("phase_class").alias("phase_class"), F.first("phase_app").alias("phase_app"),
                   F.first("phase_route").alias("phase_route"), F.count(F.lit(1)).alias("event_count"),
                   F.max(ts).alias("phase_end")))
    return rank_in_buckets(phases, key, floor_div(F.col("phase_ts"), chunk),
                           [F.col("phase_ts"), F.col("phase_order_id")], "phase_order")


# --- pattern mining ------------------------------------------------------------------------

def pattern_summary(segs: DataFrame, signature: str, session: str, seg_id: str, duration: str,
                    score: Column) -> DataFrame:
    """Segments grouped by signature with recurrence, scope and a representative."""
    out = segs.groupBy(signature).agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_distinct(session).alias("session_count"),
        F.sum(duration).alias("total_duration"),
        F.max_by(F.struct(F.col(session).alias("session"), F.col(seg_id).alias("segment")),
                 F.struct(score.alias("s"), -F.col(session), -F.col(seg_id))).alias("representative"))
    return (out.withColumn("recurrence", F.when(F.col("segment_count") >= 2, "RECURRING").otherwise("SINGLETON"))
            .withColumn("scope", F.when(F.col("session_count") >= 2, "CROSS_SESSION").otherwise("WITHIN_SESSION"))
            .select(signature, "segment_count", "session_count", "total_duration", "recurrence", "scope",
                    F.col("representative.session").alias("representative_session"),
                    F.col("representative.segment").alias("representative_segment")))


def phase_support(seqs: DataFrame, seg_key, session: str, phases: str) -> DataFrame:
    """Coverage, sessions, positions and class of every phase."""
    total = seqs.agg(F.count(F.lit(1)).alias("_total"))
    long = seqs.select(*as_list(seg_key), F.posexplode(phases).alias("_pos", "phase"))
    long = long.withColumn("position", F.col("_pos") + 1)
    per_segment = long.groupBy("phase", *as_list(seg_key)).agg(F.sum("position").alias("_s"), F.count(F.lit(1)).alias("_n"))
    stats = per_segment.groupBy("phase").agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_distinct(session).alias("session_count"),
        (F.sum("_s") / F.sum("_n")).alias("mean_position"))
    median = exact_quantiles(long, "phase", "position", {"median_position": 0.5})
    pct = F.round(100 * F.col("segment_count") / F.col("_total"), 2)
    raw = 100 * F.col("segment_count") / F.col("_total")
    cls = first_match([((raw >= 50) & (F.col("session_count") >= 3), "COMMON_CORE"), (raw >= 25, "FREQUENT")],
                      "OPTIONAL_VARIANT")
    return (stats.join(median, "phase").crossJoin(total)  # one row
            .withColumn("segment_coverage_pct", pct).withColumn("classification", cls).drop("_total"))


def order_evidence(seqs: DataFrame, seg_key, phases: str) -> DataFrame:
    """Which of two phases comes first, over the segments holding both.

    Phases are a small vocabulary, so the pairs are made inside each row and added up map-side.
    """
    firsts = F.array_distinct(phases)
    by_name = F.array_sort(firsts)

    def place(p: Column) -> Column:
        return F.array_position(F.col("_u"), p)

    pairs = F.flatten(F.transform("_n", lambda a: F.transform(
        F.filter("_n", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"), (place(a) < place(b)).alias("ab")))))
    counted = (seqs.select(firsts.alias("_u"), by_name.alias("_n")).select(F.explode(pairs).alias("_p"))
               .groupBy(F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))
               .agg(F.count(F.lit(1)).alias("segments_with_both"), F.count_if(F.col("_p.ab")).alias("_ab")))
    ba = F.col("segments_with_both") - F.col("_ab")
    forward = F.col("_ab") >= ba
    share = F.greatest(F.col("_ab"), ba) / F.col("segments_with_both")
    enough = F.col("segments_with_both") >= 10
    return counted.select(
        F.when(forward, F.col("a")).otherwise(F.col("b")).alias("first_phase"),
        F.when(forward, F.col("b")).otherwise(F.col("a")).alias("second_phase"), "segments_with_both",
        F.greatest(F.col("_ab"), ba).alias("first_before_second"), F.least(F.col("_ab"), ba).alias("second_before_first"),
        F.round(100 * share, 2).alias("precedence_pct"),
        first_match([(enough & (share >= 0.70), "COMMON_ORDER"), (enough & (share >= 0.55), "FREQUENT_ORDER")],
                    "MIXED_ORDER").alias("classification"))


def consensus_order(support: DataFrame, order: DataFrame) -> DataFrame:
    """Core phases by net wins over common pairwise orders."""
    core = support.filter(F.col("classification") == "COMMON_CORE")
    names = core.select("phase")
    common = order.filter(F.col("classification") == "COMMON_ORDER").select("first_phase", "second_phase")
    inside = (common.join(names.withColumnRenamed("phase", "first_phase"), "first_phase", "left_semi")
              .join(names.withColumnRenamed("phase", "second_phase"), "second_phase", "left_semi"))
    points = inside.select(F.explode(F.array(
        F.struct(F.col("first_phase").alias("phase"), F.lit(1).alias("p")),
        F.struct(F.col("second_phase").alias("phase"), F.lit(-1).alias("p")))).alias("_w"))
    score = points.groupBy(F.col("_w.phase").alias("phase")).agg(F.sum("_w.p").alias("order_score"))
    out = core.join(score, "phase", "left").na.fill({"order_score": 0})
    order_by = [F.col("order_score").desc(), F.col("median_position"), F.col("segment_coverage_pct").desc(), F.col("phase")]
    return rank_in_buckets(out, [], -F.col("order_score"), order_by, "consensus_rank").select(
        "consensus_rank", "phase", "order_score", "median_position", "segment_coverage_pct", "session_count")


def branch_decision(cases: DataFrame, case: str, skeleton: str) -> DataFrame:
    """Parameter, optional variant or branch by the share of the dominant skeleton."""
    counts = cases.groupBy(case, skeleton).agg(F.count(F.lit(1)).alias("_n"))
    out = counts.groupBy(case).agg(
        F.sum("_n").alias("segments"), F.count(F.lit(1)).alias("skeletons"),
        F.min_by(skeleton, F.struct(-F.col("_n"), F.col(skeleton))).alias("dominant_skeleton"),
        F.max("_n").alias("_top"))
    pct = F.round(100 * F.col("_top") / F.col("segments"), 2)
    return (out.withColumn("dominant_pct", pct)
            .withColumn("decision", first_match([(F.col("skeletons") == 1, "PARAMETER"),
                                                 (F.col("dominant_pct") >= 80, "PARAMETER_WITH_OPTIONAL_VARIANT")],
                                                "BRANCH_CANDIDATE")).drop("_top"))


def group_evidence(df: DataFrame, by, set_cols: Sequence[str], seg_key) -> DataFrame:
    """Distinct segments and sorted distinct values of set columns per group."""
    by = as_list(by)
    out = df.groupBy(*by).agg(F.count_distinct(F.struct(*as_list(seg_key))).alias("segments"))
    for c in set_cols:
        values = df.select(*by, F.explode(c).alias("_v")).groupBy(*by).agg(F.sort_array(F.collect_set("_v")).alias(c))
        out = out.join(values, by, "left")
    return out
