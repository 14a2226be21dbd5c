"""Segment profiles and the roll-ups built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions.arrays import pairs
from tracewright.functions.classify import (duration_bucket, family_signature, norm_app, page_class, page_of,
                                            transfer_class)
from tracewright.functions.columns import contains_any, count_class, is_class, ratio
from tracewright.functions.scores import screening_score
from tracewright.functions.text import field_token, norm_token, norm_url_path
from tracewright.operators.sequences import bounded_sequence, ordered_distinct
from tracewright.operators.timeline import as_list, exact_quantiles, value_bucket
from tracewright.operators.segments import ranked_ids
from tracewright.session import cut_lineage

SEGMENT_COUNTS = {"clipboard_count": "clipboard", "keyboard_count": "keyboard", "form_count": "browser_form",
                  "browser_click_count": "browser_click", "mouse_click_count": "mouse_click",
                  "navigation_count": "navigation", "app_switch_count": "app_switch",
                  "window_change_count": "window_change", "screenshot_count": "screenshot",
                  "shortcut_count": "shortcut", "scroll_count": "mouse_scroll"}


def session_summary(events: DataFrame, key, ts: str, chunk_id: str | None = None) -> DataFrame:
    """Events, chunks, span and counts per type of every session."""
    key = as_list(key)
    per_type = events.groupBy(*key, "event_type").agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    entry = F.struct("event_type", "_n")
    out = per_type.groupBy(*key).agg(
        F.sum("_n").alias("events"), F.min("_lo").alias("first_ts"), F.max("_hi").alias("last_ts"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("events_by_type"))
    if chunk_id:
        out = out.join(events.groupBy(*key).agg(F.count_distinct(chunk_id).alias("chunks")), key)
    return out


def dataset_rollup(sessions: DataFrame) -> DataFrame:
    """Totals over sessions, with the number that span several chunks."""
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"),
                        F.count_if(F.col("chunks") > 1).alias("multi_chunk_sessions"),
                        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def segment_profile(assigned: DataFrame, key, ts: str, event_id: str, chunk: int, start: str = "segment_start",
                    end: str = "segment_end", max_sequence: int = 8, max_paths: int = 12,
                    unit_per_second: float = 1e6) -> DataFrame:
    """Behaviour of each segment from its assigned events.

    Counts and sets come from one aggregate; the ordered parts (first paths, head and tail
    of the application sequence) are limited before they are gathered.  The assigned events
    are written once, narrowed to what is used, because several parts read them.
    """
    key = as_list(key)
    rows = cut_lineage(assigned.select(*key, ts, event_id, start, end, "event_type", "app", "path")
                       .withColumn("_page", F.when(F.col("path") != "", page_of("path"))))
    base = rows.groupBy(*key).agg(
        F.min(start).alias(start), F.min(end).alias(end), F.count(F.lit(1)).alias("event_count"),
        *[count_class("event_type", c).alias(n) for n, c in SEGMENT_COUNTS.items()],
        F.sort_array(F.collect_set("event_type")).alias("event_types"),
        F.sort_array(F.collect_set(F.nullif("app", F.lit("")))).alias("apps"),
        F.sort_array(F.collect_set("_page")).alias("page_classes"))
    paths = ordered_distinct(rows, key, ts, "path", max_paths, "browser_paths")
    n_paths = (rows.filter(F.coalesce("path", F.lit("")) != "").groupBy(*key, "path").agg(F.lit(1).alias("_x"))
               .groupBy(*key).agg(F.count("_x").alias("path_count")))
    apps = bounded_sequence(rows, key, ts, "app", chunk, max_sequence, (event_id,), "app_sequence")
    out = (base.join(paths, key, "left").join(n_paths, key, "left").join(apps, key, "left")
           .na.fill({"path_count": 0, "sequence_length": 0}))
    steps = F.filter(pairs("app_sequence"), lambda p: (p["from"] != "...") & (p["to"] != "..."))
    seconds = (F.col(end) - F.col(start)) / F.lit(float(unit_per_second))
    out = (out.withColumn("transitions", F.coalesce(steps, F.array().cast("array<struct<from:string,to:string>>")))
           .withColumn("transition_count", F.size("transitions").cast("long"))
           .withColumn("important_transitions", F.size(F.filter("transitions", _important)).cast("long"))
           .withColumn("app_count", F.size("apps").cast("long"))
           .withColumn("duration_seconds", seconds)
           .withColumn("duration_bucket", duration_bucket("duration_seconds"))
           .withColumn("page_class", page_class("page_classes"))
           .withColumn("transfer_class", transfer_class("clipboard_count", "form_count", "navigation_count",
                                                        F.col("sequence_length") >= 2)))
    return out.withColumn("family_signature", family_signature(
        "apps", "app_count", "page_class", "transfer_class", "duration_bucket"))


def _important(step: Column) -> Column:
    hit = F.lit(False)
    for a, b in vocab.IMPORTANT_TRANSITIONS:
        hit = hit | ((step["from"] == a) & (step["to"] == b))
    return hit


def token_sets(assigned: DataFrame, key, field: str | None = None) -> DataFrame:
    """Structural token sets and tool flags per interval.

    ``field`` names a column with the ``name=value`` of form input events; it adds ``form_fields``.  A set
    is one value per interval by definition: as large as the interval's distinct tokens.
    """
    key = as_list(key)
    app, title = F.lower(F.coalesce("app", F.lit(""))), F.lower(F.coalesce("window_title", F.lit("")))

    def seen(word):
        return F.max(F.contains(app, F.lit(word)) | F.contains(title, F.lit(word)))

    def tokens(c: Column) -> Column:
        return F.sort_array(F.collect_set(F.nullif(c, F.lit(""))))

    form = [tokens(F.when(is_class("event_type", "browser_form"), field_token(field))).alias("form_fields")] if field else []
    return assigned.groupBy(*key).agg(
        *form, tokens(norm_url_path("url")).alias("url_paths"), tokens(norm_token("app")).alias("apps"),
        tokens(norm_token("window_title")).alias("window_titles"),
        F.max(is_class("event_type", "clipboard")).alias("clipboard"), seen("word").alias("word"),
        seen("notepad").alias("notepad"), seen("excel").alias("excel"))


def mode_of(df: DataFrame, by, col: str, name: str | None = None, descending_tie: bool = False) -> DataFrame:
    """Most frequent value per group, the smallest on a tie."""
    by = as_list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(name or col))


def family_table(profile: DataFrame, family: str = "family_signature", session: str = "session_id") -> DataFrame:
    """Roll-up of segments per family with a screening score, rank and id (A10)."""
    profile = cut_lineage(profile.select(family, session, "duration_seconds", "event_count", "clipboard_count", "form_count",
                                         "navigation_count", "screenshot_count", "transfer_class", "page_class"))
    agg = profile.groupBy(family).agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_distinct(session).alias("session_count"),
        F.sum("duration_seconds").alias("total_duration"), F.avg("duration_seconds").alias("mean_duration"),
        F.min("duration_seconds").alias("min_duration"), F.max("duration_seconds").alias("max_duration"),
        F.sum("event_count").alias("total_events"), F.avg("clipboard_count").alias("mean_clipboard"),
        F.avg("form_count").alias("mean_forms"), F.avg("navigation_count").alias("mean_navigations"),
        F.avg((F.col("screenshot_count") > 0).cast("double")).alias("screenshot_coverage"),
        F.avg((F.col("transfer_class") == "CROSS_APP_DATA_TRANSFER").cast("double")).alias("transfer_rate"))
    out = (agg.join(exact_quantiles(profile, family, "duration_seconds", {"median_duration": 0.5}), family)
           .join(mode_of(profile, family, "page_class", "dominant_page"), family)
           .join(mode_of(profile, family, "transfer_class", "dominant_transfer_class"), family)
           .withColumn("screening_score", screening_score("segment_count", "session_count", "total_duration",
                                                          "transfer_rate")))
    return ranked_ids(out, [], -value_bucket(F.col("screening_score")),
                      [F.col("screening_score").desc(), F.col("segment_count").desc(), F.col(family)], "PF",
                      name="family_id")


def transition_table(profile: DataFrame, session: str, seg_id: str) -> DataFrame:
    """Application transitions over all segments."""
    steps = profile.select(session, seg_id, "duration_seconds", F.explode("transitions").alias("_t"))
    per_segment = steps.groupBy(F.col("_t.from").alias("from_app"), F.col("_t.to").alias("to_app"), session, seg_id).agg(
        F.count(F.lit(1)).alias("_n"), F.first("duration_seconds").alias("_d"))
    return per_segment.groupBy("from_app", "to_app").agg(
        F.sum("_n").alias("occurrences"), F.count(F.lit(1)).alias("segments"),
        F.count_distinct(session).alias("sessions"), F.avg("_d").alias("mean_duration"))


def quantify(profile: DataFrame, label: str) -> DataFrame:
    """Share of segments and time per label and activity percentages."""
    profile = cut_lineage(profile.select(label, "duration_seconds", "clipboard_count", "form_count", "app_count"))
    per = profile.groupBy(label).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("duration_seconds").alias("duration"),
        F.avg("duration_seconds").alias("mean_duration"),
        (F.avg((F.col("clipboard_count") > 0).cast("double")) * 100).alias("clipboard_pct"),
        (F.avg((F.col("form_count") > 0).cast("double")) * 100).alias("form_pct"),
        (F.avg((F.col("app_count") > 1).cast("double")) * 100).alias("multi_app_pct"))
    total = profile.agg(F.count(F.lit(1)).alias("_s"), F.sum("duration_seconds").alias("_d"))
    return (per.crossJoin(total)  # one row
            .withColumn("segment_pct", ratio(100 * F.col("segments"), "_s"))
            .withColumn("time_pct", ratio(100 * F.col("duration"), "_d")).drop("_s", "_d"))


def quantify_cases(cases: DataFrame, profile: DataFrame, seg_key, case: str, family: str) -> DataFrame:
    """Distinct segments per overlapping case type, share of the family and of its covered part."""
    seg_key = as_list(seg_key)
    profile = cut_lineage(profile.select(*seg_key, family))
    hits = cases.select(*seg_key, case).distinct().join(profile.select(*seg_key, family), seg_key)
    covered = hits.select(*seg_key, family).distinct().groupBy(family).agg(F.count(F.lit(1)).alias("covered_segments"))
    total = profile.groupBy(family).agg(F.count(F.lit(1)).alias("family_segments"))
    return (hits.groupBy(family, case).agg(F.count(F.lit(1)).alias("segments"))
            .join(total, family).join(covered, family)
            .withColumn("family_pct", ratio(100 * F.col("segments"), "family_segments"))
            .withColumn("covered_pct", ratio(100 * F.col("segments"), "covered_segments")))


def coverage(segs: DataFrame, obs: DataFrame, seg_key, dims: Sequence[str], score: str) -> DataFrame:
    """How many segments of each group have observations, means over the covered ones."""
    seg_key = as_list(seg_key)
    per = obs.groupBy(*seg_key).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_score"))
    both = segs.join(per, seg_key, "left")
    out = both.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("total_segments"), F.count("_n").alias("covered_segments"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("records"), F.avg("_n").alias("mean_records_covered"),
        F.avg("_score").alias("mean_score_covered"))
    return out.withColumn("coverage_pct", ratio(100 * F.col("covered_segments"), "total_segments"))


def duration_diagnostics(segs: DataFrame, family: str, seconds: str) -> DataFrame:
    """Rows with their family's duration statistics, ratio to the median and outlier flags."""
    out = with_group_stats(segs, family, seconds)
    d = F.col(seconds)
    return (out.withColumn("ratio_to_median", d / F.nullif("family_median", F.lit(0.0)))
            .withColumn("above_q95", d - F.col("family_q95")).withColumn("above_q99", d - F.col("family_q99"))
            .withColumn("q95_flag", d >= F.col("family_q95")).withColumn("q99_flag", d >= F.col("family_q99"))
            .withColumn("twice_median_flag", F.coalesce(F.col("ratio_to_median") >= 2.0, F.lit(False))))


def with_group_stats(df: DataFrame, by, col: str, prefix: str = "family") -> DataFrame:
    """Group statistics joined back to the rows."""
    by = as_list(by)
    stats = (df.groupBy(*by).agg(
        F.count(col).alias(f"{prefix}_count"), F.avg(col).alias(f"{prefix}_mean"),
        F.stddev_samp(col).alias(f"{prefix}_std"), F.min(col).alias(f"{prefix}_min"), F.max(col).alias(f"{prefix}_max"))
        .join(exact_quantiles(df, by, col, {f"{prefix}_median": 0.5, f"{prefix}_q95": 0.95, f"{prefix}_q99": 0.99}), by))
    return df.join(stats, by)


def vote_label(evidence: DataFrame, key, label: str, default: str = "other", all_keys: DataFrame | None = None,
               weight: str | None = None) -> DataFrame:
    """Label with the most evidence, alphabetical on a tie, and how it was reached."""
    key = as_list(key)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = evidence.filter(F.col(label).isNotNull()).groupBy(*key, label).agg(n.cast("long").alias("_n"))
    voted = counts.groupBy(*key).agg(
        F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("label"), F.count(F.lit(1)).alias("_k"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "_n")))).alias("label_evidence"))
    if all_keys is not None:
        voted = all_keys.select(*key).distinct().join(voted, key, "left")
    return voted.select(
        *key, F.coalesce("label", F.lit(default)).alias("label"),
        F.when(F.col("_k").isNull(), "NONE").when(F.col("_k") == 1, "SINGLE_PREFIX")
        .otherwise("MULTI_DOMINANT_PREFIX").alias("label_resolution"), "label_evidence")


def evidence_summary(evidence: DataFrame, label: str, session: str, seg_id: str, assigned_label: str) -> DataFrame:
    """Support of each evidence label: rows, segments, sessions, types, agreement."""
    return evidence.groupBy(label).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(session, seg_id).alias("segments"),
        F.count_distinct(session).alias("sessions"), F.count_distinct("event_type").alias("event_types"),
        F.avg((F.col(label) == F.col(assigned_label)).cast("double")).alias("label_agreement"))


def app_evidence(events: DataFrame, key, known: Sequence[str]) -> DataFrame:
    """Exact active applications per segment; the rest are other applications."""
    apps = events.select(*as_list(key), F.nullif(norm_app("app", "exact"), F.lit("")).alias("_app")).distinct()
    listed = F.array(*[F.lit(k) for k in known])
    out = apps.groupBy(*as_list(key)).agg(F.sort_array(F.collect_set("_app")).alias("active_apps"))
    for k in known:
        out = out.withColumn("has_" + k.lower().replace(" ", "_"), F.array_contains("active_apps", k))
    return out.withColumn("other_apps", F.array_except("active_apps", listed))


def operator_counts(df: DataFrame, by, operator: str) -> DataFrame:
    """Distinct operators per group."""
    return (df.select(*as_list(by), operator).distinct().groupBy(*as_list(by)).agg(F.count(operator).alias("operators")))


def work_decomposition(profile: DataFrame, seg_key, text: str, context: Column) -> DataFrame:
    """Mechanical categories, decision evidence and their combination per segment."""
    apps = F.lower(F.array_join("apps", " | "))
    mechanical = F.array_compact(F.array(
        F.when(F.col("navigation_count") > 0, F.lit("navigation")), F.when(F.col("form_count") > 0, F.lit("form_entry")),
        F.when(F.col("clipboard_count") > 0, F.lit("copy_paste")),
        F.when(contains_any(apps, ("word", ".doc")), F.lit("document_preparation")),
        F.when(contains_any(apps, ("notepad", ".txt")), F.lit("text_note_preparation")),
        F.when(contains_any(apps, ("excel", ".xls")), F.lit("spreadsheet_handling")),
        F.when(F.col("browser_click_count") > 0, F.lit("repetitive_browser_interaction"))))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    judgment = F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(name))
                                         for name, words in vocab.JUDGMENT_TERMS.items()]))
    return (profile.withColumn("mechanical", mechanical).withColumn("decision", judgment)
            .withColumn("has_mechanical", F.size("mechanical") > 0)
            .withColumn("has_decision", (F.size("decision") > 0) & context)
            .withColumn("has_both", F.col("has_mechanical") & F.col("has_decision")))


def decomposition_by_family(parts: DataFrame, family: str) -> DataFrame:
    """Share of mechanical, decision and combined segments per family."""
    def pct(c):
        return (F.avg(F.col(c).cast("double")) * 100).alias(c.replace("has_", "") + "_pct")
    return parts.groupBy(family).agg(F.count(F.lit(1)).alias("segments"), pct("has_mechanical"), pct("has_decision"),
                                     pct("has_both"))


def membership_summary(df: DataFrame, set_col: str, cluster: str, operator: str, seconds: str, k: int = 10) -> DataFrame:
    """Summary per member of a set column, with its largest clusters."""
    df = cut_lineage(df.select(set_col, cluster, operator, seconds))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    rows = df.select(F.explode(set_col).alias("member"), cluster, operator, seconds)
    per = rows.groupBy("member", cluster).agg(F.count(F.lit(1)).alias("_n"))
    top = per.withColumn("_r", F.row_number().over(Window.partitionBy("member").orderBy(F.col("_n").desc(), cluster)))
    top = top.filter(F.col("_r") <= k).groupBy("member").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(cluster).cast("string").alias("c"), "_n"))),
                    lambda x: F.concat_ws(":", x["c"], x["_n"].cast("string"))).alias("top_clusters"))
    shape = per.groupBy("member").agg(F.sum("_n").alias("segments"), F.count(F.lit(1)).alias("clusters"),
                                      F.max("_n").alias("_largest"))
    ops = operator_counts(rows, "member", operator)
    med = exact_quantiles(rows, "member", seconds, {"median_duration": 0.5})
    return (shape.join(ops, "member").join(med, "member").join(top, "member").crossJoin(total)  # one row
            .withColumn("fraction", ratio("segments", "_total"))
            .withColumn("largest_cluster_share", ratio("_largest", "segments")).drop("_total", "_largest"))


def cluster_summary(df: DataFrame, cluster: str, tokens: str, k: int) -> DataFrame:
    """Size of each cluster and its k most common tokens with their share."""
    size = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    counts = (df.select(cluster, F.explode(F.array_distinct(tokens)).alias("token"))
              .groupBy(cluster, "token").agg(F.count(F.lit(1)).alias("rows")))
    w = Window.partitionBy(cluster).orderBy(F.col("rows").desc(), "token")
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(size, cluster)
            .withColumn("share", ratio("rows", "size")))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts of a by b, absent combinations zero."""
    grouped = df.groupBy(a)
    return (grouped.pivot(b, list(values)) if values else grouped.pivot(b)).count().na.fill(0)


def timeline_digest(events: DataFrame, key, ts: str, event_id: str, domain: str, url: str,
                    max_urls: int = 10, max_lines: int = 40, priority: Sequence[str] = vocab.HIGH_INFORMATION_EVENTS,
                    texts: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Ordered digest of a segment: apps, types, domains, first urls, priority lines.

    ``texts`` names further columns of distinct values in order of appearance, each by its source and limit.
    """
    key = as_list(key)
    w = Window.partitionBy(*key).orderBy(ts, event_id)
    lines = (events.filter(F.col("event_type").isin(*priority)).withColumn("_r", F.row_number().over(w))
             .filter(F.col("_r") <= max_lines)
             .groupBy(*key).agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(" | ", "event_type", "app").alias("l")))),
                 lambda x: x["l"]), "\n").alias("timeline")))
    out = events.groupBy(*key).agg(F.count(F.lit(1)).alias("events"))
    for value, limit, name in (("app", None, "apps"), ("event_type", None, "types"), (domain, None, "domains"),
                               (url, max_urls, "urls"), *((col, n, name) for name, (col, n) in (texts or {}).items())):
        out = out.join(ordered_distinct(events, key, ts, value, limit, name), key, "left")
    return out.join(lines, key, "left")


def run_summary(results: DataFrame, passed: Column, corrected: Column, seconds: str, violations: Sequence[str]) -> DataFrame:
    """Pass and correction rates, times and violation counts of a run as metric rows."""
    agg = results.agg(
        F.count(F.lit(1)).cast("double").alias("cases"), F.avg(passed.cast("double")).alias("pass_rate"),
        F.avg(corrected.cast("double")).alias("correction_rate"), F.avg(seconds).alias("mean_seconds"),
        *[F.count_if(F.col(v)).cast("double").alias(v) for v in violations])
    agg = agg.crossJoin(exact_quantiles(results, [], seconds, {"median_seconds": 0.5}))  # one row each
    return unpivot_metrics(agg)


def unpivot_metrics(one_row: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                              for c in one_row.columns])).alias("_m")).select("_m.*")
