"""Inventories, audits and evidence tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions.columns import first_match, ratio
from tracewright.functions.text import has_script, regex_labels, script_chars, vocab_hits
from tracewright.operators.profiles import unpivot_metrics
from tracewright.operators.timeline import as_list, exact_quantiles
from tracewright.session import cut_lineage


def inventory(events: DataFrame, dims: Sequence[str], parent: Sequence[str] = ()) -> DataFrame:
    """Counts by dimensions and their percentage of the parent group."""
    counts = events.groupBy(*dims).agg(F.count(F.lit(1)).alias("events"))
    if not parent:
        total = events.agg(F.count(F.lit(1)).alias("_t"))
        return counts.crossJoin(total).withColumn("pct", ratio(100 * F.col("events"), "_t")).drop("_t")  # one row
    total = counts.groupBy(*parent).agg(F.sum("events").alias("_t"))
    return counts.join(total, list(parent)).withColumn("pct", ratio(100 * F.col("events"), "_t")).drop("_t")


def top_values(events: DataFrame, col: str, k: int) -> DataFrame:
    """Most common values of a column."""
    return (events.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("events")).orderBy(F.col("events").desc(), "value").limit(k))


def field_coverage(events: DataFrame, fields: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Non-blank share of each field per group."""
    def filled(c):
        return (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("double")
    wide = events.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(filled(c)).alias(f"_{c}") for c in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("coverage")) for c in fields]))
    return wide.select(*by, "rows", rows.alias("_r")).select(*by, "rows", "_r.*")


def integrity(events: DataFrame, segs: DataFrame, assigned: DataFrame, key, event_id: str, seg_id: str,
              contiguity: DataFrame) -> DataFrame:
    """Integrity metrics as (metric, value) rows."""
    key = as_list(key)
    per_event = assigned.groupBy(*key, event_id).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("assigned_events"), F.count_if(F.col("_n") > 1).alias("duplicate_events"))
    totals = events.agg(F.count(F.lit(1)).alias("total_events"))
    used = assigned.select(*key, seg_id).distinct()
    seg_stats = segs.agg(F.count(F.lit(1)).alias("segments")).crossJoin(
        segs.join(used, [*key, seg_id], "left_anti").agg(F.count(F.lit(1)).alias("empty_segments")))
    e, s = events.select(*key).distinct(), segs.select(*key).distinct()
    sessions = (e.join(s, key, "left_anti").agg(F.count(F.lit(1)).alias("sessions_without_segments"))
                .crossJoin(s.join(e, key, "left_anti").agg(F.count(F.lit(1)).alias("segments_without_events"))))
    broken = contiguity.agg(F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"),
                            F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"))
    one = totals.crossJoin(per_event).crossJoin(seg_stats).crossJoin(sessions).crossJoin(broken)  # one-row tables
    return unpivot_metrics(one.withColumn("unassigned_events", F.col("total_events") - F.col("assigned_events")))


def reconcile_manifest(events: DataFrame, manifests: DataFrame, chunk: str, session: str, ts: str) -> DataFrame:
    """Compare each chunk with its manifest (A30): counts, counts by type, time range, links.

    ``manifests`` has chunk, session, previous_chunk, next_chunk, total_events, events_by_type
    (map), start_ts and end_ts.
    """
    per_type = events.groupBy(chunk, "event_type").agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    actual = per_type.groupBy(chunk).agg(
        F.sum("_n").alias("actual_events"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.array_sort(F.collect_list(F.struct("event_type", "_n"))).alias("_types"))
    known = manifests.select(F.col(chunk).alias("_link"))
    prev = known.withColumn("_prev_found", F.lit(True)).withColumnRenamed("_link", "previous_chunk")
    nxt = known.withColumn("_next_found", F.lit(True)).withColumnRenamed("_link", "next_chunk")
    m = (manifests.join(actual, chunk, "full_outer").join(prev, "previous_chunk", "left").join(nxt, "next_chunk", "left"))
    listed = F.array_sort(F.transform(F.map_entries("events_by_type"), lambda e: F.struct(
        e["key"].alias("event_type"), e["value"].alias("_n"))))
    yes, no = F.lit(True), F.lit(False)
    return m.select(
        chunk, session, F.col("total_events").isNotNull().alias("manifest_present"),
        F.coalesce(F.col("total_events") == F.coalesce("actual_events", F.lit(0)), no).alias("count_ok"),
        F.coalesce(listed == F.col("_types"), no).alias("types_ok"),
        F.coalesce((F.col("_lo") >= F.col("start_ts")) & (F.col("_hi") <= F.col("end_ts")), no).alias("range_ok"),
        (F.col("previous_chunk").isNull() | F.coalesce("_prev_found", no)).alias("previous_ok"),
        (F.col("next_chunk").isNull() | F.coalesce("_next_found", no)).alias("next_ok")
    ).withColumn("chunk_ok", F.col("manifest_present") & F.col("count_ok") & F.col("types_ok") & F.col("range_ok")
                 & F.col("previous_ok") & F.col("next_ok"))


def count_differences(events: DataFrame, manifests: DataFrame, chunk: str, maps: Mapping[str, str]) -> DataFrame:
    """(chunk, dimension, value, actual, declared) where the counts of a chunk's events differ from its manifest.

    ``maps`` names event columns and the manifest's map of counts for each; all of them are compared in one
    grouping and one join.  A value that one side lacks counts 0; null values count as ''.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in maps]))
    actual = events.select(chunk, each.alias("_d")).groupBy(chunk, "_d.dimension", "_d.value").agg(F.count(F.lit(1)).alias("actual"))
    entries = F.concat(*[F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,long>"))), _entry(c)) for c, m in maps.items()])
    declared = manifests.select(chunk, F.explode(entries).alias("_d")).groupBy(chunk, "_d.dimension", "_d.value").agg(F.sum("_d.n").alias("declared"))
    both = actual.join(declared, [chunk, "dimension", "value"], "full_outer").na.fill(0, ["actual", "declared"])
    return both.filter(F.col("actual") != F.col("declared"))


def _entry(dimension: str):
    return lambda e: F.struct(F.lit(dimension).alias("dimension"), F.coalesce(e["key"], F.lit("")).alias("value"), e["value"].cast("long").alias("n"))


def audit_chunks(events: DataFrame, manifests: DataFrame, screenshots: DataFrame, chunk: str, session: str, ts: str, maps: Mapping[str, str], max_gap: int) -> DataFrame:
    """Every chunk against its manifest, all checks (A30); one row for each chunk of either side.

    ``manifests`` has chunk, session, previous_chunk, next_chunk, total_events, the maps of counts, start_ts,
    end_ts, screenshots and has_gaps; ``screenshots`` one row for each file found, with its chunk.  Checks:
    number of events, counts by each map, events inside the declared span, screenshot files, links (the chunk
    named is of the same session and names this one back) and gaps (a step of over ``max_gap`` from the
    declared spans before in the session is declared, and nothing else is).
    """
    actual = events.groupBy(chunk).agg(F.count(F.lit(1)).alias("actual_events"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    differ = count_differences(events, manifests, chunk, maps).groupBy(chunk).agg(F.collect_set("dimension").alias("_differ"))
    files = screenshots.groupBy(chunk).agg(F.count(F.lit(1)).alias("_files"))
    earlier = Window.partitionBy(session).orderBy("start_ts", chunk).rowsBetween(Window.unboundedPreceding, -1)
    known = manifests.withColumn("gap_before", F.col("start_ts") - F.max("end_ts").over(earlier))
    named = manifests.select(F.col(session).alias("_s"), F.col(chunk).alias("_c"), F.col("previous_chunk").alias("_back"), F.col("next_chunk").alias("_on"))

    def linked(rows, link, answer, name):
        other = named.select(F.col("_s").alias(f"_s_{name}"), F.col("_c").alias(f"_c_{name}"), F.col(answer).alias(f"_a_{name}"))
        found = rows.join(other, F.col(session).eqNullSafe(F.col(f"_s_{name}")) & (F.col(link) == F.col(f"_c_{name}")), "left")
        ok = F.col(link).isNull() | F.coalesce(F.col(f"_a_{name}") == F.col(chunk), F.lit(False))
        return found.withColumn(name, ok).drop(f"_s_{name}", f"_c_{name}", f"_a_{name}")

    known = linked(linked(known, "previous_chunk", "_on", "previous_ok"), "next_chunk", "_back", "next_ok")
    rows = known.join(actual, chunk, "full_outer").join(differ, chunk, "left").join(files, chunk, "left")
    present, no = F.col("total_events").isNotNull(), F.lit(False)
    checks = {"count_ok": F.col("total_events") == F.coalesce("actual_events", F.lit(0)),
              "range_ok": F.col("_lo").isNull() | ((F.col("_lo") >= F.col("start_ts")) & (F.col("_hi") <= F.col("end_ts"))),
              "screenshots_ok": F.col("screenshots") == F.coalesce("_files", F.lit(0)), "previous_ok": F.col("previous_ok"), "next_ok": F.col("next_ok"),
              "gaps_ok": F.coalesce(F.col("gap_before") > max_gap, no) == F.col("has_gaps"),
              **{f"{c}_ok": F.col(m).isNotNull() & ~F.coalesce(F.array_contains("_differ", c), no) for c, m in maps.items()}}
    out = rows.select(chunk, session, present.alias("manifest_present"), "gap_before", *[(present & F.coalesce(c, no)).alias(n) for n, c in checks.items()])
    every = F.lit(True)
    for n in checks:
        every = every & F.col(n)
    return out.withColumn("chunk_ok", every)


def sessions_passing(chunks: DataFrame, session: str) -> DataFrame:
    """A session passes when all of its chunks do."""
    return chunks.groupBy(session).agg(F.count(F.lit(1)).alias("chunks"), F.every("chunk_ok").alias("passed"))


def audit_leakage(columns: Sequence[str]) -> list[str]:
    """Columns that would leak the truth into the features."""
    return [c for c in columns if c in vocab.LEAKAGE_EXACT or any(t in c.lower() for t in vocab.LEAKAGE_TOKENS)]


def audit_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: numeric, nulls or NaN, infinities, constant (P09), in one aggregate."""
    kinds = dict(df.dtypes)
    numeric = {c: kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
               for c in cols}
    aggs = []
    for c in cols:
        v = F.col(c).cast("double") if numeric[c] else F.lit(None).cast("double")
        aggs += [F.count_if(F.col(c).isNull() | F.coalesce(F.isnan(v), F.lit(False))).alias(f"n_{c}"),
                 F.count_if(F.abs(v) == float("inf")).alias(f"i_{c}"),
                 # a column is constant when its extremes agree; no distinct count is needed
                 F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"c_{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(numeric[c]).alias("is_numeric"), F.col(f"n_{c}").alias("nulls"),
                              F.col(f"i_{c}").alias("infinite"), F.col(f"c_{c}").alias("is_constant")) for c in cols])
    return df.agg(*aggs).select(F.explode(rows).alias("_r")).select("_r.*")


def top_list(hits: DataFrame, by: Sequence[str], col: str, k: int, name: str) -> DataFrame:
    """The k most frequent values per group as ``value:count | ...``, the smaller value first on a tie."""
    counts = hits.filter(F.coalesce(F.col(col), F.lit("")) != "").groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), col)
    best = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    packed = F.array_sort(F.collect_list(F.struct("_r", F.concat(F.col(col), F.lit(":"), F.col("_n").cast("string")).alias("v"))))
    return best.groupBy(*by).agg(F.array_join(F.transform(packed, lambda x: x["v"]), " | ").alias(name), F.count(F.lit(1)).alias(f"{name}_shown"))


def concept_candidates(obs: DataFrame, family: str, text: str, session: str, segment: str, operator: str,
                       rules: Mapping[str, Mapping[str, Sequence[str]]], route: str, lists: Mapping[str, tuple[str, int]] | None = None,
                       min_segments: int = 5, min_sessions: int = 2, min_operators: int = 2, max_routes: int = 2,
                       shown_segments: int = 15) -> DataFrame:
    """Concepts found in texts of each family.

    Below the support gate a concept is BELOW_GATE; above it, PROCESS_CANDIDATE when its three most frequent
    routes are at most ``max_routes`` different ones, else REVIEW.  ``lists`` adds top lists: name -> (column, k).
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    names = []
    for fam, concepts in rules.items():
        for concept, words in concepts.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
            names.append(F.when((F.col(family) == fam) & hit, F.lit(concept)))
    wanted = {"top_routes": (route, 3), **(lists or {})}
    columns = dict.fromkeys([session, segment, operator, *[c for c, _ in wanted.values()]])
    hits = cut_lineage(obs.select(family, *columns, F.explode(F.array_compact(F.array(*names))).alias("concept")))
    by = [family, "concept"]
    out = hits.groupBy(*by).agg(
        F.count_distinct(session, segment).alias("segments"), F.count_distinct(session).alias("sessions"),
        F.count_distinct(operator).alias("operators"))
    family_segments = obs.groupBy(family).agg(F.count_distinct(session, segment).alias("_all"))
    out = out.join(family_segments, family).withColumn("share_pct", 100.0 * F.col("segments") / F.col("_all")).drop("_all")
    for name, (col, k) in wanted.items():
        out = out.join(top_list(hits, by, col, k, name), by, "left")
    segments = hits.select(*by, segment).distinct()
    w = Window.partitionBy(*by).orderBy(segment)
    first = segments.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= shown_segments)
    out = out.join(first.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(segment)).cast("array<string>"), " | ").alias("representative_segments")), by, "left")
    enough = (F.col("segments") >= min_segments) & (F.col("sessions") >= min_sessions) & (F.col("operators") >= min_operators)
    few = F.coalesce("top_routes_shown", F.lit(0)) <= max_routes
    status = F.when(~enough, "BELOW_GATE").when(few, "PROCESS_CANDIDATE").otherwise("REVIEW")
    return out.withColumn("status", status).drop(*[f"{n}_shown" for n in wanted])


def semantic_summary(records: DataFrame, family: str, text: str, words: Sequence[str], k: int) -> DataFrame:
    """Most frequent vocabulary terms per family."""
    hits = records.select(family, F.explode(vocab_hits(text, words)).alias("term"))
    counts = hits.groupBy(family, "term").agg(F.count(F.lit(1)).alias("records"))
    w = Window.partitionBy(family).orderBy(F.col("records").desc(), "term")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def interface_inventory(events: DataFrame, by: Sequence[str], session: str, segment: str) -> DataFrame:
    """Rows, sessions and distinct segments per interface element."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(session).alias("sessions"),
                                   F.count_distinct(session, segment).alias("segments"))


def observed_metrics(profile: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Totals, means, medians and presence of count columns over segments."""
    profile = cut_lineage(profile.select(*counts))
    out = None
    for c in counts:
        one = (profile.agg(F.sum(c).cast("double").alias("total"), F.avg(c).alias("mean"), F.max(c).cast("double").alias("maximum"),
                           F.count_if(F.col(c) > 0).alias("segments_with"))
               .crossJoin(exact_quantiles(profile, [], c, {"median": 0.5})).withColumn("metric", F.lit(c)))
        out = one if out is None else out.unionByName(one)
    return out


def phase_boundary(phases: DataFrame, session: str, segment: str, phase: str, treatment: Column, total: DataFrame) -> DataFrame:
    """Coverage and treatment of each phase."""
    n = total.agg(F.count(F.lit(1)).alias("_t"))
    return (phases.groupBy(F.col(phase).alias("phase"))
            .agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(session, segment).alias("segments"),
                 F.count_distinct(session).alias("sessions"))
            .withColumn("treatment", treatment).crossJoin(n)  # one row
            .withColumn("segment_pct", ratio(100 * F.col("segments"), "_t")).drop("_t"))


def replay_summary(replay: DataFrame, cls: str, dims: Sequence[str]) -> DataFrame:
    """Counts of replay classes and the coverage of evidence dimensions in each."""
    return replay.groupBy(cls).agg(F.count(F.lit(1)).alias("segments"),
                                   *[(F.avg(F.col(d).cast("double")) * 100).alias(f"{d}_pct") for d in dims])


def explode_counts(df: DataFrame, arr: str, name: str) -> DataFrame:
    """Rows per item of an array column."""
    return df.select(F.explode(arr).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("segments"))


def glossary(terms: DataFrame, source: str, target: str) -> DataFrame:
    """Term frequency with the most common translation."""
    counts = terms.groupBy(source, target).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(source).agg(F.sum("_n").alias("frequency"),
                                      F.min_by(target, F.struct(-F.col("_n"), F.col(target))).alias(target))


def script_stats(df: DataFrame, text: str, by: Sequence[str], ranges: str = vocab.JAPANESE) -> DataFrame:
    """Characters of a script per group, and how many records hold any."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("characters"),
        F.sum(script_chars(text, ranges)).alias("script_characters"),
        F.count_if(has_script(text, ranges)).alias("records_with_script")
    ).withColumn("script_pct", ratio(100 * F.col("script_characters"), "characters"))


def enrichment_summary(df: DataFrame, session: str, flag: Column, events: str) -> DataFrame:
    """Enriched executions per session: how many, total and largest event count."""
    return df.filter(flag).groupBy(session).agg(
        F.count(F.lit(1)).alias("executions"), F.sum(events).alias("total_events"), F.max(events).alias("max_events"))


def human_gates(phases: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Distinct decision rows whose text names a human gate."""
    labels = regex_labels(text, vocab.DECISION_RULES)
    return phases.select(*keys, F.explode(labels).alias("gate")).distinct()
