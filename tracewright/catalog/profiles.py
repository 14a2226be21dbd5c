"""Segment profiles and family roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.catalog.base import APPS, CTES, HOUR, Tables, query
from tracewright.catalog.functions import actions, dom_events, signatures
from tracewright.functions import text as tx
from tracewright.operators import profiles as pf
from tracewright.operators import sequences as sq
from tracewright.operators.evaluation import quantiles
from tracewright.operators.segments import ranked_ids
from tracewright.operators.timeline import value_bucket

SEG = ["session_id", "segment_index"]


@query("A01_session_summary", "session_id:i events:i first_ts:i last_ts:i types:s chunks:i",
       """SELECT session_id, sum(n) AS events, min(lo) AS first_ts, max(hi) AS last_ts, string_agg(event_type || '=' || CAST(n AS VARCHAR), '|' ORDER BY event_type) AS types,
  (SELECT count(DISTINCT us//86400000000) FROM ev e WHERE e.session_id=x.session_id) AS chunks FROM (SELECT session_id, event_type, count(*) AS n, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1,2) x GROUP BY 1""", "ev")
def _(t):
    e = t.events.withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return pf.session_summary(e, "session_id", "us", "day").withColumn("types", F.array_join(
        F.transform(F.map_entries("events_by_type"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), "|"))


@query("A01_dataset_rollup", "sessions:i events:i multi_chunk_sessions:i first_ts:i last_ts:i",
       """SELECT count(*) AS sessions, sum(n) AS events, count(*) FILTER (WHERE d>1) AS multi_chunk_sessions, min(lo) AS first_ts, max(hi) AS last_ts FROM (
  SELECT session_id, count(*) AS n, count(DISTINCT us//86400000000) AS d, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1)""", "ev")
def _(t):
    e = t.events.withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return pf.dataset_rollup(pf.session_summary(e, "session_id", "us", "day"))


@query("A08_segment_profile", "session_id:i segment_index:i event_count:i clipboard_count:i keyboard_count:i form_count:i browser_click_count:i navigation_count:i "
       "app_switch_count:i window_change_count:i app_count:i path_count:i sequence_length:i event_types:l apps:l app_sequence:l duration_seconds:d page_class:s transfer_class:s",
       "SELECT * FROM prof", "prof")
def _(t):
    return t.profile()


@query("A09_token_sets", "session_id:i segment_index:i url_paths:l apps:l window_titles:l clipboard:b word:b notepad:b excel:b",
       r"""SELECT session_id, segment_index, coalesce(list_sort(list(DISTINCT u) FILTER (WHERE u<>'')),[]) AS url_paths, coalesce(list_sort(list(DISTINCT lower(app)) FILTER (WHERE app IS NOT NULL)),[]) AS apps,
  coalesce(list_sort(list(DISTINCT lower(window_title)) FILTER (WHERE app IS NOT NULL)),[]) AS window_titles, bool_or(event_type='clipboard_change') AS clipboard,
  bool_or(coalesce(app LIKE '%Word%',false)) AS word, bool_or(coalesce(app LIKE '%Notepad%',false)) AS notepad, bool_or(coalesce(app LIKE '%Excel%',false)) AS excel FROM (
   SELECT *, CASE WHEN url IS NULL THEN '' ELSE lower(regexp_replace(regexp_replace(regexp_replace(url,'^[a-z]+://[^/?#]*',''),'[?#].*$',''),'/[0-9]{3,}(/|$)','/{id}\1')) END AS u FROM asg) GROUP BY 1,2""", "asg")
def _(t):
    return pf.token_sets(t.assigned(), SEG)


@query("A09_form_fields", "session_id:i segment_index:i form_fields:l",
       """SELECT session_id, segment_index, coalesce(list_sort(list(DISTINCT 'field:' || chr(CAST(97+k%5 AS INTEGER)) || ':' || chr(CAST(97+k%3 AS INTEGER))) FILTER (WHERE event_type='browser_form_input')),[]) AS form_fields FROM asg GROUP BY 1,2""", "asg")
def _(t):
    k = F.col("k")
    events = t.assigned().withColumn("field", F.concat(F.char(97 + k % 5), F.lit(" = "), F.char(97 + k % 3)))
    return pf.token_sets(events, SEG, "field").select(*SEG, "form_fields")


CTES["fam"] = ("prof", """SELECT *, ln(1+segment_count)*ln(1+session_count)*(1+transfer_rate)*(1+0.15*ln(1+total_duration)) AS screening_score FROM (
  SELECT family_signature, count(*) AS segment_count, count(DISTINCT session_id) AS session_count, sum(duration_seconds) AS total_duration, avg(duration_seconds) AS mean_duration,
   min(duration_seconds) AS min_duration, max(duration_seconds) AS max_duration, quantile_cont(duration_seconds,0.5) AS median_duration, sum(event_count) AS total_events,
   avg(CASE WHEN transfer_class='CROSS_APP_DATA_TRANSFER' THEN 1.0 ELSE 0.0 END) AS transfer_rate, min(page_class) AS dominant_page, min(transfer_class) AS dominant_transfer_class FROM prof GROUP BY 1)""")


@query("A10_family_table", "family_signature:s segment_count:i session_count:i total_duration:d4 mean_duration:d median_duration:d min_duration:d max_duration:d total_events:i "
       "transfer_rate:d dominant_page:s dominant_transfer_class:s screening_score:d", "SELECT * FROM fam", "fam")
def _(t):
    return pf.family_table(t.profile())


@query("W14_ranked_ids", "family_signature:s rank:i family_id:s",
       """SELECT family_signature, r AS rank, 'PF' || lpad(CAST(r AS VARCHAR),3,'0') AS family_id FROM (SELECT family_signature, row_number() OVER (ORDER BY n DESC, family_signature) AS r
  FROM (SELECT family_signature, count(*) AS n FROM prof GROUP BY 1))""", "prof")
def _(t):
    n = t.profile().groupBy("family_signature").agg(F.count(F.lit(1)).alias("n"))
    return ranked_ids(n, [], -value_bucket(F.col("n")), [F.col("n").desc(), F.col("family_signature")], "PF", name="family_id")


CTES["trn"] = ("aps", """SELECT session_id, segment_index, f AS from_app, g AS to_app FROM (SELECT session_id, segment_index, unnest(app_sequence[1:len(app_sequence)-1]) AS f, unnest(app_sequence[2:]) AS g FROM aps
  WHERE len(app_sequence)>1) WHERE f<>'...' AND g<>'...'""")


@query("A11_transition_table", "from_app:s to_app:s occurrences:i segments:i sessions:i mean_duration:d",
       """SELECT from_app, to_app, sum(n) AS occurrences, count(*) AS segments, count(DISTINCT session_id) AS sessions, avg(duration_seconds) AS mean_duration FROM (
  SELECT from_app, to_app, session_id, segment_index, count(*) AS n FROM trn GROUP BY ALL) JOIN prof USING (session_id, segment_index) GROUP BY 1,2""", "trn prof")
def _(t):
    return pf.transition_table(t.profile(), "session_id", "segment_index")


@query("A12_quantify", "page_class:s segments:i duration:d4 mean_duration:d clipboard_pct:d form_pct:d multi_app_pct:d segment_pct:d time_pct:d",
       """SELECT page_class, count(*) AS segments, sum(duration_seconds) AS duration, avg(duration_seconds) AS mean_duration, 100.0*avg(CASE WHEN clipboard_count>0 THEN 1 ELSE 0 END) AS clipboard_pct,
  100.0*avg(CASE WHEN form_count>0 THEN 1 ELSE 0 END) AS form_pct, 100.0*avg(CASE WHEN app_count>1 THEN 1 ELSE 0 END) AS multi_app_pct, 100.0*count(*)/(SELECT count(*) FROM prof) AS segment_pct,
  100.0*sum(duration_seconds)/(SELECT sum(duration_seconds) FROM prof) AS time_pct FROM prof GROUP BY 1""", "prof")
def _(t):
    return pf.quantify(t.profile(), "page_class")


@query("A13_quantify_cases", "page_class:s event_type:s segments:i family_segments:i covered_segments:i family_pct:d covered_pct:d",
       """SELECT page_class, event_type, segments, family_segments, covered_segments, 100.0*segments/family_segments AS family_pct, 100.0*segments/covered_segments AS covered_pct FROM (
  SELECT page_class, event_type, count(DISTINCT (session_id, segment_index)) AS segments FROM asg JOIN prof USING (session_id, segment_index) WHERE event_type IN ('keystroke','clipboard_change') GROUP BY 1,2)
  JOIN (SELECT page_class, count(*) AS family_segments, count(*) FILTER (WHERE keyboard_count+clipboard_count>0) AS covered_segments FROM prof GROUP BY 1) USING (page_class)""".replace("SELECT page_class, event_type, count(DISTINCT", "SELECT page_class, asg.event_type, count(DISTINCT"), "prof asg")
def _(t):
    cases = t.assigned().filter(F.col("event_type").isin("keystroke", "clipboard_change"))
    return pf.quantify_cases(cases, t.profile(), SEG, "event_type", "page_class")


@query("A14_coverage", "lang:s source:s total_segments:i covered_segments:i records:i mean_records_covered:d mean_score_covered:d coverage_pct:d",
       """SELECT lang, source, count(*) AS total_segments, count(q) AS covered_segments, count(q) AS records, CASE WHEN count(q)>0 THEN 1 END AS mean_records_covered, avg(q) AS mean_score_covered,
  100.0*count(q)/count(*) AS coverage_pct FROM documents LEFT JOIN (SELECT doc_id, quality AS q FROM labels) USING (doc_id) GROUP BY 1,2""")
def _(t):
    return pf.coverage(t.read("documents").select("doc_id", "lang", "source"), t.read("labels"), "doc_id", ["lang", "source"], "quality")


_diag = """SELECT *, d/nullif(family_median,0) AS ratio_to_median, d-family_q95 AS above_q95, d-family_q99 AS above_q99, d>=family_q95 AS q95_flag, d>=family_q99 AS q99_flag, coalesce(d/nullif(family_median,0)>=2,false) AS twice_median_flag
 FROM (SELECT o_orderkey, o_orderpriority, o_totalprice AS d FROM orders) JOIN (SELECT o_orderpriority, count(*) AS family_count, avg(o_totalprice) AS family_mean, stddev_samp(o_totalprice) AS family_std, min(o_totalprice) AS family_min,
  max(o_totalprice) AS family_max, quantile_cont(o_totalprice,0.5) AS family_median, quantile_cont(o_totalprice,0.95) AS family_q95, quantile_cont(o_totalprice,0.99) AS family_q99 FROM orders GROUP BY 1) USING (o_orderpriority)"""


@query("A15_duration_diagnostics", "o_orderkey:i family_median:d4 family_q95:d4 family_q99:d4 ratio_to_median:d above_q95:d4 q95_flag:b q99_flag:b twice_median_flag:b", _diag)
def _(t):
    return pf.duration_diagnostics(t.read("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice")


@query("A15_overall_percentiles", "quantile:d value:d4",
       " UNION ALL ".join(f"SELECT {q} AS quantile, quantile_cont(o_totalprice,{q}) AS value FROM orders" for q in (0.5, 0.75, 0.9, 0.95, 0.99)))
def _(t):
    return quantiles(t.read("orders"), "o_totalprice", [0.5, 0.75, 0.9, 0.95, 0.99])


@query("W13_group_stats", "o_orderkey:i family_count:i family_mean:d3 family_std:d3 family_min:d family_max:d", _diag)
def _(t):
    return pf.with_group_stats(t.read("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice")


@query("A16_mode", "o_custkey:i priority:s",
       "SELECT o_custkey, o_orderpriority AS priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1,2)) WHERE r=1")
def _(t):
    return pf.mode_of(t.read("orders"), "o_custkey", "o_orderpriority", "priority")


CTES["pre"] = ("dom asg", """SELECT a.session_id, a.segment_index, d.event_type, CASE d.v WHEN 'pi-note' THEN 'pi' WHEN 'la-ok' THEN 'la' WHEN 'si-note' THEN 'si' WHEN 'PI-OK' THEN 'pi' END AS prefix
  FROM dom d JOIN asg a USING (event_id) WHERE d.event_type IN ('browser_click','browser_form_input','keystroke') AND d.v IN ('pi-note','la-ok','si-note','PI-OK')""")
CTES["vote"] = ("pre seg", """SELECT session_id, segment_index, coalesce(label,'other') AS label, CASE WHEN k IS NULL THEN 'NONE' WHEN k=1 THEN 'SINGLE_PREFIX' ELSE 'MULTI_DOMINANT_PREFIX' END AS label_resolution FROM seg LEFT JOIN (
  SELECT session_id, segment_index, arg_min(prefix, (-n, prefix)) AS label, count(*) AS k FROM (SELECT session_id, segment_index, prefix, count(*) AS n FROM pre GROUP BY 1,2,3) GROUP BY 1,2) USING (session_id, segment_index)""")


def prefix_evidence(t: Tables):
    """One row per prefix hit of an event, with the segment it fell into."""
    from tracewright import vocab
    from tracewright.catalog.base import CHUNK
    from tracewright.operators.intervals import assign_events
    hits = dom_events(t).filter(F.col("event_type").isin(*vocab.PREFIX_EVENT_TYPES)).withColumn(
        "prefix", F.try_element_at(tx.prefix_hits(F.lit("id"), "v"), F.lit(1))).filter(F.col("prefix").isNotNull())
    return assign_events(hits, t.segments(), "session_id", "us", "event_id", "segment_index", "segment_start", "segment_end", CHUNK, "half_open_last_closed")


def voted(t: Tables):
    return pf.vote_label(prefix_evidence(t), SEG, "prefix", all_keys=t.segments())


@query("A17_vote_label", "session_id:i segment_index:i label:s label_resolution:s", "SELECT * FROM vote", "vote")
def _(t):
    return voted(t)


@query("A18_evidence_summary", "prefix:s events:i segments:i sessions:i event_types:i label_agreement:d",
       """SELECT prefix, count(*) AS events, count(DISTINCT (session_id, segment_index)) AS segments, count(DISTINCT session_id) AS sessions, count(DISTINCT event_type) AS event_types,
  avg(CASE WHEN prefix=label THEN 1.0 ELSE 0.0 END) AS label_agreement FROM pre JOIN vote USING (session_id, segment_index) GROUP BY 1""", "pre vote")
def _(t):
    return pf.evidence_summary(prefix_evidence(t).join(voted(t), SEG), "prefix", "session_id", "segment_index", "label")


@query("A19_crosstab", "o_orderpriority:s F:i O:i P:i",
       """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus='F') AS "F", count(*) FILTER (WHERE o_orderstatus='O') AS "O", count(*) FILTER (WHERE o_orderstatus='P') AS "P" FROM orders GROUP BY 1""")
def _(t):
    return pf.crosstab(t.read("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


CTES["mem"] = ("prof", "SELECT unnest(apps) AS member, page_class, session_id%7 AS operator, duration_seconds FROM prof")


@query("A20_membership_summary", "member:s segments:i clusters:i operators:i median_duration:d fraction:d largest_cluster_share:d top_clusters:l",
       """SELECT member, segments, clusters, operators, median_duration, segments/(SELECT count(*) FROM prof) AS fraction, largest/segments AS largest_cluster_share, top_clusters FROM (
  SELECT member, count(*) AS segments, count(DISTINCT operator) AS operators, quantile_cont(duration_seconds,0.5) AS median_duration FROM mem GROUP BY 1) JOIN (
  SELECT member, count(*) AS clusters, max(n) AS largest, list(page_class || ':' || CAST(n AS VARCHAR) ORDER BY n DESC, page_class)[1:10] AS top_clusters FROM (SELECT member, page_class, count(*) AS n FROM mem GROUP BY 1,2) GROUP BY 1) USING (member)""", "mem")
def _(t):
    p = t.profile().withColumn("operator", F.col("session_id") % 7)
    return pf.membership_summary(p, "apps", "page_class", "operator", "duration_seconds")


@query("A21_cluster_summary", "page_class:s token:s rows:i rank:i size:i share:d",
       """SELECT page_class, token, n AS rows, r AS rank, size, n/size AS share FROM (SELECT *, row_number() OVER (PARTITION BY page_class ORDER BY n DESC, token) AS r FROM (
  SELECT page_class, token, count(*) AS n FROM (SELECT page_class, unnest(event_types) AS token FROM prof) GROUP BY 1,2)) JOIN (SELECT page_class, count(*) AS size FROM prof GROUP BY 1) USING (page_class) WHERE r<=3""", "prof")
def _(t):
    return pf.cluster_summary(t.profile(), "page_class", "event_types", 3)


@query("A35_work_decomposition", "session_id:i segment_index:i mechanical:l has_mechanical:b has_decision:b has_both:b",
       """SELECT *, len(mechanical)>0 AS has_mechanical, dec AS has_decision, len(mechanical)>0 AND dec AS has_both FROM (SELECT session_id, segment_index, window_change_count>=2 AND path_count>0 AS dec,
  [x for x in [CASE WHEN navigation_count>0 THEN 'navigation' END, CASE WHEN form_count>0 THEN 'form_entry' END, CASE WHEN clipboard_count>0 THEN 'copy_paste' END,
  CASE WHEN array_contains(apps,'Microsoft Word') THEN 'document_preparation' END, CASE WHEN array_contains(apps,'Notepad') THEN 'text_note_preparation' END,
  CASE WHEN array_contains(apps,'Microsoft Excel') THEN 'spreadsheet_handling' END, CASE WHEN browser_click_count>0 THEN 'repetitive_browser_interaction' END] if x IS NOT NULL] AS mechanical FROM prof)""", "prof")
def _(t):
    return decomposed(t)


def decomposed(t: Tables):
    note = F.when(F.col("window_change_count") >= 2, F.lit("please approve")).otherwise(F.lit("nothing"))
    return pf.work_decomposition(t.profile().withColumn("note", note), SEG, "note", F.col("path_count") > 0)


@query("A35_decomposition_by_family", "page_class:s segments:i mechanical_pct:d decision_pct:d both_pct:d",
       """SELECT page_class, count(*) AS segments, 100.0*avg(CASE WHEN m THEN 1 ELSE 0 END) AS mechanical_pct, 100.0*avg(CASE WHEN d THEN 1 ELSE 0 END) AS decision_pct, 100.0*avg(CASE WHEN m AND d THEN 1 ELSE 0 END) AS both_pct FROM (
  SELECT page_class, window_change_count>=2 AND path_count>0 AS d, navigation_count+form_count+clipboard_count+browser_click_count>0 OR len(list_intersect(apps,['Microsoft Word','Notepad','Microsoft Excel']))>0 AS m FROM prof) GROUP BY 1""", "prof")
def _(t):
    return pf.decomposition_by_family(decomposed(t), "page_class")


@query("A36_app_evidence", "session_id:i segment_index:i active_apps:l has_notepad:b has_microsoft_word:b other_apps:l",
       """SELECT session_id, segment_index, apps AS active_apps, array_contains(apps,'Notepad') AS has_notepad, array_contains(apps,'Microsoft Word') AS has_microsoft_word,
  [x for x in apps if x NOT IN ('Notepad','Microsoft Word')] AS other_apps FROM prof""", "prof")
def _(t):
    return pf.app_evidence(t.assigned(), SEG, ["Notepad", "Microsoft Word"])


@query("A37_operator_counts", "app:s operators:i", "SELECT app, count(DISTINCT operator) AS operators FROM ev GROUP BY 1", "ev")
def _(t):
    return pf.operator_counts(t.events, "app", "operator")


@query("A55_timeline_digest", "session_id:i segment_index:i events:i apps:l types:l domains:l urls:l titles:l timeline:s",
       """SELECT session_id, segment_index, events, apps, types, domains, urls, titles, timeline FROM (SELECT session_id, segment_index, count(*) AS events FROM asg GROUP BY 1,2)
  LEFT JOIN (SELECT session_id, segment_index, list(app ORDER BY m, app) AS apps FROM (SELECT session_id, segment_index, app, min(us) AS m FROM asg WHERE app IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2) USING (session_id, segment_index)
  LEFT JOIN (SELECT session_id, segment_index, list(event_type ORDER BY m, event_type) AS types FROM (SELECT session_id, segment_index, event_type, min(us) AS m FROM asg GROUP BY 1,2,3) GROUP BY 1,2) USING (session_id, segment_index)
  LEFT JOIN (SELECT session_id, segment_index, list(dm ORDER BY m, dm) AS domains FROM (SELECT session_id, segment_index, regexp_replace(regexp_extract(url,'//([^/:]*)',1),'^www\\.','') AS dm, min(us) AS m FROM asg WHERE url IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2) USING (session_id, segment_index)
  LEFT JOIN (SELECT session_id, segment_index, list(url ORDER BY m, url)[1:10] AS urls FROM (SELECT session_id, segment_index, url, min(us) AS m FROM asg WHERE url IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2) USING (session_id, segment_index)
  LEFT JOIN (SELECT session_id, segment_index, list(window_title ORDER BY m, window_title)[1:10] AS titles FROM (SELECT session_id, segment_index, window_title, min(us) AS m FROM asg WHERE window_title IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2) USING (session_id, segment_index)
  LEFT JOIN (SELECT session_id, segment_index, string_agg(event_type || coalesce(' | ' || app,''), chr(10) ORDER BY r) AS timeline FROM (SELECT *, row_number() OVER (PARTITION BY session_id, segment_index ORDER BY us, event_id) AS r
   FROM asg WHERE event_type<>'keystroke') WHERE r<=40 GROUP BY 1,2) USING (session_id, segment_index)""".replace("\\\\", "\\"), "asg")
def _(t):
    e = t.assigned().withColumn("domain", tx.url_domain("url"))
    return pf.timeline_digest(e, SEG, "us", "event_id", "domain", "url", texts={"titles": ("window_title", 10)})


@query("A53_run_summary", "metric:s value:d4",
       """SELECT unnest(['cases','pass_rate','correction_rate','mean_seconds','urgent','median_seconds']) AS metric, unnest([CAST(count(*) AS DOUBLE), avg(CASE WHEN o_orderstatus='F' THEN 1.0 ELSE 0.0 END),
  avg(CASE WHEN o_orderstatus='P' THEN 1.0 ELSE 0.0 END), avg(o_totalprice), count(*) FILTER (WHERE o_orderpriority='1-URGENT'), quantile_cont(o_totalprice,0.5)]) AS value FROM orders""")
def _(t):
    o = t.read("orders").withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
    return pf.run_summary(o, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", "o_totalprice", ["urgent"])
