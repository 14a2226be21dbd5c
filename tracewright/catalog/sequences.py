"""Ordering, stitching, folding and sequence mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.catalog.base import APPS, CHUNK, CTES, DAY, HOUR, Tables, query
from tracewright.catalog.functions import actions, clean_sequences, signatures
from tracewright.functions import arrays as ar
from tracewright.functions import text as tx
from tracewright.operators import segments as sg
from tracewright.operators import sequences as sq
from tracewright.operators.sampling import representative_timeline
from tracewright.session import cut_lineage

SEG = ["session_id", "segment_index"]


@query("W01_event_order", "session_id:i event_id:i position:i",
       "SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN k%13=0 THEN NULL ELSE us END NULLS LAST, event_id) AS position FROM ev", "ev")
def _(t):
    # some events lose their time here, to show them ordered last
    e = t.events.withColumn("maybe_us", F.when(F.col("k") % 13 != 0, F.col("us")))
    return sg.event_order(e, "session_id", "maybe_us", "event_id", DAY)


@query("W02_running_index", "session_id:i event_id:i index:i", 'SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id)-1 AS "index" FROM ev', "ev")
def _(t):
    return sg.with_index(t.events, "session_id", "us", DAY, start=0, tie=("event_id",))


@query("W03_event_gap", "session_id:i event_id:i gap:i", "SELECT session_id, event_id, us-lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS gap FROM ev", "ev")
def _(t):
    return sg.with_gap(t.events, "session_id", "us", DAY, ("event_id",))


CTES["col"] = ("ev", "SELECT * FROM (SELECT *, lag(app) OVER (PARTITION BY session_id ORDER BY us, event_id) AS pa FROM ev WHERE app IS NOT NULL) WHERE pa IS NULL OR pa<>app")


@query("W08_collapse", "session_id:i event_id:i app:s", "SELECT * FROM col", "col")
def _(t):
    return sq.collapse(t.events, "session_id", "us", "app", DAY, ("event_id",))


@query("W09_transitions", "session_id:i us:i from:s to:s to_ts:i important:b",
       """SELECT session_id, us, app AS "from", "to", to_ts, (app='Microsoft Edge' OR "to"='Microsoft Edge') AS important FROM (SELECT *, lead(app) OVER w AS "to", lead(us) OVER w AS to_ts FROM col WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)) WHERE "to" IS NOT NULL""", "col")
def _(t):
    e = t.events.select("session_id", "us", "event_id", "app")
    return sq.transitions(e, "session_id", "us", "app", DAY, ("event_id",))


CTES["frg"] = ("", """SELECT c_custkey, o_orderkey AS fragment_id, epoch_us(o_orderdate) AS start_us, CASE WHEN o_orderkey%17=0 THEN NULL ELSE epoch_us(o_orderdate)+86400000000*(o_orderkey%40) END AS end_us, o_orderstatus AS process_code,
  CASE WHEN o_orderkey%3=0 THEN '' ELSE CAST(o_custkey%2 AS VARCHAR) END AS case_id, o_orderkey%2=0 AS cto, o_orderkey%5=0 AS cfrom FROM (SELECT *, o_custkey AS c_custkey FROM orders)""")


def fragments(t: Tables):
    """Orders of a customer as execution fragments."""
    o = t.read("orders")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("c_custkey"), key.alias("fragment_id"), start.alias("start_us"),
                    F.when(key % 17 != 0, start + F.lit(DAY) * (key % 40)).alias("end_us"), F.col("o_orderstatus").alias("process_code"),
                    F.when(key % 3 == 0, "").otherwise((F.col("o_custkey") % 2).cast("string")).alias("case_id"),
                    (key % 2 == 0).alias("continues_to_next"), (key % 5 == 0).alias("continues_from_prev"))


@query("W10_stitch_fragments", "c_custkey:i process_code:s case_id:s start_us:i end_us:i fragment_count:i fragment_ids:s complete:b",
       """SELECT c_custkey, arg_min(process_code, (start_us, fragment_id)) AS process_code, arg_min(case_id, (start_us, fragment_id)) AS case_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS fragment_count,
  string_agg(CAST(fragment_id AS VARCHAR), '|' ORDER BY start_us, fragment_id) AS fragment_ids, coalesce(max(end_us)>=min(start_us), false) AS complete FROM (
  SELECT *, sum(CASE WHEN process_code=pp AND (case_id='' OR pc='' OR case_id=pc) AND (pt OR cfrom) THEN 0 ELSE 1 END) OVER w AS grp FROM (
   SELECT *, lag(process_code) OVER w AS pp, lag(case_id) OVER w AS pc, lag(cto) OVER w AS pt FROM frg WINDOW w AS (PARTITION BY c_custkey ORDER BY start_us, fragment_id)) WINDOW w AS (PARTITION BY c_custkey ORDER BY start_us, fragment_id)) GROUP BY c_custkey, grp""", "frg")
def _(t):
    out = sg.stitch(fragments(t), "c_custkey", "start_us", "end_us", 365 * DAY)
    return out.withColumn("fragment_ids", F.array_join(F.transform("fragment_ids", lambda x: x.cast("string")), "|"))


@query("W15_boundaries_from_intervals", "c_custkey:i ts:i event:s process_code:s",
       """SELECT c_custkey, ts, event, process_code FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, ts ORDER BY event, process_code) AS r FROM (
  SELECT c_custkey, start_us AS ts, 'start' AS event, process_code FROM frg UNION ALL SELECT c_custkey, end_us, 'end', process_code FROM frg) WHERE ts IS NOT NULL) WHERE r=1""", "frg")
def _(t):
    return sg.boundaries_from_intervals(fragments(t), "c_custkey", "start_us", "end_us", ["process_code"])


@query("W12_ordered_distinct", "session_id:i apps:l",
       "SELECT session_id, list(app ORDER BY m, app) AS apps FROM (SELECT session_id, app, min(us) AS m FROM ev WHERE app IS NOT NULL GROUP BY 1,2) GROUP BY 1", "ev")
def _(t):
    return sq.ordered_distinct(t.events, "session_id", "us", "app", name="apps")


CTES["fold"] = ("act", """SELECT session_id, segment_index, us, event_id, i, st.f AS phase_class, st.o AS phase_order_id FROM (WITH RECURSIVE a AS (SELECT session_id, segment_index, us, event_id, family, CASE app WHEN 'Microsoft Edge' THEN 'Browser' WHEN 'Microsoft Word' THEN 'Word' WHEN 'Microsoft Excel' THEN 'Excel' WHEN 'Notepad' THEN 'Notepad' ELSE '' END AS app,
   CASE WHEN url LIKE '%/payroll-items%' THEN '/payroll-items' WHEN url LIKE '%/leave-applications%' THEN '/leave-applications' WHEN url LIKE '%/employee/%' THEN regexp_extract(url,'8080(/employee/[0-9]+)',1) WHEN url LIKE '%/staff/%' THEN '/staff' ELSE 'UNKNOWN_ROUTE' END AS route,
   row_number() OVER (PARTITION BY session_id, segment_index ORDER BY us, event_id) AS i FROM act),
  w(session_id, segment_index, us, event_id, i, st) AS (SELECT session_id, segment_index, us, event_id, i, {'f': family, 'a': app, 'r': route, 'o': event_id} FROM a WHERE i=1
   UNION ALL SELECT a.session_id, a.segment_index, a.us, a.event_id, a.i, CASE WHEN ((a.app='' OR w.st.a='' OR a.app=w.st.a) AND (a.family=w.st.f OR a.family IN ('DESKTOP_INPUT','CONTEXT'))) OR (a.family='TRANSFER' AND w.st.f IN ('DOCUMENT','TRANSFER','BROWSER_FORM'))
     OR (a.family IN ('BROWSER','BROWSER_FORM') AND w.st.f IN ('BROWSER','BROWSER_FORM') AND (a.app='' OR w.st.a='' OR a.app=w.st.a) AND (a.route=w.st.r OR a.route='UNKNOWN_ROUTE' OR w.st.r='UNKNOWN_ROUTE'))
    THEN w.st ELSE {'f': a.family, 'a': a.app, 'r': a.route, 'o': a.event_id} END FROM w JOIN a ON a.session_id=w.session_id AND a.segment_index=w.segment_index AND a.i=w.i+1) SELECT * FROM w)""")


def folded(t: Tables):
    from tracewright.functions.classify import norm_app
    a = actions(t).withColumn("app", F.when(F.col("app").isNotNull(), norm_app("app"))).withColumn("route", tx.route(F.regexp_replace("url", ":8080", "")))
    a = a.withColumn("route", F.when(F.col("url").isNull(), "UNKNOWN_ROUTE").otherwise(F.col("route")))
    return sq.fold_phases(a, SEG, "us", "event_id", 4 * DAY, family="family")


@query("W11_fold_phases", "session_id:i segment_index:i event_id:i phase_class:s phase_order_id:i", "SELECT * FROM fold", "fold")
def _(t):
    return folded(t)


CTES["pht"] = ("fold", """SELECT *, row_number() OVER (PARTITION BY session_id, segment_index ORDER BY phase_ts, phase_order_id) AS phase_order FROM (SELECT session_id, segment_index, phase_order_id, min(us) AS phase_ts, min(phase_class) AS phase_class, count(*) AS event_count FROM fold GROUP BY 1,2,3)""")


@query("W11_phase_table", "session_id:i segment_index:i phase_order:i phase_class:s event_count:i", "SELECT * FROM pht", "pht")
def _(t):
    return sq.phase_table(folded(t), SEG, "us", "event_id", CHUNK)


CTES["pat"] = ("sig", """SELECT *, CASE WHEN segment_count>=2 THEN 'RECURRING' ELSE 'SINGLETON' END AS recurrence, CASE WHEN session_count>=2 THEN 'CROSS_SESSION' ELSE 'WITHIN_SESSION' END AS scope FROM (
  SELECT signature, count(*) AS segment_count, count(DISTINCT session_id) AS session_count, sum(duration_seconds) AS total_duration, arg_max(session_id, (event_count, -session_id, -segment_index)) AS representative_session,
   arg_max(segment_index, (event_count, -session_id, -segment_index)) AS representative_segment FROM sig GROUP BY 1)""")


def patterns(t: Tables):
    return sq.pattern_summary(signatures(t), "signature", "session_id", "segment_index", "duration_seconds", F.col("event_count"))


@query("A38_pattern_summary", "signature:s segment_count:i session_count:i total_duration:d4 recurrence:s scope:s representative_session:i representative_segment:i", "SELECT * FROM pat", "pat")
def _(t):
    return patterns(t)


@query("T10_representative_timeline", "signature:s session_id:i segment_index:i phase_order:i phase_class:s",
       "SELECT signature, session_id, segment_index, phase_order, phase_class FROM pat JOIN pht ON session_id=representative_session AND segment_index=representative_segment WHERE recurrence='RECURRING'", "pat pht")
def _(t):
    phases = sq.phase_table(folded(t), SEG, "us", "event_id", CHUNK)
    return representative_timeline(patterns(t), phases, "session_id", "segment_index", "phase_order")


CTES["sup"] = ("phs", """SELECT *, CASE WHEN raw>=50 AND session_count>=3 THEN 'COMMON_CORE' WHEN raw>=25 THEN 'FREQUENT' ELSE 'OPTIONAL_VARIANT' END AS classification, round(raw,2) AS segment_coverage_pct FROM (
  SELECT phase, count(DISTINCT (session_id, segment_index)) AS segment_count, count(DISTINCT session_id) AS session_count, avg(pos) AS mean_position, quantile_cont(pos,0.5) AS median_position, 100.0*count(DISTINCT (session_id, segment_index))/(SELECT count(*) FROM seqs) AS raw FROM phs GROUP BY 1)""")
CTES["fst"] = ("phs", "SELECT session_id, segment_index, phase, min(pos) AS pos FROM phs GROUP BY 1,2,3")
CTES["ord"] = ("fst", """SELECT CASE WHEN ab>=ba THEN a ELSE b END AS first_phase, CASE WHEN ab>=ba THEN b ELSE a END AS second_phase, n AS segments_with_both, greatest(ab,ba) AS first_before_second, least(ab,ba) AS second_before_first, round(100.0*greatest(ab,ba)/n,2) AS precedence_pct,
  CASE WHEN n>=10 AND greatest(ab,ba)/n>=0.7 THEN 'COMMON_ORDER' WHEN n>=10 AND greatest(ab,ba)/n>=0.55 THEN 'FREQUENT_ORDER' ELSE 'MIXED_ORDER' END AS classification FROM (
  SELECT x.phase AS a, y.phase AS b, count(*) AS n, count(*) FILTER (WHERE x.pos<y.pos) AS ab, count(*) FILTER (WHERE x.pos>y.pos) AS ba FROM fst x JOIN fst y USING (session_id, segment_index) WHERE x.phase<y.phase GROUP BY 1,2)""")


@query("A39_phase_support", "phase:s segment_count:i session_count:i mean_position:d median_position:d segment_coverage_pct:d classification:s", "SELECT * FROM sup", "sup")
def _(t):
    return sq.phase_support(cut_lineage(clean_sequences(t)), SEG, "session_id", "clean")


@query("A40_order_evidence", "first_phase:s second_phase:s segments_with_both:i first_before_second:i second_before_first:i precedence_pct:d classification:s", "SELECT * FROM ord", "ord")
def _(t):
    return sq.order_evidence(clean_sequences(t), SEG, "clean")


@query("A41_consensus_order", "consensus_rank:i phase:s order_score:i median_position:d",
       """SELECT row_number() OVER (ORDER BY order_score DESC, median_position, segment_coverage_pct DESC, phase) AS consensus_rank, * FROM (SELECT s.phase, median_position, segment_coverage_pct,
  (SELECT count(*) FROM ord WHERE classification='COMMON_ORDER' AND first_phase=s.phase AND second_phase IN (SELECT phase FROM sup WHERE classification='COMMON_CORE'))
  -(SELECT count(*) FROM ord WHERE classification='COMMON_ORDER' AND second_phase=s.phase AND first_phase IN (SELECT phase FROM sup WHERE classification='COMMON_CORE')) AS order_score FROM sup s WHERE classification='COMMON_CORE')""", "sup ord")
def _(t):
    seqs = cut_lineage(clean_sequences(t))
    return sq.consensus_order(sq.phase_support(seqs, SEG, "session_id", "clean"), sq.order_evidence(seqs, SEG, "clean"))


@query("A42_group_evidence", "transfer_class:s segments:i apps:l event_types:l",
       """SELECT transfer_class, count(*) AS segments, (SELECT list_sort(list(DISTINCT x)) FROM (SELECT unnest(apps) AS x FROM prof q WHERE q.transfer_class=p.transfer_class)) AS apps,
  (SELECT list_sort(list(DISTINCT x)) FROM (SELECT unnest(event_types) AS x FROM prof q WHERE q.transfer_class=p.transfer_class)) AS event_types FROM prof p GROUP BY 1""", "prof")
def _(t):
    return sq.group_evidence(cut_lineage(t.profile()), "transfer_class", ["apps", "event_types"], SEG)


@query("A43_branch_decision", "transfer_class:s segments:i skeletons:i dominant_skeleton:s dominant_pct:d decision:s",
       """SELECT transfer_class, segments, skeletons, dominant AS dominant_skeleton, dominant_pct, CASE WHEN skeletons=1 THEN 'PARAMETER' WHEN dominant_pct>=80 THEN 'PARAMETER_WITH_OPTIONAL_VARIANT' ELSE 'BRANCH_CANDIDATE' END AS decision FROM (
  SELECT transfer_class, sum(n) AS segments, count(*) AS skeletons, arg_min(sk, (-n, sk)) AS dominant, round(100.0*max(n)/sum(n),2) AS dominant_pct FROM (
   SELECT transfer_class, array_to_string(skeleton,'>') AS sk, count(*) AS n FROM prof JOIN seqs USING (session_id, segment_index) GROUP BY 1,2) GROUP BY 1)""", "prof seqs")
def _(t):
    seqs = clean_sequences(t).withColumn("skeleton", F.array_join(ar.mechanical_skeleton("fam"), ">"))
    return sq.branch_decision(t.profile().join(seqs.select(*SEG, "skeleton"), SEG), "transfer_class", "skeleton")
