"""Interval, nearest-neighbour, checked and similarity joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.catalog.base import CHUNK, CTES, DAY, HOUR, TOL, Tables, query
from tracewright.catalog.boundaries import _gt, _pred, scored_bins
from tracewright.operators import evaluation as ev
from tracewright.operators import intervals as iv
from tracewright.operators import matching as mt
from tracewright.operators import nearest as nr
from tracewright.operators import relations as rl
from tracewright.operators import similarity as sm

KEY = "session_id"
_seg = ("session_id", "us", "event_id", "segment_index", "segment_start", "segment_end")
_asg_spec = "session_id:i event_id:i us:i segment_index:i segment_start:i segment_end:i"


@query("J01_assign_closed", _asg_spec,
       "SELECT ev.*, segment_index, segment_start, segment_end FROM ev JOIN seg USING (session_id) WHERE us BETWEEN segment_start AND segment_end", "seg")
def _(t):
    return iv.assign_events(t.events, t.segments(), *_seg, DAY, "closed")


@query("J02_assign_half_open_last_closed", _asg_spec, "SELECT * FROM asg", "asg")
def _(t):
    return t.assigned()


CTES["long"] = ("seg", f"SELECT * FROM seg WHERE segment_end-segment_start>={12 * HOUR}")


def long_segments(t: Tables):
    return t.segments().filter(F.col("segment_end") - F.col("segment_start") >= 12 * HOUR)


CTES["j03"] = ("long", """SELECT ev.*, segment_index, segment_start, segment_end, 'HALF_OPEN' AS policy FROM ev JOIN long USING (session_id)
  WHERE us>=segment_start AND us<segment_end
 UNION ALL SELECT e.*, l.segment_index, l.segment_start, l.segment_end, 'EXACT_END' FROM ev e JOIN long l ON l.session_id=e.session_id AND e.us=l.segment_end
  WHERE NOT EXISTS (SELECT 1 FROM long x WHERE x.session_id=e.session_id AND e.us>=x.segment_start AND e.us<x.segment_end)""")


def _j03(t):
    return iv.assign_with_end_fallback(t.events, long_segments(t), *_seg, CHUNK)


@query("J03_assign_end_fallback", _asg_spec + " policy:s", "SELECT * FROM j03", "j03")
def _(t):
    return _j03(t)[0]


@query("J03_assign_reconciliation", "total:i without_time:i half_open:i exact_end:i unassigned:i",
       """SELECT (SELECT count(*) FROM ev) AS total, 0 AS without_time, count(*) FILTER (WHERE policy='HALF_OPEN') AS half_open,
 count(*) FILTER (WHERE policy='EXACT_END') AS exact_end, (SELECT count(*) FROM ev)-count(*) AS unassigned FROM j03""", "j03")
def _(t):
    return _j03(t)[1]


@query("J04_assign_nearest_edge", _asg_spec + " edge_distance:i tied:b",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY edge_distance, segment_start, segment_index) AS r,
  count(*) OVER (PARTITION BY event_id, edge_distance)>1 AS tied FROM (SELECT ev.*, segment_index, segment_start, segment_end,
  least(us-segment_start, segment_end-us) AS edge_distance FROM ev JOIN seg USING (session_id) WHERE us BETWEEN segment_start AND segment_end)) WHERE r=1""", "seg")
def _(t):
    return iv.assign_events(t.events, t.segments(), *_seg, DAY, "nearest_edge")


@query("J05_assign_first", _asg_spec,
       """SELECT * FROM (SELECT ev.*, segment_index, segment_start, segment_end, row_number() OVER (PARTITION BY event_id ORDER BY segment_start) AS r
  FROM ev JOIN seg USING (session_id) WHERE us BETWEEN segment_start AND segment_end) WHERE r=1""", "seg")
def _(t):
    return iv.assign_events(t.events, t.segments(), *_seg, DAY, "first")


@query("J06_window_join", "session_id:i anchor_ts:i event_id:i event_type:s offset:i",
       f"""SELECT e.session_id, a.us AS anchor_ts, e.event_id, e.event_type, e.us-a.us AS "offset" FROM ev a JOIN ev e USING (session_id)
  WHERE a.event_type='app_switch' AND e.us BETWEEN a.us-{4 * HOUR} AND a.us+{6 * HOUR}""", "ev")
def _(t):
    anchors = t.points("app_switch").select("session_id", F.col("us").alias("anchor_ts"))
    return iv.window_join(anchors, t.events, KEY, "us", "anchor_ts", 4 * HOUR, 6 * HOUR)


@query("J07_assign_with_margin", _asg_spec,
       f"""SELECT ev.*, segment_index, segment_start, segment_end FROM ev JOIN long USING (session_id)
  WHERE us BETWEEN segment_start-{2 * HOUR} AND segment_end+{2 * HOUR}""", "long")
def _(t):
    return iv.assign_events(t.events, long_segments(t), *_seg, DAY, "closed", margin=2 * HOUR)


@query("J08_nearest_within", "session_id:i gt_id:i us:i near_us:i distance:i detected:b",
       f"""SELECT session_id, gt_id, us, CASE WHEN distance<={TOL} THEN near_us END AS near_us, CASE WHEN distance<={TOL} THEN distance END AS distance,
  coalesce(distance<={TOL}, false) AS detected FROM (SELECT l.session_id, l.event_id AS gt_id, l.us, arg_min(r.predicted_ts, (abs(r.predicted_ts-l.us), r.predicted_ts)) AS near_us,
  min(abs(r.predicted_ts-l.us)) AS distance FROM (SELECT * FROM ev WHERE event_type='app_switch') l LEFT JOIN prd r USING (session_id) GROUP BY 1,2,3)""", "prd")
def _(t):
    out = nr.nearest_within(_gt(t), _pred(t).drop("pred_id"), KEY, "us", [], TOL, CHUNK)
    return out.withColumn("near_us", F.col("near.us"))


def _cand_points(t):
    return scored_bins(t).select("session_id", F.col("bin_start").alias("us"))


CTES["gtp"] = ("ev", "SELECT DISTINCT session_id, us FROM ev WHERE event_type='app_switch'")


@query("J11_label_nearest", "session_id:i us:i label:i",
       """SELECT b.session_id, b.bin_start AS us, CASE WHEN n.near IS NULL THEN 0 ELSE 1 END AS label FROM bins b LEFT JOIN (SELECT DISTINCT session_id, near FROM (
  SELECT g.session_id, g.us, arg_min(c.bin_start, (abs(c.bin_start-g.us), c.bin_start)) AS near FROM gtp g JOIN bins c USING (session_id) GROUP BY 1,2)) n
  ON n.session_id=b.session_id AND n.near=b.bin_start""", "bins gtp")
def _(t):
    return nr.label_nearest(_cand_points(t), t.points("app_switch"), KEY, "us", CHUNK)


@query("J12_label_within", "session_id:i us:i label:i",
       f"""SELECT session_id, bin_start AS us, CASE WHEN EXISTS (SELECT 1 FROM gtp g WHERE g.session_id=b.session_id AND abs(g.us-bin_start)<={4 * HOUR})
  THEN 1 ELSE 0 END AS label FROM bins b""", "bins gtp")
def _(t):
    return nr.label_within(_cand_points(t), t.points("app_switch"), KEY, "us", 4 * HOUR, CHUNK)


@query("J13_exclude_near", "session_id:i event_id:i us:i",
       f"""SELECT e.* FROM ev e JOIN sess USING (session_id) WHERE us BETWEEN session_start+{8 * HOUR} AND session_end-{8 * HOUR}
  AND NOT EXISTS (SELECT 1 FROM gtp g WHERE g.session_id=e.session_id AND abs(g.us-e.us)<={8 * HOUR})""", "sess gtp")
def _(t):
    return nr.exclude_near(t.events, t.points("app_switch"), KEY, "us", 8 * HOUR, CHUNK)


CTES["ovl"] = ("seg tru", """SELECT *, ov/(greatest(p_end,t_end)-least(p_start,t_start)) AS iou FROM (SELECT s.session_id, s.segment_index AS pred_id,
  s.segment_start AS p_start, s.segment_end AS p_end, t.segment_index AS truth_id, t.segment_start AS t_start, t.segment_end AS t_end,
  least(s.segment_end,t.segment_end)-greatest(s.segment_start,t.segment_start) AS ov FROM seg s JOIN tru t USING (session_id)) WHERE ov>0""")


def _intervals(t: Tables):
    p = t.segments().select(KEY, F.col("segment_index").alias("pred_id"), F.col("segment_start").alias("p_start"), F.col("segment_end").alias("p_end"))
    r = t.segments("window_title_change").select(KEY, F.col("segment_index").alias("truth_id"), F.col("segment_start").alias("t_start"),
                                                 F.col("segment_end").alias("t_end"))
    return p, r


def _pairs(t: Tables):
    p, r = _intervals(t)
    return iv.overlaps(p, r, KEY, "p_start", "p_end", "t_start", "t_end", DAY)


def walk_pairs_sql(thr: float) -> str:
    return f"""SELECT session_id, pred_id, truth_id, iou FROM (WITH RECURSIVE c AS (SELECT session_id, pred_id, truth_id, iou, row_number() OVER (PARTITION BY session_id
   ORDER BY iou DESC, pred_id, truth_id) AS i FROM ovl WHERE iou>={thr}),
  walk(session_id, i, up, ut, pred_id, truth_id, iou, ok) AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), false FROM c
   UNION ALL SELECT session_id, i, CASE WHEN free THEN list_append(up, pred_id) ELSE up END, CASE WHEN free THEN list_append(ut, truth_id) ELSE ut END,
    pred_id, truth_id, iou, free FROM (SELECT w.session_id, c.i, w.up, w.ut, c.pred_id, c.truth_id, c.iou,
     NOT list_contains(w.up, c.pred_id) AND NOT list_contains(w.ut, c.truth_id) AS free FROM walk w JOIN c ON c.session_id=w.session_id AND c.i=w.i+1))
  SELECT * FROM walk WHERE ok)"""


@query("J14_match_intervals", "session_id:i pred_id:i truth_id:i iou:d", walk_pairs_sql(0.2), "ovl")
def _(t):
    return mt.match_intervals(_pairs(t), KEY, "pred_id", "truth_id", threshold=0.2)


@query("J15_best_overlap", "session_id:i pred_id:i truth_id:i iou:d",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pred_id ORDER BY iou DESC, t_start, truth_id) AS r FROM ovl WHERE iou>=0.3) WHERE r=1""", "ovl")
def _(t):
    p, r = _intervals(t)
    return iv.best_overlap(p, r, KEY, "pred_id", "truth_id", ("p_start", "p_end"), ("t_start", "t_end"), DAY, 0.3)


@query("J16_overlap_fraction", "session_id:i pred_id:i overlap:i overlap_share:d any_label:i majority_label:i",
       f"""SELECT session_id, segment_index AS pred_id, coalesce(ov,0) AS overlap, coalesce(ov,0)/(segment_end-segment_start) AS overlap_share,
  CASE WHEN coalesce(ov,0)>0 THEN 1 ELSE 0 END AS any_label, CASE WHEN coalesce(ov,0)/(segment_end-segment_start)>=0.5 THEN 1 ELSE 0 END AS majority_label
 FROM seg LEFT JOIN (SELECT session_id, pred_id AS segment_index, sum(ov) AS ov FROM ovl WHERE t_end-t_start>={24 * HOUR} GROUP BY 1,2) USING (session_id, segment_index)""", "ovl")
def _(t):
    p, r = _intervals(t)
    long_truth = r.filter(F.col("t_end") - F.col("t_start") >= 24 * HOUR)
    return iv.overlap_fraction(p, long_truth, KEY, "pred_id", ("p_start", "p_end"), ("t_start", "t_end"), DAY)


CTES["ex17"] = ("seg tru", """SELECT s.session_id, s.segment_index AS a_id, t.segment_index AS b_id FROM seg s JOIN tru t ON t.session_id=s.session_id
  AND t.segment_start=s.segment_start AND t.segment_end=s.segment_end""")
CTES["ov17"] = ("ex17 ovl", """SELECT o.session_id, pred_id AS a_id, truth_id AS b_id, iou, ov, lead(iou) OVER (PARTITION BY o.session_id, pred_id ORDER BY iou DESC, ov DESC, truth_id DESC) AS second,
  row_number() OVER (PARTITION BY o.session_id, pred_id ORDER BY iou DESC, ov DESC, truth_id DESC) AS r FROM ovl o
  WHERE NOT EXISTS (SELECT 1 FROM ex17 x WHERE x.session_id=o.session_id AND x.a_id=o.pred_id) AND NOT EXISTS (SELECT 1 FROM ex17 x WHERE x.session_id=o.session_id AND x.b_id=o.truth_id)""")


@query("J17_map_intervals", "session_id:i a_id:i b_id:i method:s ratio:d ambiguous:b reused:b",
       """SELECT *, count(*) OVER (PARTITION BY session_id, b_id)>1 AS reused FROM (SELECT session_id, a_id, b_id, 'EXACT_TIMESTAMP' AS method, 1.0 AS ratio, false AS ambiguous FROM ex17
  UNION ALL SELECT session_id, a_id, b_id, 'TIMESTAMP_OVERLAP', iou, coalesce(iou<0.9 AND iou-second<0.1, false) FROM ov17 WHERE r=1)""", "ov17")
def _(t):
    p, r = _intervals(t)
    return iv.map_intervals(p.withColumnRenamed("pred_id", "a_id"), r.withColumnRenamed("truth_id", "b_id"), KEY, "a_id", "b_id",
                            ("p_start", "p_end"), ("t_start", "t_end"), DAY)


@query("J18_join_checked", "o_orderkey:i c_name:s n_name:s", """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey=c_custkey
  JOIN nation ON c_nationkey=n_nationkey""")
def _(t):
    o = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = t.read("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = t.read("nation").select("n_nationkey", "n_name")
    return rl.join_checked(rl.join_checked(o, c, "c_custkey"), n, "n_nationkey")


CTES["dif"] = ("", """SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'LEFT_ONLY' WHEN a.doc_id IS NULL THEN 'RIGHT_ONLY' ELSE 'BOTH' END AS side,
  a.q AS q_a, b.q AS q_b, a.q IS DISTINCT FROM b.q AS q_changed FROM (SELECT doc_id, CASE WHEN n_chars>=1000 THEN 1 ELSE 0 END AS q FROM documents) a
  FULL JOIN (SELECT doc_id, quality AS q FROM labels) b USING (doc_id)""")


def _diff(t):
    a = t.read("documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("q"))
    return rl.diff_tables(a, t.read("labels").select("doc_id", F.col("quality").alias("q")), "doc_id", ["q"])


@query("J19_diff_tables", "doc_id:i side:s q_a:i q_b:i q_changed:b", "SELECT * FROM dif", "dif")
def _(t):
    return _diff(t)


@query("J19_disagreement_matrix", "q_a:i q_b:i rows:i", "SELECT q_a, q_b, count(*) AS rows FROM dif GROUP BY 1,2", "dif")
def _(t):
    return rl.disagreement(_diff(t), "q")


@query("J20_left_join_fill", "c_custkey:i orders:i", """SELECT c_custkey, coalesce(n,0) AS orders FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey=c_custkey""")
def _(t):
    n = t.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return rl.left_fill(t.read("customer").select("c_custkey"), n, "c_custkey", {"orders": 0})


CTES["inv"] = ("", "SELECT regexp_extract(url, '/([0-9]+)(?:[./?#].*)?$', 1) AS name, url || '|' || CAST(page_id AS VARCHAR) AS path FROM pages")


def _page_inventory(t):
    return t.read("pages").select(F.regexp_extract("url", r"/([0-9]+)(?:[./?#].*)?$", 1).alias("name"),
                                  F.concat_ws("|", "url", F.col("page_id").cast("string")).alias("path"))


@query("J21_resolve_refs", "doc_id:i status:s match_count:i path:s match_number:i",
       """SELECT doc_id, CASE WHEN n IS NULL THEN 'MISSING' WHEN n=1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, coalesce(n,0) AS match_count, path, match_number
  FROM documents LEFT JOIN (SELECT name, path, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY path) AS match_number FROM inv)
  ON name=CAST(doc_id AS VARCHAR)""", "inv")
def _(t):
    refs = t.read("documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    return rl.resolve_refs(refs, _page_inventory(t), "name", "doc_id")


CTES["nrf"] = ("ev", """SELECT i.session_id, i.event_id, i.us, min(abs(s.us-i.us)) FILTER (WHERE s.event_type='app_switch') AS transition_distance,
  min(abs(s.us-i.us)) FILTER (WHERE s.event_type='browser_click') AS click_distance FROM (SELECT * FROM ev WHERE event_type='keystroke') i LEFT JOIN ev s
  ON s.session_id=i.session_id AND s.event_type IN ('app_switch','browser_click') GROUP BY 1,2,3""")


@query("J22_nearest_features", "session_id:i event_id:i transition_distance:i click_distance:i", "SELECT * FROM nrf", "nrf")
def _(t):
    items = t.events.filter("event_type = 'keystroke'").select("session_id", "event_id", "us")
    marks = {"transition": t.points("app_switch").drop("event_id"), "click": t.points("browser_click").drop("event_id")}
    return nr.nearest_features(items, marks, KEY, "us", [], CHUNK)


@query("J23_bracket_events", "session_id:i segment_index:i before_delta:i after_delta:i",
       """SELECT session_id, segment_index, segment_start-max(us) FILTER (WHERE us<=segment_start) AS before_delta,
  min(us) FILTER (WHERE us>=segment_end)-segment_end AS after_delta FROM seg LEFT JOIN (SELECT * FROM ev WHERE event_type='browser_click') USING (session_id)
  GROUP BY session_id, segment_index, segment_start, segment_end""", "seg")
def _(t):
    return nr.bracket(t.segments(), t.points("browser_click"), KEY, "segment_start", "segment_end", "us", ["event_id"], CHUNK)


@query("J24_near_edges", "session_id:i event_id:i segment_index:i edge:s distance:i",
       f"""SELECT * FROM (SELECT e.session_id, event_id, segment_index, edge, abs(x.at-us) AS distance, row_number() OVER (PARTITION BY event_id ORDER BY abs(x.at-us), x.at, edge, segment_index) AS r
  FROM ev e JOIN (SELECT session_id, segment_index, 'START' AS edge, segment_start AS at FROM long UNION ALL SELECT session_id, segment_index, 'END', segment_end FROM long) x
  USING (session_id)) WHERE r=1 AND distance<{HOUR}""", "long")
def _(t):
    return nr.near_edges(t.events.select("session_id", "event_id", "us"), long_segments(t), KEY, "us", "segment_index", "segment_start",
                         "segment_end", HOUR, CHUNK)


def _words(t):
    """Distinct lower-case words of whole documents."""
    return t.read("documents").select("doc_id", "lang", F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")).alias("tokens"))


CTES["wrd"] = ("", r"""SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM documents) WHERE w<>''""")
CTES["kept"] = ("wrd", """SELECT doc_id, w FROM wrd JOIN (SELECT w, count(*) AS df FROM wrd GROUP BY 1) USING (w)
  WHERE df>=2 AND df<=(SELECT floor(count(*)*0.8) FROM documents)""")
CTES["sets"] = ("kept", "SELECT doc_id, list_sort(list(w)) AS ws FROM kept GROUP BY 1")
CTES["dst"] = ("sets", "SELECT ws, min(doc_id) AS first_id, count(*) AS members, len(ws) AS n FROM sets GROUP BY ws")
CTES["jac"] = ("dst", """SELECT id_a, id_b, common, common/(na+nb-common) AS similarity FROM (SELECT a.first_id AS id_a, b.first_id AS id_b, a.n AS na, b.n AS nb, count(*) AS common
  FROM (SELECT first_id, n, unnest(ws) AS w FROM dst) a JOIN (SELECT first_id, n, unnest(ws) AS w FROM dst) b ON a.w=b.w AND a.first_id<b.first_id
   AND least(a.n,b.n)>=0.5*greatest(a.n,b.n) GROUP BY 1,2,3,4) WHERE common/(na+nb-common)>=0.5""")


def document_sets(t):
    kept = sm.df_filter(_words(t).drop("lang"), "doc_id", "tokens")
    return sm.distinct_sets(kept.filter(F.size("tokens") > 0), "doc_id", "tokens")


@query("A50_df_filter", "doc_id:i tokens:i", """SELECT doc_id, count(w) AS tokens FROM documents LEFT JOIN kept USING (doc_id) GROUP BY 1""", "kept")
def _(t):
    return sm.df_filter(_words(t).drop("lang"), "doc_id", "tokens").withColumn("tokens", F.size("tokens"))


@query("J25_jaccard_pairs", "id_a:i id_b:i common:i similarity:d", "SELECT * FROM jac", "jac")
def _(t):
    return sm.jaccard_pairs(document_sets(t)[0], "first_id", "tokens", 0.5)


@query("J25_identical_sets", "first_id:i members:i", "SELECT first_id, members FROM dst", "dst")
def _(t):
    return document_sets(t)[0]


@query("M08_similarity_clusters", "first_id:i cluster:i",
       """WITH RECURSIVE e AS (SELECT id_a AS s, id_b AS d FROM jac UNION SELECT id_b, id_a FROM jac),
  r(v, u) AS (SELECT first_id, first_id FROM dst UNION SELECT r.v, e.d FROM r JOIN e ON e.s=r.u) SELECT v AS first_id, min(u) AS cluster FROM r GROUP BY 1""", "jac")
def _(t):
    sets, _m = document_sets(t)
    pairs = sm.jaccard_pairs(sets, "first_id", "tokens", 0.5)
    return sm.cluster_by_similarity(sets, pairs, "first_id")


@query("J26_attach_semantics", "session_id:i segment_index:i record_count:i event_type_values:l value_mean:d",
       """SELECT session_id, segment_index, count(event_id) AS record_count, list_sort(list(DISTINCT event_type) FILTER (WHERE event_type IS NOT NULL)) AS event_type_values,
  avg(value) AS value_mean FROM seg LEFT JOIN (SELECT * FROM asg WHERE event_type IN ('browser_click','keystroke')) USING (session_id, segment_index) GROUP BY 1,2""", "asg")
def _(t):
    records = t.assigned().filter(F.col("event_type").isin("browser_click", "keystroke"))
    return rl.attach_semantics(t.segments(), records, ["session_id", "segment_index"], ["event_type"], ["value"])


@query("J27_resolve_first", "doc_id:i path:s method:s",
       """SELECT doc_id, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NOT NULL THEN 'derived' WHEN b.path IS NOT NULL THEN 'original' ELSE 'MISSING' END AS method
  FROM documents LEFT JOIN (SELECT name, min(path) AS path FROM inv GROUP BY 1) a ON a.name=CAST(n_chars AS VARCHAR)
  LEFT JOIN (SELECT name, min(path) AS path FROM inv GROUP BY 1) b ON b.name=CAST(doc_id AS VARCHAR)""", "inv")
def _(t):
    refs = t.read("documents").select("doc_id", F.col("n_chars").cast("string").alias("derived"), F.col("doc_id").cast("string").alias("original"))
    return rl.resolve_first(refs, _page_inventory(t), "doc_id", ["derived", "original"])


@query("A28_interval_metrics", "threshold:d predicted:i truth:i tp:i precision:d recall:d f1:d pred_gt_ratio:d mean_iou:d",
       f"""SELECT threshold, predicted, truth, tp, tp/predicted AS precision, tp/truth AS recall, coalesce(2.0*tp/(predicted+truth),0) AS f1, predicted/truth AS pred_gt_ratio, mean_iou FROM (
  SELECT threshold, (SELECT count(*) FROM seg) AS predicted, (SELECT count(*) FROM tru) AS truth, count(iou) AS tp, avg(iou) AS mean_iou FROM (SELECT unnest([0.25,0.5,0.75]) AS threshold)
  LEFT JOIN (SELECT 0.25 AS threshold, iou FROM ({walk_pairs_sql(0.25)}) UNION ALL SELECT 0.5, iou FROM ({walk_pairs_sql(0.5)}) UNION ALL SELECT 0.75, iou FROM ({walk_pairs_sql(0.75)})) USING (threshold) GROUP BY 1)""", "ovl")
def _(t):
    p, r = _intervals(t)
    return ev.interval_metrics(_pairs(t), p, r, KEY, "pred_id", "truth_id")
