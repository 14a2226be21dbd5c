"""Bins, candidate windows, merging, cutting, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.catalog.base import CHUNK, CTES, DAY, GAP, HOUR, STEP, TOL, WINDOW, Tables, count_sql, query
from tracewright.functions.columns import is_class, prf
from tracewright.functions.scores import change_score, weighted_score
from tracewright.operators import evaluation as ev
from tracewright.operators import features as ft
from tracewright.operators import matching as mt
from tracewright.operators import segments as sg
from tracewright.plans.boundaries import heuristic_boundaries

_BIN_COUNTS = {"app_switches": "app_switch", "navigation": "browser_navigation", "browser_clicks": "browser_click",
               "mouse_clicks": "mouse_click", "window_changes": "window_title_change", "keyboard": "keystroke"}
_bins = ", ".join(f"{count_sql(v)} AS {k}" for k, v in _BIN_COUNTS.items())
CTES["bins"] = ("sess", f"""SELECT session_id, (us-session_start)//{STEP} AS bin_number,
  min(session_start)+((us-session_start)//{STEP})*{STEP} AS bin_start, count(*) AS event_count, {_bins},
  count(DISTINCT app) AS unique_apps, count(DISTINCT window_title) AS unique_windows
 FROM ev JOIN sess USING (session_id) GROUP BY session_id, (us-session_start)//{STEP}""")
CTES["scored"] = ("bins", "SELECT *, app_switches*1.0+navigation*1.0+browser_clicks*0.5+mouse_clicks*0.5+window_changes*0.25 AS score FROM bins")
CTES["pos"] = ("scored", "SELECT session_id, bin_start AS us, score FROM scored WHERE score>=2.0")


def merged_sql(src: str, gap: int) -> str:
    return f"""SELECT session_id, arg_max(us, (score, -us)) AS predicted_ts, max(score) AS score, count(*) AS cluster_size
 FROM (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY us) AS island FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session_id ORDER BY us) <= {gap} THEN 0 ELSE 1 END AS brk FROM {src}))
 GROUP BY session_id, island"""


CTES["prd"] = ("pos", merged_sql("pos", GAP))


def scored_bins(t: Tables):
    return ft.time_bins(t.events, "session_id", "us", STEP).withColumn("score", weighted_score())


def predictions(t: Tables):
    return heuristic_boundaries(t.events, "session_id", "us", STEP, 2.0, GAP, CHUNK)


@query("A02_time_bins", "session_id:i bin_number:i bin_start:i event_count:i app_switches:i navigation:i browser_clicks:i "
       "window_changes:i keyboard:i unique_apps:i unique_windows:i", "SELECT * FROM bins", "bins")
def _(t):
    return ft.time_bins(t.events, "session_id", "us", STEP)


@query("F19_weighted_score", "session_id:i bin_number:i score:d", "SELECT * FROM scored", "scored")
def _(t):
    return scored_bins(t)


@query("W04_merge_points", "session_id:i predicted_ts:i score:d cluster_size:i", "SELECT * FROM prd", "prd")
def _(t):
    return predictions(t)


@query("W06_segments_from_boundaries", "session_id:i segment_index:i segment_start:i segment_end:i", "SELECT * FROM seg", "seg")
def _(t):
    return t.segments()


_names = list(ft.MODEL_COUNTS)


def _side(side: str, cond: str, extra: str = "") -> str:
    kinds = {"app_switches": "app_switch", "navigation": "browser_navigation", "browser_clicks": "browser_click",
             "mouse_clicks": "mouse_click", "window_changes": "window_title_change,window_state_change",
             "keyboard": "keystroke,text_input_complete"}
    parts = [f"count(*) FILTER (WHERE {cond}) AS {side}_event_count"]
    for n, ks in kinds.items():
        inside = ",".join(f"'{x}'" for x in ks.split(","))
        parts.append(f"count(*) FILTER (WHERE {cond} AND event_type IN ({inside})) AS {side}_{n}")
    parts.append(f"count(DISTINCT app) FILTER (WHERE {cond}) AS {side}_unique_apps")
    return ", ".join(parts) + extra


CTES["cand"] = ("sess", f"""SELECT g.session_id, g.slot, g.c AS candidate_ts, min(g.session_start) AS session_start,
  min(g.session_end) AS session_end, {_side('before', 'us>=c-%d AND us<c' % WINDOW)}, {_side('after', 'us>=c AND us<c+%d' % WINDOW)},
  count(DISTINCT url) FILTER (WHERE us>=c-{WINDOW} AND us<c) AS before_unique_urls,
  count(DISTINCT url) FILTER (WHERE us>=c AND us<c+{WINDOW}) AS after_unique_urls
 FROM (SELECT *, session_start+slot*{STEP} AS c FROM (SELECT *, unnest(range(0, (session_end-session_start)//{STEP}+1)) AS slot FROM sess)) g
 LEFT JOIN ev ON ev.session_id=g.session_id AND us>=c-{WINDOW} AND us<c+{WINDOW} GROUP BY 1,2,3""")
_feature_spec = " ".join(f"{c}:i" for c in vocab.FEATURE_COLUMNS)


def candidates(t: Tables):
    return ft.candidate_features(t.events, "session_id", "us", STEP, WINDOW)


@query("A03_candidate_features", f"session_id:i slot:i candidate_ts:i {_feature_spec}", "SELECT * FROM cand", "cand")
def _(t):
    return candidates(t)


@query("A04_candidate_features_full_context", "session_id:i slot:i before_event_count:i after_event_count:i "
       "before_unique_urls:i after_unique_urls:i before_unique_apps:i change:d",
       f"""SELECT *, abs(after_app_switches-before_app_switches)*0.75+abs(after_navigation-before_navigation)*0.75
  +abs(after_browser_clicks-before_browser_clicks)*0.25+abs(after_mouse_clicks-before_mouse_clicks)*0.25
  +abs(after_window_changes-before_window_changes)*0.25+abs(after_unique_apps-before_unique_apps)*0.5
  +abs(after_unique_urls-before_unique_urls)*0.5+abs(after_keyboard-before_keyboard)*0.1 AS change
 FROM cand WHERE slot*{STEP}>={WINDOW} AND session_end-candidate_ts>={WINDOW}""", "cand")
def _(t):
    out = ft.candidate_features(t.events, "session_id", "us", STEP, WINDOW, ft.HEURISTIC_COUNTS,
                                {"unique_apps": "app", "unique_urls": "url"}, require_full_context=True)
    return out.withColumn("change", change_score())


CTES["anch"] = ("sess", "SELECT session_id, us AS anchor_ts, 1 AS is_boundary FROM ev WHERE event_type='app_switch'")
_anchor_w = 10 * HOUR
_ac = {"app_switch_count": "app_switch", "window_title_change_count": "window_title_change",
       "browser_navigation_count": "browser_navigation", "browser_click_count": "browser_click",
       "browser_form_input_count": "browser_form_input", "clipboard_change_count": "clipboard_change",
       "keystroke_count": "keystroke"}
_ac_sql = ", ".join(f"{count_sql(v)} AS {k}" for k, v in _ac.items())


def _anchor_sql(src: str) -> str:
    return f"""SELECT session_id, anchor_ts, is_boundary, count(*) AS event_count, count(DISTINCT event_type) AS unique_event_types,
  count(DISTINCT app) AS unique_apps, count(DISTINCT window_title) AS unique_window_titles, {_ac_sql},
  coalesce(max(gap),0)/{HOUR}.0 AS max_event_gap, coalesce(median(gap),0)/{HOUR}.0 AS median_event_gap
 FROM (SELECT *, us-lag(us) OVER (PARTITION BY session_id, anchor_ts, is_boundary ORDER BY us) AS gap FROM (
  SELECT a.session_id, anchor_ts, is_boundary, us, event_type, app, window_title FROM {src} a
  JOIN ev e ON e.session_id=a.session_id AND us BETWEEN anchor_ts-{_anchor_w} AND anchor_ts+{_anchor_w})) GROUP BY 1,2,3"""


CTES["ctrl"] = ("sess", f"""SELECT session_id, us AS anchor_ts, 0 AS is_boundary FROM (SELECT *, row_number() OVER
  (PARTITION BY session_id ORDER BY md5('42|' || CAST(event_id AS VARCHAR))) AS r FROM (
   SELECT e.* FROM ev e JOIN sess USING (session_id) WHERE us BETWEEN session_start+{_anchor_w} AND session_end-{_anchor_w}
    AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.session_id=e.session_id AND b.event_type='app_switch'
     AND abs(b.us-e.us)<={_anchor_w})))
 JOIN (SELECT session_id, count(*) AS want FROM ev WHERE event_type='app_switch' GROUP BY 1) USING (session_id) WHERE r<=want""")
CTES["anchf"] = ("anch ctrl", _anchor_sql("(SELECT * FROM anch UNION ALL SELECT * FROM ctrl)"))


def _controls(t: Tables):
    from tracewright.operators.nearest import exclude_near
    from tracewright.operators.sampling import matched_controls
    anchors = t.points("app_switch")
    valid = exclude_near(t.events, anchors, "session_id", "us", _anchor_w, CHUNK)
    return matched_controls(valid, anchors, "session_id", "event_id")


def _anchor_rows(t: Tables):
    both = t.points("app_switch").select("session_id", F.col("us").alias("anchor_ts"), F.lit(1).alias("is_boundary")).unionByName(
        _controls(t).select("session_id", F.col("us").alias("anchor_ts"), F.lit(0).alias("is_boundary")))
    out = ft.anchor_features(both, t.events, "session_id", "us", "anchor_ts", _anchor_w, by=["is_boundary"])
    return out.withColumns({c: F.col(c) / HOUR for c in ("max_event_gap", "median_event_gap")})


@query("A05_anchor_features", "session_id:i anchor_ts:i is_boundary:i event_count:i unique_event_types:i unique_apps:i "
       "unique_window_titles:i " + " ".join(f"{c}:i" for c in _ac) + " max_event_gap:d median_event_gap:d",
       "SELECT * FROM anchf", "anchf")
def _(t):
    return _anchor_rows(t)


_cf = ["event_count", "unique_apps", "app_switch_count", "browser_navigation_count", "browser_click_count", "max_event_gap"]


@query("A06_signal_contrast", "feature:s boundary_mean:d control_mean:d boundary_to_control_ratio:d difference:d",
       """SELECT feature, b AS boundary_mean, c AS control_mean, b/nullif(c,0) AS boundary_to_control_ratio, b-c AS difference FROM ("""
       + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg({f}) FILTER (WHERE is_boundary=1) AS b, "
                            f"avg({f}) FILTER (WHERE is_boundary=0) AS c FROM anchf" for f in _cf) + ")", "anchf")
def _(t):
    return ft.contrast(_anchor_rows(t), F.col("is_boundary") == 1, _cf)


@query("T08_matched_controls", "session_id:i anchor_ts:i", "SELECT * FROM ctrl", "ctrl")
def _(t):
    return _controls(t).withColumnRenamed("us", "anchor_ts")


def _gt(t: Tables):
    return t.points("app_switch").select("session_id", "us", F.col("event_id").alias("gt_id"))


def _pred(t: Tables):
    return predictions(t).select("session_id", F.col("predicted_ts").alias("us"), F.col("predicted_ts").alias("pred_id"))


# the sequential rule itself, one prediction of every session per step
def greedy_sql(tol: int, src: str = "prd") -> str:
    return f"""SELECT session_id, pred_id, gt_id, pred_ts, gt_ts, abs(pred_ts-gt_ts) AS error FROM (
 WITH RECURSIVE p AS (SELECT session_id, predicted_ts, row_number() OVER (PARTITION BY session_id ORDER BY predicted_ts) AS i FROM {src}),
 g AS (SELECT session_id, us, event_id FROM ev WHERE event_type='app_switch'),
 walk(session_id, i, used, pred_id, gt_id, pred_ts, gt_ts) AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM p
  UNION ALL
  SELECT session_id, i, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.event_id) END, predicted_ts, hit.event_id, predicted_ts, hit.us FROM (
   SELECT w.session_id, p.i, w.used, p.predicted_ts,
    arg_min({{'event_id': g.event_id, 'us': g.us}}, (abs(g.us-p.predicted_ts), g.us, g.event_id))
     FILTER (WHERE g.event_id IS NOT NULL) AS hit
   FROM walk w JOIN p ON p.session_id=w.session_id AND p.i=w.i+1
   LEFT JOIN g ON g.session_id=p.session_id AND abs(g.us-p.predicted_ts)<={tol} AND NOT list_contains(w.used, g.event_id)
   GROUP BY w.session_id, p.i, w.used, p.predicted_ts))
 SELECT * FROM walk WHERE gt_id IS NOT NULL)"""


CTES["mat"] = ("prd", greedy_sql(TOL))
_match_spec = "session_id:i pred_id:i gt_id:i pred_ts:i gt_ts:i error:i"


def _matched(t: Tables, rule: str = "nearest_within"):
    return mt.match_points(_pred(t), _gt(t), "session_id", "us", "pred_id", "gt_id", TOL, CHUNK, rule)


@query("J09_match_points", _match_spec, "SELECT * FROM mat", "mat")
def _(t):
    return _matched(t)


@query("J10_match_points_nearest_then_test", _match_spec, "SELECT * FROM mat", "mat")
def _(t):
    return _matched(t, "nearest_then_test")


@query("A26_boundary_metrics", "tolerance:i predicted:i truth:i tp:i fp:i fn:i precision:d recall:d f1:d mean_error:d3 median_error:d3",
       f"""SELECT tolerance, predicted, truth, tp, predicted-tp AS fp, truth-tp AS fn, tp/predicted AS precision, tp/truth AS recall,
  coalesce(2.0*tp/nullif(predicted+truth,0),0) AS f1, mean_error, median_error FROM (
 SELECT tolerance, (SELECT count(*) FROM prd) AS predicted, (SELECT count(*) FROM ev WHERE event_type='app_switch') AS truth,
  count(error) AS tp, avg(error) AS mean_error, median(error) AS median_error
 FROM (SELECT unnest([{TOL // 4}, {TOL // 2}, {TOL}]) AS tolerance) LEFT JOIN mat ON error<=tolerance GROUP BY 1)""", "mat")
def _(t):
    return ev.boundary_metrics(_matched(t), _pred(t), _gt(t), [TOL // 4, TOL // 2, TOL])


@query("A27_count_errors", "session_id:i predicted:i truth:i count_error:i absolute_error:i relative_error:d ratio:d",
       """SELECT session_id, coalesce(p,0) AS predicted, coalesce(g,0) AS truth, coalesce(p,0)-coalesce(g,0) AS count_error,
  abs(coalesce(p,0)-coalesce(g,0)) AS absolute_error, abs(coalesce(p,0)-coalesce(g,0))/nullif(g,0) AS relative_error,
  coalesce(p,0)/nullif(g,0) AS ratio FROM (SELECT session_id, count(*) AS p FROM prd GROUP BY 1)
 FULL JOIN (SELECT session_id, count(*) AS g FROM ev WHERE event_type='app_switch' GROUP BY 1) USING (session_id)""", "prd")
def _(t):
    return ev.count_errors(_pred(t), _gt(t), "session_id")


@query("A27_missed_truth", "session_id:i us:i gt_id:i",
       "SELECT session_id, us, event_id AS gt_id FROM ev WHERE event_type='app_switch' AND event_id NOT IN (SELECT gt_id FROM mat)", "mat")
def _(t):
    return ev.missed(_gt(t), _matched(t), "session_id", "gt_id")


@query("A29_case_table", "case_type:s session_id:i pred_ts:i gt_ts:i error:i",
       """SELECT 'TP' AS case_type, session_id, pred_ts, gt_ts, error FROM mat
 UNION ALL SELECT 'FP', session_id, predicted_ts, NULL, NULL FROM prd WHERE NOT EXISTS (SELECT 1 FROM mat m WHERE m.session_id=prd.session_id AND m.pred_ts=prd.predicted_ts)
 UNION ALL SELECT 'FN', session_id, NULL, us, NULL FROM ev WHERE event_type='app_switch' AND event_id NOT IN (SELECT gt_id FROM mat)""", "mat")
def _(t):
    return ev.case_table(_pred(t), _gt(t), _matched(t), "session_id", "pred_id", "gt_id", "us", "us")


_GAPS = [0, STEP, 2 * STEP]


def _sweep_sql() -> str:
    runs = []
    for g in _GAPS:
        runs.append(f"SELECT {g} AS gap, * FROM ({merged_sql('pos', g)})")
    return " UNION ALL ".join(runs)


CTES["prdg"] = ("pos", _sweep_sql())


@query("A25_sweep_merge_counts", "gap:i tolerance:i predicted:i truth:i",
       f"""SELECT gap, tolerance, count(*) AS predicted, (SELECT count(*) FROM ev WHERE event_type='app_switch') AS truth
 FROM prdg, (SELECT unnest([{TOL // 2}, {TOL}]) AS tolerance) GROUP BY 1,2""", "prdg")
def _(t):
    return _sweep(t)


def _sweep(t: Tables):
    points = scored_bins(t).filter(F.col("score") >= 2.0).select("session_id", F.col("bin_start").alias("us"), "score")
    return ev.sweep_merge(points, _gt(t), "session_id", "us", "score", "gt_id", _GAPS, [TOL // 2, TOL], CHUNK)


_runs = " UNION ALL ".join(f"SELECT {g} AS gap, {tol} AS tolerance, error FROM ({greedy_sql(tol, f'(SELECT * FROM prdg WHERE gap={g})')})"
                           for g in _GAPS for tol in (TOL // 2, TOL))


@query("A25_sweep_merge_metrics", "gap:i tolerance:i tp:i precision:d recall:d f1:d mean_error:d3",
       f"""SELECT gap, tolerance, tp, tp/predicted AS precision, tp/truth AS recall, 2.0*tp/(predicted+truth) AS f1, mean_error FROM (SELECT gap, tolerance, count(*) AS tp, avg(error) AS mean_error FROM ({_runs}) GROUP BY 1,2)
  JOIN (SELECT gap, count(*) AS predicted FROM prdg GROUP BY 1) USING (gap), (SELECT count(*) AS truth FROM ev WHERE event_type='app_switch')""", "prdg")
def _(t):
    return _sweep(t)


@query("W05_local_peaks", "session_id:i us:i score:d",
       f"""WITH RECURSIVE near AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS b FROM (SELECT session_id, bin_start AS us, score FROM scored)
  WINDOW w AS (PARTITION BY session_id ORDER BY us)),
 pk AS (SELECT session_id, us, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, us) AS i FROM near
  WHERE score>=1.5 AND score>=coalesce(a,score) AND score>=coalesce(b,score)),
 walk(session_id, i, kept, us, score, ok) AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), false FROM pk
  UNION ALL
  SELECT session_id, i, CASE WHEN far THEN list_append(kept, us) ELSE kept END, us, score, far FROM (
   SELECT w.session_id, p.i, w.kept, p.us, p.score, len([x for x in w.kept if abs(x-p.us)<{3 * STEP}])=0 AS far
   FROM walk w JOIN pk p ON p.session_id=w.session_id AND p.i=w.i+1))
 SELECT session_id, us, score FROM walk WHERE ok""", "scored")
def _(t):
    pts = scored_bins(t).select("session_id", F.col("bin_start").alias("us"), "score")
    return mt.local_peaks(pts, "session_id", "us", "score", 1.5, 3 * STEP, CHUNK)


_PEAK_SCORES, _DISTANCES = [1.5, 2.0, 2.5, 3.0], [STEP, 2 * STEP, 3 * STEP, 6 * STEP]
CTES["pks"] = ("scored", f"""SELECT session_id, threshold, min_distance, us AS predicted_ts FROM (
 WITH RECURSIVE near AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS b FROM (SELECT session_id, bin_start AS us, score FROM scored) WINDOW w AS (PARTITION BY session_id ORDER BY us)),
 pk AS (SELECT session_id, threshold, min_distance, us, row_number() OVER (PARTITION BY session_id, threshold, min_distance ORDER BY score DESC, us) AS i FROM near,
   (SELECT unnest({_PEAK_SCORES}) AS threshold), (SELECT unnest({_DISTANCES}) AS min_distance) WHERE score>=threshold AND score>=coalesce(a,score) AND score>=coalesce(b,score)),
 walk(session_id, threshold, min_distance, i, kept, us, ok) AS (
  SELECT DISTINCT session_id, threshold, min_distance, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), false FROM pk
  UNION ALL
  SELECT session_id, threshold, min_distance, i, CASE WHEN far THEN list_append(kept, us) ELSE kept END, us, far FROM (
   SELECT w.session_id, w.threshold, w.min_distance, p.i, w.kept, p.us, len([x for x in w.kept if abs(x-p.us)<w.min_distance])=0 AS far
   FROM walk w JOIN pk p ON p.session_id=w.session_id AND p.threshold=w.threshold AND p.min_distance=w.min_distance AND p.i=w.i+1))
 SELECT * FROM walk WHERE ok)""")
_peak_runs = " UNION ALL ".join(f"SELECT {s} AS threshold, {d} AS min_distance, error FROM ({greedy_sql(TOL, f'(SELECT * FROM pks WHERE threshold={s} AND min_distance={d})')})"
                                for s in _PEAK_SCORES for d in _DISTANCES)
CTES["pkq"] = ("pks", f"""SELECT threshold, min_distance, coalesce(predicted,0) AS predicted, truth, coalesce(tp,0) AS tp, coalesce(tp/predicted,0) AS precision, coalesce(tp/truth,0) AS recall, coalesce(2.0*tp/(predicted+truth),0) AS f1, mean_error
  FROM (SELECT unnest({_PEAK_SCORES}) AS threshold) CROSS JOIN (SELECT unnest({_DISTANCES}) AS min_distance) CROSS JOIN (SELECT count(*) AS truth FROM ev WHERE event_type='app_switch')
  LEFT JOIN (SELECT threshold, min_distance, count(*) AS predicted FROM pks GROUP BY 1,2) USING (threshold, min_distance)
  LEFT JOIN (SELECT threshold, min_distance, count(*) AS tp, avg(error) AS mean_error FROM ({_peak_runs}) GROUP BY 1,2) USING (threshold, min_distance)""")


def _peak_sweep(t: Tables):
    pts = scored_bins(t).select("session_id", F.col("bin_start").alias("us"), "score")
    return ev.sweep_peaks(pts, _gt(t), "session_id", "us", "score", "gt_id", _PEAK_SCORES, _DISTANCES, TOL, CHUNK)


@query("A25_sweep_peaks", "threshold:d min_distance:i predicted:i truth:i tp:i precision:d recall:d f1:d mean_error:d3", "SELECT * FROM pkq", "pkq")
def _(t):
    return _peak_sweep(t)


@query("A25_best_peaks", "threshold:d min_distance:i f1:d", "SELECT threshold, min_distance, f1 FROM pkq ORDER BY round(f1,12) DESC, threshold, min_distance LIMIT 1", "pkq")
def _(t):
    return ev.best_setting(_peak_sweep(t).withColumn("f1", F.round("f1", 12)), ["threshold", "min_distance"])


CTES["qseg"] = ("prd", """SELECT session_id, us AS segment_start, nxt AS segment_end, row_number() OVER (PARTITION BY session_id ORDER BY us) AS segment_index FROM (
  SELECT *, lead(us) OVER (PARTITION BY session_id ORDER BY us) AS nxt FROM (SELECT session_id, predicted_ts AS us FROM prd JOIN sess USING (session_id) WHERE predicted_ts>session_start AND predicted_ts<session_end
   UNION SELECT session_id, session_start FROM sess UNION SELECT session_id, session_end FROM sess)) WHERE nxt>us""")
CTES["qasg"] = ("qseg", CTES["asg"][1].replace("JOIN seg s", "JOIN qseg s"))
CTES["qapc"] = ("qasg", CTES["apc"][1].replace("FROM asg", "FROM qasg"))
CTES["qaps"] = ("qapc", CTES["aps"][1].replace("FROM apc", "FROM qapc"))


@query("Q01_boundaries_to_profiles", "session_id:i segment_index:i segment_start:i segment_end:i event_count:i navigation_count:i "
       "form_count:i clipboard_count:i app_count:i app_sequence:l",
       f"""SELECT * FROM (SELECT session_id, segment_index, min(segment_start) AS segment_start, min(segment_end) AS segment_end, count(*) AS event_count, {count_sql('browser_navigation')} AS navigation_count,
  {count_sql('browser_form_input')} AS form_count, {count_sql('clipboard_change')} AS clipboard_count, count(DISTINCT app) AS app_count FROM qasg GROUP BY 1,2)
  LEFT JOIN (SELECT session_id, segment_index, app_sequence FROM qaps) USING (session_id, segment_index)""", "qaps")
def _(t):
    from tracewright.plans.boundaries import boundaries_to_profiles
    return boundaries_to_profiles(t.events, "session_id", "us", "event_id", STEP, 2.0, GAP, CHUNK)
