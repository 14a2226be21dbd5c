"""Sorting, top-k, sampling, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.catalog.base import CHUNK, CTES, HOUR, Tables, query
from tracewright.catalog.functions import item_scores
from tracewright.operators import relations as rl
from tracewright.operators import sampling as sp


@query("T01_order_rows", "doc_id:i quality:i toxic:i", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def _(t):
    d = t.read("documents").select("doc_id").join(t.read("labels"), "doc_id", "left")
    return sp.order_rows(d, ["quality", "toxic", "doc_id"], descending=["toxic"])


@query("T02_top_k", "o_orderkey:i o_totalprice:d", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return sp.top_k(t.read("orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20)


@query("T03_top_k_per_group", "o_custkey:i o_orderkey:i rank:i",
       "SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r<=2")
def _(t):
    return sp.top_k_per(t.read("orders"), "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)


_best = """SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS d FROM orders"""


@query("T04_diverse_top_k", "o_orderpriority:s o_custkey:i o_orderkey:i rank:i",
       f"SELECT o_orderpriority, o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM ({_best}) WHERE d=1) WHERE r<=4")
def _(t):
    return sp.diverse_top_k(t.read("orders"), "o_orderpriority", "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 4)


@query("T04_diverse_top_k_backfilled", "o_orderstatus:s o_orderpriority:s o_orderkey:i backfilled:b",
       """SELECT o_orderstatus, o_orderpriority, o_orderkey, d>1 AS backfilled FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN d>1 THEN 1 ELSE 0 END, o_totalprice DESC, o_orderkey) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS d FROM orders)) WHERE r<=8""")
def _(t):
    return sp.diverse_top_k(t.read("orders"), "o_orderstatus", "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 8, backfill=True)


@query("T05_representative", "o_custkey:i o_orderkey:i",
       "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus='F' THEN 1000000 ELSE 0 END + o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r=1")
def _(t):
    score = F.when(F.col("o_orderstatus") == "F", 1_000_000).otherwise(0) + F.col("o_totalprice")
    return sp.representative(t.read("orders"), "o_custkey", score, "o_orderkey")


CTES["itm"] = ("nrf asg", f"""SELECT session_id, segment_index, event_id, us, app, 1.0::DOUBLE + CASE WHEN nt THEN 12 ELSE 0 END + CASE WHEN nc THEN 5 ELSE 0 END + CASE WHEN p BETWEEN 0 AND 0.2 OR p BETWEEN 0.4 AND 0.6 OR p BETWEEN 0.8 AND 1 THEN 0.5 ELSE 0 END AS score,
  CASE WHEN nt THEN 1 WHEN nc THEN 2 ELSE 3 END AS tier FROM (SELECT a.*, (a.us-segment_start)/(segment_end-segment_start) AS p, coalesce(transition_distance/{HOUR}.0<=1.5,false) AS nt, coalesce(click_distance/{HOUR}.0<=1.5,false) AS nc
   FROM asg a JOIN nrf n USING (event_id))""")


@query("T06_select_spaced", "session_id:i segment_index:i selection_order:i event_id:i selection_pass:i score:d",
       f"""WITH RECURSIVE x AS (SELECT *, min(us) OVER w AS lo, max(us) OVER w AS hi FROM itm WINDOW w AS (PARTITION BY session_id, segment_index)),
  walk(session_id, segment_index, r, sel) AS (SELECT DISTINCT session_id, segment_index, 0, CAST([] AS STRUCT(ts BIGINT, item BIGINT, app VARCHAR, score DOUBLE, pass INTEGER)[]) FROM x
   UNION ALL SELECT session_id, segment_index, r+1, CASE WHEN hit IS NULL THEN sel ELSE list_append(sel, hit) END FROM (
    SELECT w.session_id, w.segment_index, w.r, w.sel, arg_min({{'ts': x.us, 'item': x.event_id, 'app': x.app, 'score': x.score, 'pass': CASE WHEN w.r<5 THEN x.tier ELSE 4 END}},
     (CASE WHEN w.r<5 THEN x.tier ELSE 0 END, CASE WHEN w.r<5 THEN 0::DOUBLE ELSE abs(x.us-(x.lo+(x.hi-x.lo)*CASE w.r WHEN 5 THEN 0.15::DOUBLE WHEN 6 THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END)) END, -x.score, x.us, x.event_id)) FILTER (WHERE x.event_id IS NOT NULL) AS hit
    FROM walk w LEFT JOIN x ON x.session_id=w.session_id AND x.segment_index=w.segment_index AND len(w.sel)<5 AND len([s for s in w.sel if abs(s.ts-x.us)<{2 * HOUR}])=0
      AND (w.r>=5 OR x.tier<3 OR len([s for s in w.sel if s.app IS NOT DISTINCT FROM x.app])<2)
    WHERE w.r<8 GROUP BY w.session_id, w.segment_index, w.r, w.sel))
  SELECT session_id, segment_index, row_number() OVER (PARTITION BY session_id, segment_index ORDER BY s.ts, s.item) AS selection_order, s.item AS event_id, s.pass AS selection_pass, s.score AS score
  FROM (SELECT session_id, segment_index, unnest(sel) AS s FROM walk WHERE r=8)""", "itm")
def _(t):
    items = item_scores(t)
    return sp.select_spaced(items, ["session_id", "segment_index"], "us", "event_id", "app", "score", "near_transition", "near_click", spacing=2 * HOUR)


CTES["quo"] = ("", """SELECT source AS s, count(*) AS n, greatest(round(round((SELECT count(*) FROM documents)*0.2)*count(*)/(SELECT count(*) FROM documents)),1) AS q FROM documents GROUP BY 1""")
CTES["quf"] = ("quo", """SELECT s, n, q - CASE WHEN over>0 THEN coalesce(m,0) WHEN over<0 THEN -coalesce(m,0) ELSE 0 END AS quota FROM (SELECT *, (SELECT sum(q) FROM quo)-(SELECT round(count(*)*0.2) FROM documents) AS over FROM quo) LEFT JOIN (
  SELECT s, count(*) AS m FROM (SELECT *, row_number() OVER (ORDER BY v DESC, s) AS r FROM (SELECT s, over, CASE WHEN over>0 THEN q ELSE n-q END - unnest(range(0, CAST(abs(over) AS BIGINT))) AS v FROM (
   SELECT *, (SELECT sum(q) FROM quo)-(SELECT round(count(*)*0.2) FROM documents) AS over FROM quo)) WHERE over<0 OR v>1) WHERE r<=abs(over) GROUP BY 1) USING (s)""")


@query("T07_stratified_quotas", "source:s rows:i quota:i", "SELECT s AS source, n AS rows, quota FROM quf", "quf")
def _(t):
    return sp.stratified_quotas(t.read("documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows")), "source", 0.2)


@query("T07_stratified_sample", "doc_id:i is_seed:b",
       """SELECT doc_id, sd AS is_seed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN sd THEN 0 ELSE 1 END, CASE WHEN sv THEN 1 ELSE 0 END, md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM (
  SELECT *, EXISTS (SELECT 1 FROM documents x WHERE x.source=d.source AND x.lang=d.lang AND x.n_chars>=5000) AS sv, n_chars>=5000 AS sd FROM documents d)) JOIN quf ON s=source WHERE r<=quota OR sd""", "quf")
def _(t):
    return sp.stratified_sample(t.read("documents").select("doc_id", "source", "lang", "n_chars"), "source", "doc_id", 0.2, seeds=F.col("n_chars") >= 5000, variant="lang")


@query("U01_union_all", "key:i name:s acctbal:d", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL FROM nation")
def _(t):
    c = t.read("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    s = t.read("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    n = t.read("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return rl.union_all(c, s, n)


@query("U02_distinct_on", "session_id:i event_type:s", "SELECT DISTINCT session_id, event_type FROM ev", "ev")
def _(t):
    return rl.distinct_on(t.events, ["session_id", "event_type"])


@query("U03_shared_keys", "key:i", "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(t):
    return rl.shared_keys(t.read("customer").select(F.col("c_custkey").alias("key")), t.read("orders").select(F.col("o_custkey").alias("key")), "key")


@query("U03_split_leaks", "o_custkey:i splits:i", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus)>1")
def _(t):
    return rl.split_leaks(t.read("orders"), "o_custkey", "o_orderstatus")


@query("U04_missing_keys", "doc_id:i", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return rl.missing_keys(t.read("documents"), t.read("labels"), "doc_id")


CTES["spl"] = ("", """SELECT o_custkey, CASE WHEN r<=round(n*0.7) THEN 'train' WHEN r<=round(n*0.85) THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || CAST(o_custkey AS VARCHAR))) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))""")


@query("M01_split_by_key", "o_orderkey:i split:s", "SELECT o_orderkey, split FROM orders JOIN spl USING (o_custkey)", "spl")
def _(t):
    return sp.split_by_key(t.read("orders"), "o_custkey")
