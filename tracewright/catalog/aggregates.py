"""Inventories, audits, evidence tables and model metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.catalog.base import CHUNK, CTES, HOUR, Tables, query
from tracewright.catalog.functions import clean_sequences, replay
from tracewright.functions import classify as cl
from tracewright.functions import text as tx
from tracewright.operators import evaluation as ev
from tracewright.operators import intervals as iv
from tracewright.operators import inventory as nv
from tracewright.operators import profiles as pf
from tracewright.operators import semantics as sem
from tracewright.operators.segments import check_contiguous

SEG = ["session_id", "segment_index"]


@query("A07_event_inventory", "session_id:i event_type:s events:i pct:d",
       "SELECT session_id, event_type, count(*) AS events, 100.0*count(*)/sum(count(*)) OVER (PARTITION BY session_id) AS pct FROM ev GROUP BY 1,2", "ev")
def _(t):
    return nv.inventory(t.events, ["session_id", "event_type"], ["session_id"])


@query("A07_top_values", "value:s events:i", "SELECT window_title AS value, count(*) AS events FROM ev WHERE window_title IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "ev")
def _(t):
    return nv.top_values(t.events, "window_title", 5)


CTES["dl"] = ("", "SELECT *, CAST(n_chars AS DOUBLE)/(n_chars+500) AS p FROM documents JOIN labels USING (doc_id)")


def scored_docs(t: Tables):
    """Labelled documents with a score that grows with their length."""
    d = t.read("documents").select("doc_id", "lang", "source", "n_chars").join(t.read("labels"), "doc_id")
    return d.withColumn("p", F.col("n_chars").cast("double") / (F.col("n_chars") + 500))


def metrics_sql(thr: str) -> str:
    return f"""SELECT threshold, tp, fp, fn, tn, coalesce(tp/nullif(tp+fp,0),0) AS precision, coalesce(tp/nullif(tp+fn,0),0) AS recall, coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0) AS f1, (tp+tn)/(tp+fp+fn+tn) AS accuracy FROM (
  SELECT threshold, count(*) FILTER (WHERE p>=threshold AND quality=1) AS tp, count(*) FILTER (WHERE p>=threshold AND quality=0) AS fp, count(*) FILTER (WHERE p<threshold AND quality=1) AS fn,
  count(*) FILTER (WHERE p<threshold AND quality=0) AS tn FROM dl, (SELECT CAST(unnest({thr}) AS DOUBLE) AS threshold) GROUP BY 1)"""


_THR = [0.2, 0.35, 0.5, 0.65, 0.8]
CTES["swp"] = ("dl", metrics_sql(str(_THR)))


@query("A22_cluster_quality", "rows:i clusters:i true_labels:i weighted_purity:d mean_purity:d largest:i top5_share:d singleton_share:d ari:d",
       """SELECT rows, clusters, tl AS true_labels, pure/rows AS weighted_purity, mp AS mean_purity, largest, top5/rows AS top5_share, ss AS singleton_share, (ps-pt*pc/(rows*(rows-1)/2.0))/((pt+pc)/2.0-pt*pc/(rows*(rows-1)/2.0)) AS ari FROM (
  SELECT sum(n) AS rows, count(*) AS clusters, sum(top) AS pure, avg(top/n) AS mp, max(n) AS largest, avg(CASE WHEN n=1 THEN 1.0 ELSE 0.0 END) AS ss, sum(n*(n-1)/2.0) AS pc, list_sum(list_reverse_sort(list(n))[1:5]) AS top5 FROM (
   SELECT source, sum(n) AS n, max(n) AS top FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1,2) GROUP BY 1)), (SELECT count(*) AS tl, sum(n*(n-1)/2.0) AS pt FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)),
  (SELECT sum(n*(n-1)/2.0) AS ps FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1,2))""")
def _(t):
    return ev.cluster_quality(t.read("documents").select("lang", "source"), "lang", "source")


@query("A23_binary_metrics", "threshold:d tp:i fp:i fn:i tn:i precision:d recall:d f1:d accuracy:d", f"SELECT * FROM ({metrics_sql('[0.5]')})", "dl")
def _(t):
    return ev.binary_metrics(scored_docs(t), "quality", "p", [0.5])


@query("A24_average_precision", "average_precision:d positives:i rows:i",
       """SELECT sum(np*cp/cn)/sum(np) AS average_precision, sum(np) AS positives, sum(n) AS rows FROM (SELECT *, sum(np) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn FROM (
  SELECT p, count(*) FILTER (WHERE quality=1) AS np, count(*) AS n FROM dl GROUP BY 1))""", "dl")
def _(t):
    return ev.average_precision(scored_docs(t), "quality", "p")


@query("A25_sweep_thresholds", "threshold:d tp:i fp:i fn:i tn:i precision:d recall:d f1:d", "SELECT * FROM swp", "swp")
def _(t):
    return ev.sweep_thresholds(scored_docs(t), "quality", "p", _THR)


@query("A25_best_setting", "threshold:d f1:d", "SELECT threshold, f1 FROM swp ORDER BY f1 DESC, threshold LIMIT 1", "swp")
def _(t):
    return ev.best_setting(ev.sweep_thresholds(scored_docs(t), "quality", "p", _THR), ["threshold"])


def contiguity(t: Tables):
    return check_contiguous(t.segments(), "session_id", "segment_start", "segment_end", "segment_index", CHUNK)


@query("W07_check_contiguous", "session_id:i segments:i empty:i overlaps:i gaps:i wrong_index:i",
       """SELECT session_id, count(*) AS segments, count(*) FILTER (WHERE segment_end<=segment_start) AS empty, count(*) FILTER (WHERE pe>segment_start) AS overlaps, count(*) FILTER (WHERE pe<segment_start) AS gaps, 0 AS wrong_index
  FROM (SELECT *, lag(segment_end) OVER (PARTITION BY session_id ORDER BY segment_start) AS pe FROM seg) GROUP BY 1""", "seg")
def _(t):
    return contiguity(t)


@query("W07_check_broken_segments", "session_id:i segments:i gaps:i wrong_index:i",
       """SELECT session_id, count(*) AS segments, count(*) FILTER (WHERE pe<segment_start) AS gaps, count(*) FILTER (WHERE segment_index<>r+b-1) AS wrong_index
  FROM (SELECT *, lag(segment_end) OVER w AS pe, row_number() OVER w AS r, min(segment_index) OVER (PARTITION BY session_id) AS b FROM long WINDOW w AS (PARTITION BY session_id ORDER BY segment_start)) GROUP BY 1""", "long")
def _(t):
    from tracewright.catalog.joins import long_segments
    return check_contiguous(long_segments(t), "session_id", "segment_start", "segment_end", "segment_index", CHUNK)


@query("A30_reconcile_manifest", "chunk:s session_id:i manifest_present:b count_ok:b types_ok:b range_ok:b previous_ok:b next_ok:b chunk_ok:b", """WITH m AS (SELECT session_id, us//604800000000 AS w, count(*) AS n, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1,2)
 SELECT CAST(session_id AS VARCHAR) || '-' || CAST(w AS VARCHAR) AS chunk, session_id, true AS manifest_present, n%10<>3 AS count_ok, true AS types_ok, n%10<>4 AS range_ok,
  EXISTS (SELECT 1 FROM m p WHERE p.session_id=m.session_id AND p.w=m.w-1) OR n%10<>5 AS previous_ok, true AS next_ok,
  n%10<>3 AND n%10<>4 AND (n%10<>5 OR EXISTS (SELECT 1 FROM m p WHERE p.session_id=m.session_id AND p.w=m.w-1)) AS chunk_ok FROM m""", "ev")
def _(t):
    return _reconciled(t)


def _reconciled(t: Tables):
    """Weekly chunks; their manifests are written from the events with errors planted by size."""
    week = F.expr("us div 604800000000")
    name = F.concat_ws("-", F.col("session_id").cast("string"), week.cast("string"))
    events = t.events.withColumn("chunk", name)
    per = events.groupBy("chunk", "session_id", week.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    m = per.groupBy("chunk", "session_id", "w").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                                   F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("events_by_type"))
    last = F.col("n") % 10
    before = F.concat_ws("-", F.col("session_id").cast("string"), (F.col("w") - 1).cast("string"))
    manifests = m.select("chunk", "session_id", F.when(last == 5, before).alias("previous_chunk"), F.lit(None).cast("string").alias("next_chunk"),
                         F.when(last == 3, F.col("n") + 1).otherwise(F.col("n")).alias("total_events"), "events_by_type", "lo",
                         F.when(last == 4, F.col("hi") - 1).otherwise(F.col("hi")).alias("end_ts"), F.col("lo").alias("start_ts")).drop("lo")
    return nv.reconcile_manifest(events, manifests, "chunk", "session_id", "us")


@query("A30_sessions_passing", "session_id:i chunks:i passed:b", """WITH m AS (SELECT session_id, us//604800000000 AS w, count(*) AS n FROM ev GROUP BY 1,2)
 SELECT session_id, count(*) AS chunks, bool_and(n%10<>3 AND n%10<>4 AND (n%10<>5 OR EXISTS (SELECT 1 FROM m p WHERE p.session_id=m.session_id AND p.w=m.w-1))) AS passed FROM m GROUP BY 1""", "ev")
def _(t):
    return nv.sessions_passing(_reconciled(t), "session_id")


_CHUNK_CHECKS = ["count_ok", "range_ok", "screenshots_ok", "previous_ok", "next_ok", "gaps_ok", "event_type_ok", "layer_ok"]


def _audit_tables(t: Tables):
    """Weekly chunks as in ``_reconciled``; manifests with layers, screenshots, links and gaps, each check broken for some sizes."""
    week, k = F.expr("us div 604800000000"), F.col("k")
    sid = F.col("session_id").cast("string")
    events = t.events.withColumn("w", week).withColumn("chunk", F.concat_ws("-", sid, F.col("w").cast("string"))).withColumn("layer", F.concat(F.lit("L"), (k % 3).cast("string")))

    def counted(col, name):
        n = events.groupBy("chunk", col).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct(col, "n"))).alias(name))

    m = (events.groupBy("chunk", "session_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_ts"), F.max("us").alias("hi"), F.count_if(k % 4 == 0).alias("shots"))
         .join(counted("event_type", "types"), "chunk").join(counted("layer", "layers"), "chunk"))
    order = Window.partitionBy("session_id").orderBy("w")
    last, ghost = F.col("n") % 10, F.create_map(F.lit("ghost"), F.lit(1).cast("long"))
    end = F.when(last == 4, F.col("hi") - 1).otherwise(F.col("hi"))
    m = (m.withColumn("end_ts", end).withColumn("before", F.when(F.lag("w").over(order) == F.col("w") - 1, F.lag("chunk").over(order)))
         .withColumn("after", F.when(F.lead("w").over(order) == F.col("w") + 1, F.lead("chunk").over(order)))
         .withColumn("gap", F.coalesce(F.col("start_ts") - F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1)) > 48 * HOUR, F.lit(False))))
    return events, m.select(
        "chunk", "session_id", F.when(last == 5, "nowhere").otherwise(F.col("before")).alias("previous_chunk"), F.when(last != 8, F.col("after")).alias("next_chunk"),
        F.when(last == 3, F.col("n") + 1).otherwise(F.col("n")).alias("total_events"), F.when(last == 2, F.map_concat("types", ghost)).otherwise(F.col("types")).alias("events_by_type"),
        F.when(last == 6, F.map_concat("layers", ghost)).otherwise(F.col("layers")).alias("events_by_layer"), "start_ts", "end_ts",
        F.when(last == 7, F.col("shots") + 1).otherwise(F.col("shots")).alias("screenshots"), (F.col("gap") != (last == 9)).alias("has_gaps"))


_MAPS = {"event_type": "events_by_type", "layer": "events_by_layer"}
CTES["chk"] = ("ev", f"""SELECT *, coalesce(gap_before>{48 * HOUR}, false) AS gap FROM (SELECT *, lag(n) OVER o AS pn, lag(w) OVER o AS pw, lead(n) OVER o AS nn, lead(w) OVER o AS nw,
   lo-max(hi-CASE WHEN n%10=4 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_before
  FROM (SELECT session_id, us//604800000000 AS w, count(*) AS n, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1,2) WINDOW o AS (PARTITION BY session_id ORDER BY w))""")


@query("A30_audit_chunks", "chunk:s session_id:i manifest_present:b gap_before:i " + " ".join(f"{c}:b" for c in _CHUNK_CHECKS) + " chunk_ok:b",
       "SELECT *, " + " AND ".join(_CHUNK_CHECKS) + """ AS chunk_ok FROM (SELECT CAST(session_id AS VARCHAR) || '-' || CAST(w AS VARCHAR) AS chunk, session_id, true AS manifest_present, gap_before, n%10<>3 AS count_ok, n%10<>4 AS range_ok,
  n%10<>7 AS screenshots_ok, n%10<>5 AND (coalesce(pw<>w-1, true) OR pn%10<>8) AS previous_ok, n%10=8 OR coalesce(nw<>w+1, true) OR nn%10<>5 AS next_ok, n%10<>9 AS gaps_ok, n%10<>2 AS event_type_ok, n%10<>6 AS layer_ok FROM chk)""", "chk")
def _(t):
    events, manifests = _audit_tables(t)
    return nv.audit_chunks(events, manifests, events.filter("k % 4 = 0"), "chunk", "session_id", "us", _MAPS, 48 * HOUR)


@query("A30_count_differences", "chunk:s dimension:s value:s actual:i declared:i",
       """SELECT CAST(session_id AS VARCHAR) || '-' || CAST(w AS VARCHAR) AS chunk, CASE n%10 WHEN 2 THEN 'event_type' ELSE 'layer' END AS dimension, 'ghost' AS value, 0 AS actual, 1 AS declared FROM chk WHERE n%10 IN (2, 6)""", "chk")
def _(t):
    return nv.count_differences(*_audit_tables(t), "chunk", _MAPS)


@query("A31_field_coverage", "event_type:s rows:i field:s coverage:d",
       " UNION ALL ".join(f"SELECT event_type, count(*) AS rows, '{c}' AS field, avg(CASE WHEN coalesce({c},'')<>'' THEN 1.0 ELSE 0.0 END) AS coverage FROM ev GROUP BY 1" for c in ("app", "window_title", "url", "path")), "ev")
def _(t):
    return nv.field_coverage(t.events, ["app", "window_title", "url", "path"], ["event_type"])


@query("A32_integrity", "metric:s value:d",
       """WITH c AS (SELECT event_id, count(*) AS n FROM ev JOIN long USING (session_id) WHERE us BETWEEN segment_start AND segment_end GROUP BY 1)
 SELECT unnest(['total_events','assigned_events','duplicate_events','segments','empty_segments','sessions_without_segments','segments_without_events','overlaps','gaps','unassigned_events']) AS metric,
  unnest([(SELECT count(*) FROM ev), (SELECT count(*) FROM c), (SELECT count(*) FROM c WHERE n>1), (SELECT count(*) FROM long),
   (SELECT count(*) FROM long l WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.session_id=l.session_id AND us BETWEEN segment_start AND segment_end)),
   (SELECT count(*) FROM sess WHERE session_id NOT IN (SELECT session_id FROM long)), 0, 0,
   (SELECT count(*) FROM (SELECT segment_start, lag(segment_end) OVER (PARTITION BY session_id ORDER BY segment_start) AS pe FROM long) WHERE pe<segment_start), (SELECT count(*) FROM ev)-(SELECT count(*) FROM c)]) AS value""", "long")
def _(t):
    from tracewright.catalog.base import DAY
    from tracewright.catalog.joins import long_segments
    from tracewright.session import cut_lineage
    segs = cut_lineage(long_segments(t))
    hits = cut_lineage(iv.assign_events(t.events, segs, "session_id", "us", "event_id", "segment_index", "segment_start", "segment_end", DAY, "closed"))
    check = check_contiguous(segs, "session_id", "segment_start", "segment_end", "segment_index", CHUNK)
    return nv.integrity(t.events, segs, hits, "session_id", "event_id", "segment_index", check)


_CONCEPTS = {"en": {"reporting": ["tion", "ment"], "rare": ["zzzz", "theronth"]}, "fr": {"aqueous": ["eau"]}, "de": {"speech": ["sch"]}}


CTES["cob"] = ("", """SELECT *, CASE lang WHEN 'fr' THEN 'r' || CAST(doc_id%2 AS VARCHAR) WHEN 'de' THEN NULL ELSE 'r' || CAST(doc_id%4 AS VARCHAR) END AS route FROM documents""")
CTES["con"] = ("cob", """SELECT *, unnest([x for x in [CASE WHEN lang='en' AND (contains(lower(text),'tion') OR contains(lower(text),'ment')) THEN 'reporting' END,
  CASE WHEN lang='en' AND (contains(lower(text),'zzzz') OR contains(lower(text),'theronth')) THEN 'rare' END,
  CASE WHEN lang='fr' AND contains(lower(text),'eau') THEN 'aqueous' END, CASE WHEN lang='de' AND contains(lower(text),'sch') THEN 'speech' END] if x IS NOT NULL]) AS concept FROM cob""")


def _top_sql(col: str, k: int, name: str) -> str:
    return f"""SELECT lang, concept, string_agg({col} || ':' || CAST(n AS VARCHAR), ' | ' ORDER BY r) AS {name}, count(*) AS {name}_shown FROM (
   SELECT *, row_number() OVER (PARTITION BY lang, concept ORDER BY n DESC, {col}) AS r FROM (SELECT lang, concept, {col}, count(*) AS n FROM con WHERE coalesce({col},'')<>'' GROUP BY 1,2,3)) WHERE r<={k} GROUP BY 1,2"""


@query("A33_concept_candidates", "lang:s concept:s segments:i sessions:i operators:i share_pct:d top_routes:s top_sources:s representative_segments:s status:s",
       f"""SELECT *, CASE WHEN NOT (segments>=5 AND sessions>=2 AND operators>=2) THEN 'BELOW_GATE' WHEN coalesce(top_routes_shown,0)<=2 THEN 'PROCESS_CANDIDATE' ELSE 'REVIEW' END AS status FROM (
  SELECT lang, concept, count(DISTINCT (source, doc_id)) AS segments, count(DISTINCT source) AS sessions, count(DISTINCT n_chars%5) AS operators FROM con GROUP BY 1,2)
  JOIN (SELECT lang, count(*) AS total FROM documents GROUP BY 1) USING (lang)
  LEFT JOIN ({_top_sql('route', 3, 'top_routes')}) USING (lang, concept) LEFT JOIN ({_top_sql('source', 8, 'top_sources')}) USING (lang, concept)
  LEFT JOIN (SELECT lang, concept, string_agg(CAST(doc_id AS VARCHAR), ' | ' ORDER BY doc_id) AS representative_segments FROM (
   SELECT *, row_number() OVER (PARTITION BY lang, concept ORDER BY doc_id) AS r FROM (SELECT DISTINCT lang, concept, doc_id FROM con)) WHERE r<=15 GROUP BY 1,2) USING (lang, concept)
  """.replace("SELECT *, CASE WHEN NOT", "SELECT *, 100.0*segments/total AS share_pct, CASE WHEN NOT"), "con")
def _(t):
    i = F.col("doc_id")
    route = F.when(F.col("lang") == "fr", F.concat(F.lit("r"), (i % 2).cast("string"))).when(F.col("lang") != "de", F.concat(F.lit("r"), (i % 4).cast("string")))
    d = t.read("documents").withColumn("operator", F.col("n_chars") % 5).withColumn("route", route)
    return nv.concept_candidates(d, "lang", "text", "source", "doc_id", "operator", _CONCEPTS, "route", {"top_sources": ("source", 8)})


_TERMS = ("tion", "the", "eau", "sch", "ción", "ment", "que")


@query("A34_semantic_summary", "lang:s term:s records:i rank:i",
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY records DESC, term) AS rank FROM (SELECT lang, term, count(*) AS records FROM documents, (SELECT unnest({list(_TERMS)}) AS term) WHERE contains(lower(text), term) GROUP BY 1,2)) WHERE rank<=3""")
def _(t):
    return nv.semantic_summary(t.read("documents"), "lang", "text", _TERMS, 3)


_PHRASES = ("経費精算 申請 保留 社員番号 金額", "payroll change approved, status completed", "Leave application pending processing", "Word document: confirm and save",
            "Excel sheet, dependent deduction, category and type", "勤怠 ステータス 確認", "", "REJECTED request, retroactive amount", "social insurance tax hold", "メモ 氏名 入力", "交通費 transportation expense submit")
_LISTS = {"concepts": ["request", "case"], "fields": ["field"], "actions": ["action", "status"], "documents": ["document"]}
_OTHERS = {"routes": "route", "variants": "variant"}


def semantic_texts(t: Tables):
    """Whole documents with a phrase of a case, a route and a variant."""
    i = F.col("doc_id")
    phrase = F.array(*[F.lit(p) for p in _PHRASES])[F.pmod(i, F.lit(len(_PHRASES))).cast("int")]
    return t.read("documents").select("doc_id", "lang", "source", "n_chars", F.concat_ws(" ", phrase, "text").alias("said"), F.concat(F.lit("/r"), (i % 5).cast("string")).alias("route"),
                                      F.when(i % 3 == 0, "WORD").when(i % 3 == 1, "EXCEL").alias("variant"), (i % 7).alias("segment"), ((i * 37) % 101 / 100.0).alias("score"))


def _rule_list(rules) -> str:
    return "list_distinct([x for x in [" + ", ".join(f"CASE WHEN regexp_matches(said, '(?i){p}') THEN '{v}' END" for p, v in rules) + "] if x IS NOT NULL])"


CTES["sst"] = ("", f"""SELECT doc_id, lang, source, concat_ws(' ', [{', '.join("'" + p + "'" for p in _PHRASES)}][CAST(doc_id%{len(_PHRASES)} AS INTEGER)+1], text) AS said, '/r' || CAST(doc_id%5 AS VARCHAR) AS route,
  CASE doc_id%3 WHEN 0 THEN 'WORD' WHEN 1 THEN 'EXCEL' END AS variant, doc_id%7 AS segment, ((doc_id*37)%101)/100.0 AS score FROM documents""")
CTES["srec"] = ("sst", "SELECT *, " + ", ".join(f"{_rule_list(rules)} AS {kind if kind != 'case' else 'case_'}" for kind, rules in sem.RULES.items())
                + ", " + "CASE " + " ".join(f"WHEN regexp_matches(said, '(?i){p}') THEN '{v}'" for p, v in vocab.OBJECT_RULES) + " ELSE '' END AS object"
                + f", regexp_matches(said, '{vocab.HUMAN_GATE_TEXT}') AS human_gate FROM sst")


@query("F23_semantic_record", "doc_id:i request:l field:l status:l action:l document:l instruction:l decision:l case_:l object:s human_gate:b",
       "SELECT doc_id, " + ", ".join(f"list_sort({k}) AS {k}" for k in ("request", "field", "status", "action", "document", "instruction", "decision", "case_")) + ", object, human_gate FROM srec", "srec")
def _(t):
    made = sem.semantic_record(semantic_texts(t), "said").withColumnRenamed("case", "case_")
    return made.withColumns({k: F.sort_array(k) for k in ("request", "field", "status", "action", "document", "instruction", "decision", "case_")})


CTES["shit"] = ("srec", """SELECT DISTINCT doc_id, lang, list, value FROM (SELECT doc_id, lang, 'concepts' AS list, unnest(list_concat(request, case_)) AS value FROM srec UNION ALL SELECT doc_id, lang, 'fields', unnest(field) FROM srec
  UNION ALL SELECT doc_id, lang, 'actions', unnest(list_concat(action, status)) FROM srec UNION ALL SELECT doc_id, lang, 'documents', unnest(document) FROM srec
  UNION ALL SELECT doc_id, lang, 'routes', route FROM srec UNION ALL SELECT doc_id, lang, 'variants', variant FROM srec WHERE variant IS NOT NULL) WHERE lang IS NOT NULL""")


@query("A34_semantic_lists", "lang:s records:i segments:i sessions:i mean_score:d concepts:s fields:s actions:s documents:s routes:s variants:s",
       """SELECT s.*, """ + ", ".join(f"coalesce({c}, '') AS {c}" for c in [*_LISTS, *_OTHERS]) + """ FROM (SELECT lang, count(*) AS records, count(DISTINCT (source, segment)) AS segments, count(DISTINCT source) AS sessions, avg(score) AS mean_score
   FROM srec WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY GROUPING SETS ((lang), ())) s LEFT JOIN (
  SELECT lang, """ + ", ".join(f"max(v) FILTER (WHERE list='{c}') AS {c}" for c in [*_LISTS, *_OTHERS]) + """ FROM (SELECT lang, list, string_agg(value || ' (' || CAST(n AS VARCHAR) || ')', ' | ' ORDER BY r) AS v FROM (
   SELECT *, row_number() OVER (PARTITION BY lang, list ORDER BY n DESC, value) AS r FROM (SELECT lang, list, value, count(*) AS n FROM shit GROUP BY GROUPING SETS ((lang, list, value), (list, value)))) WHERE r<=12 GROUP BY 1,2) GROUP BY 1) w
  ON s.lang IS NOT DISTINCT FROM w.lang""", "shit")
def _(t):
    records = sem.semantic_record(semantic_texts(t), "said").filter("source is not null")
    return sem.semantic_lists(records, "lang", "source", "segment", "score", "labels", _LISTS, _OTHERS)


@query("A44_interface_inventory", "path:s event_type:s rows:i sessions:i segments:i",
       "SELECT path, event_type, count(*) AS rows, count(DISTINCT session_id) AS sessions, count(DISTINCT (session_id, segment_index)) AS segments FROM asg GROUP BY 1,2", "asg")
def _(t):
    return nv.interface_inventory(t.assigned(), ["path", "event_type"], "session_id", "segment_index")


_OM = ("event_count", "navigation_count", "form_count", "clipboard_count")


@query("A45_observed_metrics", "metric:s total:d mean:d maximum:d segments_with:i median:d",
       " UNION ALL ".join(f"SELECT '{c}' AS metric, sum({c}) AS total, avg({c}) AS mean, max({c}) AS maximum, count(*) FILTER (WHERE {c}>0) AS segments_with, quantile_cont({c},0.5) AS median FROM prof" for c in _OM), "prof")
def _(t):
    return nv.observed_metrics(t.profile(), _OM)


CTES["phs"] = ("seqs", "SELECT session_id, segment_index, unnest(clean) AS phase, unnest(range(1, len(clean)+1)) AS pos FROM seqs")


@query("A46_phase_boundary", "phase:s occurrences:i segments:i sessions:i treatment:s segment_pct:d",
       """SELECT phase, count(*) AS occurrences, count(DISTINCT (session_id, segment_index)) AS segments, count(DISTINCT session_id) AS sessions, CASE WHEN phase='APPLICATION_SWITCH' THEN 'AUTOMATE' WHEN phase IN ('DESKTOP_INPUT','OTHER') THEN 'UNKNOWN / VALIDATE' ELSE 'AUTOMATE + FLAG' END AS treatment,
  100.0*count(DISTINCT (session_id, segment_index))/(SELECT count(*) FROM seqs) AS segment_pct FROM phs GROUP BY 1""", "phs")
def _(t):
    from tracewright.session import cut_lineage
    seqs = cut_lineage(clean_sequences(t))
    phases = seqs.select("session_id", "segment_index", F.explode("clean").alias("phase"))
    return nv.phase_boundary(phases, "session_id", "segment_index", "phase", cl.phase_treatment("phase"), seqs)


@query("A47_replay_summary", "replay:s segments:i source_pct:d target_pct:d xform_pct:d",
       "SELECT replay, count(*) AS segments, 100.0*avg(source::INT) AS source_pct, 100.0*avg(target::INT) AS target_pct, 100.0*avg(xform::INT) AS xform_pct FROM rep GROUP BY 1", "rep")
def _(t):
    return nv.replay_summary(replay(t), "replay", ["source", "target", "xform"])


@query("A47_variant_counts", "variant:s segments:i", "SELECT variant, count(*) AS segments FROM (SELECT unnest(variants) AS variant FROM rep) GROUP BY 1", "rep")
def _(t):
    return nv.explode_counts(replay(t), "variants", "variant")


@query("A48_set_recovery", "doc_id:i recovered:i missing:i precision:d recall:d f1:d jaccard:d",
       r"""SELECT doc_id, i AS recovered, nt-i AS missing, CASE WHEN nt>0 THEN coalesce(i/nullif(np,0),0) END AS precision, CASE WHEN nt>0 THEN i/nt END AS recall, CASE WHEN nt>0 THEN 2.0*i/(np+nt) END AS f1, CASE WHEN nt>0 THEN i/(np+nt-i) END AS jaccard FROM (
  SELECT doc_id, len(p) AS np, len(t) AS nt, len(list_intersect(p,t)) AS i FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(trim(string_split(text, chr(10))[1])),'[a-z0-9_]+|[ぁ-んァ-ン一-龥]{2,}')) AS p, list_distinct(regexp_extract_all(lower(trim(text)),'[a-z0-9_]+|[ぁ-んァ-ン一-龥]{2,}')) AS t FROM documents))""")
def _(t):
    d = t.read("documents").select("doc_id", tx.token_set(F.element_at(F.split("text", "\n"), 1)).alias("p"), tx.token_set("text").alias("t"))
    out = ev.set_recovery(d, "p", "t")
    return out.withColumns({"recovered": F.size("recovered"), "missing": F.size("missing")})


CTES["glo"] = ("", "SELECT unnest(string_split(lower(p_name),' ')) AS term, p_type AS kind FROM part")


@query("A49_glossary", "term:s frequency:i kind:s", "SELECT term, sum(n) AS frequency, arg_min(kind, (-n, kind)) AS kind FROM (SELECT term, kind, count(*) AS n FROM glo GROUP BY 1,2) GROUP BY 1", "glo")
def _(t):
    return nv.glossary(t.read("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"), F.col("p_type").alias("kind")), "term", "kind")


@query("A51_quantiles", "o_orderstatus:s quantile:d value:d4",
       " UNION ALL ".join(f"SELECT o_orderstatus, {q} AS quantile, quantile_cont(o_totalprice,{q}) AS value FROM orders GROUP BY 1" for q in (0.1, 0.5, 0.9, 0.99)))
def _(t):
    return ev.quantiles(t.read("orders"), "o_totalprice", [0.1, 0.5, 0.9, 0.99], ["o_orderstatus"])


@query("A52_script_stats", "lang:s records:i characters:i script_characters:i records_with_script:i script_pct:d",
       """SELECT lang, count(*) AS records, sum(length(text)) AS characters, sum(length(text)-length(regexp_replace(text,'[à-ÿ]','','g'))) AS script_characters, count(*) FILTER (WHERE regexp_matches(text,'[à-ÿ]')) AS records_with_script,
  100.0*sum(length(text)-length(regexp_replace(text,'[à-ÿ]','','g')))/sum(length(text)) AS script_pct FROM documents GROUP BY 1""")
def _(t):
    return nv.script_stats(t.read("documents"), "text", ["lang"], "[à-ÿ]")


@query("A54_accepted_precision", "lang:s held_out:i accepted:i correct:i precision:d",
       "SELECT lang, count(*) AS held_out, count(*) FILTER (WHERE p>=0.6) AS accepted, count(*) FILTER (WHERE p>=0.6 AND quality=1) AS correct, coalesce(count(*) FILTER (WHERE p>=0.6 AND quality=1)/nullif(count(*) FILTER (WHERE p>=0.6),0),0) AS precision FROM dl GROUP BY 1", "dl")
def _(t):
    return ev.accepted_precision(scored_docs(t), F.col("p") >= 0.6, F.col("quality") == 1, ["lang"])


@query("A56_enrichment_summary", "session_id:i executions:i total_events:i max_events:i",
       "SELECT session_id, count(*) AS executions, sum(event_count) AS total_events, max(event_count) AS max_events FROM prof WHERE form_count>0 GROUP BY 1", "prof")
def _(t):
    return nv.enrichment_summary(t.profile(), "session_id", F.col("form_count") > 0, "event_count")


CTES["fq"] = ("prof", """SELECT page_class AS family, 100.0*count(*)/(SELECT count(*) FROM prof) AS time_share, 100.0*avg(CASE WHEN navigation_count+form_count+browser_click_count+clipboard_count>0 THEN 1 ELSE 0 END) AS mechanical, 100.0*avg(CASE WHEN window_change_count>=2 THEN 1 ELSE 0 END) AS decision,
  100.0*avg(CASE WHEN clipboard_count>0 THEN 1 ELSE 0 END) AS clipboard, max(app_count) AS apps FROM prof GROUP BY 1""")


@query("F30_rules_to_decision", "family:s fit:s human_risk:s cross_app_risk:s risk_points:i feasibility:s priority:s",
       """SELECT *, CASE WHEN risk_points>=7 THEN 'PILOT-FIRST' WHEN risk_points>=5 THEN 'FEASIBLE_WITH_VALIDATION' ELSE 'LOWER_RISK' END AS feasibility,
  CASE WHEN time_share>=20 AND mechanical>=95 AND clipboard>=85 THEN 'P2 — STRONG SECOND' WHEN time_share>=10 AND mechanical>=95 AND clipboard>=90 AND cross_app_risk IN ('MEDIUM','LOW-MEDIUM') THEN 'P2 — GOOD CANDIDATE'
   WHEN cross_app_risk='HIGH' THEN 'P3 — PILOT / VALIDATE' ELSE 'P3 — LIMITED / PILOT' END AS priority FROM (
  SELECT *, CASE human_risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END + CASE cross_app_risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END + 2 AS risk_points FROM (
   SELECT *, CASE WHEN mechanical>=90 AND decision<20 AND clipboard>=80 THEN 'STRONG_MECHANICAL_FIT' WHEN mechanical>=80 AND clipboard>=50 THEN 'GOOD_MECHANICAL_FIT_WITH_HUMAN_STEP' ELSE 'PARTIAL_AUTOMATION_CANDIDATE' END AS fit,
    CASE WHEN decision>=30 THEN 'HIGH' WHEN decision>=15 THEN 'MEDIUM' ELSE 'LOW-MEDIUM' END AS human_risk, CASE WHEN apps>=3 OR clipboard>=80 THEN 'HIGH' WHEN apps>=2 THEN 'MEDIUM' ELSE 'LOW-MEDIUM' END AS cross_app_risk FROM fq))""", "fq")
def _(t):
    def pct(cond):
        return F.avg(cond.cast("double")) * 100
    p = t.profile()
    c = F.col
    total = p.agg(F.count(F.lit(1)).alias("_t"))
    fam = p.groupBy(c("page_class").alias("family")).agg(
        F.count(F.lit(1)).alias("_n"), pct(c("navigation_count") + c("form_count") + c("browser_click_count") + c("clipboard_count") > 0).alias("mechanical"),
        pct(c("window_change_count") >= 2).alias("decision"), pct(c("clipboard_count") > 0).alias("clipboard"), F.max("app_count").alias("apps"))
    fam = fam.crossJoin(total).withColumn("time_share", 100 * c("_n") / c("_t"))  # one row
    risks = cl.risk_levels("family", "decision", "clipboard", "apps", F.lit("MEDIUM"))
    out = fam.withColumns(risks).withColumn("fit", cl.mechanical_fit("mechanical", "decision", "clipboard"))
    return out.withColumn("priority", cl.priority_tier("family", "time_share", "mechanical", "clipboard", "selector_risk", "cross_app_risk", F.lit("MEDIUM")))
