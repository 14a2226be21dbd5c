"""Sources and sinks: staged files are written from the driver tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.catalog.base import CTES, DAY, HOUR, Tables, query
from tracewright.catalog.profiles import voted
from tracewright.session import staging_path
from tracewright.sources import dictionary as dc
from tracewright.sources import readers as rd
from tracewright.sources import variants as vr
from tracewright.sources import writers as wr


def nested_events(t: Tables):
    """Events in the nested shape of the raw log."""
    app = F.struct(F.col("app").alias("app_name"), F.lit("p.exe").alias("process_name"), F.col("window_title"))
    context = F.struct(F.when(F.col("app").isNotNull(), app).alias("active_app"), F.struct("url").alias("active_browser_tab"), F.col("path").alias("extracted_text"))
    ids = F.struct(F.concat(F.lit("chunk_"), F.expr("us div 604800000000").cast("string")).alias("chunk_id"), F.col("event_id").alias("sequence_number"))
    return t.events.select(
        F.concat(F.lit("ses_"), F.col("session_id").cast("string")).alias("session_id"), F.expr("us div 1000").alias("timestamp_ms"), "event_type",
        F.lit("L1").alias("layer"), F.col("event_id").cast("string").alias("event_id"), ids.alias("correlation"), context.alias("context"),
        F.struct(F.col("k"), F.col("url").alias("current_url")).alias("payload"), F.struct(F.col("operator").cast("string").alias("username_hash")).alias("source"))


def staged_log(t: Tables) -> str:
    """JSON lines below dataset=/session folders, with malformed lines mixed in."""
    path = staging_path(t.spark, "events")
    e = nested_events(t)
    good = e.select(F.to_json(F.struct(*e.columns)).alias("value"), F.concat(F.lit("ds_"), F.col("source.username_hash")).alias("dataset"))
    bad = e.filter(F.col("payload.k") % 10 == 0).select(F.lit('{"session_id": "broken').alias("value"), F.lit("ds_0").alias("dataset"))
    blank = e.filter(F.col("payload.k") % 10 == 1).select(F.lit("").alias("value"), F.lit("ds_1").alias("dataset"))
    good.unionByName(bad).unionByName(blank).write.partitionBy("dataset").text(path)
    return path


@query("S01_read_events", "session_id:s event_type:s app:s events:i corrupt:i",
       """SELECT 'ses_' || CAST(session_id AS VARCHAR) AS session_id, event_type, app, count(*) AS events, 0 AS corrupt FROM ev GROUP BY 1,2,3
 UNION ALL SELECT NULL, NULL, NULL, count(*), count(*) FROM ev WHERE k%10=0 HAVING count(*)>0""", "ev")
def _(t):
    e = rd.read_events(t.spark, staged_log(t), file_name="*.txt")
    return e.groupBy("session_id", "event_type", F.col("context.active_app.app_name").alias("app")).agg(
        F.count(F.lit(1)).alias("events"), F.count("_corrupt").alias("corrupt"))


@query("S02_path_tags", "dataset:s events:i", "SELECT CAST(operator AS VARCHAR) AS dataset, count(*) AS events FROM ev GROUP BY 1", "ev")
def _(t):
    e = rd.read_events(t.spark, staged_log(t), file_name="*.txt").filter(F.col("session_id").isNotNull())
    return rd.with_path_tags(e, {"dataset": r"/dataset=ds_([^/]+)/"}).groupBy("dataset").agg(F.count(F.lit(1)).alias("events"))


@query("S03_session_from_path", "path_session:s path_chunk:s events:i",
       "SELECT 'ses_' || CAST(session_id AS VARCHAR) AS path_session, 'chunk_' || CAST(us//604800000000 AS VARCHAR) AS path_chunk, count(*) AS events FROM ev GROUP BY 1,2", "ev")
def _(t):
    where = F.concat_ws("/", F.lit("/raw"), F.concat(F.lit("ses_"), F.col("session_id").cast("string")),
                        F.concat(F.lit("chunk_"), F.expr("us div 604800000000").cast("string")), F.lit("events.jsonl"))
    return rd.with_path_tags(t.events.withColumn("source_file", where), rd.SESSION_TAGS).groupBy("path_session", "path_chunk").agg(F.count(F.lit(1)).alias("events"))


@query("P01_event_fields", "session_id:s us:i event_id:s event_type:s app:s window_title:s url:s text:s operator:s",
       """SELECT 'ses_' || CAST(session_id AS VARCHAR) AS session_id, us//1000*1000 AS us, CAST(event_id AS VARCHAR) AS event_id, event_type, app, window_title, url, nullif(trim(path),'') AS text, CAST(operator AS VARCHAR) AS operator FROM ev""", "ev")
def _(t):
    return rd.event_fields(rd.read_events(t.spark, staged_log(t), file_name="*.txt")).filter(F.col("session_id").isNotNull())


def staged_manifests(t: Tables) -> str:
    """One manifest per customer: processes are order statuses, executions are orders."""
    path = staging_path(t.spark, "manifests")
    o = t.read("orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.col("o_orderkey")
    execution = F.struct(F.when(key % 4 == 0, F.lit("own")).alias("code"), key.cast("string").alias("exec_id"), iso.alias("start_ts"),
                         F.when(key % 3 != 0, iso).alias("end_ts"), F.lit("v").alias("variant"), key.alias("seq"), (key % 2 == 0).alias("continues_to_next"))
    per_process = o.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(execution).alias("executions"))
    process = F.struct(F.col("o_orderstatus").alias("code"), F.concat(F.lit("family "), "o_orderstatus").alias("family_name"), "executions")
    per = per_process.groupBy("o_custkey").agg(F.collect_list(process).alias("processes"))
    body = per.select(F.col("o_custkey").cast("string").alias("session_id"), F.struct(F.lit("1992-01-01T00:00:00Z").alias("start_ts")).alias("session"), "processes")
    body.write.json(path)
    return path


@query("S04_explode_executions", "session_id:s process_code:s process_name:s exec_id:s start_us:i has_end:b continues_to_next:b",
       """SELECT CAST(o_custkey AS VARCHAR) AS session_id, CASE WHEN o_orderkey%4=0 THEN 'own' ELSE o_orderstatus END AS process_code, 'family ' || o_orderstatus AS process_name, CAST(o_orderkey AS VARCHAR) AS exec_id, epoch_us(o_orderdate) AS start_us,
  o_orderkey%3<>0 AS has_end, o_orderkey%2=0 AS continues_to_next FROM orders""")
def _(t):
    raw = t.spark.read.schema(rd.MANIFEST_SCHEMA).json(staged_manifests(t))
    out = rd.explode_executions(raw)
    return out.withColumn("start_us", F.unix_micros("start_ts")).withColumn("has_end", F.col("end_ts").isNotNull())


@query("S05_find_records", "exec_id:s start_ts:s variant:s",
       "SELECT CAST(o_orderkey AS VARCHAR) AS exec_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS start_ts, 'v' AS variant FROM orders")
def _(t):
    lines = rd.read_text_lines(t.spark, staged_manifests(t), "*.json")
    return vr.find_records(lines, [], "line", ["exec_id"], ["exec_id", "start_ts", "variant"])


@query("S06_read_boundaries", "session_id:s us:i event:s process_code:s",
       """SELECT CAST(session_id AS VARCHAR) AS session_id, us//1000*1000 AS us, event_type AS event, app AS process_code FROM ev WHERE event_type IN ('app_switch','keystroke')""", "ev")
def _(t):
    return _boundary_lines(t)[1]


def _boundary_lines(t):
    path = staging_path(t.spark, "boundaries")
    iso = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    t.events.select(F.col("session_id").cast("string").alias("session_id"), iso.alias("ts"), F.col("event_type").alias("event"), F.col("app").alias("process_code")).write.json(path)
    return path, rd.read_gt_boundaries(t.spark, path, ["app_switch", "keystroke"], "*.json").withColumn("us", F.unix_micros("ts"))


@query("S06_numbered_lines", "lines:i distinct_lines:i last_line:i", "SELECT count(*) AS lines, count(*) AS distinct_lines, count(*) AS last_line FROM ev", "ev")
def _(t):
    numbered = rd.numbered_lines(t.spark, _boundary_lines(t)[0], "*.json")
    per_file = numbered.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_line").alias("d"), F.max("source_line").alias("m"))
    return per_file.agg(F.sum("n").alias("lines"), F.sum("d").alias("distinct_lines"), F.sum("m").alias("last_line"))


@query("S07_read_table", "o_orderkey:i o_totalprice:d o_orderpriority:s", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(t):
    path = wr.write_table(t.read("orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), staging_path(t.spark, "orders"), "csv")
    return rd.read_table(t.spark, path, {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderpriority": "string"})


@query("S08_parse_event_lines", "session_id:s event_type:s ts:s app:s",
       "SELECT CAST(session_id AS VARCHAR) AS session_id, event_type, CAST(us//1000 AS VARCHAR) AS ts, app FROM ev", "ev")
def _(t):
    ms, sid = F.expr("us div 1000").cast("string"), F.col("session_id").cast("string")
    as_json = F.to_json(F.struct(F.col("session_id"), "event_type", ms.alias("timestamp_ms"), F.col("app").alias("app_name")))
    flat = F.concat(F.lit("session_id="), sid, F.lit(" | type="), F.col("event_type"), F.lit(" | ts="), ms, F.coalesce(F.concat(F.lit(" | app="), F.col("app")), F.lit("")))
    return rd.parse_event_lines(t.events.select(F.when(F.col("k") % 2 == 0, as_json).otherwise(flat).alias("line")), "line")


@query("S09_file_inventory", "files:i some_bytes:b wrongly_flagged:i", "SELECT count(DISTINCT o_orderpriority) AS files, true AS some_bytes, 0 AS wrongly_flagged FROM orders")
def _(t):
    path = staging_path(t.spark, "media")
    t.read("orders").select("o_orderkey", "o_orderpriority").repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    inv = rd.file_inventory(t.spark, path, [".parquet"])
    return inv.agg(F.sum("copies").alias("files"), (F.min("bytes") > 0).alias("some_bytes"),
                   F.count_if(F.col("ambiguous") != (F.col("copies") > 1)).alias("wrongly_flagged"))


@query("S09_inventory_of_paths", "name:s copies:i bytes:i first_path:s ambiguous:b",
       "SELECT name, count(*) AS copies, sum(n) AS bytes, min(p) AS first_path, count(*)>1 AS ambiguous FROM (SELECT regexp_extract(url, '([^/]*)$', 1) AS name, url AS p, length(html) AS n FROM pages) GROUP BY 1")
def _(t):
    return rd.inventory_of(t.read("pages").select(F.col("url").alias("path"), F.length("html").alias("length")))


@query("S09_ambiguous_paths", "name:s path:s copies:i",
       """SELECT name, p AS path, copies FROM (SELECT *, count(*) OVER (PARTITION BY name) AS copies FROM (SELECT regexp_extract(url, '([^/]*)$', 1) AS name, url AS p FROM pages)) WHERE copies>1""")
def _(t):
    return rd.paths_of(t.read("pages").select(F.col("url").alias("path"))).filter("ambiguous")


@query("S10_pick_best_copy", "lang:s source:s files:i bytes:i copies:i",
       """SELECT lang, arg_max(source, (n, b, source)) AS source, max(n) AS files, arg_max(b, (n, b, source)) AS bytes, count(*) AS copies FROM (SELECT lang, source, count(*) AS n, sum(n_chars) AS b FROM documents GROUP BY 1,2) GROUP BY 1""")
def _(t):
    return rd.pick_best_copy(t.read("documents"), "lang", "source", "n_chars")


@query("S11_write_table", "doc_id:i quality:i toxic:i", "SELECT * FROM labels")
def _(t):
    return t.spark.read.parquet(wr.write_table(t.read("labels"), staging_path(t.spark, "labels")))


@query("S12_write_segments_jsonl", "session_id:i segment_index:i segment_start:s segment_end:s label:s",
       """SELECT session_id, segment_index, strftime(make_timestamp(segment_start),'%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS segment_start, strftime(make_timestamp(segment_end),'%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS segment_end, label FROM seg JOIN vote USING (session_id, segment_index)""", "vote")
def _(t):
    segs = t.segments().join(voted(t), ["session_id", "segment_index"])
    return wr.write_segments_jsonl(segs, staging_path(t.spark, "segments"), ["session_id", "segment_index"])


@query("S13_write_bundle", "table:s rows:i", "SELECT 'labels' AS \"table\", count(*) AS rows FROM labels UNION ALL SELECT 'parts', count(*) FROM part")
def _(t):
    paths = wr.write_bundle({"labels": t.read("labels"), "parts": t.read("part")}, staging_path(t.spark, "bundle"))
    out = None
    for name, path in paths.items():
        one = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


CTES["lin"] = ("", "SELECT doc_id, unnest(string_split(text, chr(10))) AS term, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents")
CTES["dic"] = ("", "SELECT DISTINCT trm AS term, md5(trm) AS translation FROM (SELECT unnest(string_split(text, chr(10))) AS trm FROM documents WHERE n_chars<1500)")


def _dictionary(t):
    docs = t.read("documents").select("doc_id", F.split("text", "\n").alias("lines"), "n_chars")
    known = docs.filter("n_chars < 1500").select(F.explode("lines").alias("term")).distinct().withColumn("translation", F.md5("term"))
    return docs.drop("n_chars"), known


@query("S14_pending_terms", "term:s", "SELECT DISTINCT md5(term) AS term FROM lin WHERE term NOT IN (SELECT term FROM dic)", "lin dic")
def _(t):
    docs, known = _dictionary(t)
    return dc.pending_terms(docs, known, "lines").select(F.md5("term").alias("term"))


@query("S14_dictionary_enrich", "doc_id:i line_count:i translated_count:i translation_status:s digest:s",
       """SELECT doc_id, count(*) AS line_count, count(translation) AS translated_count, CASE WHEN count(translation)=count(*) THEN 'COMPLETE' WHEN count(translation)>0 THEN 'PARTIAL' ELSE 'PENDING' END AS translation_status,
  md5(coalesce(string_agg(translation, chr(10) ORDER BY pos),'')) AS digest FROM lin LEFT JOIN dic USING (term) GROUP BY 1""", "lin dic")
def _(t):
    docs, known = _dictionary(t)
    return dc.dictionary_enrich(docs, known, "doc_id", "lines").withColumn("digest", F.md5("translated_text"))
