"""Row-level projections, predicates and audits, and schema-less JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.catalog.base import APPS, CHUNK, CTES, STEP, WINDOW, Tables, query
from tracewright.functions import columns as co
from tracewright.operators import features as ft
from tracewright.operators import inventory as nv
from tracewright.operators import relations as rl
from tracewright.sources import readers as rd
from tracewright.sources import variants as vr


@query("P02_first_nonblank", "event_id:i place:s", "SELECT event_id, coalesce(nullif(trim(path),''), app, event_type) AS place FROM ev", "ev")
def _(t):
    return t.events.select("event_id", co.first_nonblank("path", "app", "event_type").alias("place"))


@query("P03_event_time", "event_id:i micros:i",
       "SELECT event_id, CASE k%4 WHEN 0 THEN us//1000*1000 WHEN 1 THEN us//1000000*1000000 WHEN 2 THEN us ELSE us//1000*1000 END AS micros FROM ev", "ev")
def _(t):
    us, k = F.col("us"), F.col("k")
    millis, seconds = F.expr("us div 1000"), F.expr("us div 1000000")
    iso = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    raw = (F.when(k % 4 == 0, millis.cast("string")).when(k % 4 == 1, seconds.cast("string")).when(k % 4 == 2, iso).otherwise(F.lit("not a time")))
    e = t.events.select("event_id", raw.alias("first"), millis.alias("second"))
    return e.select("event_id", F.unix_micros(co.event_time("first", "second")).alias("micros"))


@query("P04_clean_events", "event_id:i event_type:s", "SELECT event_id, coalesce(CASE WHEN k%7=0 THEN NULL ELSE event_type END,'unknown') AS event_type FROM ev WHERE k%5<>4", "ev")
def _(t):
    k = F.col("k")
    e = t.events.withColumn("event_type", F.when(k % 7 != 0, F.col("event_type"))).withColumn("us", F.when(F.col("app").isNotNull(), F.col("us")))
    return rd.clean_events(e)


@query("P05_event_classes", "keyboard:i window_change:i browser:i desktop:i",
       """SELECT count(*) FILTER (WHERE event_type IN ('keystroke','text_input_complete')) AS keyboard, count(*) FILTER (WHERE event_type IN ('window_title_change','window_state_change')) AS window_change,
  count(*) FILTER (WHERE event_type LIKE 'browser%') AS browser, count(*) FILTER (WHERE event_type NOT LIKE 'browser%') AS desktop FROM ev""", "ev")
def _(t):
    return t.events.agg(*[co.count_class("event_type", c).alias(c) for c in ("keyboard", "window_change", "browser", "desktop")])


@query("P06_restrict_sessions", "o_orderkey:i", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING')")
def _(t):
    keep = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rl.restrict_sessions(t.read("orders"), keep, "o_custkey")


@query("P07_assert_keys", "o_orderkey:i o_custkey:i", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    return rl.assert_keys(t.read("orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("P08_audit_leakage", "column:s rows:i", "SELECT unnest(['case_id','label']) AS \"column\", (SELECT count(*) FROM labels) AS rows")
def _(t):
    table = t.read("labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("label"), F.col("toxic").alias("before_event_count"))
    found = F.explode(F.array(*[F.lit(c) for c in nv.audit_leakage(table.columns)]))
    return table.agg(F.count(F.lit(1)).alias("rows")).withColumn("column", found)


@query("P09_audit_features", "column:s is_numeric:b nulls:i infinite:i is_constant:b",
       " UNION ALL ".join(f"SELECT '{c}' AS \"column\", true AS is_numeric, 0 AS nulls, 0 AS infinite, count(DISTINCT {c})<=1 AS is_constant FROM cand" for c in vocab.FEATURE_COLUMNS), "cand")
def _(t):
    return nv.audit_features(ft.candidate_features(t.events, "session_id", "us", STEP, WINDOW), vocab.FEATURE_COLUMNS)


def json_events(t: Tables):
    """Events re-packed as nested JSON, so that search at any depth has something to find."""
    element = F.struct(F.col("event_type").alias("name"), F.col("k").cast("string").alias("value"), F.struct(F.col("app").alias("id")).alias("inner"))
    doc = F.struct(F.col("event_id").cast("string").alias("event_id"), F.struct(element.alias("element"), F.array(
        F.struct(F.col("path").alias("href"), F.lit(None).cast("long").alias("depth")),
        F.struct(F.lit(None).cast("string").alias("href"), F.col("k").alias("depth"))).alias("links")).alias("payload"), F.col("operator").alias("process_id"))
    return t.events.select("event_id", "session_id", "event_type", "app", "path", "k", F.to_json(doc).alias("doc"))


@query("P10_json_find", "event_id:i path:s value:s",
       """SELECT event_id, unnest(['payload.element.inner.id','payload.links[0].href','payload.element.value']) AS path, unnest([app, path, CAST(k AS VARCHAR)]) AS value FROM ev""".replace("unnest([app, path,", "unnest([app, ev.path,")
       .join(["SELECT * FROM (", ") WHERE value IS NOT NULL"]), "ev")
def _(t):
    return vr.json_find(json_events(t), ["event_id"], "doc", ["id", "href", "value"])


CTES["flat"] = ("ev", """SELECT * FROM (SELECT event_id, event_type, unnest(['payload.element.name','payload.element.value','payload.element.inner.id','payload.links[0].href','payload.links[1].depth']) AS path,
  unnest([event_type, CAST(k AS VARCHAR), app, ev.path, CAST(k AS VARCHAR)]) AS value FROM ev) WHERE value IS NOT NULL AND value<>''""")


@query("P11_json_flatten", "event_id:i path:s value:s", "SELECT * FROM flat", "flat")
def _(t):
    return vr.json_flatten(json_events(t), ["event_id"], "doc")


def deep_events(t):
    """Events whose payload lies 1 to 13 objects and arrays deep, every fourth a text of over 1000 characters."""
    k = F.col("k")
    n = (k % 13).cast("int")
    value = F.concat(F.when(k % 4 == 0, F.repeat(F.lit("x"), 1200)).otherwise(F.lit("y")), k.cast("string"))
    doc = F.concat(F.repeat(F.lit('{"n":['), n), F.lit('{"deep":"'), value, F.lit('"}'), F.repeat(F.lit("]}"), n))
    return t.events.select("event_id", doc.alias("doc"))


_DEEP = """SELECT event_id, repeat('n[0].', CAST(k%13 AS INTEGER)) || 'deep' AS path,
  CASE WHEN k%4=0 THEN repeat('x', 1200) ELSE 'y' END || CAST(k AS VARCHAR) AS value FROM ev"""


@query("P11_json_flatten_deep", "event_id:i path:s value:s", _DEEP, "ev")
def _(t):
    return vr.json_flatten(deep_events(t), ["event_id"], "doc")


@query("P11_json_flatten_short", "event_id:i path:s value:s", _DEEP + " WHERE k%4<>0", "ev")
def _(t):
    return vr.json_flatten(deep_events(t), ["event_id"], "doc", max_len=1000)


@query("P10_json_find_deep", "event_id:i path:s value:s", _DEEP, "ev")
def _(t):
    return vr.json_find(deep_events(t), ["event_id"], "doc", ["deep"])


@query("S05_find_records_deep", "event_id:i deep:s", f"SELECT event_id, value AS deep FROM ({_DEEP})", "ev")
def _(t):
    return vr.find_records(deep_events(t), ["event_id"], "doc", ["deep"], ["deep"])


@query("P12_payload_scalars", "event_id:i event_type:s path:s value:s",
       """SELECT event_id, event_type, path, value FROM flat WHERE event_type<>'keystroke' UNION ALL SELECT event_id, event_type, 'k', CAST(k AS VARCHAR) FROM ev WHERE event_type='keystroke'""", "flat")
def _(t):
    e = json_events(t).withColumn("keys", F.to_json(F.struct("k")))
    return vr.payload_scalars(e, ["event_id"], "event_type", {"keystroke": "keys"}, "doc")


@query("F25_structured_case", "session_id:i field:s value:s provenance:s",
       """SELECT DISTINCT session_id, CASE k%3 WHEN 0 THEN 'amount' WHEN 1 THEN 'status' ELSE 'employee_id' END AS field, CAST(k AS VARCHAR) AS value, 'SIBLING' AS provenance FROM ev
 UNION ALL SELECT DISTINCT session_id, 'category', event_type, 'KEY' FROM ev""", "ev")
def _(t):
    k = F.col("k")
    field = F.when(k % 3 == 0, "金額").when(k % 3 == 1, "status").otherwise("Employee ID")
    doc = F.struct(F.struct(field.alias("name"), k.cast("string").alias("value")).alias("field_input"), F.col("event_type").alias("category"))
    e = t.events.select("event_id", "session_id", F.to_json(doc).alias("doc"))
    scalars = vr.json_flatten(e, ["event_id", "session_id"], "doc")
    return vr.structured_case(scalars, ["event_id", "session_id"], ["session_id"]).select("session_id", "field", "value", "provenance").distinct()
