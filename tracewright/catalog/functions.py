"""Scalar functions over whole columns of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.catalog.base import CHUNK, CTES, HOUR, Tables, query
from tracewright.functions import arrays as ar
from tracewright.functions import classify as cl
from tracewright.functions import columns as co
from tracewright.functions import scores as sc
from tracewright.functions import text as tx
from tracewright.operators import sequences as sq


def _r(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


_ids = r"\bE[0-9]{3,8}\b", r"\b[A-Z]{1,6}-[0-9]{4,12}(?:-[0-9]{1,6})?\b"


def mask_sql(c: str) -> str:
    out = _r(_r(_r(c, "(?i)" + _ids[0], "{ID}"), "(?i)" + _ids[1], "{ID}"), r"\b[0-9]{6,}\b", "{ID}")
    out = _r(_r(out, r"\b[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}\b", "{DATE}"), r"\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b", "{TIME}")
    return f"lower(trim({_r(_r(out, r'\b[0-9]{3,}\b', '{N}'), r'\s+', ' ')}))"


def token_sql(c: str) -> str:
    out = _r(_r(_r(f"lower(trim({c}))", r"\be[0-9]{3,8}\b", "{id}"), r"\b[a-z]{1,8}-[0-9]{4,12}(?:-[0-9]{1,6})?\b", "{id}"), r"\b[0-9]{6,}\b", "{n}")
    return f"trim({_r(out, r'\s+', ' ')})"


@query("F01_mask_ids", "doc_id:i masked:s", f"SELECT doc_id, md5({mask_sql('text')}) AS masked FROM documents")
def _(t):
    return t.read("documents").select("doc_id", F.md5(tx.mask_ids("text")).alias("masked"))


@query("F02_norm_token", "page_id:i token:s", f"SELECT page_id, {token_sql('url')} AS token FROM pages")
def _(t):
    return t.read("pages").select("page_id", tx.norm_token("url").alias("token"))


@query("F03_coarsen_title", "title:s events:i",
       r"""SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(window_title || ' - ' || app), '\s*-\s*microsoft edge.*$', ''),
  '\s*-\s*notepad.*$', ''), '\s*-\s*microsoft (word|excel).*$', ''), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS title, count(*) AS events FROM ev WHERE app IS NOT NULL GROUP BY 1""", "ev")
def _(t):
    e = t.events.filter(F.col("app").isNotNull())
    return e.groupBy(tx.coarsen_title(F.concat_ws(" - ", "window_title", "app")).alias("title")).agg(F.count(F.lit(1)).alias("events"))


@query("F04_norm_url_path", "page_id:i path:s",
       r"""SELECT page_id, lower(CASE WHEN p='' THEN '/' ELSE p END) AS path FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '\b[0-9]{6,}\b', '{id}', 'g'), '/[0-9]{3,}(/|$)', '/{id}\1', 'g'),
  '/[A-Fa-f0-9]{8,}(/|$)', '/{id}\1', 'g'), '/+', '/', 'g') AS p FROM pages)""")
def _(t):
    return t.read("pages").select("page_id", tx.norm_url_path("url").alias("path"))


@query("F05_route", "route:s path:s events:i",
       """SELECT CASE WHEN url LIKE '%/payroll-items%' THEN '/payroll-items' WHEN url LIKE '%/leave-applications%' THEN '/leave-applications'
  WHEN regexp_extract(url, '(?:https?://[^\\s/#]+)?(?:#)?(/[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*)', 1)<>'' THEN regexp_extract(url, '(?:https?://[^\\s/#]+)?(?:#)?(/[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*)', 1)
  ELSE 'UNKNOWN_ROUTE' END AS route, path, count(*) AS events FROM ev GROUP BY 1,2""".replace("\\\\", "\\"), "ev")
def _(t):
    return t.events.groupBy(tx.route("url").alias("route"), "path").agg(F.count(F.lit(1)).alias("events"))


@query("F06_url_domain", "domain:s pages:i",
       "SELECT regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)', 1), '^www\\.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1")
def _(t):
    return t.read("pages").groupBy(tx.url_domain("url").alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("F07_parse_list", "event_id:i items:l keys:l counted:i quoted:l",
       """SELECT event_id, [x for x in [event_type, coalesce(app,''), CAST(k AS VARCHAR)] if x<>''] AS items, ['k'] AS keys, k AS counted,
  [event_type, CAST(k AS VARCHAR)] AS quoted FROM ev""", "ev")
def _(t):
    ks = F.col("k").cast("string")
    line = F.concat_ws(" | ", F.col("event_type"), F.coalesce("app", F.lit("")), ks)
    props = t.read("events").select("event_id", "props")
    return t.events.join(props, "event_id").select(
        "event_id", tx.parse_list(line).alias("items"), tx.parse_list("props", "keys").alias("keys"),
        F.element_at(tx.parse_list(F.concat(F.lit("a=1 | k = x | k="), ks), "counter"), "k").alias("counted"),
        tx.parse_list(F.concat(F.lit("('"), F.col("event_type"), F.lit("', '"), ks, F.lit("')")), "literal").alias("quoted"))


@query("F08_norm_app", "app:s by_keyword:s by_exact:s tool:s events:i",
       """SELECT app, CASE app WHEN 'Microsoft Edge' THEN 'Browser' WHEN 'Notepad' THEN 'Notepad' WHEN 'Microsoft Word' THEN 'Word' WHEN 'Microsoft Excel' THEN 'Excel' ELSE 'UNKNOWN_APP' END AS by_keyword,
  coalesce(app,'') AS by_exact, CASE app WHEN 'Microsoft Edge' THEN 'Browser' WHEN 'Notepad' THEN 'DocumentTool' WHEN 'Microsoft Word' THEN 'DocumentTool' WHEN 'Microsoft Excel' THEN 'DocumentTool' ELSE 'OtherTool' END AS tool,
  count(*) AS events FROM ev GROUP BY ALL""", "ev")
def _(t):
    return t.events.groupBy("app", cl.norm_app("app").alias("by_keyword"), cl.norm_app(F.lower("app"), "exact").alias("by_exact"),
                            cl.norm_app("app", "tool").alias("tool")).agg(F.count(F.lit(1)).alias("events"))


@query("F09_duration_bucket", "bucket:s lines:i",
       """SELECT CASE WHEN d<10 THEN '<10s' WHEN d<20 THEN '10-20s' WHEN d<40 THEN '20-40s' WHEN d<60 THEN '40-60s' WHEN d<120 THEN '1-2m' WHEN d<300 THEN '2-5m' ELSE '5m+' END AS bucket,
  count(*) AS lines FROM (SELECT l_quantity*l_linenumber AS d FROM lineitem) GROUP BY 1""")
def _(t):
    d = F.col("l_quantity") * F.col("l_linenumber")
    return t.read("lineitem").groupBy(cl.duration_bucket(d).alias("bucket")).agg(F.count(F.lit(1)).alias("lines"))


_values = ("'pi-note'", "'la-ok'", "'btn-ob-ok'", "'si-note'", "'rt-other'", "'PI-OK'", "'xpi-note'", "'ob_note'")
_value_sql = "CASE k%8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_values)) + " END"
CTES["dom"] = ("ev", f"SELECT *, {_value_sql} AS v FROM ev")


def dom_events(t: Tables):
    value = F.element_at(F.array(*[F.lit(v.strip("'")) for v in _values]), (F.col("k") % 8 + 1).cast("int"))
    return t.events.withColumn("v", value)


@query("F10_prefix_evidence", "v:s plain:l buttons:l events:i",
       """SELECT v, CASE v WHEN 'pi-note' THEN ['pi','pi'] WHEN 'la-ok' THEN ['la','la'] WHEN 'si-note' THEN ['si','si'] WHEN 'PI-OK' THEN ['pi','pi'] ELSE CAST([] AS VARCHAR[]) END AS plain,
  CASE v WHEN 'pi-note' THEN ['pi','pi'] WHEN 'la-ok' THEN ['la','la'] WHEN 'si-note' THEN ['si','si'] WHEN 'PI-OK' THEN ['pi','pi'] WHEN 'btn-ob-ok' THEN ['ob','ob'] WHEN 'ob_note' THEN ['ob','ob'] ELSE CAST([] AS VARCHAR[]) END AS buttons,
  count(*) AS events FROM dom GROUP BY 1""", "dom")
def _(t):
    key = F.lit("id")
    return dom_events(t).groupBy("v", tx.prefix_hits(key, "v").alias("plain"), tx.prefix_hits(key, "v", buttons=True).alias("buttons")).agg(
        F.count(F.lit(1)).alias("events"))


@query("F11_signature_hash", "event_id:i signature:s redacted:s",
       """SELECT event_id, substr(sha1('{"c0":"' || event_type || '","c1":' || CAST(k AS VARCHAR) || '}'),1,16) AS signature, sha1(event_type) AS redacted FROM ev""", "ev")
def _(t):
    return t.events.select("event_id", tx.signature_hash("event_type", "k").alias("signature"), tx.redact("event_type").alias("redacted"))


@query("F12_field_token", "v:s token:s plain:s events:i",
       "SELECT v, 'field:id:' || lower(v) AS token, 'field:' || lower(v) AS plain, count(*) AS events FROM dom GROUP BY 1", "dom")
def _(t):
    return dom_events(t).groupBy("v", tx.field_token(F.concat(F.lit("id= "), F.col("v"))).alias("token"), tx.field_token("v").alias("plain")).agg(
        F.count(F.lit(1)).alias("events"))


@query("F13_app_variant", "app:s variant:s documents:l events:i",
       """SELECT app, CASE app WHEN 'Microsoft Word' THEN 'word' WHEN 'Notepad' THEN 'notepad' WHEN 'Microsoft Excel' THEN 'excel' ELSE 'browser' END AS variant,
  CASE app WHEN 'Microsoft Word' THEN ['Word/document'] WHEN 'Notepad' THEN ['Notepad/text'] WHEN 'Microsoft Excel' THEN ['Excel/spreadsheet'] ELSE CAST([] AS VARCHAR[]) END AS documents,
  count(*) AS events FROM ev GROUP BY 1""", "ev")
def _(t):
    return t.events.groupBy("app", cl.app_variant("app").alias("variant"), cl.document_patterns("app", "window_title").alias("documents")).agg(
        F.count(F.lit(1)).alias("events"))


@query("F14_page_and_transfer_class", "session_id:i segment_index:i page_class:s transfer_class:s family_signature:s", "SELECT * FROM prof", "prof")
def _(t):
    return t.profile()


_TYPES = {"app_switch": ("SWITCH_APPLICATION", "APP_TRANSITION"), "browser_navigation": ("NAVIGATE_BROWSER", "BROWSER"),
          "browser_form_input": ("ENTER_BROWSER_FORM", "BROWSER_FORM"), "browser_click": ("CLICK_BROWSER", "BROWSER"),
          "clipboard_change": ("CLIPBOARD_TRANSFER", "TRANSFER"), "window_title_change": ("WINDOW_CHANGE", "CONTEXT")}
_KEYS = {"Microsoft Word": ("EDIT_WORD", "DOCUMENT"), "Microsoft Excel": ("EDIT_EXCEL", "DOCUMENT"), "Notepad": ("EDIT_NOTEPAD", "DOCUMENT"),
         "Microsoft Edge": ("TYPE_BROWSER", "BROWSER_FORM")}


def _action_sql(i: int, other: str) -> str:
    return ("CASE " + " ".join(f"WHEN event_type='{k}' THEN '{v[i]}'" for k, v in _TYPES.items())
            + " ".join(f" WHEN event_type='keystroke' AND app='{k}' THEN '{v[i]}'" for k, v in _KEYS.items()) + f" ELSE '{other}' END")


CTES["act"] = ("asg", f"SELECT *, {_action_sql(0, 'TYPE')} AS action, {_action_sql(1, 'DESKTOP_INPUT')} AS family FROM asg")


def actions(t: Tables):
    out = t.assigned().withColumn("action", cl.action_class("event_type", "app"))
    return out.withColumn("family", cl.action_family("action"))


@query("F15_action_class", "event_id:i action:s family:s phase:s",
       """SELECT *, CASE WHEN family='BROWSER_FORM' THEN 'FORM_ENTRY' WHEN action='NAVIGATE_BROWSER' THEN 'BROWSER_NAVIGATION' WHEN family='BROWSER' THEN 'BROWSER_WORK'
  WHEN family='TRANSFER' THEN 'DATA_TRANSFER' WHEN family='DOCUMENT' THEN 'DOCUMENT_WORK' WHEN family='APP_TRANSITION' THEN 'APPLICATION_SWITCH' ELSE family END AS phase FROM act""", "act")
def _(t):
    return actions(t).withColumn("phase", cl.phase_class("action"))


def _collapse_sql(lst: str) -> str:
    return f"list_transform(list_filter(list_zip({lst}, list_prepend(CAST(NULL AS VARCHAR), {lst})[1:len({lst})]), lambda z: z[1] IS DISTINCT FROM z[2]), lambda z: z[1])"


_CLEAN = """CASE x WHEN 'BROWSER' THEN 'BROWSER_WORK' WHEN 'BROWSER_FORM' THEN 'FORM_ENTRY' WHEN 'TRANSFER' THEN 'DATA_TRANSFER' WHEN 'DOCUMENT' THEN 'DOCUMENT_WORK'
 WHEN 'APP_TRANSITION' THEN 'APPLICATION_SWITCH' ELSE x END"""
_CANON = "CASE x WHEN 'BROWSER' THEN 'BROWSER_WORK' WHEN 'APP_TRANSITION' THEN 'APPLICATION_SWITCH' ELSE x END"
CTES["fams"] = ("act", "SELECT session_id, segment_index, list(family ORDER BY us, event_id) AS fam FROM act GROUP BY 1,2")
CTES["seqs"] = ("fams", f"""SELECT session_id, segment_index, fam, {_collapse_sql("c")} AS clean, {_collapse_sql("o")} AS observed, {_collapse_sql("m")} AS skeleton FROM (
  SELECT *, list_filter(list_transform(fam, lambda x: {_CLEAN}), lambda x: x NOT IN ('EVIDENCE','CONTEXT','UNKNOWN','')) AS c,
   list_filter(list_transform(fam, lambda x: {_CANON}), lambda x: x NOT IN ('EVIDENCE','CONTEXT','')) AS o,
   list_filter(list_transform(fam, lambda x: {_CANON}), lambda x: x NOT IN ('EVIDENCE','CONTEXT','','APPLICATION_SWITCH','DESKTOP_INPUT')) AS m FROM fams)""")


def phase_sequences(t: Tables):
    """One row per segment with its ordered action families; repeats collapse before they are gathered."""
    packed = F.array_sort(F.collect_list(F.struct("us", "event_id", "family")))
    steps = actions(t).select("session_id", "segment_index", "us", "event_id", "family")
    return sq.collapse(steps, ["session_id", "segment_index"], "us", "family", CHUNK, ("event_id",)).groupBy("session_id", "segment_index").agg(F.transform(packed, lambda x: x["family"]).alias("fam"))


def clean_sequences(t: Tables):
    return phase_sequences(t).withColumn("clean", ar.clean_path("fam"))


@query("F16_clean_paths", "session_id:i segment_index:i clean:l observed:l skeleton:l", "SELECT * FROM seqs", "seqs")
def _(t):
    return phase_sequences(t).select("session_id", "segment_index", ar.clean_path("fam").alias("clean"), ar.observed_path("fam").alias("observed"),
                                     ar.mechanical_skeleton("fam").alias("skeleton"))


CTES["sig"] = ("prof seqs", """SELECT session_id, segment_index, event_count, duration_seconds, CASE WHEN len(browser)>0 THEN 'WEB' ELSE 'UNKNOWN_ROUTE' END || ' || apps=' || CASE WHEN len(apps)=0 THEN 'UNKNOWN_APP' ELSE array_to_string(apps,'>') END
  || ' || phases=' || CASE WHEN len(clean)=0 THEN 'UNKNOWN_PHASE' ELSE array_to_string(list_sort(list_distinct(clean)),'>') END || ' || clip=' || CASE WHEN clipboard_count>0 THEN '1' ELSE '0' END
  || ' || form=' || CASE WHEN form_count>0 THEN '1' ELSE '0' END || ' || nav=' || CASE WHEN navigation_count>0 THEN '1' ELSE '0' END AS signature
  FROM (SELECT p.*, s.clean, page_classes AS browser FROM prof p JOIN seqs s USING (session_id, segment_index))""")


def signatures(t: Tables):
    p = t.profile().join(clean_sequences(t), ["session_id", "segment_index"])
    web = F.when(F.size("page_classes") > 0, F.lit("WEB"))
    return p.withColumn("signature", cl.workflow_signature(
        web, F.array_join("apps", ">"), F.array_join(F.array_sort(F.array_distinct("clean")), ">"),
        F.col("clipboard_count") > 0, F.col("form_count") > 0, F.col("navigation_count") > 0))


@query("F17_workflow_signature", "session_id:i segment_index:i signature:s", "SELECT * FROM sig", "sig")
def _(t):
    return signatures(t)


@query("F18_contains_subsequence", "session_id:i segment_index:i has_pattern:b",
       "SELECT session_id, segment_index, contains('>' || array_to_string(clean,'>') || '>', '>BROWSER_WORK>FORM_ENTRY>') AS has_pattern FROM seqs", "seqs")
def _(t):
    return clean_sequences(t).withColumn("has_pattern", ar.contains_subseq("clean", ["BROWSER_WORK", "FORM_ENTRY"]))


@query("T09_truncate_sequence", "session_id:i segment_index:i short:l",
       "SELECT session_id, segment_index, CASE WHEN len(clean)<=5 THEN clean ELSE list_concat(list_concat(clean[1:2], ['...']), clean[len(clean)-2:]) END AS short FROM seqs", "seqs")
def _(t):
    return clean_sequences(t).withColumn("short", ar.truncate_seq("clean", 5))


@query("W08_collapse_array", "conv_id:i collapsed:l", f"""SELECT conv_id, {_collapse_sql('a')} AS collapsed FROM (
  SELECT conv_id, list(role || ' ' || text ORDER BY turn) AS a FROM conversations GROUP BY 1)""")
def _(t):
    packed = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(" "), "text").alias("v"))))
    c = t.read("conversations").groupBy("conv_id").agg(F.transform(packed, lambda x: x["v"]).alias("a"))
    return c.select("conv_id", ar.collapse("a").alias("collapsed"))


@query("F20_interaction_density", "session_id:i segment_index:i density:d complex:b priority:s",
       """SELECT session_id, segment_index, (clipboard_count+form_count+navigation_count+browser_click_count+mouse_click_count+keyboard_count)/nullif(duration_seconds,0)*10 AS density,
  app_count>=3 OR path_count>=2 OR event_count>=75 AS complex,
  CASE WHEN s<2 THEN 'LOW' WHEN s<4 THEN 'MEDIUM' WHEN s<6 THEN 'HIGH' ELSE 'VERY_HIGH' END AS priority FROM (SELECT *, CASE WHEN app_count>=3 OR path_count>=2 OR event_count>=75 THEN 2 ELSE 0 END
  + CASE WHEN app_count>=4 THEN 1 ELSE 0 END + CASE WHEN path_count>=3 THEN 1 ELSE 0 END + CASE WHEN duration_seconds>=120 THEN 1 ELSE 0 END AS s FROM prof)""", "prof")
def _(t):
    p = t.profile()
    inter = sum((F.col(c) for c in ("form_count", "navigation_count", "browser_click_count", "mouse_click_count", "keyboard_count")), F.col("clipboard_count"))
    cx = sc.complexity_flag("app_count", F.lit(0), "path_count", "event_count")
    no = F.lit(False)
    score = sc.review_score(no, no, no, cx, "app_count", "path_count", F.lit(0), "duration_seconds")
    return p.select("session_id", "segment_index", sc.interaction_density(inter, "duration_seconds").alias("density"), cx.alias("complex"),
                    sc.review_priority(score).alias("priority"))


_ACCENT = "[à-ÿ]"


@query("F21_script_lines", "doc_id:i has:b lines:i",
       f"""SELECT doc_id, regexp_matches(text, '{_ACCENT}') AS has, len([x for x in string_split(text, chr(10)) if regexp_matches(x, '{_ACCENT}')]) AS lines FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", tx.has_script("text", _ACCENT).alias("has"), F.size(tx.script_lines("text", _ACCENT)).alias("lines"))


_WORDS = ("tion", "the", "que", "sch", "ción")


@query("F22_vocabulary_hits", "doc_id:i hits:l", "SELECT doc_id, [x for x in ['tion','the','que','sch','ción'] if contains(lower(text), x)] AS hits FROM documents")
def _(t):
    return t.read("documents").select("doc_id", tx.vocab_hits("text", _WORDS).alias("hits"))


_RULES = ((r"th[ae]t?\b", "ENGLISH"), (r"eau|ou", "FRENCH"), (r"sch|ung", "GERMAN"))


@query("F23_regex_labels", "doc_id:i labels:l first:s",
       r"""SELECT doc_id, [x for x in [CASE WHEN regexp_matches(text,'(?i)th[ae]t?\b') THEN 'ENGLISH' END, CASE WHEN regexp_matches(text,'(?i)eau|ou') THEN 'FRENCH' END,
  CASE WHEN regexp_matches(text,'(?i)sch|ung') THEN 'GERMAN' END] if x IS NOT NULL] AS labels,
  CASE WHEN regexp_matches(text,'(?i)th[ae]t?\b') THEN 'ENGLISH' WHEN regexp_matches(text,'(?i)eau|ou') THEN 'FRENCH' WHEN regexp_matches(text,'(?i)sch|ung') THEN 'GERMAN' ELSE 'NONE' END AS first FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", tx.regex_labels("text", _RULES).alias("labels"), tx.first_label("text", _RULES, "NONE").alias("first"))


_FIELDS = ("Employee ID", "氏名", "amount (JPY)", "Order STATUS", "other", "適用日", "request type", "遡及区分")
_CANON_F = ("employee_id", "employee_name", "amount", "status", "", "effective_date", "request_type", "category")


@query("F24_canonical_field", "raw:s field:s events:i",
       "SELECT " + "CASE k%8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_FIELDS)) + " END AS raw, CASE k%8 "
       + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_CANON_F)) + " END AS field, count(*) AS events FROM ev GROUP BY 1,2", "ev")
def _(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in _FIELDS]), (F.col("k") % 8 + 1).cast("int"))
    e = t.events.withColumn("raw", raw)
    return e.groupBy("raw", tx.canonical_field("raw").alias("field")).agg(F.count(F.lit(1)).alias("events"))


# \\b of the oracle engine is ASCII-only, so its text has other letters replaced by a word character first
@query("F26_token_sets", "doc_id:i tokens:i concrete:l jaccard:d",
       r"""SELECT doc_id, len(tk) AS tokens, [x for x in list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(tt,'\b20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b'), regexp_extract_all(tt,'\b[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?\b')),
  list_concat(regexp_extract_all(tt,'\b[0-9]+(?:\.[0-9]{1,2})?\b'), regexp_extract_all(tt,'(?i)\b(?:INV|ID|EMP|P|E)[-_]?[A-Z0-9-]{2,}\b'))), lambda x: lower(x)))) if NOT contains(x, '_')] AS concrete,
  CASE WHEN len(list_distinct(list_concat(tk,lk)))=0 THEN 1 ELSE len(list_intersect(tk,lk))/len(list_distinct(list_concat(tk,lk))) END AS jaccard FROM (
   SELECT doc_id, regexp_replace(trim(text), '[^\x00-\x7F]', '_', 'g') AS tt, list_distinct(regexp_extract_all(lower(trim(text)), '[a-z0-9_]+|[ぁ-んァ-ン一-龥]{2,}')) AS tk,
    list_distinct(regexp_extract_all(lower(trim(string_split(text, chr(10))[1])), '[a-z0-9_]+|[ぁ-んァ-ン一-龥]{2,}')) AS lk FROM documents)""")
def _(t):
    first = F.element_at(F.split("text", "\n"), 1)
    d = t.read("documents").select("doc_id", "text", tx.token_set("text").alias("_t"), tx.token_set(first).alias("_l"))
    return d.select("doc_id", F.size("_t").alias("tokens"), F.array_sort(tx.concrete_tokens("text")).alias("concrete"), tx.set_jaccard("_t", "_l").alias("jaccard"))


_CASES = ("expense_reimbursement", "payroll_change", "dependent_deduction_change", "transportation_expense", "other_case")
_case_sql = "CASE o_orderkey%5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CASES)) + " END"
_emp_sql = "CASE WHEN o_orderkey%11=0 THEN ' ' ELSE 'E' || CAST(o_custkey AS VARCHAR) END"
_amt_sql = "CASE WHEN o_orderkey%7=0 THEN 'n/a' WHEN o_orderkey%7=1 THEN '-' || CAST(o_custkey AS VARCHAR) || '.50' ELSE '1,' || lpad(CAST(o_custkey%1000 AS VARCHAR),3,'0') || '.25' END"
_dat_sql = "CASE WHEN o_orderkey%13=0 THEN '1998/01/02' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


def case_records(t: Tables):
    o = t.read("orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return o.select(
        "o_orderkey", F.when(key % 11 == 0, " ").otherwise(F.concat(F.lit("E"), cust)).alias("emp"),
        F.element_at(F.array(*[F.lit(c) for c in _CASES]), (key % 5 + 1).cast("int")).alias("kind"),
        F.when(key % 7 == 0, "n/a").when(key % 7 == 1, F.concat(F.lit("-"), cust, F.lit(".50"))).otherwise(
            F.concat(F.lit("1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(".25"))).alias("amount"),
        F.when(key % 13 == 0, "1998/01/02").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))


CTES["rec"] = ("", f"""SELECT *, CASE WHEN trim(emp)='' THEN 'STOP_MISSING_REQUIRED_INPUT' WHEN kind='other_case' THEN 'STOP_UNSUPPORTED_REQUEST_TYPE'
  WHEN amount='n/a' OR (amount LIKE '-%' AND CAST(amount AS DOUBLE)<0) OR date LIKE '%/%' THEN 'STOP_INVALID_INPUT' ELSE 'VALID' END AS code
  FROM (SELECT o_orderkey, {_emp_sql} AS emp, {_case_sql} AS kind, {_amt_sql} AS amount, {_dat_sql} AS date FROM orders)""")


@query("F27_validate_record", "o_orderkey:i ok:b code:s amount_2dp:d effective_date_iso:s",
       """SELECT o_orderkey, code='VALID' AS ok, code, CASE WHEN code='VALID' THEN CAST(replace(amount,',','') AS DECIMAL(18,2)) END AS amount_2dp,
  CASE WHEN code='VALID' THEN date END AS effective_date_iso FROM rec""", "rec")
def _(t):
    checks = cl.validate_record("emp", "kind", "amount", "date")
    return case_records(t).select("o_orderkey", *[c.alias(n) for n, c in checks.items()])


_flag_text = {"A": "Please APPROVE this", "R": "rejected, hold for manual review", "N": "policy unclear"}
_flag_sql = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _flag_text.items()) + " END"


@query("F28_text_flags", "l_returnflag:s decision_context:b policy_exception_context:b lines:i",
       "SELECT l_returnflag, l_returnflag IN ('A','R') AS decision_context, l_returnflag IN ('R','N') AS policy_exception_context, count(*) AS lines FROM lineitem GROUP BY 1")
def _(t):
    text = co.lookup("l_returnflag", _flag_text)
    return t.read("lineitem").select("l_returnflag", *cl.text_flags(text)).groupBy("l_returnflag", "decision_context", "policy_exception_context").agg(
        F.count(F.lit(1)).alias("lines"))


@query("F28_human_gates", "l_orderkey:i gate:s",
       """SELECT DISTINCT l_orderkey, unnest(CASE l_returnflag WHEN 'A' THEN ['APPROVE'] ELSE ['HOLD','REJECT'] END) AS gate FROM lineitem WHERE l_returnflag IN ('A','R')""")
def _(t):
    from tracewright.operators.inventory import human_gates
    return human_gates(t.read("lineitem").withColumn("note", co.lookup("l_returnflag", _flag_text)), "note", ["l_orderkey"])


CTES["rep"] = ("prof", """SELECT *, CASE WHEN exception THEN 'EXCEPTION' WHEN gate AND target THEN 'HUMAN_GATE' WHEN event_count=0 THEN 'INSUFFICIENT_RAW_EVIDENCE' WHEN NOT source THEN 'STRUCTURAL_ONLY'
  WHEN NOT target THEN 'INSUFFICIENT_TARGET_EVIDENCE' WHEN NOT xform THEN 'TRANSFORM_REVIEW' WHEN len(variants)>0 THEN 'REPLAYABLE_WITH_VARIANT' ELSE 'REPLAYABLE' END AS replay FROM (
  SELECT *, keyboard_count>=2 AS exception, window_change_count>=3 AS gate, form_count>0 AS target, path_count>0 AS source, clipboard_count>0 OR path_count>1 AS xform,
   [x for x in [CASE WHEN app_count>1 THEN 'MULTI_APPLICATION' END, CASE WHEN app_switch_count>0 THEN 'APPLICATION_SWITCH' END] if x IS NOT NULL] AS variants FROM prof)""")


def replay(t: Tables):
    p = t.profile()
    c = F.col
    variants = F.array_compact(F.array(F.when(c("app_count") > 1, F.lit("MULTI_APPLICATION")), F.when(c("app_switch_count") > 0, F.lit("APPLICATION_SWITCH"))))
    p = p.withColumns({"exception": c("keyboard_count") >= 2, "gate": c("window_change_count") >= 3, "target": c("form_count") > 0,
                       "source": c("path_count") > 0, "xform": (c("clipboard_count") > 0) | (c("path_count") > 1), "variants": variants})
    return p.withColumn("replay", cl.replay_class("exception", "gate", "target", "event_count", "source", "xform", "variants"))


@query("F29_replay_class", "session_id:i segment_index:i replay:s variants:l", "SELECT * FROM rep", "rep")
def _(t):
    return replay(t)


@query("F31_item_score", "event_id:i score:d",
       f"""SELECT n.event_id, 1.0 + CASE WHEN transition_distance/{HOUR}.0<=1.5 THEN 12 ELSE 0 END + CASE WHEN click_distance/{HOUR}.0<=1.5 THEN 5 ELSE 0 END
  + CASE WHEN p BETWEEN 0 AND 0.2 OR p BETWEEN 0.4 AND 0.6 OR p BETWEEN 0.8 AND 1 THEN 0.5 ELSE 0 END AS score
  FROM nrf n JOIN (SELECT event_id, (us-segment_start)/(segment_end-segment_start) AS p FROM asg) USING (event_id)""", "nrf asg")
def _(t):
    return item_scores(t)


def item_scores(t: Tables):
    """Keystroke events as items, scored by their nearness to switches and clicks."""
    from tracewright.operators.nearest import nearest_features
    items = t.assigned().filter("event_type = 'keystroke'").select("session_id", "segment_index", "event_id", "us", "app",
                                                                  ((F.col("us") - F.col("segment_start")) / (F.col("segment_end") - F.col("segment_start"))).alias("p"))
    marks = {"transition": t.points("app_switch").drop("event_id"), "click": t.points("browser_click").drop("event_id")}
    out = nearest_features(items, marks, "session_id", "us", [], CHUNK)
    td, cd = F.col("transition_distance") / HOUR, F.col("click_distance") / HOUR
    return out.withColumn("near_transition", F.coalesce(td <= 1.5, F.lit(False))).withColumn("near_click", F.coalesce(cd <= 1.5, F.lit(False))).withColumn(
        "score", cl.item_score(td, cd, F.lit("browser_click"), "p"))


@query("F32_map_json", "session_id:i evidence:s",
       """SELECT session_id, '{' || string_agg('"' || event_type || '":' || CAST(n AS VARCHAR), ',' ORDER BY event_type) || '}' AS evidence FROM (SELECT session_id, event_type, count(*) AS n FROM ev GROUP BY 1,2) GROUP BY 1""", "ev")
def _(t):
    n = t.events.groupBy("session_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("session_id").agg(tx.map_json(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))).alias("evidence"))


@query("F33_precision_recall_f1", "lang:s precision:d recall:d f1:d",
       """SELECT lang, coalesce(tp/nullif(tp+fp,0),0) AS precision, coalesce(tp/nullif(tp+fn,0),0) AS recall, coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0) AS f1 FROM (
  SELECT lang, count(*) FILTER (WHERE quality=1 AND n_chars>=1000) AS tp, count(*) FILTER (WHERE quality=0 AND n_chars>=1000) AS fp, count(*) FILTER (WHERE quality=1 AND n_chars<1000) AS fn
  FROM documents JOIN labels USING (doc_id) GROUP BY 1)""")
def _(t):
    d = t.read("documents").join(t.read("labels"), "doc_id")
    hit, pos = F.col("n_chars") >= 1000, F.col("quality") == 1
    n = d.groupBy("lang").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    return n.select("lang", *co.prf("tp", "fp", "fn"))
