"""Registry of checkable queries and the driver tables seen as a desktop event log.

A query has one column spec used for both engines: ``name:type`` with i (integer), d or dN
(double rounded to N, default 6), s (text), b (boolean as 0/1), l (list joined with ``|``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.columns import first_match
from tracewright.functions.text import hash_route
from tracewright.operators.features import session_span
from tracewright.operators.intervals import assign_events
from tracewright.operators.profiles import segment_profile
from tracewright.operators.segments import segments_from_boundaries

HOUR = 3_600_000_000
DAY = 24 * HOUR
CHUNK = 7 * DAY
STEP, WINDOW, GAP, TOL = 6 * HOUR, 18 * HOUR, 6 * HOUR, 12 * HOUR


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    select: str | None
    ctes: str

    @property
    def sql(self) -> str | None:
        return None if self.select is None else with_ctes(self.ctes) + self.select


REGISTRY: dict[str, Entry] = {}


def _spec(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _spark_col(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        return c.cast("long").alias(name)
    if kind == "b":
        return c.cast("boolean").cast("int").cast("long").alias(name)
    if kind == "l":
        return F.array_join(c, "|").alias(name)
    if kind.startswith("d"):
        return (F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)).alias(name)
    return c.cast("string").alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "b":
        return f'CAST(CAST("{name}" AS BOOLEAN) AS BIGINT) AS "{name}"'
    if kind == "l":
        return f"""array_to_string("{name}", '|') AS "{name}\""""
    if kind.startswith("d"):
        return f'ROUND(CAST("{name}" AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS "{name}"'
    return f'CAST("{name}" AS VARCHAR) AS "{name}"'


def query(name: str, spec: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``ctes`` names shared SQL definitions placed before ``sql``."""
    cols = _spec(spec)

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir)).select(*[_spark_col(n, k) for n, k in cols])

        text = None
        if sql is not None:
            text = f"SELECT {', '.join(_sql_col(n, k) for n, k in cols)} FROM ({sql}) AS _q"
        REGISTRY[name] = Entry(name, run, text, ctes)
        return fn

    return register


class Tables:
    """The driver tables and the desktop-log view of them; one object serves one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        raw = self.read("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
        k = F.col("k")
        kind = first_match([(k % 9 == 0, "clipboard_change"), (k % 9 == 1, "keystroke")]
                           + [(F.col("event_type") == a, b) for a, b in EVENT_MAP], "unknown")
        app = first_match([(k % 5 == i, a) for i, a in enumerate(APPS)], F.lit(None).cast("string"))
        ks = k.cast("string")
        url = first_match([(k % 6 == 0, F.concat(F.lit("https://hr.example.com/#/payroll-items/"), ks)),
                           (k % 6 == 1, F.concat(F.lit("https://hr.example.com/#/leave-applications?id="), ks)),
                           (k % 6 == 2, F.concat(F.lit("https://www.example.com:8080/employee/"), (k + 1000).cast("string"))),
                           (k % 6 == 3, F.lit("http://intra.example.org/staff/#top"))], F.lit(None).cast("string"))
        return raw.select(
            "event_id", F.col("user_id").alias("session_id"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), kind.alias("event_type"), "k", "value",
            app.alias("app"), F.concat(app, F.lit(" - Doc "), (k % 7).cast("string")).alias("window_title"),
            url.alias("url"), hash_route(url).alias("path"), (F.col("user_id") % 7).alias("operator"))

    @property
    def sessions(self) -> DataFrame:
        return session_span(self.events, "session_id", "us")

    def points(self, event_type: str) -> DataFrame:
        return self.events.filter(F.col("event_type") == event_type).select("session_id", "us", "event_id")

    def segments(self, event_type: str = "app_switch") -> DataFrame:
        if event_type not in self._made:
            self._made[event_type] = segments_from_boundaries(self.points(event_type), self.sessions, "session_id", "us", CHUNK)
        return self._made[event_type]

    def assigned(self) -> DataFrame:
        return assign_events(self.events, self.segments(), "session_id", "us", "event_id", "segment_index",
                             "segment_start", "segment_end", CHUNK, "half_open_last_closed")

    def profile(self) -> DataFrame:
        """Segment profiles with durations in hours standing for seconds."""
        if "profile" not in self._made:
            self._made["profile"] = segment_profile(self.assigned(), ["session_id", "segment_index"], "us", "event_id", CHUNK,
                                                    unit_per_second=HOUR)
        return self._made["profile"]


EVENT_MAP = (("view", "browser_navigation"), ("click", "browser_click"), ("purchase", "browser_form_input"),
             ("signup", "app_switch"), ("error", "window_title_change"))
APPS = ("Microsoft Edge", "Notepad", "Microsoft Word", "Microsoft Excel")

_KIND = " ".join(f"WHEN event_type='{a}' THEN '{b}'" for a, b in EVENT_MAP)
_APP = "CASE k%5 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(APPS)) + " END"


def _cut(event_type: str) -> str:
    return f"""SELECT session_id, us AS segment_start, nxt AS segment_end,
  row_number() OVER (PARTITION BY session_id ORDER BY us) AS segment_index
 FROM (SELECT *, lead(us) OVER (PARTITION BY session_id ORDER BY us) AS nxt FROM (
   SELECT session_id, us FROM ev JOIN sess USING (session_id)
    WHERE event_type='{event_type}' AND us>session_start AND us<session_end
   UNION SELECT session_id, session_start FROM sess UNION SELECT session_id, session_end FROM sess))
 WHERE nxt>us"""


def count_sql(kinds: str) -> str:
    return "count(*) FILTER (WHERE event_type IN (" + ",".join(f"'{k}'" for k in kinds.split(",")) + "))"


_PAGE = """CASE WHEN path LIKE '%payroll-items%' THEN 'PAYROLL_ITEMS' WHEN path LIKE '%leave-applications%' THEN
 'LEAVE_APPLICATIONS' WHEN path LIKE '%employee%' OR path LIKE '%staff%' THEN 'EMPLOYEE' ELSE 'OTHER_WEB_PAGE' END"""
BUCKET_SQL = """CASE WHEN duration_seconds IS NULL THEN 'UNKNOWN' WHEN duration_seconds<10 THEN '<10s'
 WHEN duration_seconds<20 THEN '10-20s' WHEN duration_seconds<40 THEN '20-40s' WHEN duration_seconds<60 THEN '40-60s'
 WHEN duration_seconds<120 THEN '1-2m' WHEN duration_seconds<300 THEN '2-5m' ELSE '5m+' END"""

# shared SQL definitions: name -> (needs, text)
CTES: dict[str, tuple[str, str]] = {
    "ev": ("", f"""SELECT event_id, session_id, us, event_type, k, value, app,
   app || ' - Doc ' || CAST(k%7 AS VARCHAR) AS window_title, url,
   trim(regexp_replace(regexp_replace(coalesce(url,''), '^.*?#/', ''), '[?#].*$', ''), '/') AS path, operator
  FROM (SELECT event_id, user_id AS session_id, epoch_us(ts) AS us, k, value, user_id%7 AS operator,
   CASE WHEN k%9=0 THEN 'clipboard_change' WHEN k%9=1 THEN 'keystroke' {_KIND} ELSE 'unknown' END AS event_type,
   {_APP} AS app,
   CASE k%6 WHEN 0 THEN 'https://hr.example.com/#/payroll-items/' || CAST(k AS VARCHAR)
    WHEN 1 THEN 'https://hr.example.com/#/leave-applications?id=' || CAST(k AS VARCHAR)
    WHEN 2 THEN 'https://www.example.com:8080/employee/' || CAST(k+1000 AS VARCHAR)
    WHEN 3 THEN 'http://intra.example.org/staff/#top' END AS url
   FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""),
    "sess": ("ev", "SELECT session_id, min(us) AS session_start, max(us) AS session_end FROM ev GROUP BY 1"),
    "seg": ("sess", _cut("app_switch")),
    "tru": ("sess", _cut("window_title_change")),
    "asg": ("seg", """SELECT e.*, s.segment_index, s.segment_start, s.segment_end FROM ev e JOIN sess USING (session_id)
  JOIN seg s ON s.session_id=e.session_id AND e.us>=s.segment_start
   AND (e.us<s.segment_end OR (e.us=s.segment_end AND s.segment_end=session_end))"""),
    "apc": ("asg", """SELECT session_id, segment_index, us, event_id, app FROM (SELECT *, lag(app) OVER (PARTITION BY
  session_id, segment_index ORDER BY us, event_id) AS pa FROM asg WHERE app IS NOT NULL) WHERE pa IS NULL OR pa<>app"""),
    "aps": ("apc", """SELECT session_id, segment_index, max(n) AS sequence_length,
   CASE WHEN max(n)<=8 THEN list(app ORDER BY i) ELSE list_concat(list_concat(list(app ORDER BY i) FILTER (WHERE i<=4),
    ['...']), list(app ORDER BY i) FILTER (WHERE i>n-4)) END AS app_sequence
  FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY session_id, segment_index) AS n FROM apc
   WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY us, event_id)) GROUP BY 1,2"""),
    "prof": ("aps", f"""SELECT *, {BUCKET_SQL} AS duration_bucket,
   CASE WHEN array_contains(apps,'Microsoft Edge') AND array_contains(apps,'Microsoft Word') THEN 'EDGE_WORD_WORKFLOW'
    WHEN array_contains(apps,'Microsoft Edge') AND array_contains(apps,'Notepad') THEN 'EDGE_NOTEPAD_WORKFLOW'
    WHEN array_contains(apps,'Microsoft Edge') AND array_contains(apps,'Microsoft Excel') THEN 'EDGE_EXCEL_WORKFLOW'
    WHEN app_count>=2 THEN 'OTHER_CROSS_APP' ELSE 'EDGE_ONLY_OR_SINGLE_APP' END
    || ' | ' || page_class || ' | ' || transfer_class || ' | ' || {BUCKET_SQL} AS family_signature FROM (
   SELECT *, CASE WHEN clipboard_count>0 AND form_count>0 AND sequence_length>=2 THEN 'CROSS_APP_DATA_TRANSFER'
    WHEN clipboard_count>0 AND sequence_length>=2 THEN 'CROSS_APP_CLIPBOARD' WHEN form_count>0 THEN 'FORM_INTERACTION'
    WHEN navigation_count>0 THEN 'NAVIGATION' WHEN sequence_length>=2 THEN 'CROSS_APP_OTHER'
    ELSE 'SINGLE_APP_ACTIVITY' END AS transfer_class,
    CASE WHEN len(page_classes)=0 THEN 'NO_PAGE' WHEN len(page_classes)=1 THEN page_classes[1] ELSE 'MULTI_PAGE' END AS page_class
   FROM (SELECT b.*, coalesce(a.sequence_length,0) AS sequence_length, a.app_sequence, len(apps) AS app_count,
     (segment_end-segment_start)/{HOUR}.0 AS duration_seconds FROM (
    SELECT session_id, segment_index, min(segment_start) AS segment_start, min(segment_end) AS segment_end,
     count(*) AS event_count, {count_sql('clipboard_change')} AS clipboard_count,
     {count_sql('keystroke,text_input_complete')} AS keyboard_count, {count_sql('browser_form_input')} AS form_count,
     {count_sql('browser_click')} AS browser_click_count, {count_sql('mouse_click')} AS mouse_click_count,
     {count_sql('browser_navigation')} AS navigation_count, {count_sql('app_switch')} AS app_switch_count,
     {count_sql('window_title_change,window_state_change')} AS window_change_count,
     {count_sql('screenshot_smart')} AS screenshot_count,
     list_sort(list(DISTINCT event_type)) AS event_types,
     coalesce(list_sort(list(DISTINCT app) FILTER (WHERE app IS NOT NULL)), []) AS apps,
     coalesce(list_sort(list(DISTINCT {_PAGE}) FILTER (WHERE path<>'')), []) AS page_classes,
     count(DISTINCT nullif(path,'')) AS path_count
    FROM asg GROUP BY 1,2) b LEFT JOIN aps a USING (session_id, segment_index)))"""),
}


def with_ctes(names: str) -> str:
    order: list[str] = []

    def visit(n):
        for dep in CTES[n][0].split():
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    if not order:
        return ""
    # materialised once: the oracle engine may otherwise expand a chain many times
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + " "
