"""Scans of event logs, manifests, tables and file inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.columns import blank_to_null, event_time, first_nonblank
from tracewright.operators.relations import CheckFailed
from tracewright.operators.timeline import rank_in_buckets

_TAB = "struct<url:string,href:string>"
EVENT_SCHEMA = (
    "session_id string, timestamp_ms bigint, timestamp_iso string, event_type string, layer string, event_id string, "
    "correlation struct<chunk_id:string,sequence_number:bigint>, "
    "context struct<active_app:struct<app_name:string,process_name:string,window_title:string>,"
    f"browser:struct<url:string>,active_browser_tab:{_TAB},extracted_text:string>, "
    "payload variant, extensions variant, source struct<username_hash:string>, _corrupt string"
)


def read_events(spark: SparkSession, root: str, schema: str | T.StructType = EVENT_SCHEMA,
                file_name: str = "events.jsonl") -> DataFrame:
    """Every event file below a folder (S01).  Blank lines vanish; malformed lines stay as rows
    with ``_corrupt`` set, and ``source_file`` names their file."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
           .schema(schema).json(root))
    return raw.withColumn("source_file", F.col("_metadata.file_path"))


def malformed_lines(events: DataFrame) -> DataFrame:
    """Lines that are no JSON object, with their file.

    The parser must be asked for a data column as well, hence the test on the session.
    """
    return events.filter(F.col("_corrupt").isNotNull() & F.col("session_id").isNull()).select("source_file", "session_id", "_corrupt")


def read_text_lines(spark: SparkSession, root: str, file_name: str = "*.jsonl") -> DataFrame:
    """(source_file, line) for non-blank lines."""
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name).text(root)
            .select(F.col("_metadata.file_path").alias("source_file"), F.trim("value").alias("line"))
            .filter(F.col("line") != ""))


def with_path_tags(df: DataFrame, patterns: Mapping[str, str], path: str = "source_file") -> DataFrame:
    """Columns taken from the file path, such as the data set (S02) or session and chunk ids."""
    return df.withColumns({name: F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for name, p in patterns.items()})


SESSION_TAGS = {"path_session": r"/(ses_[^/]+)/", "path_chunk": r"/(chunk_[^/]+)/"}

EXECUTION = ("struct<code:string,variant:string,case_id:string,start_ts:string,end_ts:string,phase:string,exec_id:string,"
             "seq:bigint,split_id:string,continues_from_prev:boolean,continues_to_next:boolean>")
MANIFEST_SCHEMA = ("session_id string, session struct<start_ts:string,end_ts:string>, processes array<struct<code:string,"
                   f"family_name:string,domain:string,executions:array<{EXECUTION}>>>")


def read_manifests(spark: SparkSession, root: str, file_name: str = "*.json") -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
            .option("multiLine", True).schema(MANIFEST_SCHEMA).json(root))


def explode_executions(manifests: DataFrame) -> DataFrame:
    """One row per execution with its process and session fields (S04); processes without
    executions stay as one row."""
    per_process = manifests.select("session_id", "session", F.explode_outer("processes").alias("p"))
    rows = per_process.select("session_id", "session", "p", F.explode_outer("p.executions").alias("e"))
    return rows.select(
        "session_id", F.coalesce("e.code", "p.code").alias("process_code"), F.col("p.family_name").alias("process_name"),
        F.col("p.domain").alias("domain"), "e.variant", "e.case_id", event_time("e.start_ts").alias("start_ts"),
        event_time("e.end_ts").alias("end_ts"), "e.phase", "e.exec_id", "e.seq", "e.split_id",
        F.coalesce("e.continues_from_prev", F.lit(False)).alias("continues_from_prev"),
        F.coalesce("e.continues_to_next", F.lit(False)).alias("continues_to_next"),
        event_time("session.start_ts").alias("session_start"), event_time("session.end_ts").alias("session_end"))


BOUNDARY_SCHEMA = ("session_id string, ts string, event string, `from` string, `to` string, process_code string, "
                   "case_id string, split_id string, phase string")


def read_gt_boundaries(spark: SparkSession, root: str, events: Sequence[str] = (), file_name: str = "*.jsonl") -> DataFrame:
    """Strict boundary lines: a malformed line fails the read."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
           .option("mode", "FAILFAST").schema(BOUNDARY_SCHEMA).json(root))
    out = raw.withColumn("source_file", F.col("_metadata.file_path")).withColumn("ts", event_time("ts"))
    return out.filter(F.col("event").isin(*events)) if events else out


def numbered_lines(spark: SparkSession, root: str, file_name: str = "*.jsonl") -> DataFrame:
    """Non-blank lines with their number in the file (S06), for provenance.

    Lines are numbered inside a file block, in reading order, and shifted by the lines of the
    blocks before it, so a file may be of any size.
    """
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name).text(root)
           .select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.col("value").alias("line"), F.monotonically_increasing_id().alias("_seen")))
    numbered = rank_in_buckets(raw, "source_file", F.col("_block"), [F.col("_seen")], "source_line")
    return numbered.filter(F.trim("line") != "").select("source_file", "source_line", "line")


def read_table(spark: SparkSession, path: str, required: Mapping[str, str]) -> DataFrame:
    """CSV with a header; the required columns must be there and are cast strictly."""
    raw = spark.read.option("header", True).csv(path)
    first = raw.columns[0] if raw.columns else ""
    if first.startswith("﻿"):
        raw = raw.withColumnRenamed(first, first.lstrip("﻿"))
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise CheckFailed(f"missing columns {missing}")
    return raw.withColumns({c: F.nullif(F.trim(c), F.lit("")).cast(t) for c, t in required.items()})


LINE_FIELDS = {"session_id": ("session_id",), "event_type": ("event_type", "type"), "app": ("app", "app_name"),
               "ts": ("timestamp_ms", "timestamp", "ts"), "url": ("url",)}


def parse_event_lines(df: DataFrame, line: str, fields: Mapping[str, Sequence[str]] = LINE_FIELDS) -> DataFrame:
    """JSON or flattened ``key=value`` lines read by one tolerant expression per field."""
    def field(names):
        found = []
        for n in names:
            found.append(F.get_json_object(line, f"$.{n}"))
            found.append(F.nullif(F.regexp_extract(line, rf"(?:^|[\s|;,]){n}\s*[=:]\s*\"?([^|;,\"]*)", 1), F.lit("")))
        return first_nonblank(*found)
    return df.withColumns({name: field(names) for name, names in fields.items()})


def file_inventory(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """Files by base name with all their paths (S09); contents are never read."""
    ext = "|".join(e.lstrip(".") for e in extensions)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
             .filter(F.rlike(F.lower("path"), F.lit(rf"\.({ext})$"))))
    return inventory_of(files)


def inventory_of(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """Base name, number of copies, total bytes and the paths."""
    return (files.groupBy(F.substring_index(path, "/", -1).alias("name"))
            .agg(F.count(F.lit(1)).alias("copies"), F.sum(size).alias("bytes"), F.min(path).alias("first_path"))
            .withColumn("ambiguous", F.col("copies") > 1))


def paths_of(files: DataFrame, path: str = "path") -> DataFrame:
    """Every path with its base name and how many files have that name: the long form of the inventory."""
    named = files.select(F.substring_index(path, "/", -1).alias("name"), F.col(path).alias("path"))
    copies = named.groupBy("name").agg(F.count(F.lit(1)).alias("copies"))
    return named.join(copies, "name").withColumn("ambiguous", F.col("copies") > 1)


def pick_best_copy(files: DataFrame, key: str, root: str, size: str) -> DataFrame:
    """Fullest physical copy of each key: most files, then bytes, then path."""
    per = files.groupBy(key, root).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b"))
    return per.groupBy(key).agg(F.max(F.struct("_n", "_b", root)).alias("_m"), F.count(F.lit(1)).alias("copies")).select(
        key, F.col(f"_m.{root}").alias(root), F.col("_m._n").alias("files"), F.col("_m._b").alias("bytes"), "copies")


def event_fields(df: DataFrame) -> DataFrame:
    """Flat null-safe view of nested events."""
    payload = [F.try_variant_get("payload", f"$.{k}", "string") for k in ("url", "current_url", "target_url")]
    return df.select(
        "session_id", F.unix_micros(event_time("timestamp_ms", "timestamp_iso")).alias("us"),
        blank_to_null("event_type").alias("event_type"), "layer", "event_id",
        F.col("correlation.chunk_id").alias("chunk_id"), F.col("correlation.sequence_number").alias("seq"),
        blank_to_null("context.active_app.app_name").alias("app"),
        blank_to_null("context.active_app.window_title").alias("window_title"),
        first_nonblank("context.active_browser_tab.url", "context.active_browser_tab.href", *payload).alias("url"),
        blank_to_null("context.extracted_text").alias("text"), F.col("source.username_hash").alias("operator"))


def clean_events(df: DataFrame, session: str = "session_id", ts: str = "us") -> DataFrame:
    """Rows with a session and a time; a missing type becomes "unknown" (P04)."""
    return df.filter(F.col(session).isNotNull() & F.col(ts).isNotNull()).withColumn(
        "event_type", F.coalesce("event_type", F.lit("unknown")))
