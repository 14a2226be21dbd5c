"""Schema-less JSON: find keys and flatten scalars at any depth with VARIANT columns.

A frontier of open containers is opened level by level; scalars leave as soon as they are found, so no
row passes more levels than its own depth.  After ``LEVELS`` levels, and for texts that the variant parser
refuses (nested over 1,000 levels, or too long), a tokenizer without such limits walks what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright import vocab
from tracewright.session import staged
from tracewright.sources import jsontext

#: Levels opened as variants; what lies deeper is walked as text.
LEVELS = 8


def _is_container(v: Column) -> Column:
    return F.substring(F.schema_of_variant(v), 1, 5).isin("OBJEC", "ARRAY")


def _walk(df: DataFrame, keep: Sequence[str], json_col: str, interior: bool, deep: Callable) -> DataFrame:
    """(keep, path, leaf, _v, _text) of every scalar of the texts that parse, with ``interior`` of every container too.

    ``deep`` finds values in the text of what lies below the frontier; such containers come as ``_text``.
    """
    # an explosion of one element keeps the optimiser from writing the text and its parsing out again at every use
    rows = df.select(*keep, F.explode(F.array(json_col)).alias("_text")).filter(F.col("_text").isNotNull())
    rows = rows.select(*keep, "_text", F.explode(F.array(F.try_parse_json("_text"))).alias("_v"))
    rows = staged(rows.select(*keep, F.lit("").alias("path"), F.lit("").alias("leaf"), "_v", F.when(F.col("_v").isNull(), F.col("_text")).alias("_text"),
                              F.coalesce(_is_container(F.col("_v")), F.lit(False)).alias("_open")), "level")
    refused = rows.filter("_v is null").select(*keep, "path", "leaf", "_text", F.lit(False).alias("_inner"))
    tvf = SparkSession.getActiveSession().tvf
    parts, level = [], 0
    while True:
        parts.append(rows.filter(F.col("_v").isNotNull() & (F.lit(interior) | ~F.col("_open"))).select(*keep, "path", "leaf", "_v", F.lit(None).cast("string").alias("_text")))
        frontier = rows.filter("_open")
        if frontier.isEmpty():
            texts = refused
            break
        if level == LEVELS:
            # what was found on the frontier is not found again below it
            texts = refused.unionByName(frontier.select(*keep, "path", "leaf", F.to_json("_v").alias("_text"), F.lit(True).alias("_inner")))
            break
        found = frontier.lateralJoin(tvf.variant_explode(F.col("_v").outer()))
        rows = staged(found.select(
            *keep, _joined(F.col("path"), F.col("key"), F.col("pos")).alias("path"), F.coalesce("key", "leaf").alias("leaf"), F.col("value").alias("_v"),
            F.lit(None).cast("string").alias("_text"), _is_container(F.col("value")).alias("_open")), "level")
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if not texts.isEmpty():
        kept = [texts.schema[k] for k in keep]
        schema = T.StructType([*kept, T.StructField("path", T.StringType()), T.StructField("leaf", T.StringType()),
                               T.StructField("_text", T.StringType()), T.StructField("_container", T.BooleanType())])
        below = texts.mapInArrow(jsontext.each(deep, len(kept), to_arrow_schema(schema)), schema)
        below = below.select(*keep, "path", "leaf", F.when(~F.col("_container"), F.try_parse_json("_text")).alias("_v"), "_text")
        out = out.unionByName(below.withColumn("_text", F.when(F.col("_v").isNull(), F.col("_text"))))
    return out


def _joined(path: Column, key: Column, pos: Column) -> Column:
    named = F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))
    return F.when(key.isNotNull(), named).otherwise(F.concat(path, F.lit("["), pos.cast("string"), F.lit("]")))


def json_flatten(df: DataFrame, keep: Sequence[str], json_col: str, drop_leaf_regex: str = vocab.JSON_NOISE_KEY,
                 max_len: int | None = None) -> DataFrame:
    """Scalars of a JSON column as (path, leaf, value) rows without noise keys (P11); ``max_len`` drops longer texts."""
    nodes = _walk(df, keep, json_col, False, jsontext.scalars)
    # a single string too long for a variant stands as its literal
    value = F.trim(F.coalesce(F.try_variant_get(F.col("_v"), "$", "string"), "_text"))
    out = (nodes.select(*keep, "path", "leaf", value.alias("value"))
           .filter(F.col("value").isNotNull() & (F.col("value") != "") & ~F.rlike(F.col("leaf"), F.lit(drop_leaf_regex))))
    return out if max_len is None else out.filter(F.length("value") <= max_len)


def json_find(df: DataFrame, keep: Sequence[str], json_col: str, keys: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """All values, containers too, under the given keys at any depth (P10)."""
    leaf = F.lower("leaf") if ignore_case else F.col("leaf")
    wanted = [k.lower() if ignore_case else k for k in keys]
    nodes = _walk(df, keep, json_col, True, jsontext.named(frozenset(wanted), ignore_case)).filter(leaf.isin(*wanted))
    return nodes.filter((F.col("path") != "") & ~F.endswith("path", F.lit("]"))).select(
        *keep, "path", "leaf", F.coalesce("_text", F.try_variant_get(F.col("_v"), "$", "string"), F.to_json("_v")).alias("value"))


def find_records(df: DataFrame, keep: Sequence[str], json_col: str, required_any: Sequence[str],
                 fields: Sequence[str]) -> DataFrame:
    """Objects anywhere in the JSON that hold one of the required keys, read as flat records and
    de-duplicated on all fields (S05)."""
    nodes = _walk(df, keep, json_col, True, jsontext.records(frozenset([*required_any, *fields])))

    def get(name):
        return F.try_variant_get(F.col("_v"), f"$.{name}", "string")

    wanted = F.lit(False)
    for name in required_any:
        wanted = wanted | get(name).isNotNull()
    objects = nodes.filter(F.startswith(F.schema_of_variant(F.col("_v")), F.lit("OBJECT")) & wanted)
    return objects.select(*keep, *[get(f).alias(f) for f in fields]).dropDuplicates()


def payload_scalars(df: DataFrame, keep: Sequence[str], event_type: str, containers: Mapping[str, str], default: str,
                    max_len: int | None = None) -> DataFrame:
    """Scalars of the column that carries the payload of each event type."""
    chosen = F.col(default)
    for kind, column in containers.items():
        chosen = F.when(F.col(event_type) == kind, F.col(column)).otherwise(chosen)
    rows = df.withColumn("_payload", chosen)
    return json_flatten(rows, [*keep, event_type], "_payload", max_len=max_len).dropDuplicates()


def structured_case(scalars: DataFrame, event_keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Field/value pairs of a case with provenance.

    A field name and a value that are siblings in one event form a pair; other scalars whose
    key is a known field name stand for themselves.
    """
    from tracewright.functions.text import canonical_field
    parent = F.regexp_replace("path", r"\.?[^.]*$", "")
    rows = scalars.withColumn("_parent", parent)
    names = rows.filter(F.lower("leaf").isin("name", "field", "field_name", "id", "label", "target_field")).select(
        *event_keys, "_parent", canonical_field("value").alias("field"), F.col("path").alias("name_path"))
    values = rows.filter(F.lower("leaf").isin("value", "text", "content", "new_value")).select(
        *event_keys, "_parent", "value", F.col("path").alias("value_path"), *[c for c in group if c not in event_keys])
    siblings = (names.filter(F.col("field") != "").join(values, [*event_keys, "_parent"])
                .select(*group, "field", "value", F.col("value_path").alias("path"), F.lit("SIBLING").alias("provenance")))
    direct = (rows.withColumn("field", canonical_field("leaf")).filter(F.col("field") != "")
              .select(*group, "field", "value", "path", F.lit("KEY").alias("provenance")))
    return siblings.unionByName(direct).distinct()
