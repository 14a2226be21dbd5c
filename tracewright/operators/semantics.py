"""Semantic records: what a text says about a case, and what is frequent in each family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions.text import first_label

#: Kinds of labels a text can carry, each with its rules (pattern, label) in order.
RULES: Mapping[str, Sequence[tuple[str, str]]] = {
    "request": vocab.REQUEST_RULES, "field": vocab.FIELD_RULES, "status": vocab.STATUS_RULES, "action": vocab.ACTION_RULES,
    "document": vocab.DOCUMENT_RULES, "instruction": vocab.INSTRUCTION_RULES, "decision": vocab.DECISION_RULES, "case": vocab.CASE_RULES,
}


def semantic_labels(text: Column, rules: Mapping[str, Sequence[tuple[str, str]]] = RULES) -> Column:
    """array<struct<kind, value>> of every rule that the text meets, in the order of the rules; one pass of one table of rules."""
    body = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(F.rlike(body, F.lit("(?i)" + pattern)), F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("value")))
                                     for kind, some in rules.items() for pattern, label in some]))


def of_kinds(labels: str, kinds: Sequence[str]) -> Column:
    """The labels of these kinds."""
    return F.filter(labels, lambda x: x["kind"].isin(*kinds))


def semantic_record(df: DataFrame, text: str, rules: Mapping[str, Sequence[tuple[str, str]]] = RULES) -> DataFrame:
    """Add ``labels``, a column of values for each kind of rule, ``object`` (the first that fits, or '') and
    ``human_gate``: whether a person has to decide (F23).  A null text has no labels."""
    out = df.withColumn("labels", F.explode(F.array(semantic_labels(F.col(text), rules))))
    for kind in rules:
        out = out.withColumn(kind, F.array_distinct(F.transform(of_kinds("labels", [kind]), lambda x: x["value"])))
    return (out.withColumn("object", first_label(text, vocab.OBJECT_RULES, ""))
            .withColumn("human_gate", F.rlike(F.coalesce(text, F.lit("")), F.lit(vocab.HUMAN_GATE_TEXT))))


def semantic_lists(records: DataFrame, family: str, session: str, segment: str, score: str, labels: str, lists: Mapping[str, Sequence[str]],
                   others: Mapping[str, str], k: int = 12) -> DataFrame:
    """One row for each family, and one over all (family null), with its most frequent values.

    ``lists`` names an output column and the kinds of ``labels`` that it counts; ``others`` an output column
    and the column counted.  A list holds the k most frequent values as ``value (n)``, the smaller first on a
    tie; only those are gathered.  Families and the whole are counted together by grouping sets; without records there is no row.
    """
    def named(list_name, values):
        return F.transform(values, lambda x: F.struct(F.lit(list_name).alias("list"), x["value"].alias("value")))

    parts = [named(name, of_kinds(labels, kinds)) for name, kinds in lists.items()]
    parts += [F.when(F.coalesce(F.col(col), F.lit("")) != "", F.array(F.struct(F.lit(name).alias("list"), F.col(col).cast("string").alias("value"))))
              .otherwise(F.array().cast("array<struct<list:string,value:string>>")) for name, col in others.items()]
    rows = records.filter(F.col(family).isNotNull())
    hits = rows.select(family, F.explode(F.array_distinct(F.concat(*parts))).alias("_h")).select(family, "_h.list", "_h.value")
    counts = hits.groupingSets([[F.col(family), F.col("list"), F.col("value")], [F.col("list"), F.col("value")]], family, "list", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy(family, "list").orderBy(F.col("n").desc(), "value"))).filter(F.col("r") <= k)
    shown = F.array_sort(F.collect_list(F.struct("r", F.concat("value", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("v"))))
    wide = best.groupBy(family, "list").agg(F.array_join(F.transform(shown, lambda x: x["v"]), " | ").alias("v")).groupBy(family).pivot("list", [*lists, *others]).agg(F.first("v"))
    stats = rows.groupingSets([[F.col(family)], []], family).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(session, segment).alias("segments"),
                                                                  F.count_distinct(session).alias("sessions"), F.avg(score).alias("mean_score"))
    lists_of = wide.withColumnRenamed(family, "_family")
    out = stats.join(lists_of, F.col(family).eqNullSafe(F.col("_family")), "left").drop("_family")
    return out.select(family, "records", "segments", "sessions", "mean_score", *[F.coalesce(c, F.lit("")).alias(c) for c in [*lists, *others]])
