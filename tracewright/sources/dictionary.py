"""Dictionary enrichment of text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(docs: DataFrame, id: str, lines: str) -> DataFrame:
    return docs.select(id, F.posexplode(lines).alias("_pos", "term"))


def pending_terms(docs: DataFrame, dictionary: DataFrame, lines: str, term: str = "term") -> DataFrame:
    """Distinct lines the dictionary does not know yet."""
    return docs.select(F.explode(lines).alias("term")).distinct().join(
        dictionary.select(F.col(term).alias("term")), "term", "left_anti")


def dictionary_enrich(docs: DataFrame, dictionary: DataFrame, id: str, lines: str, term: str = "term",
                      translation: str = "translation") -> DataFrame:
    """Ordered translations of each document's lines and a COMPLETE / PARTIAL / NONE status.

    Only distinct lines meet the dictionary; the hit is then joined back to its positions.
    """
    long = _lines(docs, id, lines)
    known = long.select("term").distinct().join(
        dictionary.select(F.col(term).alias("term"), F.col(translation).alias("_t")), "term")
    packed = F.array_sort(F.collect_list(F.struct("_pos", "term", F.col("_t").alias("translation"))))
    per = long.join(known, "term", "left").groupBy(id).agg(
        F.count(F.lit(1)).alias("line_count"), F.count("_t").alias("translated_count"), packed.alias("_p"))
    out = docs.drop(lines).join(per, id, "left")
    status = (F.when(F.coalesce("line_count", F.lit(0)) == 0, "NO_LINES")
              .when(F.col("translated_count") == F.col("line_count"), "COMPLETE")
              .when(F.col("translated_count") > 0, "PARTIAL").otherwise("PENDING"))
    text = F.array_join(F.transform(F.filter("_p", lambda x: x["translation"].isNotNull()), lambda x: x["translation"]), "\n")
    return (out.withColumn("translation_status", status).withColumn("translated_text", F.coalesce(text, F.lit("")))
            .na.fill({"line_count": 0, "translated_count": 0}).drop("_p"))
