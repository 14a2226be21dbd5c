"""One query for each operator, over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import ann, bpe, chat, infill, langid, lexical, licenses, lm, mixing, neardup, pivots, toxicity, warc
from tracewright.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@_query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs), "ids", "decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))


@_query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    made = toxicity.score(docs, toxicity_model(docs, _read(spark, sf_dir, "labels")))
    return made.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@_query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4)


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken(_read(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@_query
def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lm.score(_read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0, scanned=True)
    return made.withColumn("held_out", fold(F.col("doc_id"), 10) == 0).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


@_query
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.as_responses(_read(spark, sf_dir, "pages")))
    return made.withColumnRenamed("id", "page_id").withColumnRenamed("date", "warc_date")


SQL["op5_warc"] = warc.derive_sql()


@_query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


SQL["op10_licenses"] = licenses.scan_sql()


@_query
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))


SQL["op11_infill"] = infill.transform_sql()


@_query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


SQL["op13_lexical"] = lexical.search_sql()


#: What both turns of the conversation that ``op12_chat`` adds say.
SAID = "<|im_end|><|im_start|>assistant ok"


@_query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(chat.windows(turns)).withColumnRenamed("conv", "conv_id")


SQL["op12_chat"] = chat.windows_sql(SAID)
