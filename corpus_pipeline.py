"""A corpus pipeline: language, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet in the shared folder and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, langid, mixing, neardup, toxicity
from tracewright.llm.common import fresh
from tracewright.llm.queries import language_model, toxicity_model
from tracewright.session import staging_path

#: A document whose likeliest language has less than this share of probability is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; texts that are null, empty or without letters go."""
    lang, score = fresh(docs, "_lang_pred", "_lang_score")
    found = langid.predict(docs, language_model(docs), lang=lang, score=score)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not predicted toxic; the model is learned from the labels of ``sf_dir``."""
    score, toxic = fresh(docs, "_toxic_score", "_toxic")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = toxicity.score(docs, toxicity_model(docs, labels), out=score, predicted=toxic)
    return scored.filter(F.col(toxic) == 0).drop(score, toxic)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the smallest doc_id.  Rows with a null doc_id stay.

    Five-word shingles, similarity 0.8 or more.  Of rows that repeat a doc_id one stays.
    """
    kept = neardup.near_duplicates(docs).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    with_id = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return with_id.unionByName(docs.filter("doc_id is null")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents as the mix takes their words.

    A document of which the mix takes t of its n words comes floor(t / n + u) times, u in [0, 1) a hash
    of its id, so that sources keep their targets.  Documents without words have no place in the mix.
    """
    taken = mixing.taken(docs).groupBy(F.col("id").alias("_id")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    part = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    copies = taken.filter("_taken > 0").select("_id", F.floor(F.col("_taken") / F.col("_size") + part).cast("int").alias("_copies"))
    joined = docs.join(copies.filter("_copies > 0"), docs["doc_id"].eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again: doc_id, source, n_tokens, ids and whether the round trip is exact."""
    ids, back = fresh(docs, "ids", "_decoded")
    coded = bpe.decode(bpe.encode(docs, ids=ids), ids, back)
    exact = F.col(back) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"), exact.alias("round_trip"))


STAGES = [("language", language_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage),
          ("mixing", mixing_stage), ("tokens", token_stage)]

#: The stages learn models and draw samples; their tests compare them with brute force and planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each from what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = staging_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
