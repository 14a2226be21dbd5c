"""Scores of a boosted ensemble after any number of its trees, in one pass.

A boosted model with k iterations is the first k trees of one with more, so a sweep over iterations needs
one training: the trees of the longest model are read from its saved form, every row walks all trees at
once in Arrow batches, and running sums of weighted predictions give the score at each stage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.operators.evaluation import _as_long, with_params
from tracewright.operators.matching import match_points
from tracewright.operators.segments import merge_points
from tracewright.operators.timeline import as_list
from tracewright.functions.columns import prf
from tracewright.plans.models import THRESHOLDS, train_boundary_model
from tracewright.session import staged, staging_path

STAGES = (200, 300, 500, 800)


class Trees:
    """All trees of a model as arrays [tree, node]; leaves point to themselves."""

    def __init__(self, spark: SparkSession, model: GBTClassificationModel):
        path = staging_path(spark, "trees")
        model.save(path)
        # a model's nodes are bounded by its settings: trees times 2 ** (depth + 1)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
        shape = len(model.treeWeights), 1 + max(r["id"] for r in rows)
        self.weight = np.array(model.treeWeights)
        self.feature, self.left = np.zeros(shape, np.int64), np.tile(np.arange(shape[1]), (shape[0], 1))
        self.right, self.limit, self.value = self.left.copy(), np.zeros(shape), np.zeros(shape)
        for r in rows:
            at = r["treeID"], r["id"]
            self.value[at] = r["prediction"]
            if r["leftChild"] >= 0:
                split = r["split"]
                if split["numCategories"] != -1:
                    raise ValueError("only splits of numbers are read")
                self.feature[at], self.limit[at] = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
                self.left[at], self.right[at] = r["leftChild"], r["rightChild"]

    def margins(self, rows: np.ndarray, stages: Sequence[int]) -> np.ndarray:
        """[row, stage]: the sum over the first trees of each stage."""
        out, total, each = np.zeros((len(rows), len(stages))), np.zeros(len(rows)), np.arange(len(rows))
        for tree in range(max(stages)):
            at = np.zeros(len(rows), np.int64)
            while True:
                below = np.where(rows[each, self.feature[tree, at]] <= self.limit[tree, at], self.left[tree, at], self.right[tree, at])
                if (below == at).all():
                    break
                at = below
            total = total + self.weight[tree] * self.value[tree, at]
            for k, stage in enumerate(stages):
                if tree + 1 == stage:
                    out[:, k] = total
        return out


def staged_probabilities(features: Column, trees: Trees, stages: Sequence[int]) -> Column:
    """array<double>: the probability of class 1 after each number of trees; ``features`` is a vector."""
    if not all(0 < s <= len(trees.weight) for s in stages):
        raise ValueError(f"stages must be between 1 and {len(trees.weight)}")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array(batch.to_pylist(), np.float64).reshape(len(batch), -1)
            made = 1 / (1 + np.exp(-2 * trees.margins(rows, stages))) if len(batch) else np.empty((0, len(stages)))
            yield pa.array(made.tolist(), pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<double>")(vector_to_array(features))


def score_stages(model: PipelineModel, df: DataFrame, stages: Sequence[int] = STAGES, name: str = "stages", last: str = "p") -> DataFrame:
    """Add the probability after each stage as an array, and the whole model's own probability as ``last``."""
    trees = Trees(df.sparkSession, model.stages[-1])
    out = model.transform(df).withColumn(name, staged_probabilities(F.col("features"), trees, stages)).withColumn(last, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction", "features")


def sweep_iterations(train: DataFrame, held: DataFrame, gt: DataFrame, key, ts: str, gt_id: str, gap: int, tol: int, chunk: int,
                     features: Sequence[str] = vocab.FEATURE_COLUMNS, label: str = "label", stages: Sequence[int] = STAGES,
                     thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Iterations x threshold: boundaries of the held-out rows against the true ones.

    One model is trained, with the most iterations.  Positive rows are merged within ``gap`` and matched
    within ``tol``; iterations and threshold are key columns of one merge and one match.
    ``last_is_model`` tells whether the last stage gave every row the model's own probability.
    """
    key, setting = as_list(key), ["iterations", "threshold"]
    model = train_boundary_model(train, features, label, max(stages))
    scored = staged(score_stages(model, held, stages).select(*key, ts, "stages", "p"), "stages")
    agrees = scored.agg(F.coalesce(F.max(F.abs(F.element_at("stages", len(stages)) - F.col("p"))) < 1e-9, F.lit(True)).alias("last_is_model"))
    each = F.explode(F.arrays_zip(F.array(*[F.lit(s).cast("long") for s in stages]).alias("iterations"), F.col("stages").alias("score")))
    grid = scored.select(*key, ts, each.alias("_e")).select(*key, ts, "_e.*")
    positive = staged(with_params(grid, threshold=[float(t) for t in thresholds]).filter(F.col("score") >= F.col("threshold")), "positive")
    merged = merge_points(positive, [*key, *setting], ts, "score", gap, chunk)
    pred = merged.select(*key, *setting, F.col("predicted_ts").alias(ts), F.col("predicted_ts").alias("pred_id"))
    truth = _as_long(with_params(gt.select(*key, ts, gt_id), iterations=[int(s) for s in stages], threshold=[float(t) for t in thresholds]), "iterations")
    found = match_points(pred, truth, [*key, *setting], ts, "pred_id", gt_id, tol, chunk)
    hits = found.groupBy(*setting).agg(F.count(F.lit(1)).alias("tp"), F.avg("error").alias("mean_error"))
    rows = positive.groupBy(*setting).agg(F.count(F.lit(1)).alias("positive"))
    made = pred.groupBy(*setting).agg(F.count(F.lit(1)).alias("predicted"))
    every = gt.agg(F.count(F.lit(1)).alias("truth")).crossJoin(agrees)  # one row each
    every = _as_long(with_params(every, iterations=[int(s) for s in stages], threshold=[float(t) for t in thresholds]), "iterations")
    return (every.join(rows, setting, "left").join(made, setting, "left").join(hits, setting, "left").na.fill(0, ["positive", "predicted", "tp"])
            .withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("truth") - F.col("tp"))
            .select(*setting, "positive", "predicted", "truth", "tp", *prf("tp", "fp", "fn"), "mean_error", "last_is_model"))
