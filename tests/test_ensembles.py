"""Stages of a boosted ensemble against models trained with that many iterations."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tracewright.plans import ensembles as en
from tracewright.plans import models as md


def data(spark, n=400):
    rng = random.Random(1)
    rows = [(1, i, rng.randint(0, 9), rng.randint(0, 5)) for i in range(n)]
    return spark.createDataFrame([(k, i, a, b, int(a + b + rng.random() * 4 > 9)) for k, i, a, b in rows], "k long, t long, a long, b long, label int")


def test_stages_are_the_shorter_models(spark):
    df = data(spark)
    model = md.train_boundary_model(df, ["a", "b"], iterations=9)
    got = {r["t"]: (r["stages"], r["p"]) for r in en.score_stages(model, df, (2, 5, 9)).collect()}
    for k, stage in enumerate((2, 5)):
        shorter = md.train_boundary_model(df, ["a", "b"], iterations=stage).transform(df).withColumn("p", vector_to_array("probability")[1])
        for r in shorter.select("t", "p").collect():
            assert got[r["t"]][0][k] == pytest.approx(r["p"], abs=1e-9)
    assert all(stages[-1] == pytest.approx(p, abs=1e-9) for stages, p in got.values())
    assert en.score_stages(model, df.limit(0), (2, 9)).count() == 0
    with pytest.raises(ValueError):
        en.score_stages(model, df, (10,))


def test_sweep_of_iterations(spark):
    df = data(spark)
    gt = df.filter("label = 1").select("k", "t", F.col("t").alias("gt_id"))
    made = en.sweep_iterations(df, df, gt, "k", "t", "gt_id", 0, 0, 50, ["a", "b"], stages=(1, 6), thresholds=(0.1, 0.5, 1.0)).collect()
    assert {(r["iterations"], r["threshold"]) for r in made} == {(i, t) for i in (1, 6) for t in (0.1, 0.5, 1.0)}
    for r in made:
        assert r["last_is_model"] and r["predicted"] == r["positive"] and r["tp"] <= r["predicted"] and r["truth"] == gt.count()
        if r["threshold"] == 1.0:
            assert r["predicted"] == r["tp"] == 0 and r["f1"] == 0
    model = md.score(md.train_boundary_model(df, ["a", "b"], iterations=6), df, "p").filter("p >= 0.5")
    (one,) = [r for r in made if (r["iterations"], r["threshold"]) == (6, 0.5)]
    assert (one["predicted"], one["tp"]) == (model.count(), model.filter("label = 1").count())
