"""Nearest marks of several kinds in one pass, against a plain search."""

import random

import pytest
from conftest import rows

from tracewright.operators import nearest as nr


@pytest.mark.parametrize("chunk", [7, 40, 10_000])
def test_nearest_marks_of_many_kinds(spark, chunk):
    rng = random.Random(chunk)
    items = [(k, rng.randrange(-200, 200), i) for i in range(120) for k in [rng.choice(["x", "y", None])]]
    kinds = {n: [(k, rng.randrange(-200, 200), rng.randrange(5)) for _ in range(c) for k in [rng.choice(["x", "y", None])]] for n, c in (("a", 40), ("b", 8), ("c", 1), ("d", 0))}
    df = spark.createDataFrame(items, "k string, t long, id long")
    marks = {n: spark.createDataFrame(m, "k string, t long, v long") for n, m in kinds.items()}
    made = nr.nearest_features(df, marks, "k", "t", ["v"], chunk)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2  # the staged rows, and once more for the chunk edges
    assert made.columns == ["k", "t", "id"] + [c for n in kinds for c in (f"nearest_{n}", f"{n}_distance")]
    got = {r["id"]: r for r in made.collect()}
    assert len(got) == len(items)
    for k, t, i in items:
        for n, points in kinds.items():
            mine = sorted((abs(p - t), p, v) for g, p, v in points if g == k)
            r = got[i]
            if not mine:
                assert r[f"nearest_{n}"] is None and r[f"{n}_distance"] is None
            else:
                assert (r[f"{n}_distance"], r[f"nearest_{n}"]["t"], r[f"nearest_{n}"]["v"]) == mine[0]


def test_nearest_of_no_items(spark):
    empty = spark.createDataFrame([], "k string, t long, v long")
    assert rows(nr.nearest_features(empty, {"a": empty}, "k", "t", ["v"], 5)) == []
