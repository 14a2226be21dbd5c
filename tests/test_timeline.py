"""Ordered helpers against brute force, with chunks far smaller than the keys."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.operators import timeline as tl


def points(spark, seed, keys=3, n=60, top=500):
    rng = random.Random(seed)
    data = [(k, t, rng.randint(0, 9)) for k in range(keys) for t in sorted(rng.sample(range(-top, top), n))]
    return data, spark.createDataFrame(data, "k int, t long, v long")


@pytest.mark.parametrize("chunk", [7, 90, 5000])
def test_previous_and_next(spark, chunk):
    data, df = points(spark, 1)
    got = rows(tl.with_next(tl.with_previous(df, "k", "t", {"pv": "v"}, chunk), "k", "t", {"nt": "t"}, chunk), "k", "t", "pv", "nt")
    want = []
    for i, (k, t, v) in enumerate(data):
        before = data[i - 1][2] if i and data[i - 1][0] == k else None
        after = data[i + 1][1] if i + 1 < len(data) and data[i + 1][0] == k else None
        want.append((k, t, before, after))
    assert got == sorted(want)


@pytest.mark.parametrize("chunk,closed", [(5, True), (40, False), (9000, True)])
def test_islands(spark, chunk, closed):
    data, df = points(spark, 2)
    want, at, last, label = [], None, None, None
    for k, t, _ in data:
        if k != at or (t - last > 12 if closed else t - last >= 12):
            label = t
        at, last = k, t
        want.append((k, t, label))
    assert rows(tl.islands(df, "k", "t", 12, chunk, closed), "k", "t", "island") == sorted(want)


@pytest.mark.parametrize("chunk", [6, 111])
def test_asof(spark, chunk):
    left, ldf = points(spark, 3)
    right, rdf = points(spark, 4, n=9)
    rdf = rdf.withColumnRenamed("v", "w")
    got = rows(tl.asof(ldf, rdf, "k", "t", ["w"], chunk).select("k", "t", F.col("prev.t").alias("p"), F.col("next.w").alias("n")))
    want = []
    for k, t, _ in left:
        back = [x for x in right if x[0] == k and x[1] <= t]
        ahead = [x for x in right if x[0] == k and x[1] >= t]
        want.append((k, t, max(back, key=lambda x: x[1])[1] if back else None, min(ahead, key=lambda x: x[1])[2] if ahead else None))
    assert got == sorted(want, key=lambda r: tuple((v is None, v) for v in r))


def test_rank_in_buckets(spark):
    data, df = points(spark, 5)
    got = rows(tl.rank_in_buckets(df, "k", tl.floor_div(F.col("t"), 10), [F.col("t")]), "k", "t", "rank")
    want = [(k, t, sum(1 for x in data if x[0] == k and x[1] <= t)) for k, t, _ in data]
    assert got == sorted(want)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    data = [(int(g), float(x)) for g in range(3) for x in np.concatenate([rng.normal(0, 50, 101), [7.0] * 30])]
    df = spark.createDataFrame(data, "g int, x double")
    got = {r["g"]: r for r in tl.exact_quantiles(df, "g", "x", {"lo": 0.05, "mid": 0.5, "hi": 0.99}).collect()}
    for g in range(3):
        xs = [x for h, x in data if h == g]
        for name, q in (("lo", 0.05), ("mid", 0.5), ("hi", 0.99)):
            assert got[g][name] == pytest.approx(np.quantile(xs, q))
    whole = tl.exact_quantiles(df, [], "x", {"mid": 0.5}).first()["mid"]
    assert whole == pytest.approx(np.quantile([x for _, x in data], 0.5))


def test_floor_div_below_zero(spark):
    df = spark.createDataFrame([(-1,), (-10,), (0,), (9,), (10,)], "t long")
    assert rows(df.select("t", tl.floor_div(F.col("t"), 10).alias("b"))) == [(-10, -1), (-1, -1), (0, 0), (9, 0), (10, 1)]


def _keys_of_exchanges(df):
    """Hash keys of the exchanges of a plan made without broadcasts."""
    import re
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


def test_hot_keys_are_dealt_by_bin_and_bucket(spark):
    from tracewright.operators.features import time_bins
    from tracewright.operators.sampling import matched_controls
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForDistribution")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.requireAllClusterKeysForDistribution", "false")
    try:
        events = spark.createDataFrame([(1, 5, "click", "a", "w")], "k long, us long, event_type string, app string, window_title string")
        assert any(x.startswith("k, bin_number") for x in _keys_of_exchanges(time_bins(events, "k", "us", 10)))
        anchors = spark.createDataFrame([(1,)], "k long")
        controls = matched_controls(spark.createDataFrame([(1, 2)], "k long, id long"), anchors, "k", "id")
        assert any(x.startswith("k, _bucket") for x in _keys_of_exchanges(controls))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_value_buckets_spread(spark):
    from pyspark.sql import functions as F
    from tracewright.operators.timeline import value_bucket
    df = spark.range(100_000).select((F.col("id") / 100_000.0 - 0.1).alias("v")).withColumn("b", value_bucket(F.col("v")))
    assert df.select("b").distinct().count() > 1000
    got = [r["b"] for r in df.orderBy("v").collect()]
    assert got == sorted(got) and df.filter("v = 0").first()["b"] == 0


def test_quantiles_of_a_narrow_range_spread(spark):
    """10^6 distinct times within one day fall in more than 100 buckets, none of them large; quantiles stay exact."""
    import numpy as np
    base = 1_700_000_000_000_000
    df = spark.range(1_000_000).select((F.lit(base) + F.col("id") * 86_400).alias("t"), F.lit(None).cast("string").alias("g"))
    sizes = [r["n"] for r in tl.data_bucket(df.select(F.col("t").cast("double").alias("v"), "g"), ["g"], "v", "b").groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 100 and max(sizes) < 20_000 and sum(sizes) == 1_000_000
    got = tl.exact_quantiles(df, [], "t", {"a": 0.0, "b": 0.123, "c": 0.5, "d": 1.0}).first()
    want = np.quantile(base + np.arange(1_000_000) * 86_400.0, [0, 0.123, 0.5, 1])
    assert [got[c] for c in "abcd"] == pytest.approx(want.tolist(), abs=1)


def test_quantiles_of_uneven_values(spark):
    import numpy as np
    rng = random.Random(2)
    values = {g: [rng.choice([0.0, -1.5, 1e-9, 1e12 * rng.random(), rng.gauss(0, 1)]) for _ in range(700)] for g in ("x", None)}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    for r in tl.exact_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.99}).collect():
        assert [r[c] for c in "abc"] == pytest.approx(np.quantile(values[r["g"]], [0.01, 0.5, 0.99]).tolist(), rel=1e-9)
