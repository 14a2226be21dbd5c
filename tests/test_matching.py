"""Greedy operators against the plain sequential rule."""

import bisect
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.operators import matching as mt
from tracewright.operators import segments as sg


def greedy(pred, gt, tol):
    used, out = set(), []
    for t, pid in sorted(pred):
        best = None
        for g, gid in sorted(gt):
            if gid not in used and abs(g - t) <= tol and (best is None or abs(g - t) < best[0]):
                best = (abs(g - t), gid)
        if best:
            used.add(best[1])
            out.append((pid, best[1]))
    return out


@pytest.mark.parametrize("seed,top,chunk", [(1, 2000, 10_000), (2, 300, 20), (3, 150, 1), (4, 90, 25)])
def test_match_points(spark, seed, top, chunk):
    """Dense inputs make one chain far longer than a piece, so pieces must settle."""
    rng = random.Random(seed)
    pred = [(k, rng.randint(0, top), i) for i in range(80) for k in [rng.randint(0, 1)]]
    gt = [(k, rng.randint(0, top), i) for i in range(70) for k in [rng.randint(0, 1)]]
    p, g = spark.createDataFrame(pred, "k int, t long, pid long"), spark.createDataFrame(gt, "k int, t long, gid long")
    got = rows(mt.match_points(p, g, "k", "t", "pid", "gid", 5, chunk), "k", "pid", "gid")
    want = []
    for k in (0, 1):
        want += [(k, *x) for x in greedy([(t, i) for q, t, i in pred if q == k], [(t, i) for q, t, i in gt if q == k], 5)]
    assert got == sorted(want)


def test_match_points_ties_and_order(spark):
    p = spark.createDataFrame([("s", 10, 1), ("s", 12, 2), ("s", 40, 3)], "k string, t long, pid long")
    g = spark.createDataFrame([("s", 8, 1), ("s", 12, 2), ("s", 46, 3)], "k string, t long, gid long")
    # the first prediction is as near to 8 as to 12: the earlier wins; the third is out of reach
    assert rows(mt.match_points(p, g, "k", "t", "pid", "gid", 5, 100), "pid", "gid", "error") == [(1, 1, 2), (2, 2, 0)]


def peaks_by_hand(pts, thr, dist):
    out = []
    idx = [i for i, (t, s) in enumerate(pts) if s >= thr and (i == 0 or s >= pts[i - 1][1]) and (i + 1 == len(pts) or s >= pts[i + 1][1])]
    for i in sorted(idx, key=lambda i: (-pts[i][1], pts[i][0])):
        if all(abs(pts[i][0] - t) >= dist for t in out):
            out.append(pts[i][0])
    return sorted(out)


@pytest.mark.parametrize("chunk", [10_000, 30])
def test_local_peaks(spark, chunk):
    rng = random.Random(7)
    pts = [(t, rng.choice([0.1, 0.5, 0.6, 0.9])) for t in sorted(rng.sample(range(600), 200))]
    df = spark.createDataFrame([("s", t, s) for t, s in pts], "k string, t long, p double")
    got = [r[0] for r in rows(mt.local_peaks(df, "k", "t", "p", 0.5, 15, chunk), "t")]
    assert got == peaks_by_hand(pts, 0.5, 15)


def test_local_peaks_plateau(spark):
    df = spark.createDataFrame([("s", t, 0.8) for t in (0, 2, 4, 6)], "k string, t long, p double")
    assert rows(mt.local_peaks(df, "k", "t", "p", 0.5, 4, 100), "t") == [(0,), (4,)]


def test_match_intervals(spark):
    pairs = [("s", 1, 1, 0.6), ("s", 1, 2, 0.7), ("s", 2, 2, 0.65), ("s", 2, 3, 0.3), ("s", 3, 3, 0.3)]
    df = spark.createDataFrame(pairs, "k string, pid long, tid long, iou double")
    # 0.7 first; prediction 2 loses truth 2 and takes 3 before prediction 3 (row order on a tie)
    assert rows(mt.match_intervals(df, "k", "pid", "tid", threshold=0.25), "pid", "tid") == [(1, 2), (2, 3)]


def test_merge_points(spark):
    pts = [("s", 0, 0.5), ("s", 2, 0.9), ("s", 4, 0.9), ("s", 7, 0.4), ("s", 9, 0.3), ("u", 0, 1.0)]
    df = spark.createDataFrame(pts, "k string, t long, p double")
    for chunk in (3, 1000):
        got = rows(sg.merge_points(df, "k", "t", "p", 2, chunk), "k", "predicted_ts", "score", "cluster_size")
        assert got == [("s", 2, 0.9, 3), ("s", 7, 0.4, 2), ("u", 0, 1.0, 1)]
        assert sum(r[3] for r in got) == len(pts)


def log_rounds(rounds, pieces):
    return len(rounds) <= math.ceil(math.log2(pieces)) + 2


def test_match_of_one_dense_island(spark):
    """100,000 points that all hang together; every prediction also reaches targets of its neighbours."""
    rng = random.Random(12)
    pred = sorted((rng.randrange(400_000), i) for i in range(60_000))
    gt = sorted((rng.randrange(400_000), i) for i in range(40_000))
    p, g = spark.createDataFrame(pred, "t long, pid long"), spark.createDataFrame(gt, "t long, gid long")
    p, g = (df.withColumn("k", F.lit(1)) for df in (p, g))
    rounds = []
    got = rows(mt.match_points(p, g, "k", "t", "pid", "gid", 12, 5000, rounds=rounds), "pid", "gid")
    assert log_rounds(rounds, 80)
    used, want, times = set(), [], [t for t, _ in gt]
    for t, i in pred:
        near = [(abs(gt[j][0] - t), j) for j in range(bisect.bisect_left(times, t - 12), bisect.bisect_right(times, t + 12)) if j not in used]
        if near:
            j = min(near)[1]
            used.add(j)
            want.append((i, gt[j][1]))
    assert got == sorted(want)


def test_match_when_each_choice_hangs_on_the_one_before(spark):
    """Targets at the places of the predictions before: the first one shifts all others, over 64 pieces."""
    n = 640
    p = spark.createDataFrame([(None, 10 * i, i) for i in range(n)], "k string, t long, pid long")
    g = spark.createDataFrame([(None, 10 * i - 5, i) for i in range(n)] + [(None, 10 * n, n)], "k string, t long, gid long")
    rounds = []
    got = rows(mt.match_points(p, g, "k", "t", "pid", "gid", 6, 100, rounds=rounds), "pid", "gid")
    assert got == [(i, i) for i in range(n)] and log_rounds(rounds, 64)


def test_many_peaks_of_equal_score(spark):
    """100,000 peaks of one score, one time unit apart: every seventh stays, as each hangs on the one before."""
    df = spark.range(100_000).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.lit(0.5).alias("p"))
    rounds = []
    got = [r[0] for r in rows(mt.local_peaks(df, "k", "t", "p", 0.5, 7, 1000, rounds=rounds), "t")]
    assert got == list(range(0, 100_000, 7)) and log_rounds(rounds, 100)


def test_distances_as_a_key(spark):
    rng = random.Random(3)
    pts = [(t, rng.choice([0.4, 0.6, 0.8])) for t in sorted(rng.sample(range(900), 300))]
    df = spark.createDataFrame([(d, t, s) for d in (1, 5, 30) for t, s in pts], "d long, t long, p double")
    got = rows(mt.suppress(df, "d", "t", "p", "d", 60), "d", "t")
    for d in (1, 5, 30):
        want = []
        for t, _ in sorted(pts, key=lambda x: (-x[1], x[0])):
            if all(abs(t - x) >= d for x in want):
                want.append(t)
        assert [t for k, t in got if k == d] == sorted(want)


@pytest.mark.parametrize("width", [1, 64])
def test_a_chain_of_rising_ious(spark, width):
    """Each pair is better than the one before and shares a side with it: 1,000 pairs that settle from the far end."""
    pairs = [("s", (i + 1) // 2, i // 2, 0.1 + i / 2000) for i in range(1000)]
    df = spark.createDataFrame(pairs, "k string, pid long, tid long, iou double")
    rounds = []
    got = rows(mt.match_intervals(df, "k", "pid", "tid", width=width, rounds=rounds), "pid", "tid")
    assert got == sorted((p, t) for i, (_, p, t, _) in enumerate(pairs) if i % 2 == 1) and len(rounds) <= 15


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_match_intervals_against_the_plain_rule(spark, width):
    rng = random.Random(width)
    pairs = {(k, rng.randrange(40), rng.randrange(40)): rng.choice([0.2, 0.5, rng.random()]) for k in (1, 2) for _ in range(200)}
    df = spark.createDataFrame([(*e, s) for e, s in pairs.items()], "k long, pid long, tid long, iou double")
    want, used = [], set()
    for (k, p, t), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if ("p", k, p) not in used and ("t", k, t) not in used:
            used |= {("p", k, p), ("t", k, t)}
            want.append((k, p, t))
    assert rows(mt.match_intervals(df, "k", "pid", "tid", width=width), "k", "pid", "tid") == sorted(want)


def test_matching_of_nothing(spark):
    points = spark.createDataFrame([], "k string, t long, id long, p double")
    assert mt.match_points(points, points, "k", "t", "id", "id", 5, 10).count() == 0
    assert mt.local_peaks(points, "k", "t", "p", 0.5, 4, 10).count() == 0
    assert mt.match_intervals(spark.createDataFrame([], "k string, a long, b long, iou double"), "k", "a", "b").count() == 0
