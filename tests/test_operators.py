import random

from conftest import rows
from pyspark.sql import functions as F

from tracewright.operators import evaluation as ev
from tracewright.operators import features as ft
from tracewright.operators import intervals as iv
from tracewright.operators import nearest as nr
from tracewright.operators import profiles as pf
from tracewright.operators import sampling as sp
from tracewright.operators import similarity as sm


def test_candidate_windows_brute_force(spark):
    rng = random.Random(5)
    types = ["app_switch", "keystroke", "browser_click"]
    data = [(k, rng.randint(0, 90), rng.choice(types), rng.choice(["A", "B", None])) for k in (1, 2) for _ in range(40)]
    df = spark.createDataFrame(data, "k int, t long, event_type string, app string")
    for step, window in ((2, 6), (4, 6), (3, 3)):
        got = {(r["k"], r["slot"]): r for r in ft.candidate_features(df, "k", "t", step, window).collect()}
        for k in (1, 2):
            mine = [x for x in data if x[0] == k]
            start, end = min(x[1] for x in mine), max(x[1] for x in mine)
            for slot in range((end - start) // step + 1):
                c = start + slot * step
                before, after = [x for x in mine if c - window <= x[1] < c], [x for x in mine if c <= x[1] < c + window]
                r = got[(k, slot)]
                assert r["before_event_count"] == len(before) and r["after_event_count"] == len(after)
                assert r["after_app_switches"] == sum(x[2] == "app_switch" for x in after)
                assert r["before_unique_apps"] == len({x[3] for x in before if x[3]})
        assert len(got) == sum((max(x[1] for x in data if x[0] == k) - min(x[1] for x in data if x[0] == k)) // step + 1 for k in (1, 2))


def test_assignment_policies(spark):
    e = spark.createDataFrame([("s", 0, 1), ("s", 5, 2), ("s", 10, 3), ("s", 11, 4), ("s", None, 5)], "k string, t long, id long")
    s = spark.createDataFrame([("s", 1, 0, 5), ("s", 2, 5, 10)], "k string, seg long, st long, en long")
    args = ("k", "t", "id", "seg", "st", "en")
    closed = iv.assign_events(e, s, *args, 3, "closed")
    assert rows(closed, "id", "seg") == [(1, 1), (2, 1), (2, 2), (3, 2)]
    assert rows(iv.assign_events(e, s, *args, 3, "half_open_last_closed"), "id", "seg") == [(1, 1), (2, 2), (3, 2)]
    assert rows(iv.assign_events(e, s, *args, 3, "first"), "id", "seg") == [(1, 1), (2, 1), (3, 2)]
    near = rows(iv.assign_events(e, s, *args, 3, "nearest_edge"), "id", "seg", "tied")
    assert near == [(1, 1, False), (2, 1, True), (3, 2, False)]
    got, summary = iv.assign_with_end_fallback(e, s, *args, 4)
    assert rows(got, "id", "seg", "policy") == [(1, 1, "HALF_OPEN"), (2, 2, "HALF_OPEN"), (3, 2, "EXACT_END")]
    assert tuple(summary.first()) == (5, 1, 2, 1, 1)


def test_labels(spark):
    c = spark.createDataFrame([("s", t) for t in (0, 2, 4, 6)] + [("u", 3)], "k string, t long")
    g = spark.createDataFrame([("s", 3), ("s", 100)], "k string, t long")
    assert rows(nr.label_nearest(c, g, "k", "t", 3)) == [("s", 0, 0), ("s", 2, 1), ("s", 4, 0), ("s", 6, 1), ("u", 3, 0)]
    assert rows(nr.label_within(c, g, "k", "t", 1, 3)) == [("s", 0, 0), ("s", 2, 1), ("s", 4, 1), ("s", 6, 0), ("u", 3, 0)]


def test_map_intervals(spark):
    a = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 10, 20), ("s", 3, 30, 40)], "k string, a long, s0 long, e0 long")
    b = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 10, 19), ("s", 3, 30, 35), ("s", 4, 35, 40)], "k string, b long, s1 long, e1 long")
    got = rows(iv.map_intervals(a, b, "k", "a", "b", ("s0", "e0"), ("s1", "e1"), 7), "a", "b", "method", "ambiguous")
    assert got == [(1, 1, "EXACT_TIMESTAMP", False), (2, 2, "TIMESTAMP_OVERLAP", False), (3, 4, "TIMESTAMP_OVERLAP", True)]


def test_jaccard_brute_force_and_clusters(spark):
    rng = random.Random(9)
    sets = [(i, sorted(rng.sample("abcdefghijkl", rng.randint(1, 8)))) for i in range(60)]
    df = spark.createDataFrame(sets, "id long, tok array<string>")
    for t in (0.3, 0.5, 0.8, 1.0):
        want = sorted((i, j) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= t - 1e-9)
        assert rows(sm.jaccard_pairs(df, "id", "tok", t), "id_a", "id_b") == want
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 12)] + [(20, 21)], "id_a long, id_b long")
    ids = spark.createDataFrame([(i,) for i in [*range(13), 20, 21, 30]], "id long")
    got = dict(rows(sm.cluster_by_similarity(ids, pairs, "id")))
    assert {got[i] for i in range(13)} == {0} and got[20] == got[21] == 20 and got[30] == 30


def test_df_filter_bounds(spark):
    df = spark.createDataFrame([(i, ["all"] + (["most"] if i < 4 else []) + (["one"] if i == 0 else [])) for i in range(5)], "id int, tok array<string>")
    got = dict(rows(sm.df_filter(df, "id", "tok")))
    assert got == {0: ["most"], 1: ["most"], 2: ["most"], 3: ["most"], 4: []}


def test_cluster_quality_and_average_precision(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), ("b", 1)], "t string, c int")
    r = ev.cluster_quality(df, "t", "c").first()
    assert abs(r["weighted_purity"] - 0.8) < 1e-9 and abs(r["ari"] - 1 / 6) < 1e-9
    assert ev.cluster_quality(df.withColumn("c", F.lit(1)).withColumn("t", F.lit("a")), "t", "c").first()["ari"] == 1.0
    s = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, p double")
    assert abs(ev.average_precision(s, "y", "p").first()["average_precision"] - (1 + 2 / 3) / 2) < 1e-9


def test_vote_label(spark):
    e = spark.createDataFrame([("s", 1, "pi"), ("s", 1, "la"), ("s", 2, "ob"), ("s", 2, "ob"), ("s", 2, "pi")], "k string, seg int, p string")
    keys = spark.createDataFrame([("s", i) for i in (1, 2, 3)], "k string, seg int")
    got = rows(pf.vote_label(e, ["k", "seg"], "p", all_keys=keys), "seg", "label", "label_resolution")
    assert got == [(1, "la", "MULTI_DOMINANT_PREFIX"), (2, "ob", "MULTI_DOMINANT_PREFIX"), (3, "other", "NONE")]


def test_stratified_quotas(spark):
    counts = spark.createDataFrame([("a", 97), ("b", 2), ("c", 1)], "s string, rows long")
    got = dict((r["s"], r["quota"]) for r in sp.stratified_quotas(counts, "s", 0.05).collect())
    assert got == {"a": 3, "b": 1, "c": 1}


def test_select_spaced(spark):
    items = [("s", 0, 1, "A", 13.0, True, False), ("s", 1, 2, "A", 14.0, True, False), ("s", 10, 3, "A", 6.0, False, True),
             ("s", 20, 4, "B", 1.0, False, False), ("s", 30, 5, "A", 1.0, False, False)]
    df = spark.createDataFrame(items, "k string, t long, item long, app string, score double, nt boolean, ne boolean")
    got = rows(sp.select_spaced(df, "k", "t", "item", "app", "score", "nt", "ne", k=4, spacing=5), "t", "item", "selection_pass")
    # item 1 is too near item 2; application A is full after two picks, so item 5 comes from the fallback
    assert got == [(1, 2, 1), (10, 3, 2), (20, 4, 3), (30, 5, 4)]


def test_split_is_whole_and_proportional(spark):
    df = spark.createDataFrame([(i // 3,) for i in range(300)], "k long")
    out = sp.split_by_key(df, "k")
    assert out.groupBy("k").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert dict(rows(out.select("k", "split").distinct().groupBy("split").count())) == {"train": 70, "validation": 15, "test": 15}


def test_rounds_of_select_spaced_do_not_double(spark, monkeypatch):
    """Each round reads what the rounds before have chosen, not their plans."""
    df = spark.createDataFrame([(k, t, t, "a", float(t), t % 3 == 0, False) for k in range(3) for t in range(30)],
                               "k long, t long, item long, app string, score double, nt boolean, ne boolean")
    joins, join = [], type(df).join

    def spy(self, *args, **kwargs):
        out = join(self, *args, **kwargs)
        joins.append(out._jdf.queryExecution().analyzed().toString().count("Join "))
        return out

    monkeypatch.setattr(type(df), "join", spy)
    assert sp.select_spaced(df, "k", "t", "item", "app", "score", "nt", "ne", k=5, spacing=5).count() == 15
    assert len(joins) == 16 and max(joins) == 2
