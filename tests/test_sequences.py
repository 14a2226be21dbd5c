import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.functions import arrays as ar
from tracewright.operators import segments as sg
from tracewright.operators import sequences as sq


def fold(events):
    out, now = [], None
    for t, f, a, r in events:
        if now is None or not sq.absorbed(f, a, r, now[1:]):
            now = (t, f, a, r)
        out.append((t, now[0]))
    return out


@pytest.mark.parametrize("chunk", [3, 17, 10_000])
def test_fold_phases(spark, chunk):
    rng = random.Random(3)
    fams = ["BROWSER", "BROWSER_FORM", "TRANSFER", "DOCUMENT", "CONTEXT", "DESKTOP_INPUT"]
    ev = [(t, rng.choice(fams), rng.choice(["Browser", "Word", ""]), rng.choice(["/a", "/b", "UNKNOWN_ROUTE"])) for t in range(120)]
    df = spark.createDataFrame([("s", t, t, f, a, r) for t, f, a, r in ev], "k string, t long, id long, action_family string, app string, route string")
    got = rows(sq.fold_phases(df, "k", "t", "id", chunk), "t", "phase_ts")
    assert got == fold(ev)


def test_absorb_rules():
    word = ("DOCUMENT", "Word", "UNKNOWN_ROUTE")
    assert sq.absorbed("TRANSFER", "Excel", "", word)
    assert sq.absorbed("CONTEXT", "Word", "", word) and not sq.absorbed("CONTEXT", "Excel", "", word)
    web = ("BROWSER", "Browser", "/a")
    assert sq.absorbed("BROWSER_FORM", "Browser", "UNKNOWN_ROUTE", web)
    assert not sq.absorbed("BROWSER_FORM", "Browser", "/b", web)
    assert sq.absorbed("BROWSER", "Browser", "/b", web)  # same family and application
    assert not sq.absorbed("TRANSFER", "Browser", "/a", web)


def test_stitch(spark):
    f = [("s", 1, 0, 5, "A", "", True, False), ("s", 2, 6, 9, "A", "c1", False, False), ("s", 3, 10, None, "A", "c1", False, True),
         ("s", 4, 20, 25, "A", "c2", False, True), ("s", 5, 30, 31, "B", "c2", False, True)]
    df = spark.createDataFrame(f, "k string, fragment_id long, st long, en long, process_code string, case_id string, continues_to_next boolean, continues_from_prev boolean")
    got = rows(sg.stitch(df, "k", "st", "en", 7), "st", "en", "fragment_count", "complete")
    assert got == [(0, 9, 3, True), (20, 25, 1, True), (30, 31, 1, True)]


def test_segments_tile_the_session(spark):
    b = spark.createDataFrame([("s", t) for t in (0, 5, 5, 12, 20, 33)], "k string, t long")
    s = spark.createDataFrame([("s", 0, 20)], "k string, session_start long, session_end long")
    got = rows(sg.segments_from_boundaries(b, s, "k", "t", 6), "segment_index", "segment_start", "segment_end")
    assert got == [(1, 0, 5), (2, 5, 12), (3, 12, 20)]
    assert rows(sg.check_contiguous(sg.segments_from_boundaries(b, s, "k", "t", 6), "k", "segment_start", "segment_end", "segment_index", 6),
                "empty", "overlaps", "gaps", "wrong_index") == [(0, 0, 0, 0)]


def test_bounded_sequence(spark):
    apps = ["a", "a", "b", "c", "d", "d", "e", "f", "g"]
    df = spark.createDataFrame([("s", i, a) for i, a in enumerate(apps)], "k string, t long, app string")
    assert rows(sq.bounded_sequence(df, "k", "t", "app", 2, 4), "sequence_length", "sequence") == [(7, ["a", "b", "...", "f", "g"])]
    assert rows(sq.bounded_sequence(df, "k", "t", "app", 2, 8), "sequence") == [(["a", "b", "c", "d", "e", "f", "g"],)]


def test_array_expressions(spark):
    df = spark.createDataFrame([(["TRANSFER[Excel]", "CLICK_BROWSER", "BROWSER", "WINDOW_CHANGE", "APP_TRANSITION", "BROWSER_FORM"],)], "a array<string>")
    r = df.select(ar.clean_path("a").alias("c"), ar.mechanical_skeleton("a").alias("m"), ar.contains_subseq("a", ["BROWSER", "WINDOW_CHANGE"]).alias("y"),
                  ar.contains_subseq("a", ["BROWSER", "APP_TRANSITION"]).alias("n"), ar.truncate_seq("a", 3).alias("t")).first()
    assert r["c"] == ["DATA_TRANSFER", "BROWSER_WORK", "APPLICATION_SWITCH", "FORM_ENTRY"]
    assert r["m"][0] == "TRANSFER" and "APPLICATION_SWITCH" not in r["m"]
    assert (r["y"], r["n"]) == (True, False)
    assert r["t"] == ["TRANSFER[Excel]", "...", "APP_TRANSITION", "BROWSER_FORM"]


def test_order_evidence_and_consensus(spark):
    seqs = [(i % 4, i, ["A", "B"] + (["C"] if i % 2 else [])) for i in range(12)] + [(0, 99, ["B", "A"])]
    df = spark.createDataFrame(seqs, "session_id int, segment_index int, p array<string>")
    order = rows(sq.order_evidence(df, ["session_id", "segment_index"], "p"), "first_phase", "second_phase", "first_before_second", "classification")
    assert ("A", "B", 12, "COMMON_ORDER") in order and ("A", "C", 6, "MIXED_ORDER") in order
    support = sq.phase_support(df, ["session_id", "segment_index"], "session_id", "p")
    assert rows(support, "phase", "classification") == [("A", "COMMON_CORE"), ("B", "COMMON_CORE"), ("C", "FREQUENT")]
    got = rows(sq.consensus_order(support, sq.order_evidence(df, ["session_id", "segment_index"], "p")), "consensus_rank", "phase", "order_score")
    assert got == [(1, "A", 1), (2, "B", -1)]


def test_fold_of_a_long_segment_and_odd_keys(spark):
    """10^6 events of one segment in about 400 pieces, long phases and changing routes; a null key; times that tie."""
    import numpy as np
    from pyspark.sql import functions as F
    fams = ["BROWSER", "BROWSER_FORM", "TRANSFER", "DOCUMENT", "CONTEXT", "DESKTOP_INPUT"]
    n = 1_000_000
    rng = np.random.default_rng(6)
    fam = np.where(rng.random(n) < 0.7, "BROWSER", rng.choice(fams, n))
    app = np.where(rng.random(n) < 0.999, "Browser", rng.choice(["Word", ""], n))
    route = np.char.add("/r", (np.arange(n) // 3000).astype(str)).astype(object)
    route[rng.random(n) < 0.2] = "UNKNOWN_ROUTE"
    ev = list(zip((np.arange(n) // 2).tolist(), fam.tolist(), app.tolist(), route.tolist()))
    small = ev[:5000]
    import pandas as pd
    frame = pd.DataFrame(ev + small, columns=["t", "action_family", "app", "route"])
    frame["id"], frame["k"] = np.concatenate([np.arange(n), np.arange(5000)]), ["s"] * n + [None] * 5000
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    df = spark.createDataFrame(frame)
    got = sq.fold_phases(df, "k", "t", "id", 1300).select("k", "id", "phase_order_id").toPandas().sort_values(["id"])
    for events, key in ((ev, "s"), (small, None)):
        want, now, memo = [], None, {}
        for i, (_, f, a, r) in enumerate(events):
            if now is not None and ((f, a, r), now[1]) not in memo:
                memo[(f, a, r), now[1]] = sq.absorbed(f, a, r, now[1])
            if now is None or not memo[(f, a, r), now[1]]:
                now = (i, (f, a, r))
            want.append(now[0])
        mine = got[got["k"].isna()] if key is None else got[got["k"] == key]
        assert (mine["phase_order_id"].to_numpy() == np.array(want)).all() and len(mine) == len(want)
    assert sq.fold_phases(df.limit(0), "k", "t", "id", 1300).count() == 0
    assert df.filter(F.col("k").isNull()).count() == 5000
