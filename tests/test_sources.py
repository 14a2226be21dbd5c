

import json
import random
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.operators import inventory as nv
from tracewright.operators.relations import CheckFailed, assert_keys, join_checked
from tracewright.sources import dictionary as dc
from tracewright.sources import readers as rd
from tracewright.sources import variants as vr
from tracewright.sources import writers as wr


@pytest.fixture
def log(tmp_path):
    event = {"session_id": "ses_1", "timestamp_ms": 1700000000123, "event_type": "browser_click", "event_id": "e1",
             "correlation": {"chunk_id": "c1", "sequence_number": 2}, "context": {"active_app": {"app_name": " Edge ", "window_title": ""}},
             "payload": {"current_url": "https://h/a"}, "source": {"username_hash": "u"}}
    bare = {"session_id": "ses_1", "timestamp_iso": "2023-11-14T22:13:20Z", "context": {}, "payload": [1]}
    lost = {"session_id": "ses_1", "event_type": "keystroke"}
    for chunk, lines in (("chunk_a", [event, bare]), ("chunk_b", [lost])):
        folder = tmp_path / "dataset_a" / "ses_1" / chunk
        folder.mkdir(parents=True)
        body = "\n".join(json.dumps(x) for x in lines) + ("\n\n{broken\n" if chunk == "chunk_a" else "\n")
        (folder / "events.jsonl").write_text(body)
    (tmp_path / "other.jsonl").write_text("{}\n")
    return str(tmp_path)


def test_read_events(spark, log):
    e = rd.read_events(spark, log)
    assert e.count() == 4
    assert rd.malformed_lines(e).select("_corrupt").collect()[0][0] == "{broken"
    tagged = rd.with_path_tags(e, rd.SESSION_TAGS)
    assert rows(tagged.select("path_session", "path_chunk").distinct()) == [("ses_1", "chunk_a"), ("ses_1", "chunk_b")]
    flat = rd.event_fields(e)
    clean = rd.clean_events(flat)
    assert rows(clean.select("us", "event_type", "app", "window_title", "url")) == [
        (1700000000000000, "unknown", None, None, None), (1700000000123000, "browser_click", "Edge", None, "https://h/a")]


def test_strict_boundaries(spark, tmp_path):
    good = tmp_path / "g"
    good.mkdir()
    (good / "b.jsonl").write_text('{"session_id":"s","ts":"2024-01-01T00:00:00Z","event":"start"}\n{"session_id":"s","ts":"2024-01-01T00:00:05Z","event":"end"}\n')
    assert rd.read_gt_boundaries(spark, str(good), ["start"]).count() == 1
    (good / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        rd.read_gt_boundaries(spark, str(good)).collect()
    assert rows(rd.numbered_lines(spark, str(good), "b.jsonl"), "source_line") == [(1,), (2,)]


def test_table_and_segments_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, " 2.5 ")], "a int, b string")
    path = wr.write_table(df, str(tmp_path / "t"), "csv")
    assert rows(rd.read_table(spark, path, {"a": "int", "b": "double"})) == [(1, 2.5)]
    with pytest.raises(CheckFailed):
        rd.read_table(spark, path, {"c": "int"})
    segs = spark.createDataFrame([("s", 1, 1_500_000, 2_000_000, {"pi": 2})], "session_id string, segment_index int, segment_start long, segment_end long, ev map<string,int>")
    back = wr.write_segments_jsonl(segs, str(tmp_path / "j"), ["session_id", "segment_index"])
    assert rows(back, "segment_start", "ev") == [("1970-01-01T00:00:01.500Z", '{"pi":2}')]
    with pytest.raises(CheckFailed):
        wr.write_segments_jsonl(segs.union(segs), str(tmp_path / "k"), ["session_id", "segment_index"])


def test_json_search(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[{"c":1},{"c":"x"}]},"event_id":"no","t":null}'), (2, "not json")], "id int, j string")
    assert rows(vr.json_flatten(df, ["id"], "j"), "path", "value") == [("a.b[0].c", "1"), ("a.b[1].c", "x")]
    assert rows(vr.json_find(df, ["id"], "j", ["b"]), "path") == [("a.b",)]
    assert rows(vr.json_find(df, ["id"], "j", ["B"]), "path") == []
    assert rows(vr.json_find(df, ["id"], "j", ["B"], ignore_case=True), "path") == [("a.b",)]
    recs = vr.find_records(df, ["id"], "j", ["c"], ["c", "d"])
    assert rows(recs, "c", "d") == [("1", None), ("x", None)]


def test_dictionary(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["z"]), (3, [])], "id int, lines array<string>")
    words = spark.createDataFrame([("a", "A"), ("b", "B")], "term string, translation string")
    got = rows(dc.dictionary_enrich(docs, words, "id", "lines"), "id", "translation_status", "translated_text")
    assert got == [(1, "COMPLETE", "A\nB\nA"), (2, "PENDING", ""), (3, "NO_LINES", "")]
    assert rows(dc.pending_terms(docs, words, "lines")) == [("z",)]


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    with pytest.raises(CheckFailed):
        join_checked(a, b, "k")
    with pytest.raises(CheckFailed):
        assert_keys(b, "k")
    assert join_checked(b, a, "k").count() == 2
    assert nv.audit_leakage(["before_event_count", "Case_ID_x", "label", "gt_boundary_1"]) == ["Case_ID_x", "label", "gt_boundary_1"]
    f = spark.createDataFrame([(1.0, float("inf"), "t", 7), (None, 2.0, "u", 7)], "a double, b double, c string, d int")
    got = rows(nv.audit_features(f, ["a", "b", "c", "d"]))
    assert got == [("a", True, 1, 0, True), ("b", True, 0, 1, False), ("c", False, 0, 0, False), ("d", True, 0, 0, True)]


def test_manifest_reconciliation(spark):
    e = spark.createDataFrame([("c1", "s", "k", 1), ("c1", "s", "m", 5), ("c2", "s", "k", 9), ("c3", "s", "k", 11)], "chunk string, session string, event_type string, us long")
    m = spark.createDataFrame([("c1", "s", None, "c2", 2, {"m": 1, "k": 1}, 1, 5), ("c2", "s", "c1", "c9", 3, {"k": 1}, 9, 9)],
                              "chunk string, session string, previous_chunk string, next_chunk string, total_events long, events_by_type map<string,long>, start_ts long, end_ts long")
    got = rows(nv.reconcile_manifest(e, m, "chunk", "session", "us"), "chunk", "manifest_present", "count_ok", "types_ok", "next_ok", "chunk_ok")
    assert got == [("c1", True, True, True, True, True), ("c2", True, False, True, False, False), ("c3", False, False, False, True, False)]


def test_json_search_has_no_limits(spark):
    deep = '{"n":' * 40 + '{"deep":"' + "x" * 3000 + '","empty":{},"s":"[[{{\\\"["}' + "}" * 40
    df = spark.createDataFrame([(1, deep), (2, '{"deep":2}'), (3, "7"), (4, None), (5, "[]")], "id int, j string")
    flat = rows(vr.json_flatten(df, ["id"], "j"), "id", "leaf", "value")
    assert flat == [(1, "deep", "x" * 3000), (1, "s", '[[{{"['), (2, "deep", "2"), (3, "", "7")]
    assert rows(vr.json_find(df, ["id"], "j", ["empty", "deep"]), "id", "leaf") == [(1, "deep"), (1, "empty"), (2, "deep")]
    assert rows(vr.find_records(df, ["id"], "j", ["deep"], ["deep"]), "id", "deep") == [(1, "x" * 3000), (2, "2")]


def test_json_deeper_and_longer_than_variants_go(spark):
    """1,500 levels and 20 MB: texts that the variant parser refuses are walked as texts, malformed ones give nothing."""
    n = 750
    deep = '{"n":[1, ' * n + '{"deep":"v","list":[1.50,{"deep":null,"a.b":tru}]}'.replace("tru}", "true}") + "]}" * n
    long = '{"deep":"' + "y" * 20_000_000 + '","z":' + "[" * 3 + '{"deep":7}' + "]" * 3 + "}"
    bad = ['{"a":' * 1200 + "1" + "}" * 1199, '{"a":1,"a":{"deep":2}}', '{"deep":1', '{deep:1}', '{"x":[' * 1100 + '{"deep":1,"deep":2}' + "]}" * 1100]
    df = spark.createDataFrame([(1, deep), (2, long), *((3 + i, t) for i, t in enumerate(bad))], "id int, j string")
    flat = rows(vr.json_flatten(df.filter("id != 2"), ["id"], "j", drop_leaf_regex="^n$"), "id", "path", "value")
    root = "n[1]." * n
    assert flat == sorted([(1, root + "deep", "v"), (1, root + "list[0]", "1.5"), (1, root + "list[1].a.b", "true")])
    counts = vr.json_flatten(df.filter("id = 1"), ["id"], "j").groupBy("leaf").count().collect()
    assert {r["leaf"]: r["count"] for r in counts} == {"n": n, "deep": 1, "list": 1, "a.b": 1}
    found = vr.json_find(df, ["id"], "j", ["deep"]).select("id", "path", F.length("value").alias("n")).collect()
    assert sorted((r["id"], r["path"], r["n"]) for r in found if r["n"]) == sorted([(1, root + "deep", 1), (2, "deep", 20_000_000), (2, "z[0][0][0].deep", 1), (1, root + "list[1].deep", 4)])
    assert rows(vr.find_records(df.filter("id != 2"), ["id"], "j", ["list"], ["deep", "list"]), "id", "deep") == [(1, "v")]


def test_json_walk_equals_variants(spark, monkeypatch):
    """The same rows whether levels are opened as variants or walked as text."""
    rng = random.Random(2)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([1, 1.5, -0.25, 1e30, "x", "", "é\n\"q", True, None, 123456789012345678901234])
        if kind < 0.6:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["a", "b", "c d", "", "k"]) + str(i): made(depth - 1) for i in range(rng.randint(0, 3))}

    df = spark.createDataFrame([(i, json.dumps(made(6))) for i in range(150)], "id int, j string")

    def all_rows():
        return (rows(vr.json_flatten(df, ["id"], "j"), "id", "path", "leaf", "value"), rows(vr.json_find(df, ["id"], "j", ["a0", "b1", "k0"]), "id", "path"),
                rows(vr.find_records(df, ["id"], "j", ["a0", "k1"], ["a0", "b0", "k1"]), "id", "b0"))

    want = all_rows()
    for levels in (0, 2):
        monkeypatch.setattr(vr, "LEVELS", levels)
        got = all_rows()
        assert got == want


def test_audit_of_chunks(spark):
    events = spark.createDataFrame([("a", 1, "x", "L0"), ("a", 2, "x", None), ("b", 12, "y", "L1"), ("d", 50, "x", "L0")], "chunk string, us long, kind string, layer string")
    m = [("a", "s", None, "b", 2, {"x": 2}, {"L0": 1, "": 1}, 0, 5, 1, False), ("b", "s", "a", "c", 1, {"y": 1, "z": 1}, {"L1": 1}, 12, 20, 0, True),
         ("c", "s", None, None, 0, {}, {}, 21, 22, 0, False), ("e", "t", "a", None, 0, None, {}, 0, 1, 2, False)]
    manifests = spark.createDataFrame(m, "chunk string, session string, previous_chunk string, next_chunk string, total_events long, kinds map<string,long>, layers map<string,long>, "
                                         "start_ts long, end_ts long, screenshots long, has_gaps boolean")
    shots = spark.createDataFrame([("a", "1.png"), ("e", "2.png")], "chunk string, path string")
    maps = {"kind": "kinds", "layer": "layers"}
    got = {r["chunk"]: r.asDict() for r in nv.audit_chunks(events, manifests, shots, "chunk", "session", "us", maps, 6).collect()}
    assert got["a"]["chunk_ok"] and got["a"]["gap_before"] is None
    b = got["b"]
    assert (b["count_ok"], b["kind_ok"], b["layer_ok"], b["previous_ok"], b["next_ok"], b["gap_before"], b["gaps_ok"]) == (True, False, True, True, False, 7, True)
    assert got["c"]["previous_ok"] and got["c"]["gap_before"] == 1 and got["c"]["chunk_ok"]
    assert not got["d"]["manifest_present"] and not got["d"]["count_ok"] and not got["d"]["chunk_ok"]
    e = got["e"]
    assert (e["kind_ok"], e["layer_ok"], e["screenshots_ok"], e["previous_ok"]) == (False, True, False, False)
    assert rows(nv.count_differences(events, manifests, "chunk", maps)) == [("b", "kind", "z", 0, 1), ("d", "kind", "x", 1, 0), ("d", "layer", "L0", 1, 0)]
