"""Mixing, licence scans, WARC derivatives and the pipeline."""

import hashlib

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import licenses, mixing, queries, warc

SF = "/root/testdata/sf0.001"


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    got = mixing.targets([10, 1000, 10], [1, 2, 3])
    assert got == pytest.approx([30, 960, 30]) and sum(got) == pytest.approx(1020)
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_mix(spark):
    texts = [(i, " ".join(["w"] * (1 + i * 7 % 90)), None if i % 11 == 0 else f"s{min(i % 7, 3)}", i) for i in range(400)]
    texts += [(900, None, "s1", 0), (901, "", "s9", 0), (None, "a b c", "s1", 0), (5, texts[5][1], "s3", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, target int").repartition(4)
    rows = mixing.taken(docs, block=8, slots=64).collect()
    again = mixing.taken(docs.repartition(7), block=8, slots=64).collect()
    key = sorted((str(r["id"]), r["size"], r["taken"]) for r in rows)
    assert key == sorted((str(r["id"]), r["size"], r["taken"]) for r in again)
    assert len(rows) == len(texts) and all(r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0], s[1] = s[0] + r["size"], s[1] + r["taken"]
    assert all(size == total for size, _, _, total in by.values())
    assert sum(t for _, _, t, _ in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    for size, taken, target, _ in by.values():
        assert abs(taken - target) <= 0.03 * target + 16
    assert mixing.taken(docs.filter("false")).count() == 0
    assert mixing.taken(docs.filter("doc_id = 901")).first()["taken"] == 0


def test_mix_pieces_are_whole(spark):
    docs = spark.createDataFrame([(i, "x " * (5 + i), "s") for i in range(60)], "doc_id long, text string, source string")
    _, pieces = mixing.mix(docs, block=16, slots=32)
    for r in pieces.groupBy("id").agg(F.sum("words").alias("w")).collect():
        assert r["w"] == 5 + r["id"]  # one source: every block exactly once


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None


def test_license_edges(spark):
    mit = licenses.TEMPLATES["MIT"][3]
    docs = spark.createDataFrame([(1, "Intro\nreleased UNDER the MIT license\nend", 0.5), (2, None, 0.5), (3, "", 0.5), (4, "license", 0.5),
                                  (5, "x\n\n" + mit.replace(" copy, modify", "\ncopy, modify") + "\n\ny", 0.5), (6, "the mit license is short", 0.5),
                                  (1, "Intro\nreleased UNDER the MIT license\nend", 0.5)], "doc_id long, text string, dice double")
    got = {(r["doc_id"], r["part"], r["place"]): r["license"] for r in licenses.scan(docs).collect()}
    # the whole of document 1 is one paragraph: 4 of its 6 bigrams, 2 * 4 / (6 + 4)
    assert got == {(1, "line", 1): "MIT", (1, "paragraph", 0): "MIT", (5, "paragraph", 1): "MIT", (5, "text", 0): "MIT"}
    assert licenses.scan(docs.filter("false")).count() == 0


def parse_warc(data):
    """Records of WARC text: headers and block."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n: n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4:]
    return out


def test_warc_files(spark, tmp_path):
    import base64
    import gzip
    import glob
    pages = spark.createDataFrame([(1, "http://a/x", "<html><title>A &amp; B</title><script>var t='</p>'</script><p>Hé <b>you</b></p><a href=\"/l?a=1&amp;b\">l</a></html>"),
                                   (2, None, None), (3, "http://b/", ""), (3, "http://b/", "")], "page_id long, url string, html string")
    responses = warc.as_responses(pages.withColumn("block", F.lit("x")))
    warc.write_warc(warc.derive(responses), str(tmp_path / "w"))
    records = [r for f in glob.glob(str(tmp_path / "w/*.gz")) for r in parse_warc(gzip.open(f).read())]
    assert len(records) == 8
    ids = {f"<{r['record_id']}>" for r in responses.collect()}
    for fields, block in records:
        assert fields["WARC-Refers-To"] in ids and fields["WARC-Type"] in ("metadata", "conversion")
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    text = [b for f, b in records if f["WARC-Type"] == "conversion" and f.get("WARC-Target-URI") == "http://a/x"]
    assert text == ["A & B\nHé you\nl".encode()]
    meta = [b.decode() for f, b in records if f["WARC-Type"] == "metadata" and f.get("WARC-Target-URI") == "http://a/x"][0]
    assert "title: A & B\r\n" in meta and "outlink: /l?a=1&b\r\n" in meta and "source-status: 200" in meta


def test_pipeline(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    folder = str(tmp_path / "sf")
    clean = source.limit(300)
    extra = spark.createDataFrame([(90_001, "12345 !!! 678", "en", "src1", 1), (90_002, None, "en", "src1", 0), (90_003, "", None, None, 0)], source.schema)
    copies = clean.limit(20).withColumn("doc_id", F.col("doc_id") + 80_000)
    clean.union(extra).union(copies).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit(1)), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert not {90_001, 90_002, 90_003} & set(seen["language"]) and len(seen["language"]) >= 318
    assert len(seen["toxicity"]) >= 0.8 * len(seen["language"])
    assert not [i for i in seen["near_duplicates"] if i >= 80_000] and len(set(seen["near_duplicates"])) == len(seen["near_duplicates"])
    assert set(seen["mixing"]) <= set(seen["near_duplicates"]) and sorted(seen["tokens"]) == sorted(seen["mixing"])
    assert docs.filter("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == len(seen["tokens"])


def test_pipeline_of_nothing(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_license_rows_without_an_id_of_their_own(spark):
    """Rows that share an id, or have none, keep their own matches; the words looked for first lose no match."""
    texts = ["Released under the MIT License.", "Licensed under the ISC License."]
    docs = spark.createDataFrame([(i, t) for i in (None, 7) for t in texts] + [(8, "no notice here"), (9, "x\n" + texts[0] + "\n" + texts[1])], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["place"], r["license"]) for r in licenses.scan(docs).collect())
    assert got == [(0, 0, "ISC"), (0, 0, "MIT"), (7, 0, "ISC"), (7, 0, "MIT"), (9, 1, "MIT"), (9, 2, "ISC")]


def test_every_match_holds_a_marker():
    import random
    import re
    rng = random.Random(5)
    words = licenses.markers(licenses.TEMPLATES, 0.8)
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            own = re.findall("[a-z0-9]+", text.lower())
            grams = set(zip(own, own[1:]))
            for _ in range(200):
                some = [w for w in own if rng.random() > 0.12] + rng.sample(["foo", "bar", "the", "of"], rng.randint(0, 2))
                mine = set(zip(some, some[1:]))
                if mine and 2 * len(mine & grams) / (len(mine) + len(grams)) >= 0.8:
                    assert any(m in " ".join(some) for m in words)


def test_license_short_words_are_looked_for_in_pairs(spark):
    """Words such as "by" are parts of very many texts; a notice that holds only such pairs is found all the same."""
    words = licenses.markers(licenses.TEMPLATES, 0.8)
    assert all(" " in w or len(w) >= licenses.SHORT for w in words)
    short = {"X": ("a cc by sa 4 0 of it",)}
    docs = spark.createDataFrame([(1, "abyss by cc"), (2, "x\nA  CC-BY\tSA 4.0, of it!"), (3, "a cc by\nsa 4 0 of it"), (4, None), (5, "AKccby sa 40")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["part"], r["dice"]) for r in licenses.scan(docs, templates=short).collect())
    # document 2 as a paragraph has one bigram more than the template's seven
    assert got == [(2, "line", 1.0), (2, "paragraph", 14 / 15), (3, "paragraph", 1.0)]


def test_license_filter_lowers_a_text_once(spark):
    docs = spark.createDataFrame([(1, "Licensed under the ISC License.")], "doc_id long, text string")
    likely = docs.filter(licenses.marked(F.col("text"), licenses.markers(licenses.TEMPLATES, 0.8)))
    plan = likely._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1 and likely.count() == 1
