"""Near duplicates of texts and vectors, components, neighbours: brute force and edge cases."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import ann, neardup, pivots
from tracewright.llm.components import components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 1000 + i) for i in range(300)]
    noise = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges = chain + star + noise + [(5, 5)] + chain[:3]
    want = Union()
    for a, b in edges:
        want.link(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k: k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_classes(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows]
    union, index = Union(), defaultdict(list)
    for k, (i, s) in enumerate(sets):
        union.find(i)
        seen = defaultdict(int)
        for x in s:
            for o in index[x]:
                seen[o] += 1
            index[x].append(k)
        for o, n in seen.items():
            if 100 * n >= 80 * (len(s) + len(sets[o][1]) - n):
                union.link(i, sets[o][0])
    return {i: (len(s), union.find(i)) for i, s in sets}


def edited(words, share, rng):
    return [rng.choice("abcdefgh") * 5 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("small,block", [(96, 256), (6, 8)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice((3, 6, 40, 200)))] for _ in range(30)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k, words in enumerate(base):
        for _ in range(rng.choice((1, 2, 12 if k % 5 else 40))):
            rows.append(" ".join(edited(words, rng.choice((0, 0.01, 0.03, 0.05)), rng)))
        rows.append(" ".join(passage + words))
    rows += [" ".join(base[4]).upper(), "", None, " \n", "one two", "One\tTWO", "one", "x" * 5000]
    rng.shuffle(rows)
    data = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in data] + [(0, rows[0], 0, "k")], "doc_id long, text string, kept int, node string").repartition(5)
    got = neardup.near_duplicates(docs, shingle=4).collect()
    want = brute_classes(data, 4)
    assert len(got) == len(data) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    """Texts that are alike at 0.5 to 0.95: the exact rest in blocks of 32 sets, or of 1,000 shingles, finds every link."""
    monkeypatch.setattr(neardup, "SMALL", 6)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "REST", 32)
    monkeypatch.setattr(neardup, "REST_SHINGLES", 1000)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    data = [(i, " ".join(edited(base, rng.choice((0.02, 0.03, 0.05, 0.08)), rng))) for i in range(150)]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), shingle=4).collect()
    want = brute_classes(data, 4)
    assert 10 < len({c for _, c in want.values()}) < 140
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_sets_outside_the_largest_part_meet_few_blocks(spark, monkeypatch):
    """A group of texts that are alike and not linked: blocks of the rest hold each set a few times, not once for 256 others."""
    rows_of = {}
    plain = neardup._by_block

    def counted(rows, columns, work):
        if work is neardup._involved:
            rows_of["involved"] = rows.count()
        return plain(rows, columns, work)

    monkeypatch.setattr(neardup, "_by_block", counted)
    rng = random.Random(10)
    base = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(edited(base, 0.05, rng))) for i in range(1500)]
    assert neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shingle=4).count() == 1500
    assert rows_of["involved"] <= 16 * 1500


def test_shared_shingles_are_counted_exactly():
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(1000, 1400, rng.integers(0, 60)), rng.integers(0, 1 << 60, 5)])).astype(np.uint64) for _ in range(150)]
    sets[7] = sets[3]
    for first, both in neardup.shared(sets):
        for k, row in enumerate(both):
            i = first + k
            assert np.delete(row, i).tolist() == [len(np.intersect1d(sets[i], x)) for j, x in enumerate(sets) if j != i]
    near = np.array([x[:4].view(np.uint8).repeat(4) for x in sets])
    part = rng.integers(0, 40, 150)
    agree = (near[:, None] == near[None]).mean(2)
    assert neardup.crossing(near, part).tolist() == ((agree >= neardup.LIKELY) & (part[:, None] != part)).any(1).tolist()


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == [(0, None, True), (2, 2, True), (2, 2, True), (4, 2, False)]
    assert neardup.near_duplicates(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, percent=70)


def vector_rows(n, dims, seed, copies=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // copies, dims))
    rows = []
    for k, x in enumerate(base):
        for _ in range(1 + k % (2 * copies - 1)):
            rows.append(x + rng.normal(size=dims) * np.linalg.norm(x) * rng.choice([0, 0.01, 0.02, 0.03]) / np.sqrt(dims) * 8)
    return np.array(rows, np.float32)


def test_near_duplicate_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 16)
    x = vector_rows(600, 32, 1)
    labels = [int(k % 3) if k % 17 else None for k in range(len(x))]
    rows = [(k, v.tolist(), lab, 1.0) for k, (v, lab) in enumerate(zip(x, labels))]
    odd = [(9000, None, 1, 1.0), (9001, [0.0] * 32, 1, 1.0), (9002, [float("nan")] * 32, 1, 1.0), (9003, [None] * 32, 1, 1.0), (9004, [], 1, 1.0),
           (9005, [float("inf")] + [1.0] * 31, 1, 1.0), (None, x[1].tolist(), labels[1], 1.0), (9006, [1.0, 2.0], 1, 1.0), (1, x[1].tolist(), labels[1], 1.0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, node double")
    got = pivots.near_duplicate_vectors(table).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    union, links = Union(), defaultdict(int)
    for i in range(len(x)):
        union.find(i)
        for j in np.flatnonzero(unit[i + 1:] @ unit[i] >= 0.98) + i + 1:
            if labels[i] is not None and labels[i] == labels[int(j)]:
                links[i] += 1
                links[int(j)] += 1
                union.link(i, int(j))
    assert len(got) == len(rows) + len(odd)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    right = sum(found[i] == (links[i], union.find(i)) for i in range(len(x)))
    assert sum(links.values()) > 300 and right >= 0.99 * len(x)
    assert sum(n for i, (n, _) in found.items() if i is not None and i < 9000) <= sum(links.values())
    assert all(found[i] == (0, i) for i in range(9000, 9007)) and found[None] == (0, None)
    assert pivots.near_duplicate_vectors(table.filter("false")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(5000, None, 0), (5020, [0.0] * 24, 0), (None, x[0].tolist(), 0), (20, x[20].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    score = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(score, -np.inf)
    hits = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        assert all(s == pytest.approx(score[q, v], rel=1e-12) for _, v, s in found)
        best = sorted(range(1500), key=lambda v: (-score[q, v], v))[:20]
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.95 * 20 * len(got)


def test_neighbours_of_few(spark):
    table = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(9)] + [(40, [1.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert ann.nearest(table.filter("false"), F.lit(True)).count() == 0


def exact_neighbours(x, q, k=20):
    score = x.astype(float) @ x[q].astype(float)
    score[q] = -np.inf
    return sorted(range(len(x)), key=lambda v: (-score[v], v))[:k]


@pytest.mark.parametrize("n", [1000, 3000])
def test_neighbours_from_a_poor_start(spark, monkeypatch, n):
    """Three partitions with leaves of 16: rounds go on until the graph and each search have settled."""
    monkeypatch.setattr(ann, "TREES", 3)
    monkeypatch.setattr(ann, "LEAF", 16)
    x = np.random.default_rng(4).normal(size=(n, 24)).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[q] & set(exact_neighbours(x, q))) for q in range(0, n, 50))
    assert hits >= 0.97 * 20 * (n // 50)


def test_neighbours_of_outliers(spark, monkeypatch):
    """Vectors alone in their leaves, small groups of their own and a rare length still get k rows, the exact ones."""
    monkeypatch.setattr(ann, "LEAF", 64)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((1500, 16)) + rng.normal(size=(1500, 16)) * 0.02, -np.eye(16)[:3] * 5, -np.ones((5, 16)) + rng.normal(size=(5, 16)) * 0.01]).astype(np.float32)
    rare = rng.normal(size=(30, 7)).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(2000 + k, v.tolist()) for k, v in enumerate(rare)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") >= 1500).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert all(got[q] == exact_neighbours(x, q) for q in range(1500, 1508))
    assert all(len(got[2000 + q]) == 20 for q in range(30))


def test_neighbours_almost_equal(spark, monkeypatch):
    """A third of the vectors differ by 0.003: their order is below the rounding of 8 bits, and they overfill a leaf."""
    monkeypatch.setattr(ann, "LEAF", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1800, 12))
    x[:600] = x[0] + rng.normal(size=(600, 12)) * 0.003
    x = x.astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sum(len(set(got[q]) & set(exact_neighbours(x, q))) for q in range(0, 600, 20)) >= 0.97 * 20 * 30


def test_search_goes_to_the_end_of_a_chain(spark):
    """Each node knows only the next one, and the best nodes are 40 expansions away from the query."""
    x = np.zeros((41, 4), np.float32)
    x[:, 0] = np.arange(1, 42)
    links = [(i, j) for i in range(41) for j in (i - 1, i + 1) if 0 <= j < 41]
    lists = [(i, [j for u, j in links if u == i], [x[j].tobytes() for u, j in links if u == i]) for i in range(41)]
    edges = spark.createDataFrame([(0, 1, 2.0)], "a long, b long, score double")
    queries = spark.createDataFrame([(0, x[0].tobytes(), 0.0)], "node long, small binary, slack double")
    found = ann.search(queries, edges, spark.createDataFrame(lists, "u long, nodes array<long>, vectors array<binary>"), 5, np.float32)
    assert [r["b"] for r in found.orderBy("rank").limit(5).collect()] == [40, 39, 38, 37, 36]


@pytest.mark.parametrize("at_once", [4, 1 << 16])
def test_local_join_sends_the_best_of_a_block(monkeypatch, at_once):
    """A block gets each vector once and sends at most DEGREE pairs of a node, the best that its nodes' neighbourhoods hold."""
    monkeypatch.setattr(ann, "AT_ONCE", at_once)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    ids, worst = 1000 - 3 * np.arange(120), np.where(np.arange(120) % 5, -np.inf, 1.5)
    near = [rng.choice(120, 45, replace=False) for _ in range(40)]
    news = [rng.random(45) < 0.6 for _ in near]
    rows = [(7, 0, int(ids[i]), x[i].tobytes(), float(worst[i]), None, None) for i in rng.permutation(120)]
    rows += [(7, 1, u, None, None, ids[v].tolist(), new.tolist()) for u, (v, new) in enumerate(zip(near, news))]
    rows += [(9, 0, 5, x[0].tobytes(), -np.inf, None, None), (9, 1, 5, None, None, [5], [True])]
    kinds = pa.schema([("block", pa.int64()), ("own", pa.int32()), ("node", pa.int64()), ("small", pa.binary()), ("worst", pa.float64()),
                       ("nodes", pa.list_(pa.int64())), ("news", pa.list_(pa.bool_()))])
    batches = pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds).to_batches(max_chunksize=23)
    got = defaultdict(dict)
    for batch in ann._local_join(np.float32)(iter(batches)):
        for r in batch.to_pylist():
            assert r["b"] not in got[r["a"]]
            got[r["a"]][r["b"]] = r["score"]
    score = x.astype(float) @ x.astype(float).T
    want = defaultdict(set)
    for v, new in zip(near, news):
        for i, j in ((i, j) for i in range(45) for j in range(45) if i != j and (new[i] or new[j])):
            if score[v[i], v[j]] > worst[v[i]]:
                want[v[i]].add(v[j])
    assert set(got) == {int(ids[a]) for a in want}
    for a, found in want.items():
        best = sorted(found, key=lambda b: -score[a, b])[:ann.DEGREE]
        assert set(got[int(ids[a])]) == {int(ids[b]) for b in best}
        assert all(got[int(ids[a])][int(ids[b])] == pytest.approx(score[a, b]) for b in best)


def test_search_expands_ids(spark):
    """Lists without vectors: a search brings a query's vector to the nodes, not the vectors of every list to the query."""
    x = np.zeros((41, 4), np.float32)
    x[:, 0] = np.arange(1, 42)
    lists = [(i, [j for j in (i - 1, i + 1) if 0 <= j < 41]) for i in range(41)]
    nodes = spark.createDataFrame([(i, x[i].tobytes()) for i in range(41)], "node long, small binary")
    edges = spark.createDataFrame([(0, 1, 2.0)], "a long, b long, score double")
    queries = spark.createDataFrame([(0, x[0].tobytes(), 0.0)], "node long, small binary, slack double")
    found = ann.search(queries, edges, spark.createDataFrame(lists, "u long, nodes array<long>"), 5, np.float32, nodes=nodes)
    assert [(r["b"], r["score"]) for r in found.orderBy("rank").limit(3).collect()] == [(40, 41.0), (39, 40.0), (38, 39.0)]
