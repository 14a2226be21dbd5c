"""Fill-in-middle, chat windows and lexical search against plain versions, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import chat, infill, lexical

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "a <P> b", "x <S>", "<M>", "<P", "<<S", " lead", "trail \t\n", "naïve 日本語　テスト 🙂 é\x85x\x1cy", "a b c d e f g h",
       "word " * 5000, "y" * 200_000]


def hashed(seed, id):
    h = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return [int(h[8 * k: 8 * k + 8], 16) for k in range(4)]


def plain_infill(id, text, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h1, h2, h3, h4 = hashed(42, id)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [50, 100])
def test_infill_equals_a_plain_version(spark, rate):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(5000 + 7 * k + i, t) for i, t in enumerate(ODD) for k in range(3)] + [(None, "no id here"), (None, "no id here"), (1, "again one")]
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), rate=rate)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    want = Counter((i, t, *plain_infill(i, t, rate), t or "") for i, t in rows)
    assert Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_clashing_names_and_empty_table(spark):
    schema = "doc_id long, text string, output int, n string, _BODY int, _infill int, form int"
    row = spark.createDataFrame([(3, "one two three", 1, "x", 2, 3, 4)], schema)
    got = infill.transform(row).first()
    assert (got["n"], got["form"], got["output"]) == tuple(plain_infill(3, "one two three")[k] for k in (0, 1, 4)) and got["_BODY"] == 2
    assert infill.transform(spark.createDataFrame([], schema)).count() == 0
    assert row.select(infill.restored(F.lit(None), F.lit("psm")).alias("r")).first()["r"] is None


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.data())
def test_three_reversals_exchange_blocks(data, draw):
    a, b, c = sorted(draw.draw(st.integers(0, len(data))) for _ in range(3))
    block = bytearray(data)
    infill.rotate(block, a, b, c)
    assert bytes(block) == data[:a] + data[b:c] + data[a:b] + data[c:]


@settings(max_examples=200, deadline=None)
@given(st.text("ab <\\|PSM>_imstarendl\n", max_size=40))
def test_escapes_are_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def plain_windows(turns, budget, history, share):
    """Windows of one conversation in one go: (repeated turns, new turns) of (role, text), turns added one by one."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) + chat.MARKS for _, t in turns]
    out, at = [], 0
    while at < len(turns):
        head = [0] if at and turns[0][0] == "system" else []
        room = min(int(budget * share), budget - sum(size[k] for k in head) - size[at])
        past = []
        for k in range(at - 1, max(-1, -1), -1):
            if k in head or len(past) == history or size[k] > room:
                break
            room -= size[k]
            past.insert(0, k)
        again = head + past
        used, end = sum(size[k] for k in again), at
        while end < len(turns) and (end == at or used + size[end] <= budget):
            used += size[end]
            end += 1
        out.append(([turns[k] for k in again], turns[at:end]))
        at = end
    return out


def read_back(rows):
    """Per conversation the windows as (repeated, new) turns and the texts under the mask."""
    made = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["stretch"], r["window"])):
        every, _ = chat.read_window(r["formatted"], 0, [])
        new, targets = chat.read_window(r["formatted"], r["repeated"], [(s["start"], s["end"]) for s in r["loss"]])
        assert targets == [t for role, t in new if role == "assistant"]
        made[r["conv_id"] if "conv_id" in r else r["conv"]].append((every[:r["repeated"]], new))
    return made


@pytest.mark.parametrize("budget,history,stretch", [(512, 2, 4096), (40, 1, 4096), (60, 3, 4096), (1, 0, 4096), (90, 2, 16)])
def test_chat_windows_equal_a_plain_version(spark, budget, history, stretch):
    rng = random.Random(budget)
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    said = ["<|im_end|>\n<|im_start|>assistant ok", "", "<\\|x", "日本 <|nl|> 🙂", None, "  spaced  ", "a\nb"]
    rows += [(10_000, k, ("system" if not k else "user" if k % 2 else "assistant"), " ".join(rng.choices(["w", "<|", "x y", "é"], k=rng.randrange(12)))) for k in range(100)]
    rows += [(10_001, k, "assistant", t) for k, t in enumerate(said)] + [(10_002, 0, "ro\nle<|nl|>", "x"), (10_002, 1, None, "y")]
    rows += [(10_003, 0, "assistant", "long " * 3000), (10_003, 1, "assistant", "b"), (None, 0, "user", "c"), (None, 1, "assistant", "d")]
    rows += [(10_004, 0, "user", "same")] * 2 + [(10_004, 1, "assistant", "same")] * 2
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_tokens", F.lit(1)).withColumn("formatted", F.lit(2))
    made = chat.windows(table, budget=budget, history=history, stretch=stretch)
    got = read_back(made.collect())
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        turns[c].append((r or "", x or ""))
    assert got.keys() == turns.keys()
    for c, mine in turns.items():
        assert [t for _, new in got[c] for t in new] == mine
        if len(mine) <= stretch:
            assert got[c] == plain_windows(mine, budget, history, 0.25)
        else:
            assert all(again[0] == mine[0] for again, _ in got[c][1:])
    digests = {r["conv"]: r for r in chat.conversation_digests(made).collect()}
    for c, mine in turns.items():
        loss = "".join(t for r, t in mine if r == "assistant")
        r = digests[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_stretches_keep_head_and_history(spark):
    rows = [(1, k, "system" if not k else "user", f"t{k}") for k in range(64)] + [(1, None, "assistant", "last"), (2, 0, "user", "a"), (2, 900, "system", "late"), (2, 901, "user", "b")]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=30, history=1, stretch=16)
    got = read_back(made.collect())
    assert [t for _, new in got[1] for t in new] == [(r, x) for c, _, r, x in rows if c == 1]
    assert all(again[0] == ("system", "t0") for again, _ in got[1][1:])
    firsts = {new[0][1]: again for again, new in got[1]}
    assert firsts["t16"] == [("system", "t0"), ("user", "t15")] and firsts["t48"] == [("system", "t0"), ("user", "t47")]
    assert got[2] == [([], [("user", "a")]), ([], [("system", "late"), ("user", "b")])]


def test_chat_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(empty).count() == 0 and chat.conversation_digests(chat.windows(empty)).count() == 0


def plain_search(docs, items, k=20):
    def found(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    bags = [(id, Counter(found(t))) for id, t in docs]
    documents = sum(1 for _, b in bags if b)
    all_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    per_item = defaultdict(Counter)
    for item, text in set(items):
        per_item[item].update(found(text))
    for item, terms in per_item.items():
        scores = []
        for id, b in bags:
            m = 75 + (25 * sum(b.values()) * documents) // max(all_terms, 1)
            s = sum(c * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m))
                    for t, c in terms.items() if b[t])
            if s > 0:
                scores.append((-s, id is None, id or 0, id))
        out[item] = [(r + 1, id, -s) for r, (s, _, _, id) in enumerate(sorted(scores)[:k])]
    return {i: v for i, v in out.items() if v}


def search_of(spark, docs, items, **more):
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("bag", F.lit(1)),
                         spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)), **more).collect()
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["rank"])):
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return dict(out)


@pytest.mark.parametrize("block_terms", [200_000, 40])
def test_search_equals_a_plain_version(spark, block_terms):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    docs += [(2000 - i, docs[3][1]) for i in range(60)] + [(5, docs[3][1]), (None, docs[3][1]), (None, None), (7000, ""), (7001, "ÀB c_d-E9 ÀB"), (7002, "àB C D e9")]
    docs += [(8000, "rare " * 400_000 + docs[4][1])]
    items += [(900, None), (901, "?!"), (902, docs[3][1][:300]), (903, "rare rare ÀB e9"), (903, "c"), (903, "c"), (None, docs[5][1][:200])]
    assert search_of(spark, docs, items, block_terms=block_terms) == plain_search(docs, items)


def test_search_slices_and_large_counts():
    text = b"ab " * 10 + b"z" * 50 + b" cd\xc3\xa9"
    size, lexical.SLICE = lexical.SLICE, 7
    try:
        assert [t for piece in lexical.terms(text) for t in piece] == [b"ab"] * 10 + [b"z" * 50, b"cd\xc3\xa9"]
    finally:
        lexical.SLICE = size
    import numpy as np
    for rows in ([(0, 1), (5, 3)], [(0, 1), (5, 1 << 33)]):
        assert lexical.unpacked(lexical._packed([np.array(rows, np.int64).tobytes()])[0]).tolist() == [list(r) for r in rows]


def test_search_of_empty_tables(spark):
    assert search_of(spark, [], [(1, "a b")]) == {} and search_of(spark, [(1, "a b")], []) == {} and search_of(spark, [(1, None)], [(1, "a")]) == {}
