r"""Ranked lexical search with bag de-duplication.

Every document is restricted to the terms of the items: what is left is a vector of (term, occurrences).
A document's score needs only that vector and m, which stands for its length.  So documents are dealt by
a hash of (vector, m); rows of one hash are compared byte by byte, equal ones are one class, and a class
is scored once.  Its members have equal scores, so of a class only the k smallest ids can be among the
k best of an item: those are found before the shuffle already, and a class of any size costs k rows a task.

Items are taken in blocks of bounded vocabulary, whose terms go to every task; each block passes over
the documents.  Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z
lower-cased, on UTF-8 bytes: ASCII letters, digits and all that is not ASCII.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import kept, small_batches, uncollected
from tracewright.session import staging_path

BLOCK_TERMS = 200_000   # (item, term) pairs of a block of items, on average
SLICE = 1 << 20         # bytes of a text that are cut into terms at once
SCORED = 1 << 21        # scores (classes times items) worked out at once
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LAST = np.iinfo(np.int64).max  # a null id, after all others


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in slices that no term crosses."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def terms(text: bytes) -> Iterator[list[bytes]]:
    for piece in pieces(text):
        yield _TERM.findall(piece.lower())


def _bags(vocabulary: dict[bytes, int]):
    """Rows (id, text) to (id, n, bag): number of terms, and the vocabulary's terms with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        for batch in batches:
            sizes, bags = [], []
            with uncollected():
                for text in batch.column(1):
                    n, found = 0, {}
                    for piece in terms(text.as_py() or b""):
                        n += len(piece)
                        for term in piece:
                            at = vocabulary.get(term)
                            if at is not None:
                                found[at] = found.get(at, 0) + 1
                    sizes.append(n)
                    bags.append(np.array(sorted(found.items()), np.int64).tobytes() if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(_packed(bags), pa.binary())], ["id", "n", "bag"])

    return run


def _packed(bags: list[bytes | None]) -> list[bytes | None]:
    """Bags as 32-bit numbers where all fit, which is told by their length modulo 16."""
    out = []
    for bag in bags:
        if bag is not None:
            wide = np.frombuffer(bag, np.int64)
            if int(wide.max()) < 1 << 32:
                bag = wide.astype(np.uint32).tobytes()
            else:
                bag += b"\0"
        out.append(bag)
    return out


def unpacked(bag: bytes) -> np.ndarray:
    """[entry, (term, occurrences)]"""
    wide = len(bag) % 8 == 1
    return np.frombuffer(bag[:-1] if wide else bag, np.int64 if wide else np.uint32).astype(np.int64).reshape(-1, 2)


def _frequencies(size: int):
    """Rows (bag) to (term, documents), added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            bags = [unpacked(b)[:, 0] for b in batch.column(0).to_pylist()]
            if bags:
                total += np.bincount(np.concatenate(bags), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "df"])

    return run


class Postings:
    """The items that hold each term: per term the items and weight times repeats."""

    def __init__(self, items: int, term: np.ndarray, item: np.ndarray, repeats: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.items = items
        self.item, self.value = item[order], (weight[term] * repeats)[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def scores(self, bags: list[np.ndarray], m: np.ndarray) -> np.ndarray:
        """Scores [class, item] in 64-bit integers."""
        out = np.zeros(len(bags) * self.items, np.int64)
        lengths = [len(b) for b in bags]
        term, tf = np.concatenate(bags).T
        row = np.repeat(np.arange(len(bags)), lengths)
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, lengths))
        first, many = self.start[term], self.start[term + 1] - self.start[term]
        ends = np.cumsum(many)
        step = 1 << 20
        for low in range(0, len(term), step):  # entries of very long vectors are taken a part at a time
            some = slice(low, low + step)
            count = many[some]
            at = np.arange(int(count.sum())) - np.repeat(ends[some] - count - (ends[low - 1] if low else 0), count) + np.repeat(first[some], count)
            np.add.at(out, np.repeat(row[some], count) * self.items + self.item[at], np.repeat(part[some], count) * self.value[at])
        return out.reshape(len(bags), self.items)


class Best:
    """The k best documents of every item so far: highest score, then smallest id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((items, k), np.int64), np.full((items, k), _LAST)

    def add(self, scores: np.ndarray, members: list[list[int]]) -> None:
        least = self.score[:, -1]
        for item in np.flatnonzero(((scores >= np.maximum(least, 1)).any(0))):
            rows = np.flatnonzero(scores[:, item] >= max(least[item], 1))
            many = [len(members[r]) for r in rows]
            score = np.concatenate([self.score[item], np.repeat(scores[rows, item], many)])
            ids = np.concatenate([self.id[item], np.fromiter((i for r in rows for i in members[r]), np.int64)])
            order = np.lexsort((ids, -score))[: self.k]
            self.score[item], self.id[item] = score[order], ids[order]


def _classes(postings: Postings, k: int):
    """Rows (hash, m, bag, id) sorted so to the k best (item, id, score) of the task; a class is scored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = Best(postings.items, k), None
        bags: list[np.ndarray] = []
        sizes: list[int] = []
        members: list[list[int]] = []

        def score() -> None:
            if bags:
                best.add(postings.scores(bags, np.array(sizes, np.int64)), members)
            bags.clear()
            sizes.clear()
            members.clear()

        held = 0
        for batch in batches:
            for key, m, bag, id in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (key, m, bag):  # equal hashes are not enough: m and the vector are compared
                    if (len(bags) + 1) * postings.items > SCORED or held > SLICE:
                        score()
                        held = 0
                    now = (key, m, bag)
                    bags.append(unpacked(bag))
                    sizes.append(m)
                    members.append([])
                    held += len(bags[-1])
                members[-1].append(_LAST if id is None else id)
        score()
        item, place = np.nonzero(best.score)
        id = best.id[item, place]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(id, pa.int64(), mask=id == _LAST),
                                          pa.array(best.score[item, place], pa.int64())], ["item", "id", "score"])

    return run


def length_factor(n: Column, documents: int, all_terms: int) -> Column:
    """m of a document with n terms, in 64-bit integers rounding down."""
    return F.lit(75).cast("long") + F.expr(f"(25L * `{n}` * {documents}L) div {max(all_terms, 1)}L")


def _item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item, term, repeats); texts of one id count together, a text that the id repeats once."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[t for piece in terms(x or b"") for t in piece] for x in batch.to_pylist()], pa.list_(pa.binary()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rows = items.select(F.col(id).cast("long").alias("item"), F.col(text).cast("binary").alias("t")).distinct()
    return rows.select("item", F.explode(F.arrow_udf(run, "array<binary>")(F.col("t"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("repeats"))


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _block_best(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """(item_id, rank, id, score): the k best documents of the items in ``rows`` (item, term, repeats)."""
    spark: SparkSession = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    ids = sorted({r["item"] for r in rows}, key=lambda i: (i is None, i))
    number = {i: k for k, i in enumerate(ids)}
    bags = _staged(docs.mapInArrow(_bags(vocabulary), "id long, n long, bag binary"), "bags")
    documents, all_terms = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = bags.filter("bag is not null")
    counts = held.select("bag").mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.collect():  # at most one row for each term of the block
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    postings = Postings(len(ids), np.array([vocabulary[bytes(r["term"])] for r in rows]), np.array([number[r["item"]] for r in rows]),
                        np.array([r["repeats"] for r in rows]), weight)
    keyed = held.select(length_factor("n", documents, all_terms).alias("m"), "bag", "id").withColumn("hash", F.xxhash64("bag", "m"))
    first = F.row_number().over(Window.partitionBy("hash", "m", "bag").orderBy(F.col("id").asc_nulls_last()))
    fewer = keyed.withColumn("_at", first).filter(F.col("_at") <= k).select("hash", "m", "bag", "id")
    dealt = fewer.sortWithinPartitions("hash", "m", "bag", F.col("id").asc_nulls_last())
    found = dealt.mapInArrow(_classes(postings, k), "item long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id",
           text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    Equal scores are ranked by ascending doc_id, null ids last.  Every row of ``docs`` is a document, also
    those that repeat an id or a text; null and empty texts hold no term and count in no statistic.
    Texts of one item_id (which may be null) are searched together as one item, a repeated row once; an
    item without terms gives no row.  Other columns are neither needed nor returned.  ``block_terms``
    bounds the vocabulary that tasks and the driver hold at a time; a single item may exceed it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    asked = _staged(_item_terms(items, item_id, text), "item_terms")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if rows:
            part = _block_best(narrow, rows, k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "item_id long, rank int, id long, score long")
    return out.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(doc_id), "score")


def search_sql(k: int = 20) -> str:
    """The same over the tables ``documents`` and ``benchmark``, every document with every item that shares a term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
 dt AS (SELECT row, term, count(*) AS tf FROM (SELECT row, {found} AS term FROM d) GROUP BY 1, 2),
 size AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM dt GROUP BY 1),
 st AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
 q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {found} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM dt, st WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
 m AS (SELECT row, 75 + (25 * n * docs) // terms AS m FROM size, st),
 s AS (SELECT item_id, row, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN dt USING (term) JOIN m USING (row) GROUP BY 1, 2),
 r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM s JOIN d USING (row) WHERE score > 0)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {k}"""
