"""Mixing sources to target weights.

The words of each source, documents in hash order, form one line that is cut into fixed-length blocks.
Every output shard has a fixed number of slots and draws from a multinomial how many of them each
source fills.  The slots of a source are numbered over all shards; slot t takes block p(t mod n) of its
n blocks, p a pseudorandom permutation of its own for every pass, so blocks repeat only after all
others were used.  Slots meet their blocks in a join by index.

The draws of all shards add up to a little more or less than a source's quota; slots beyond the quota
go to the sources that fell short, in order, so that every quota is met.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import running_before, small_batches
from tracewright.session import staging_path

MAX_SOURCES = 100_000
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; 0 for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([len(t.encode().split()) if t else 0 for t in batch.to_pylist()], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text)


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; the excess is shared anew."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    left, weight = total, float(sum(weights))
    # by growing size per weight: once one is not stopped, none after it is
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k] / weights[k]):
        out[k] = min(most * sizes[k], left * weights[k] / weight)
        left, weight = left - out[k], weight - weights[k]
    return out


@dataclass(frozen=True)
class Layout:
    """Per source, in order: words, blocks, target words and quota of slots."""
    sources: list[str | None]
    sizes: list[int]
    blocks: np.ndarray
    target: list[float]
    quota: np.ndarray


def layout(totals: dict[str | None, int], block: int, weights: Sequence[int], most: float) -> Layout:
    sources = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in totals)
    sizes = [totals[s] for s in sources]
    target = targets(sizes, [weights[k % len(weights)] for k in range(len(sources))], most)
    blocks = np.array([-(-n // block) for n in sizes], np.int64)
    quota = np.array([round(t * b / n) if n else 0 for t, b, n in zip(target, blocks.tolist(), sizes)], np.int64)
    return Layout(sources, sizes, blocks, target, quota)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1: a Feistel network, walked on until it lands below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(x):
        left, right = x >> np.uint64(half), x & low
        for turn in range(4):
            f = (right + np.uint64((key * 8 + turn) & (2 ** 63 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * _MIX
            left, right = right, left ^ ((f >> np.uint64(29)) & low)
        return left << np.uint64(half) | right

    x = once(index.astype(np.uint64))
    while len(out := np.flatnonzero(x >= n)):
        x[out] = once(x[out])
    return x.astype(np.int64)


def _draws(plan: Layout, slots: int, seed: int, total: int):
    share = plan.quota / max(1, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, count = [], [], []
            for s in batch.column(0).to_pylist():
                drawn = np.random.default_rng([seed, s]).multinomial(min(slots, total - s * slots), share)
                for k in np.flatnonzero(drawn).tolist():
                    shard.append(s)
                    source.append(k)
                    count.append(int(drawn[k]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard, source, count)], ["shard", "source", "count"])

    return run


def _placed(plan: Layout, drawn: np.ndarray, seed: int):
    """Slots (shard, source, t) to (shard, source, slot, block), the surplus handed to who fell short."""
    surplus, short = np.maximum(drawn - plan.quota, 0), np.maximum(plan.quota - drawn, 0)
    surplus_before, short_end = np.cumsum(surplus) - surplus, np.cumsum(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, count, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            source = np.repeat(source, count)
            t = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            over = np.flatnonzero(t >= plan.quota[source])
            place = surplus_before[source[over]] + t[over] - plan.quota[source[over]]
            to = np.searchsorted(short_end, place, side="right")
            source[over], t[over] = to, drawn[to] + place - (short_end[to] - short[to])
            block = np.empty(len(t), np.int64)
            turn = t // plan.blocks[source]
            for k, p in set(zip(source.tolist(), turn.tolist())):
                at = np.flatnonzero((source == k) & (turn == p))
                n = int(plan.blocks[k])
                block[at] = permuted(t[at] % n, n, (seed * 1_000_003 + k) * 64 + p)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.repeat(shard, count), source, t, block)],
                                             ["shard", "source_no", "slot", "block"])

    return run


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3),
        most: float = 3.0, block: int = 64, slots: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes and targets, and the pieces of them that the mix takes.

    First table: row (a number), id, source, size (words), source_size, target (words of its source).
    Second: shard, source_no, slot, row, id, begin, words: each piece of a block a slot takes.

    Sources are weighed in code point order, null last, ``weights`` repeating; targets share the sum of
    all sizes and stop at ``most`` times a source's size.  No block, hence no document, is taken more
    than ``ceil(most)`` times.  Texts that are null or without words have size 0 and no pieces; repeated
    rows are separate documents; ids may be null.  Reruns agree: order and draws come from hashes of ids
    and from ``seed``.  One row per source reaches the driver (more than 100,000 sources are an error).
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = _staged(plain.withColumn("row", F.monotonically_increasing_id()), "sizes")
    totals = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = layout(totals, block, weights, most)
    known = spark.createDataFrame([(k, s, n, float(t)) for k, (s, n, t) in enumerate(zip(plan.sources, plan.sizes, plan.target))],
                                  "source_no long, name string, source_size long, target double")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    total = int(plan.quota.sum())
    # documents on the line of their source
    chunks = max(1, rows.count() // 4_000)
    hashed = rows.filter("size > 0").select("row", "id", "source_no", "size", F.xxhash64("id").alias("h"))
    line = running_before(hashed.withColumn("chunk", F.pmod("h", F.lit(chunks))), "source_no", "chunk", ["h", "id", "size", "row"], "size", "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = line.select("source_no", "row", "id", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))
    packed = cut.select("source_no", "block", "row", "id", begin.alias("begin"), (end - begin).alias("words"))
    # slots of all shards
    shards = spark.range(-(-total // slots)).withColumnRenamed("id", "shard")
    drawn = _staged(shards.mapInArrow(_draws(plan, slots, seed, total), "shard long, source long, count long"), "draws")
    sums = np.zeros(len(plan.sources), np.int64)
    for r in drawn.groupBy("source").agg(F.sum("count").alias("n")).collect():
        sums[r["source"]] = r["n"]
    numbered = running_before(drawn.withColumn("chunk", F.floor(F.col("shard") / 1024)), "source", "chunk", ["shard"], "count", "first")
    placed = numbered.select("shard", "source", "count", "first").mapInArrow(
        _placed(plan, sums, seed), "shard long, source_no long, slot long, block long")
    # sizes of what Python or explode makes are not known beforehand: neither side may be broadcast
    return rows, placed.hint("merge").join(packed.hint("merge"), ["source_no", "block"]).select("shard", "source_no", "slot", "row", "id", "begin", "words")


def taken(docs: DataFrame, **options) -> DataFrame:
    """The first table of :func:`mix` with the words each document gives to the mix, repeats counted."""
    rows, pieces = mix(docs, **options)
    sums = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
