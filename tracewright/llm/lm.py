"""Language-model scores by a weighted backoff automaton, learned from the corpus itself.

States are the contexts seen in training (two words, one word, none).  From a context h an arc for word
w weighs  (1-B) c(hw)/c(h) + B p(w | shorter h);  for a word not seen after h only the failure arc to the
shorter context is followed, at weight B.  The root has the smoothed single words.  A text is read once
from left to right: the state is carried along and log10 weights add up.

The counts are far too many for one machine, and every text needs only its own n-grams.  So a part of
the corpus (some thousand texts) is reduced to its distinct n-gram hashes, which are split by hash into
buckets and shuffled as compressed sorted arrays; a bucket adds the training counts of all parts and
answers each part with the counts of just the hashes it sent, in their order.  The answers travel back
to the texts, which are then scored part by part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import kept, small_batches, words
from tracewright.session import staging_path

ORDER = 3
BACKOFF = 2 / 3       # share of the shorter context, and weight of a failure arc
SMOOTH = 0.1          # added to the count of every word at the root
BLOCK_ROWS = 4096     # neighbouring texts of a file that are scored together
PART_TOKENS = 2_000_000
END = xxhash.xxh64_intdigest(b"", seed=1)  # of the end of a text; also the context of its first word
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _single(word: np.ndarray) -> np.ndarray:
    return _mix(word) & ~np.uint64(3)


class Part:
    """Texts taken together: hashes of the n-gram that ends at each token, for each order."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []
        self.train: list[bool] = []
        self.tokens = 0

    def add(self, text: str | None, train: bool) -> None:
        row = words(text)
        self.rows.append(np.array([self.number.setdefault(w, len(self.number)) for w in row], np.int64))
        self.train.append(train)
        self.tokens += len(row) + 1

    def grams(self) -> np.ndarray:
        """[order, token]: hashes of n-grams of all texts in line, the order in the last two bits; 0 where a text has none yet."""
        table = np.append(np.fromiter(map(xxhash.xxh64_intdigest, self.number), np.uint64, len(self.number)), np.uint64(END))
        length = np.array([len(r) + 1 for r in self.rows])
        end = np.cumsum(length)
        flat = np.full(int(end[-1]), len(self.number))
        inside = np.ones(len(flat), bool)
        inside[end - 1] = False
        flat[inside] = np.concatenate(self.rows)
        word = table[flat]
        place = np.arange(len(flat)) - np.repeat(end - length, length)
        out = np.zeros((ORDER, len(flat)), np.uint64)
        out[0] = _single(word)
        for n in range(1, ORDER):  # the word before the first is the end mark, nothing is before that
            total = np.full(len(flat), n + 1, np.uint64)
            for back in range(n, -1, -1):
                seen = np.full(len(flat), END, np.uint64)
                seen[back:] = word[: len(word) - back]
                seen[place < back] = END
                total = _mix(total * _GOLD + seen)
            out[n] = np.where(place >= n - 1, total & ~np.uint64(3) | np.uint64(n), 0)
        return out

    def lengths(self) -> np.ndarray:
        return np.array([len(r) + 1 for r in self.rows])


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (the leading bits) begins among sorted keys, and the end."""
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def _asked(bits: int):
    """Rows (block, row, text, train) to (block, first, bucket, keys, counts), a part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        now, first, last, part = None, 0, 0, Part()

        def flush():
            grams = part.grams()
            trained = np.repeat(np.array(part.train), part.lengths())
            keys, inverse = np.unique(grams, return_inverse=True)
            counts = np.bincount(inverse.ravel(), np.tile(trained, ORDER), len(keys)).astype(np.uint32)
            if keys[0] == 0:
                keys, counts = keys[1:], counts[1:]
            edge = _bounds(keys, bits)
            full = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([
                pa.array([now] * len(full), pa.int64()), pa.array([first] * len(full), pa.int64()), pa.array(full, pa.int64()),
                pa.array([pack(np.diff(keys[edge[b]: edge[b + 1]], prepend=np.uint64(0))) for b in full], pa.binary()),
                pa.array([pack(counts[edge[b]: edge[b + 1]]) for b in full], pa.binary())],
                ["block", "first", "bucket", "keys", "counts"])

        for batch in batches:
            for block, row, text, train in zip(*(batch.column(c).to_pylist() for c in ("block", "row", "text", "train"))):
                if part.rows and (block != now or row != last + 1 or part.tokens >= PART_TOKENS):
                    yield flush()
                    part = Part()
                if not part.rows:
                    now, first = block, row
                part.add(text, bool(train))
                last = row
        if part.rows:
            yield flush()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket (sorted by bucket) to (block, first, bucket, counts) with the counts of all parts added,
    and one row without block that has the bucket's training tokens and distinct trained words."""
    now, rows = None, []

    def answer():
        sizes, keys, counts = [], [], []
        for _, _, k, c in rows:
            keys.append(np.cumsum(unpack(k, np.uint64), dtype=np.uint64))
            counts.append(unpack(c, np.uint32))
            sizes.append(len(keys[-1]))
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts))
        found = total[inverse].astype(np.uint64)
        end = np.cumsum(sizes)
        single = total[every & np.uint64(3) == 0]
        none = [None] * len(rows)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows] + [None], pa.int64()), pa.array([r[1] for r in rows] + [None], pa.int64()),
            pa.array([now] * (len(rows) + 1), pa.int64()),
            pa.array([pack(found[b - n: b]) for n, b in zip(sizes, end)] + [None], pa.binary()),
            pa.array(none + [int(single.sum())], pa.int64()), pa.array(none + [int((single > 0).sum())], pa.int64())],
            ["block", "first", "bucket", "counts", "tokens", "distinct"])

    for batch in batches:
        for block, first, bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and rows:
                yield answer()
                rows = []
            now = bucket
            rows.append((block, first, keys, counts))
    if rows:
        yield answer()


def traverse(counts: list[list[int]], start: int, root: list[float], backoff: float = BACKOFF) -> float:
    """Log10 weight of one text.

    ``counts`` has, per order, the count of the n-gram ending at each token, ``root`` the weight of the
    token at the root, ``start`` the count of the empty beginning.  The state is the counts of the
    contexts that the last words form; a count of 0 means the automaton has failed to a shorter one.
    """
    total, shorter, longer, log = 0.0, start, 0, math.log10
    seen = 1 - backoff
    for one, two, three, weight in zip(*counts, root):
        if shorter:
            weight = seen * two / shorter + backoff * weight
        if longer:
            weight = seen * three / longer + backoff * weight
        total += log(weight)
        shorter, longer = one, two
    return total


def _scored(tokens: int, distinct: int):
    """Answers and texts, sorted by (block, row, kind), to scores."""
    spread = tokens + SMOOTH * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        part, ids, answers = Part(), [], []

        def finish():
            grams = part.grams()
            keys, inverse = np.unique(grams, return_inverse=True)
            found = np.concatenate([unpack(a, np.uint64) for _, a in sorted(answers)])
            if keys[0] == 0:
                found = np.append(np.uint64(0), found)
            if len(found) != len(keys):
                raise RuntimeError("the input changed while it was scored")
            by_order = found[inverse.reshape(grams.shape)]
            starts = int(found[np.searchsorted(keys, _single(np.array([END], np.uint64)))[0]])
            root = (by_order[0] + SMOOTH) / spread
            base = np.log10(root)
            out, at = [], 0
            for id, n in zip(ids, part.lengths().tolist()):
                own = by_order[:, at: at + n]
                out.append((id, n, int((own[0] > 0).sum()), float(base[at: at + n].sum()),
                            traverse(own.tolist(), starts, root[at: at + n].tolist())))
                at += n
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                ["id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for kind, id, text, bucket, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "id", "text", "bucket", "counts"))):
                if kind == 0:
                    if ids:
                        yield finish()
                        part, ids, answers = Part(), [], []
                    answers.append((bucket, counts))
                else:
                    part.add(text, False)
                    ids.append(id)
        if ids:
            yield finish()

    return run


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", scanned: bool = False) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are lower-cased (A-Z) runs without ASCII white space and one end; null is an empty text.
    Rows where ``train`` is true are learned from (null: not).  ``base_score`` uses single words alone.
    Repeated rows count and come out as often; ids may be null.  Other columns are neither needed nor
    returned.  A text must be found again under the place it was counted at: with ``scanned``, docs is
    a plain Parquet scan and files and row numbers are the places; otherwise the texts are first
    written to the shared folder.  The number of buckets grows with the rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not scanned:
        docs = _staged(docs.select(F.col(id).alias("id"), F.col(text).alias("text"), train.alias("train")), "texts")
        named, id, text, train = id, "id", "text", F.col("train")
    else:
        named = id
    place = F.col("_metadata.row_index")
    rows = docs.select(F.xxhash64(F.col("_metadata.file_path"), F.floor(place / BLOCK_ROWS)).alias("block"), place.alias("row"),
                       F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    bits = min(40, (docs.count() // BLOCK_ROWS).bit_length())
    asked = rows.mapInArrow(_asked(bits), "block long, first long, bucket long, keys binary, counts binary")
    dealt = asked.repartition(F.xxhash64("bucket")).sortWithinPartitions("bucket")
    answers = _staged(dealt.mapInArrow(_answered, "block long, first long, bucket long, counts binary, tokens long, distinct long"), "answers")
    sums = answers.filter("block is null").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = sums[0] or 0, sums[1] or 0
    parts = answers.filter("block is not null").select("block", F.col("first").alias("row"), F.lit(0).alias("kind"), "bucket", "counts")
    texts = rows.select("block", "row", F.lit(1).alias("kind"), "id", "text")
    joined = parts.unionByName(texts, allowMissingColumns=True).repartition(F.xxhash64("block")).sortWithinPartitions("block", "row", "kind")
    made = joined.mapInArrow(_scored(tokens, distinct), "id long, n_tokens long, n_known long, base_score double, score double")
    return made.select(F.col("id").alias(named), "n_tokens", "n_known",
                       F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
