"""Byte-level BPE by a public rank file: encoding with a segment tree, and decoding.

A piece (one match of the split pattern) starts as one token per byte.  The leaf of a live token
holds (rank of the pair it forms with its right neighbour, position); every inner node holds the
smaller of its children, so the root is the leftmost pair of least rank.  A merge changes three
leaves (the merged token, the swallowed one, the left neighbour), each a logarithmic update.

Short pieces of a batch run side by side, one tree per row of a matrix; a long piece has a tree of
its own, so a text without spaces costs n log n.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import kept, list_array, small_batches, tokenizer_file, trimmed, uncollected

SHORT = 64          # pieces up to so many bytes share a matrix of trees
REMEMBERED = 600_000  # distinct pieces kept between the batches of a task
_SHIFT = 6          # a node of a short piece is rank << _SHIFT | position
_NONE = np.int32(2 ** 31 - 1)


class Ranks:
    """Token bytes by rank, and the rank of every mergeable pair of tokens."""

    def __init__(self, file: bytes):
        pairs = (line.split() for line in file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = rank
        self.merges = merges
        self.keys = np.array(sorted(merges), np.int64)
        self.values = np.array([merges[k] for k in self.keys.tolist()], np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaf values of many pairs; a token below 0 is no token."""
        key = (left.astype(np.int64) << 32 | right).astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.values[at] << _SHIFT | position, _NONE).astype(np.int32)


class Encoder:
    """Ids of texts split by any pattern.  Pieces met are kept between batches as raw int32 bytes."""

    def __init__(self, file: bytes, pattern: str):
        self.ranks = Ranks(file)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def texts(self, texts: list[str | None]) -> pa.ListArray:
        rows = [self.split(t) if t else [] for t in texts]
        new = list({p for row in rows for p in row} - self.known.keys())
        self.known.update(zip(new, pieces_ids(new, self.ranks)))
        ids = [b"".join(map(self.known.__getitem__, row)) for row in rows]
        if len(self.known) > REMEMBERED:
            self.known = {}
        return list_array(np.frombuffer(b"".join(ids), np.int32), [len(x) >> 2 for x in ids], pa.int32())


def pieces_ids(pieces: list[str], ranks: Ranks) -> list[bytes]:
    """Ids of distinct pieces as raw int32 bytes."""
    out: list[bytes] = [b""] * len(pieces)
    by_size: dict[int, list[int]] = {}
    data = [p.encode() for p in pieces]
    for i, x in enumerate(data):
        rank = ranks.ranks.get(x)
        if rank is not None:
            out[i] = rank.to_bytes(4, "little")
        elif len(x) > SHORT:
            out[i] = np.array(merge_one(x, ranks), np.int32).tobytes()
        else:
            by_size.setdefault(1 << (len(x) - 1).bit_length(), []).append(i)
    for size, group in by_size.items():
        step = max(1, (1 << 20) // size)
        for at in range(0, len(group), step):
            part = group[at: at + step]
            flat, counts = merge_many([data[i] for i in part], size, ranks)
            raw, end = flat.astype(np.int32).tobytes(), np.cumsum(counts) * 4
            for i, a, b in zip(part, (end - counts * 4).tolist(), end.tolist()):
                out[i] = raw[a:b]
    return out


class PatternEncoder:
    """The same for the public pattern, cut by character classes instead of a regex engine.

    A batch is one array of code points, its texts parted by a mark.  Pieces are looked up by a
    64-bit multilinear hash with random multipliers in a sorted table of the pieces met so far.
    """

    MARK, SPACE, LETTER, NUMBER, OTHER = 4, 0, 1, 2, 3
    SLICE = 1 << 20  # code points worked on at a time

    def __init__(self, file: bytes):
        self.ranks = Ranks(file)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.cls = np.full(0x110001, self.OTHER, np.uint8)
        for value, kind in ((self.SPACE, r"\s"), (self.LETTER, r"\p{L}"), (self.NUMBER, r"\p{N}")):
            self.cls[np.frombuffer("".join(regex.findall(kind + "+", every)).encode("utf-32-le"), np.uint32)] = value
        self.cls[0x110000] = self.MARK
        self.by_place = np.random.default_rng(20).integers(0, 1 << 63, SHORT, np.uint64) * np.uint64(2) + np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.keys = np.array([0], np.uint64)           # 0: a mark, which has no ids
        self.first, self.count = np.array([0]), np.array([0], np.int32)
        self.flat = np.empty(0, np.int32)

    def texts(self, texts: list[str | None]) -> pa.ListArray:
        ids, counts, part, size = [], [], [], 0
        for at, text in enumerate(texts):
            part.append(text or "")
            size += len(part[-1])
            if size > self.SLICE or at == len(texts) - 1:
                flat, many = self._slice(part)
                ids.append(flat)
                counts += many
                part, size = [], 0
        return list_array(np.concatenate(ids or [np.empty(0, np.int32)]), counts, pa.int32())

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        owner, cuts = [], []
        for i, text in enumerate(texts):  # before a single space a text can be cut in two
            while len(text) > 2 * self.SLICE and (found := regex.search(r"\S(?= \S)", text, pos=self.SLICE)):
                owner.append(i)
                cuts.append(text[: found.end()])
                text = text[found.end():]
            owner.append(i)
            cuts.append(text)
        ids, many = [], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(cuts):
            to, size = at + 1, len(cuts[at])
            while to < len(cuts) and size + len(cuts[to]) <= 2 * self.SLICE:
                size += len(cuts[to])
                to += 1
            flat, counts = self._encode(cuts[at:to])
            ids.append(flat)
            np.add.at(many, owner[at:to], counts)
            at = to
        return np.concatenate(ids), many.tolist()

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Where pieces (and marks) begin."""
        kind = self.cls[codes]
        following = np.append(kind[1:], np.uint8(self.MARK))
        start = np.append(True, kind[1:] != kind[:-1]) | (kind == self.MARK)
        # the last of a run of white space parts from it before a word, and a plain space joins the word
        last = (kind == self.SPACE) & (following != self.SPACE) & (following != self.MARK)
        start |= last
        start[1:] &= ~(last & (codes == 32))[:-1]
        # contractions: an apostrophe where a piece begins, and the one or two letters after it
        at = np.flatnonzero(start & (codes == 39) & (following == self.LETTER))
        if len(at):
            one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
            size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 0)
            for x, y in ("re", "ve", "ll"):
                size[(one == ord(x)) & (two == ord(y))] = 2
            at, size = at[size > 0], size[size > 0]
            start[at + 1] = False
            start[at + 1 + size] = True
        return np.flatnonzero(start)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(t.encode("utf-32-le") + b"\x00\x00\x11\x00" for t in texts)
        codes = np.frombuffer(raw, np.uint32)
        start = self.starts(codes)
        length = np.diff(np.append(start, len(codes)))
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
        value = (codes + np.uint32(1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        value *= self.by_place[place & (SHORT - 1)]
        key = np.add.reduceat(value, start)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xD6E8FEB86659FD93)
        mark = codes[start] == 0x110000
        key[mark] = 0
        for i in np.flatnonzero(length > SHORT).tolist():  # long pieces by a digest instead
            piece = raw[4 * start[i]: 4 * (start[i] + length[i])]
            key[i] = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")
        at = self._known(key, start, length, raw)
        counts = self.count[at]
        end = np.cumsum(counts, dtype=np.int64)
        total = int(end[-1])
        flat = self.flat[np.arange(total) + np.repeat(self.first[at] - end + counts, counts)]
        text_end = end[mark]
        return flat, np.diff(text_end, prepend=0)

    def _known(self, key, start, length, raw) -> np.ndarray:
        """Row of each key in the table, into which new pieces go first."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        lacking = np.flatnonzero(self.keys[at] != key)
        if not len(lacking):
            return at
        if len(self.keys) > REMEMBERED:
            self.forget()
            lacking = np.flatnonzero(key != 0)
        new, which = np.unique(key[lacking], return_index=True)
        which = lacking[which]
        pieces = [raw[a: a + n].decode("utf-32-le") for a, n in zip((4 * start[which]).tolist(), (4 * length[which]).tolist())]
        ids = pieces_ids(pieces, self.ranks)
        counts = np.array([len(x) >> 2 for x in ids], np.int32)
        first = np.cumsum(counts) - counts + len(self.flat)
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), np.int32))
        where = np.searchsorted(self.keys, new)
        self.keys, self.first = np.insert(self.keys, where, new), np.insert(self.first, where, first)
        self.count = np.insert(self.count, where, counts)
        return np.searchsorted(self.keys, key)


def merge_many(pieces: list[bytes], size: int, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of pieces of at most ``size`` bytes (a power of 2): flat ids, and how many each has."""
    n, width = len(pieces), size + 1
    length = np.array([len(p) for p in pieces], np.int32)
    inside = np.arange(size, dtype=np.int32) < length[:, None]
    token = np.full((n, width), -1, np.int32)
    token[:, :size][inside] = ranks.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    places = np.arange(width, dtype=np.int32)
    after = np.where(places + 1 < length[:, None], places + 1, size)  # next live position; size: none
    before = np.tile(places - 1, (n, 1))
    tree = np.full((n, 2 * size), _NONE, np.int32)
    tree[:, size:][inside] = ranks.leaves(token[:, :size][inside], token[:, 1:][inside], np.nonzero(inside)[1])
    half = size // 2
    while half:
        np.minimum(tree[:, 2 * half: 4 * half: 2], tree[:, 2 * half + 1: 4 * half: 2], out=tree[:, half: 2 * half])
        half //= 2
    tree_, token_, after_, before_ = tree.ravel(), token.ravel(), after.ravel(), before.ravel()

    def put(root, leaf, value):  # all leaves are equally deep
        tree_[root + size + leaf] = value
        node = size + leaf
        for _ in range(size.bit_length() - 1):
            value = np.minimum(value, tree_[root + (node ^ 1)])
            node = node >> 1
            tree_[root + node] = value

    row = np.flatnonzero(tree[:, 1] < _NONE)
    while len(row):
        root, base = row * (2 * size), row * width
        best = tree_[root + 1]
        at = best & ((1 << _SHIFT) - 1)
        gone = after_[base + at]
        follows = after_[base + gone]
        token_[base + at] = best >> _SHIFT
        token_[base + gone] = -1
        after_[base + at] = follows
        before_[base + follows] = at
        put(root, gone, np.full(len(row), _NONE, np.int32))
        put(root, at, ranks.leaves(token_[base + at], token_[base + follows], at))
        left = before_[base + at]
        has = np.flatnonzero(left >= 0)
        if len(has):
            p, b = left[has], base[has]
            put(root[has], p, ranks.leaves(token_[b + p], token_[b + at[has]], p))
        row = row[tree_[root + 1] < _NONE]
    live = token[:, :size] >= 0
    return token[:, :size][live], live.sum(1)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Tokens of one long piece."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    token = [int(t) for t in ranks.of_byte[np.frombuffer(piece, np.uint8)]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges, none = ranks.merges, 1 << 62

    def pair(a: int, b: int) -> int:
        rank = merges.get(token[a] << 32 | token[b]) if b < n else None
        return none if rank is None else rank << 32 | a

    tree = [none] * size + [pair(i, i + 1) for i in range(n)] + [none] * (size - n)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(leaf: int, value: int) -> None:
        node = leaf + size
        tree[node] = value
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1] < none:
        best = tree[1]
        at = best & 0xFFFFFFFF
        gone = after[at]
        token[at] = best >> 32
        token[gone] = -1
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        put(gone, none)
        put(at, pair(at, after[at]))
        if before[at] >= 0:
            put(before[at], pair(before[at], at))
    return [t for t in token if t >= 0]


def encoded(text: Column, file: bytes, pattern: str | None) -> Column:
    """Token ids of a text column (array<int>); an empty or null text has none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = kept(("bpe", hash(file), pattern), lambda: Encoder(file, pattern) if pattern else PatternEncoder(file))
        for batch in batches:
            with uncollected():
                ids = encoder.texts(batch.to_pylist())
            yield ids
        trimmed()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(text)


def decoded(ids: Column, file: bytes) -> Column:
    """Bytes of token ids; null or no ids give no bytes, an unknown id is an error."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _token_bytes(file)
        for batch in batches:
            # the ids of one row at a time, as a batch of Python integers takes nine times its bytes
            yield pa.array([b"".join([tokens[i] for i in row.as_py() or ()]) for row in batch], pa.binary())
        del tokens
        trimmed()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(ids)


def _token_bytes(file: bytes) -> dict[int, bytes]:
    return {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in file.splitlines() if x)}


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Add the ids of every whole text, split by ``pattern`` (none: the public GPT-2 pattern) and
    merged by the ranks in ``path`` (none: the public byte-level file).

    Special tokens are ordinary text.  Nulls and empty texts get an empty list; repeated rows stay;
    other columns pass through, and a column named as ``ids`` is replaced.  No shuffle.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(ids, encoded(F.col(text), tokenizer_file("byte_bpe_50k.tiktoken", path), pattern))


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the bytes that the ids stand for; the inverse of :func:`encode` on every text."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, decoded(F.col(ids), tokenizer_file("byte_bpe_50k.tiktoken", path)))
