"""Language identification by unigram pieces with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a
word is the sum over all ways to cut it into pieces (forward algorithm); of a text, the product over
its words, since no piece crosses a word.  Probabilities are learned by expectation-maximisation
(forward-backward counts) on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import fresh, kept, small_batches, tokenizer_file, trimmed, uncollected

UNKNOWN = "und"
LONGEST = 12      # characters of a piece; longer pieces of the vocabulary are not used
UNSEEN = 1e-7     # probability of a character that is no piece
REMEMBERED = 300_000
STRETCH = 24      # letters of a word learned from at once; a longer word is learned from in stretches
HELD = 128 << 20  # bytes of lattices kept between rounds of learning; the rest are made again
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> list[str]:
    """Maximal runs of letters (Unicode category L), lower-cased."""
    out = []
    for word in _WORD.findall(text.lower()):
        if word.isalpha():
            out.append(word)
        else:  # numerals such as a half are taken for word characters, but are no letters
            out += "".join(c if c.isalpha() else " " for c in word).split()
    return out


class Pieces:
    """The usable pieces of a SentencePiece file, found by a hash of their characters."""

    def __init__(self, file: bytes):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        kept = sorted({p for p in (model.id_to_piece(i) for i in range(model.get_piece_size()))
                       if 0 < len(p) <= LONGEST and p == p.lower() and p.lstrip("▁").isalpha()})
        keys = np.array([int(_hashes(np.array([[ord(c) for c in p]], np.uint64))[-1][0, 0]) for p in kept], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.size = keys[order], order.astype(np.int32), len(kept)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers; ``size`` stands for none."""
        at = np.minimum(np.searchsorted(self.keys, keys), self.size - 1)
        return np.where(self.keys[at] == keys, self.ids[at], self.size).astype(np.int32)

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length n: piece number at [word, start, size - 1], ``size`` + 1 for a single unknown character."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)
        n = codes.shape[1]
        out = np.full((len(words), n, min(n, LONGEST)), self.size, np.int32)
        for k, keys in enumerate(_hashes(codes)):
            out[:, : n - k, k] = self.find(keys)
        out[:, :, 0] = np.where(out[:, :, 0] == self.size, self.size + 1, out[:, :, 0])
        return out


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, ... characters, by start."""
    out, run = [], np.zeros_like(codes)
    for k in range(min(codes.shape[1], LONGEST)):
        run = (run[:, : codes.shape[1] - k] + codes[:, k:] + np.uint64(1)) * _BASE
        run ^= run >> np.uint64(29)
        out.append(run)
    return out


def forward(grid: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled probability of whole words [word, language] and the log of the scales; only the last places are held."""
    words, n, most = grid.shape
    recent = [np.ones((words, prob.shape[1]))]
    scale = np.zeros((words, prob.shape[1]))
    for end in range(1, n + 1):
        now = np.zeros((words, prob.shape[1]))
        for size in range(1, min(end, most) + 1):
            now += recent[-size] * prob[grid[:, end - size, size - 1]]
        recent.append(now)
        del recent[:-most]
        if end % 8 == 0 and end < n:  # long words must not underflow
            factor = np.maximum(now, 1e-300)
            recent = [r / factor for r in recent]
            scale += np.log(factor)
    return recent[-1], scale


@dataclass(frozen=True)
class LanguageModel:
    """Piece probabilities [piece, language]; the last two rows are "no piece" (0) and an unknown character."""
    languages: tuple[str, ...]
    prob: np.ndarray
    file: bytes

    def word_scores(self, pieces: Pieces, words: list[str]) -> np.ndarray:
        """Natural log probability [word, language] of each word, every segmentation counted."""
        out = np.empty((len(words), len(self.languages)))
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word), []).append(i)
        for n, group in by_size.items():
            step = max(1, 300_000 // (n * min(n, LONGEST)))
            for at in range(0, len(group), step):
                part = group[at: at + step]
                last, scale = forward(pieces.lattice(["▁" + words[i] for i in part]), self.prob)
                out[part] = np.log(np.maximum(last, 1e-300)) + scale
        return out


def learn(texts: list[tuple[str, str]], file: bytes, rounds: int = 5, smoothing: float = 0.01) -> LanguageModel:
    """Fit the piece probabilities of every language among (text, language) pairs.

    A word longer than ``STRETCH`` letters, as in languages written without spaces, is learned from in stretches.
    """
    pieces = Pieces(file)
    counts: dict[str, Counter] = {}
    for text, language in texts:
        mine = counts.setdefault(language, Counter())
        for word in letters(text):
            mine["▁" + word[:STRETCH]] += 1
            for at in range(STRETCH, len(word), STRETCH):
                mine[word[at: at + STRETCH]] += 1
    languages = tuple(sorted(k for k, c in counts.items() if c))
    prob = np.zeros((pieces.size + 2, len(languages)))
    for k, language in enumerate(languages):
        p = np.full((pieces.size + 2, 1), 1.0 / pieces.size)
        p[-2:, 0] = 0, UNSEEN
        by_size: dict[int, list[str]] = {}
        for word in counts[language]:
            by_size.setdefault(len(word), []).append(word)
        blocks, held = [], 0
        for group in by_size.values():
            for at in range(0, len(group), 20_000):
                block = group[at: at + 20_000]
                grid = pieces.lattice(block) if held < HELD else None
                held += grid.nbytes if grid is not None else 0
                blocks.append((block, grid, np.array([counts[language][w] for w in block], float)))
        for _ in range(rounds):
            expected = np.zeros(pieces.size + 2)
            for block, grid, weight in blocks:
                _expect(pieces.lattice(block) if grid is None else grid, weight, p, expected)
            known = expected[:-2] + smoothing
            p[:-2, 0] = known / known.sum()
        prob[:, k] = p[:, 0]
    return LanguageModel(languages, prob, file)


def _expect(grid, weight, p, expected) -> None:
    """Add the expected piece counts of words of one length."""
    words, n, most = grid.shape
    ahead = np.zeros((n + 1, words))
    ahead[0] = 1
    for end in range(1, n + 1):
        for size in range(1, min(end, most) + 1):
            ahead[end] += ahead[end - size] * p[grid[:, end - size, size - 1], 0]
    back = np.zeros((n + 1, words))
    back[n] = 1
    for start in range(n - 1, -1, -1):
        for size in range(1, min(n - start, most) + 1):
            back[start] += back[start + size] * p[grid[:, start, size - 1], 0]
    share = weight / np.maximum(ahead[n], 1e-300)
    for start in range(n):
        for size in range(1, min(n - start, most) + 1):
            piece = grid[:, start, size - 1]
            expected += np.bincount(piece, share * ahead[start] * p[piece, 0] * back[start + size], len(expected))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, longest: int = 20_000,
        max_languages: int = 200, path: str | None = None) -> LanguageModel:
    """Fit on a sample of rows whose text and language are known.

    The sample is bounded: at most ``per_language`` texts of at most ``longest`` characters for each of
    at most ``max_languages`` languages (more are an error), those with the least hash of their text.
    """
    file = tokenizer_file("piece_bpe_32k.model", path)
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter(
        F.col("l").isNotNull() & (F.length("t") > 0) & (F.length("t") <= longest))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return LanguageModel((), np.zeros((0, 0)), file)
    span = 1 << 53  # twice the wanted share, cut below, so that no language is sorted in one task
    bound = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(span, int(span * 2 * per_language / n) + 1))])
    drawn = rows.withColumn("h", F.pmod(F.xxhash64("t", "l"), F.lit(span))).filter(F.col("h") < bound[F.col("l")])
    got: dict[str, list] = {}
    for r in drawn.distinct().toLocalIterator():
        got.setdefault(r["l"], []).append((r["h"], r["t"]))
    return learn([(t, k) for k, found in sorted(got.items()) for _, t in sorted(found)[:per_language]], file)


class Scorer:
    """Scores of words, kept between batches as rows of one matrix."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, Pieces(model.file)
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.languages)))

    def texts(self, texts: list[str | None]) -> pa.StructArray:
        if len(self.row) > REMEMBERED:
            self.forget()
        # of a text's words only their rows are held
        rows = [np.array([self.row.setdefault(w, len(self.row)) for w in letters(t)] if t and self.model.languages else [], np.int32) for t in texts]
        new = list(islice(self.row, len(self.scores), None))
        if new:
            self.scores = np.concatenate([self.scores, self.model.word_scores(self.pieces, new)])
        lang, score = [], []
        for row in rows:
            if not len(row):
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            total = self.scores[row].sum(0)
            share = np.exp(total - total.max())
            lang.append(self.model.languages[int(total.argmax())])
            score.append(float(share.max() / share.sum()))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])


def predicted(text: Column, model: LanguageModel) -> Column:
    """struct(lang, score): the likeliest language of a whole text and its probability among the learned ones."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = kept(("language", hash((model.languages, model.prob.tobytes()))), lambda: Scorer(model))
        for batch in batches:
            with uncollected():
                found = scorer.texts(batch.to_pylist())
            yield found
        trimmed()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang string, score double")(text)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """Add the predicted language and its probability; no shuffle, repeated rows stay.

    A text that is null, empty or without letters gets ``und`` and 0, as does every text when nothing
    was learned.  Of equally likely languages the first by name wins.  Columns named as the results
    are replaced.
    """
    small_batches(docs.sparkSession)
    (found,) = fresh(docs, "_found")
    return (docs.withColumn(found, predicted(F.col(text), model))
            .withColumn(lang, F.col(f"{found}.lang")).withColumn(score, F.col(f"{found}.score")).drop(found))
