"""Toxicity by bags of subword embeddings and a linear softmax.

A word is its character n-grams (3 to 6, with word edges); each n-gram has an embedding in a hashed
table, so a misspelling or an unseen form shares most vectors with what was learned.  Embeddings are
averaged over a short window of words and go through a linear softmax of two classes.  A text is as
toxic as its most toxic window: an average over thousands of words would drown one insult.

Embeddings and softmax are trained together in numpy (full-batch Adam).  Labels are of whole texts,
so after a first fit only the most toxic window of each toxic text stays a positive example.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import fresh, kept, small_batches, trimmed

GRAMS = (3, 4, 5, 6)
TABLE_BITS = 22
WINDOW = 2       # words averaged together
AT_ONCE = 1 << 16  # characters of words whose n-grams are looked up at once
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of every word, word by word, and how many each word has (1 at least)."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # characters up to the word's end
    found, owner = [], []
    run = np.zeros(len(codes), np.uint64)
    word = np.repeat(np.arange(len(marked)), length)
    for k in range(1, max(GRAMS) + 1):
        run = (run[: len(codes) - k + 1] + codes[k - 1:] + np.uint64(1)) * _BASE
        run ^= run >> np.uint64(29)
        if k in GRAMS:
            inside = np.flatnonzero(left[: len(run)] >= k)
            found.append((run[inside] >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
            owner.append(word[inside])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner_all, minlength=len(marked))


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    start = np.cumsum(counts) - counts
    return np.add.reduceat(values, start, axis=0) / counts.reshape(-1, *[1] * (values.ndim - 1))


@dataclass(frozen=True)
class ToxicityModel:
    """``margin``: difference of the two class scores for the table rows ``rows`` (ascending), 0 for all others;
    ``slope`` and ``shift`` turn a text's largest window margin into a probability; ``empty``: probability of a
    text without words.  Only the rows learned are held, as every worker has the model."""
    rows: np.ndarray
    margin: np.ndarray
    slope: float
    shift: float
    empty: float

    def words(self, words: list[str]) -> np.ndarray:
        """Mean margin of each word's n-grams; in parts, as n-grams take many times the bytes of their words."""
        if not len(self.rows):
            return np.zeros(len(words))
        part = np.cumsum(list(map(len, words))) // AT_ONCE
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
        return np.concatenate([self._part(words[start:end]) for start, end in zip([0, *ends], ends)])

    def _part(self, words: list[str]) -> np.ndarray:
        found, counts = grams(words)
        at = np.minimum(np.searchsorted(self.rows, found), len(self.rows) - 1)
        return _means(np.where(self.rows[at] == found, self.margin[at], np.float32(0)), counts)

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Largest window margin of each text, nan without words.  Of a text's words only numbers are held,
        each word once for all texts."""
        number: dict[str, int] = {}
        at = [np.array([number.setdefault(w, len(number)) for w in _WORD.findall(t.lower())] if t else [], np.int32) for t in texts]
        value = self.words(list(number)) if number else np.zeros(0)
        return np.array([top_window(value[i]) for i in at])

    def probability(self, top: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * top + self.shift, -40, 40)
        return np.where(np.isnan(top), self.empty, 1 / (1 + np.exp(-z)))


def top_window(scores: np.ndarray, width: int = WINDOW) -> float:
    """Largest mean of ``width`` neighbouring words (of all words, if fewer); nan without words."""
    if not len(scores):
        return float("nan")
    total = np.append(0.0, np.cumsum(scores))
    width = min(width, len(scores))
    return float((total[width:] - total[:-width]).max() / width)


def learn(texts: list[tuple[str, int]], prior: float = 0.1, dims: int = 4, steps: int = 30, rounds: int = 3,
          support: int = 3, seed: int = 11) -> ToxicityModel:
    """Fit on (text, 0 or 1) pairs; ``prior`` is the share of label 1 among all texts.

    An n-gram found in fewer than ``support`` texts of label 1 keeps the zero vector.  Without both
    classes every text gets ``prior``.
    """
    bags = [_WORD.findall(t.lower()) for t, _ in texts]
    labels = np.array([y for (_, y), b in zip(texts, bags) if b])
    bags = [b for b in bags if b]
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, float(np.log(prior / (1 - prior))), prior)
    number: dict[str, int] = {}
    tokens = [np.array([number.setdefault(w, len(number)) for w in b], np.int32) for b in bags]
    rows, per_word = grams(list(number))
    end = np.cumsum(per_word)
    seen = np.zeros(1 << TABLE_BITS, np.int32)
    for i in np.flatnonzero(labels == 1).tolist():
        seen[np.unique(np.concatenate([rows[end[w] - per_word[w]: end[w]] for w in np.unique(tokens[i])]))] += 1
    kept = np.flatnonzero(seen >= support)
    place = np.full(1 << TABLE_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    feature, of_word = place[rows], np.repeat(np.arange(len(number), dtype=np.int32), per_word)
    feature, of_word = feature[feature >= 0], of_word[feature >= 0]
    windows, of_text = [], []  # [window, word], unused places hold -1
    for i, t in enumerate(tokens):
        padded = np.full(-(-len(t) // WINDOW) * WINDOW, -1, np.int32)
        padded[: len(t)] = t
        windows.append(padded.reshape(-1, WINDOW))
        of_text.append(np.full(len(windows[-1]), i))
    windows, of_text = np.concatenate(windows), np.concatenate(of_text)
    sizes, target = (windows >= 0).sum(1), labels[of_text]
    active, margin = np.ones(len(windows), bool), np.zeros(len(number))
    rng = np.random.default_rng(seed)

    def word_means(values):
        return np.bincount(of_word, values[feature], len(number)) / per_word

    for _ in range(rounds):
        chosen = np.flatnonzero(active)
        inside = windows[chosen] >= 0
        word, owner = windows[chosen][inside], np.nonzero(inside)[0]
        n, y = sizes[chosen], target[chosen]
        share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        table, weights, bias = rng.normal(0, 0.05, (dims, len(kept))), rng.normal(0, 0.3, (dims, 2)), np.zeros(2)
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, weights, bias)]
        for step in range(1, steps + 1):
            bag = np.stack([np.bincount(owner, word_means(table[d])[word], len(n)) / n for d in range(dims)], 1)
            logits = bag @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(n)), y] -= 1
            p *= share[:, None]
            to_bag = (p @ weights.T) / n[:, None]
            to_table = np.stack([np.bincount(feature, (np.bincount(word, to_bag[owner, d], len(number)) / per_word)[of_word],
                                             len(kept)) for d in range(dims)])
            for x, g, (m, v), floor in zip((table, weights, bias), (to_table, bag.T @ p, p.sum(0)), moments, (1e-6, 1e-8, 1e-8)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                # the floor keeps what only few texts show from moving as fast as what many show
                x -= 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + floor) + (0.002 * x if x is table else 0)
        by_feature = (weights[:, 1] - weights[:, 0]) @ table
        margin = word_means(by_feature)
        of_window = np.where(windows >= 0, margin[np.maximum(windows, 0)], 0).sum(1) / sizes
        best = np.full(len(bags), -np.inf)
        np.maximum.at(best, of_text, of_window)
        active = (target == 0) | (of_window >= best[of_text])
    top = np.array([top_window(margin[t]) for t in tokens])
    slope, shift = _logistic(top, labels, prior)
    return ToxicityModel(kept.astype(np.int32), by_feature.astype(np.float32), slope, shift, prior)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Ridge logistic regression of one variable by Newton steps, classes weighted as they occur."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        beta += np.clip(np.linalg.solve(curve, design.T @ (weight * (y - p)) - 0.1 * beta), -5, 5)
    return float(max(beta[0], 0) / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: tuple[int, int] = (1200, 800), longest: int = 6_000, tried: int = 3) -> ToxicityModel:
    """Fit on a sample of labelled texts: at most ``per_class`` of label 0 and 1, each of at most ``longest``
    characters.

    Of each label the first ids by hash are tried, ``tried`` times as many as are taken, since some
    texts are missing or too long; so many ids are the bound of the broadcast that picks their texts.
    """
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y")).filter(
        F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).distinct()
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.xxhash64("_id").alias("_h")
    picked = [known.filter(F.col("_y") == y).select("_id", "_y", order).orderBy("_h", "_id").limit(tried * most) for y, most in enumerate(per_class)]
    texts = (docs.select(F.col(id).alias("_id"), F.col(text).alias("_t")).filter((F.length("_t") > 0) & (F.length("_t") <= longest))
             .join(F.broadcast(picked[0].unionByName(picked[1])), "_id").select("_h", "_t", "_y"))
    found = sorted(tuple(r) for r in texts.distinct().toLocalIterator())
    sample = [(t, y) for y, most in enumerate(per_class) for _, t, _ in [r for r in found if r[2] == y][:most]]
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return learn(sample, min(0.5, max(0.01, share)))


def scored(text: Column, model: ToxicityModel) -> Column:
    """Probability that a whole text is toxic."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept(None)
        for batch in batches:
            yield pa.array(model.probability(model.texts(batch.to_pylist())), pa.float64())
        trimmed()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score", predicted: str | None = "predicted",
          threshold: float = 0.3) -> DataFrame:
    """Add the probability of label 1, and whether it reaches ``threshold``; no shuffle, repeated rows stay.

    A text that is null, empty or without words gets the model's prior.  Columns named as the results are replaced.
    """
    small_batches(docs.sparkSession)
    (found,) = fresh(docs, "_found")
    made = docs.withColumn(found, scored(F.col(text), model))
    if predicted:
        made = made.withColumn(predicted, (F.col(found) >= threshold).cast("int"))
    return made.withColumn(out, F.col(found)).drop(found)
