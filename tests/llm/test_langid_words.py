"""Languages without spaces, numerals that are no letters, very long words, and predictions against a plain version."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import langid
from tracewright.llm.common import tokenizer_file

FILE = tokenizer_file("piece_bpe_32k.model")


def test_languages_without_spaces_are_told_apart():
    chinese, japanese = "今天天气很好我们去公园散步然后回家吃饭看书学习中文" * 3, "きょうはとてもいいてんきなのでこうえんへさんぽにいきましたそれから" * 3
    model = langid.learn([(chinese, "zh"), (japanese, "ja")], FILE)
    assert not np.allclose(model.prob[:, 0], model.prob[:, 1])
    found = langid.Scorer(model).texts([chinese[5:60], japanese[4:70]]).to_pylist()
    assert [r["lang"] for r in found] == ["zh", "ja"]


def test_what_is_not_a_letter():
    assert langid.letters("½² ⅷ ² 12 _ --") == [] and langid.letters("Ab½cd e²") == ["ab", "cd", "e"] and langid.letters("ÀÉ日本") == ["àé日本"]
    model = langid.learn([("the cat", "en")], FILE)
    got = langid.Scorer(model).texts(["½²", "ⅷ ²", "", None, "1", "a"]).to_pylist()
    assert [r["lang"] for r in got] == ["und"] * 5 + ["en"]


def test_a_very_long_word():
    model = langid.learn([("the cat sat", "en"), ("der hund", "de")], FILE)
    (score,) = model.word_scores(langid.Pieces(FILE), ["thecatsat" * 5000])
    assert np.isfinite(score).all() and score[1] > score[0]  # languages are sorted: de, en


def plain_prediction(model, pieces, text):
    """Every segmentation of every word, by a forward sum in logarithms over Python floats."""
    number = {}

    def piece(w):
        if w not in number:
            codes = np.array([[ord(c) for c in w]], np.uint64)
            number[w] = int(pieces.find(np.array([int(langid._hashes(codes)[-1][0, 0])], np.uint64))[0]) if len(w) <= langid.LONGEST else pieces.size
        return number[w]

    words = langid.letters(text or "")
    if not words:
        return "und"
    totals = []
    for k in range(len(model.languages)):
        total = 0.0
        for word in words:
            w = "▁" + word
            ahead = [1.0]
            for end in range(1, len(w) + 1):
                now = 0.0
                for size in range(1, min(end, langid.LONGEST) + 1):
                    at = piece(w[end - size:end])
                    p = model.prob[at, k] if at < pieces.size else (langid.UNSEEN if size == 1 else 0.0)
                    now += ahead[end - size] * p
                ahead.append(now)
            total += math.log(max(ahead[-1], 1e-300))
        totals.append(total)
    return model.languages[int(np.argmax(totals))]


def test_predictions_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang").limit(200)
    model = langid.fit(docs.filter("doc_id % 4 != 2"))
    pieces = langid.Pieces(FILE)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count() and [r["lang_pred"] for r in got] == [plain_prediction(model, pieces, r["text"]) for r in got]
