r"""Fill-in-middle transformation by rotating blocks in place.

A text is cut into prefix, middle and suffix at ends of tokens.  Sentinels are inserted at the cuts in
one bytearray, which then holds the blocks in reading order; the order of a form is reached by exchanging
neighbouring blocks, each exchange being three reversals inside the array.  The exchange of two blocks is
undone by exchanging them back, so the text is restored from the output and its form alone.

Everything works on UTF-8 bytes: white space is ASCII, so ends of tokens are never inside a character.
Rows are independent: no shuffle, and a task holds one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import fresh, kept, small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def rotate(block: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange ``block[start:middle]`` and ``block[middle:end]`` in place by three reversals."""
    for a, b in ((start, middle), (middle, end), (start, end)):
        block[a:b] = block[a:b][::-1]


def token_ends(text: bytes) -> np.ndarray:
    r"""Byte positions after each token ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``."""
    if not text:
        return np.empty(0, np.int64)
    white = _WHITE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return np.append(ends, len(text))


def characters(text: bytes) -> int:
    """Code points of UTF-8 text."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def arrange(text: bytes, first: int, second: int, form: str) -> bytes:
    """The text cut at two byte positions, in the order of the form, with sentinels."""
    block = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        block[at:at] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    if form == PSM:
        rotate(block, middle, suffix, len(block))
    else:
        rotate(block, 0, suffix, len(block))
    return bytes(block)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``arrange`` was given: sentinels are found, the exchange is undone, sentinels go.

    No sentinel stands in the text and none can arise where text and sentinel meet, so each is found once.
    """
    if form == PLAIN:
        return output
    block = bytearray(output)
    if form == PSM:
        suffix, middle = block.find(SUFFIX), block.find(MIDDLE)
        rotate(block, suffix, middle, len(block))
    else:
        rotate(block, 0, block.find(PREFIX), len(block))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = block.find(mark)
        del block[at: at + len(mark)]
    return bytes(block)


def draws(id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers from the hex SHA-256 of ``seed:id`` (a null id counts as empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _cut(text: Column, form: Column, one: Column, two: Column) -> Column:
    """struct(n, prefix, middle, output); prefix and middle are null for the plain form."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kept(None)
        for batch in batches:
            counts, prefixes, middles, outputs = [], [], [], []
            for scalar, kind, a, b in zip(batch[0], *(c.to_pylist() for c in batch[1:])):
                raw = scalar.as_py()
                ends = token_ends(raw)
                counts.append(len(ends))
                if kind == PLAIN:
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(raw)
                    continue
                low, high = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
                first, second = (int(ends[k - 1]) if k else 0 for k in (low, high))
                prefixes.append(characters(raw[:first]))
                middles.append(characters(raw[first:second]))
                outputs.append(arrange(raw, first, second, kind))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()),
                                              pa.array(outputs, pa.binary())], ["n", "prefix", "middle", "output"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n long, prefix long, middle long, output binary")(text, form, one, two)


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80,
              n: str = "n", form: str = "form", output: str = "output") -> DataFrame:
    """Add ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (code points) and ``output`` (the new text).

    The id alone draws the form and the cuts: ``rate`` percent of the rows are transformed, ``spm`` percent
    of these with the suffix first.  Empty texts and those that contain a sentinel stay plain; a null text
    counts as empty, a null id as an empty one.  Rows that repeat an id are cut alike, each by its own
    length.  Columns of ``docs`` named as the results are replaced, all others stay.
    """
    small_batches(docs.sparkSession)
    body, found = fresh(docs, "_body", "_infill")
    h1, h2, h3, h4 = draws(F.col(id), seed)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col(body), F.lit(mark))
    kind = F.when((F.length(body) == 0) | marked | (F.pmod(h3, F.lit(100)) >= rate), PLAIN).when(F.pmod(h4, F.lit(100)) < spm, SPM).otherwise(PSM)
    made = docs.withColumn(body, raw).withColumn(found, F.struct(kind.alias("form"), _cut(F.col(body), kind, h1, h2).alias("d")))
    named = {n: "d.n", form: "form", "prefix_chars": "d.prefix", "middle_chars": "d.middle"}
    made = made.withColumns({name: F.col(f"{found}.{path}") for name, path in named.items()} | {output: F.col(f"{found}.d.output").cast("string")})
    return made.drop(body, found)


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation; null for a null output or form."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            yield pa.array([None if o is None or f is None else restore(o, f) for o, f in zip(outputs.to_pylist(), forms.to_pylist())], pa.binary())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(output.cast("binary"), form).cast("string")


def transform_sql() -> str:
    """What the query returns, over the table ``documents``, cut and put together by lists of tokens."""
    hashes = ", ".join(f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 e AS (SELECT doc_id, t, {hashes}, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
 f AS (SELECT *, len(units) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
   WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
   greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM e),
 g AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM f)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM g"""
