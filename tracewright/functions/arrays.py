"""Expressions over ordered arrays of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions.columns import col, lookup


def collapse(arr) -> Column:
    """Drop blanks and consecutive repeats (W08 on arrays)."""
    a = F.filter(col(arr), lambda x: x.isNotNull() & (x != ""))
    shifted = F.concat(F.array(F.lit(None).cast("string")), a)
    pairs = F.arrays_zip(a.alias("v"), shifted.alias("p"))
    # the shifted copy is one longer, so the last zipped entry carries no value
    kept = F.filter(pairs, lambda z: z["v"].isNotNull() & ~z["v"].eqNullSafe(z["p"]))
    return F.transform(kept, lambda z: z["v"])


def truncate_seq(arr, n: int) -> Column:
    """First n//2 items, "...", and the rest of n from the end."""
    a = col(arr)
    left = n // 2
    right = n - left
    short = F.concat(F.slice(a, 1, left), F.array(F.lit("...")),
                     F.slice(a, F.size(a) - F.lit(right - 1), F.lit(right)))
    return F.when(F.size(a) <= n, a).otherwise(short)


def contains_subseq(arr, pattern: Sequence[str]) -> Column:
    """Whether the pattern occurs as a contiguous run."""
    a, n = col(arr), len(pattern)
    want = F.array(*[F.lit(p) for p in pattern])
    starts = F.sequence(F.lit(1), F.size(a) - F.lit(n - 1))
    return F.when(F.size(a) >= n, F.exists(starts, lambda i: F.slice(a, i, n) == want)).otherwise(
        F.lit(False))


def pairs(arr) -> Column:
    """Adjacent (from, to) pairs of an array."""
    a = col(arr)
    ahead = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    zipped = F.arrays_zip(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), ahead)
    return F.transform(zipped, lambda z: F.struct(z["0"].alias("from"), z["1"].alias("to")))


def _bare(x: Column) -> Column:
    return F.substring_index(F.trim(x), "[", 1)


def clean_path(arr) -> Column:
    """Phase names mapped to the clean vocabulary, noise dropped, repeats collapsed (F16)."""
    named = F.transform(col(arr), lambda x: lookup(_bare(x), vocab.CLEAN_PHASE))
    return collapse(F.filter(named, lambda p: ~p.isin("EVIDENCE", "CONTEXT", "UNKNOWN", "")))


def observed_path(arr) -> Column:
    """Canonical phases without evidence and context (F16)."""
    named = F.transform(col(arr), lambda x: lookup(_bare(x), vocab.PHASE_ALIASES))
    return collapse(F.filter(named, lambda p: ~p.isin("", "CONTEXT", "EVIDENCE")))


def mechanical_skeleton(arr) -> Column:
    """Observed path without switches and desktop input, navigation folded into browser work (F16)."""
    kept = F.filter(observed_path(arr), lambda p: ~p.isin("APPLICATION_SWITCH", "DESKTOP_INPUT"))
    folded = F.transform(kept, lambda p: F.when(p == "BROWSER_NAVIGATION", F.lit("BROWSER_WORK")).otherwise(p))
    return collapse(folded)
