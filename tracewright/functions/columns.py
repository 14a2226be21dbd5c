"""Small Column helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright import vocab


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_nonblank(*cols) -> Column:
    """First non-blank of several text columns."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def is_class(c, name: str) -> Column:
    """Membership of an event type in a named class."""
    return F.coalesce(col(c).isin(*vocab.EVENT_CLASSES[name]), F.lit(False))


def count_class(c, name: str) -> Column:
    return F.count_if(is_class(c, name))


def lookup(c, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Dictionary lookup as a literal map; the table is a constant, so nothing is joined."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)),
                      col(c) if default is None else default)


def contains_any(c, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(col(c), F.lit(w))
    return hit


def first_match(cases: Sequence[tuple[Column, object]], default) -> Column:
    """Ordered CASE WHEN."""
    out = None
    for cond, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def event_time(*cols) -> Column:
    """First parsable of several polymorphic time columns.

    Numbers of at least 1e10 are epoch milliseconds, smaller ones epoch seconds; text
    is read as ISO-8601, and numeric text as a number.
    """
    parsed = []
    for c in cols:
        text = col(c).cast("string")
        n = text.try_cast("double")
        whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("long")
        from_number = F.when(F.abs(n) >= F.lit(1e10), F.timestamp_millis(whole)).otherwise(
            F.timestamp_seconds(whole))
        parsed.append(F.when(n.isNotNull(), from_number).otherwise(F.try_to_timestamp(text)))
    return F.coalesce(*parsed)


def ratio(a, b) -> Column:
    """a / b with a zero denominator counted as zero."""
    return F.coalesce(col(a) / F.nullif(col(b).cast("double"), F.lit(0.0)), F.lit(0.0))


def prf(tp, fp, fn) -> list[Column]:
    """Precision, recall and F1 with zero-division = 0."""
    tp, fp, fn = (col(c).cast("double") for c in (tp, fp, fn))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]
