"""Arithmetic scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions.columns import col, first_match


def weighted_score(weights: Mapping[str, float] = vocab.BIN_WEIGHTS) -> Column:
    """Weighted sum of count columns."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * F.lit(w)
    return out


def change_score(weights: Mapping[str, float] = vocab.CHANGE_WEIGHTS) -> Column:
    """Weighted absolute before/after change."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.abs(F.col(f"after_{name}") - F.col(f"before_{name}")) * F.lit(w)
    return out


def screening_score(segments, sessions, duration, transfer_rate) -> Column:
    """Frequency x coverage x transfer x time."""
    return (F.log1p(col(segments)) * F.log1p(col(sessions)) * (1.0 + col(transfer_rate))
            * (1.0 + 0.15 * F.log1p(col(duration))))


def complexity_flag(apps, transitions, pages, events) -> Column:
    """Any of the complexity limits reached."""
    limit = vocab.COMPLEXITY
    return ((col(apps) >= limit["app_count"]) | (col(transitions) >= limit["transition_count"])
            | (col(pages) >= limit["page_count"]) | (col(events) >= limit["event_count"]))


def interaction_density(interactions, seconds) -> Column:
    """Interactions per ten seconds; null for an empty duration."""
    return col(interactions) / F.nullif(col(seconds).cast("double"), F.lit(0.0)) * 10


def review_score(q95, q99, twice_median, complex_, apps, pages, transitions, seconds) -> Column:
    """Additive review score."""
    def points(cond, n):
        return F.when(cond, n).otherwise(0.0)

    return (points(col(q95), 2.0) + points(col(q99), 2.0) + points(col(twice_median), 2.0)
            + points(col(complex_), 2.0) + points(col(apps) >= 4, 1.0) + points(col(pages) >= 3, 1.0)
            + points(col(transitions) >= 3, 1.0) + points(col(seconds) >= 120, 1.0))


def review_priority(score) -> Column:
    """LOW below 2, MEDIUM below 4, HIGH below 6, VERY_HIGH from 6."""
    s = col(score)
    return first_match([(s < 2, "LOW"), (s < 4, "MEDIUM"), (s < 6, "HIGH")], "VERY_HIGH")
