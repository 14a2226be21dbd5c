"""Where are the task boundaries and what are the segments, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scores import weighted_score
from tracewright.operators.features import session_span, time_bins
from tracewright.operators.intervals import assign_events
from tracewright.operators.profiles import segment_profile
from tracewright.operators.segments import merge_points, segments_from_boundaries
from tracewright.operators.timeline import as_list
from tracewright.session import cut_lineage


def heuristic_boundaries(events: DataFrame, key, ts: str, width: int, threshold: float, gap: int, chunk: int) -> DataFrame:
    """Fixed bins -> weighted score -> threshold -> merge."""
    bins = time_bins(events, key, ts, width).withColumn("score", weighted_score())
    positive = bins.filter(F.col("score") >= threshold).select(*as_list(key), F.col("bin_start").alias(ts), "score")
    # read twice by the merge, and far smaller than the events
    return merge_points(cut_lineage(positive), key, ts, "score", gap, chunk)


def boundaries_to_profiles(events: DataFrame, key, ts: str, event_id: str, width: int, threshold: float, gap: int,
                           chunk: int) -> DataFrame:
    """Boundaries, contiguous segments, assigned events, one profile per segment."""
    key = as_list(key)
    bounds = heuristic_boundaries(events, key, ts, width, threshold, gap, chunk).withColumnRenamed("predicted_ts", ts)
    segs = segments_from_boundaries(bounds, session_span(events, key, ts), key, ts, chunk)
    placed = assign_events(events, segs, key, ts, event_id, "segment_index", "segment_start", "segment_end", chunk,
                           "half_open_last_closed")
    return segment_profile(placed, [*key, "segment_index"], ts, event_id, chunk)
