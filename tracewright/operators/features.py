"""Counting windows: fixed bins, before/after windows on a candidate grid, anchor windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.columns import count_class
from tracewright.operators.intervals import window_join
from tracewright.operators.timeline import as_list, floor_div
from tracewright.session import by_all_keys

# feature name -> event class
HEURISTIC_COUNTS = {"app_switches": "app_switch", "navigation": "navigation", "browser_clicks": "browser_click",
                    "mouse_clicks": "mouse_click", "window_changes": "window_title", "keyboard": "keystroke"}
MODEL_COUNTS = {"app_switches": "app_switch", "navigation": "navigation", "browser_clicks": "browser_click",
                "mouse_clicks": "mouse_click", "window_changes": "window_change", "keyboard": "keyboard"}
ANCHOR_COUNTS = {"app_switch_count": "app_switch", "window_title_change_count": "window_title",
                 "browser_navigation_count": "navigation", "browser_click_count": "browser_click",
                 "browser_form_input_count": "browser_form", "clipboard_change_count": "clipboard",
                 "keystroke_count": "keystroke", "mouse_click_count": "mouse_click",
                 "mouse_scroll_count": "mouse_scroll", "screenshot_count": "screenshot"}
GRID_BLOCK = 4096


def session_span(events: DataFrame, key, ts: str) -> DataFrame:
    return events.groupBy(*as_list(key)).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))


def time_bins(events: DataFrame, key, ts: str, width: int, counts: Mapping[str, str] = HEURISTIC_COUNTS,
              distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Fixed bins from the session start with type counts and distinct values."""
    key = as_list(key)
    distinct = {"unique_apps": "app", "unique_windows": "window_title"} if distinct is None else distinct
    span = session_span(events, key, ts)
    binned = by_all_keys(events).join(span, key).withColumn("bin_number", floor_div(F.col(ts) - F.col("session_start"), width))
    return (binned.groupBy(*key, "bin_number")
            .agg((F.first("session_start") + F.col("bin_number") * F.lit(int(width))).alias("bin_start"),
                 F.count(F.lit(1)).alias("event_count"),
                 *[count_class("event_type", c).alias(n) for n, c in counts.items()],
                 *[F.size(F.collect_set(c)).cast("long").alias(n) for n, c in distinct.items()]))


def candidate_grid(span: DataFrame, key, step: int) -> DataFrame:
    """Slots 0..floor(span/step) of every session, made block by block."""
    key = as_list(key)
    last = floor_div(F.col("session_end") - F.col("session_start"), step)
    block = F.lit(GRID_BLOCK).cast("long")
    blocks = span.withColumn("_last", last).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), floor_div(F.col("_last"), GRID_BLOCK))))
    return (blocks.withColumn("slot", F.explode(F.sequence(
        F.col("_b") * block, F.least(F.col("_last"), F.col("_b") * block + block - 1)))).drop("_b", "_last"))


def candidate_features(events: DataFrame, key, ts: str, step: int, window: int,
                       counts: Mapping[str, str] = MODEL_COUNTS,
                       distinct: Mapping[str, str] | None = None,
                       require_full_context: bool = False) -> DataFrame:
    """Counts in [c - w, c) and [c, c + w) for every grid point c of a session.

    Events are first added up in bins of gcd(step, window), so what is copied to the slots
    is at most one row per bin.  ``require_full_context`` keeps only slots with a whole
    window on both sides (A04).
    """
    key = as_list(key)
    distinct = {"unique_apps": "app"} if distinct is None else distinct
    unit = gcd(int(step), int(window))
    per_step, per_window = int(step) // unit, int(window) // unit
    span = session_span(events, key, ts)
    fine = (by_all_keys(events).join(span, key)
            .groupBy(*key, floor_div(F.col(ts) - F.col("session_start"), unit).alias("_f"))
            .agg(F.count(F.lit(1)).alias("event_count"),
                 *[count_class("event_type", c).alias(n) for n, c in counts.items()],
                 *[F.collect_set(c).alias(n) for n, c in distinct.items()]))
    here = floor_div(F.col("_f"), per_step)

    def slots(side: str, low: Column, high: Column) -> Column:
        low = F.greatest(low, F.lit(0).cast("long"))
        made = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
        return F.transform(made, lambda k: F.struct(F.lit(side).alias("side"), k.alias("slot")))

    spread = fine.withColumn("_at", F.explode(F.concat(
        slots("before", here + 1, floor_div(F.col("_f") + per_window, per_step)),
        slots("after", floor_div(F.col("_f") - per_window, per_step) + 1, here))))
    names = ["event_count", *counts]
    aggs = []
    for side in ("before", "after"):
        on = F.col("_at.side") == side
        aggs += [F.sum(F.when(on, F.col(n))).alias(f"{side}_{n}") for n in names]
        aggs += [F.size(F.array_distinct(F.flatten(F.collect_list(F.when(on, F.col(n)))))).cast("long")
                 .alias(f"{side}_{n}") for n in distinct]
    filled = spread.groupBy(*key, F.col("_at.slot").alias("slot")).agg(*aggs)
    features = [c for c in filled.columns if c not in (*key, "slot")]
    grid = candidate_grid(span, key, step).withColumn(
        "candidate_ts", F.col("session_start") + F.col("slot") * F.lit(int(step)))
    if require_full_context:
        grid = grid.filter((F.col("candidate_ts") - F.col("session_start") >= window)
                           & (F.col("session_end") - F.col("candidate_ts") >= window))
    return (grid.join(filled, [*key, "slot"], "left")
            .select(*key, "slot", "candidate_ts",
                    *[F.coalesce(F.col(f), F.lit(0)).cast("long").alias(f) for f in features]))


def anchor_features(anchors: DataFrame, events: DataFrame, key, ts: str, anchor_ts: str, width: int,
                    counts: Mapping[str, str] = ANCHOR_COUNTS, by: Sequence[str] = ()) -> DataFrame:
    """Summary of the closed window around each anchor; anchors without events are absent."""
    key = as_list(key)
    group = [*key, anchor_ts, *by]
    near = window_join(anchors.select(*group), events, key, ts, anchor_ts, width, width)
    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(*group).orderBy(ts))
    return (near.withColumn("_gap", gap).groupBy(*group)
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.count_distinct("event_type").alias("unique_event_types"),
                 F.count_distinct("app").alias("unique_apps"),
                 F.count_distinct("window_title").alias("unique_window_titles"),
                 *[count_class("event_type", c).alias(n) for n, c in counts.items()],
                 F.coalesce(F.max("_gap"), F.lit(0)).alias("max_event_gap"),
                 F.coalesce(F.median("_gap"), F.lit(0.0)).alias("median_event_gap")))


def contrast(df: DataFrame, is_boundary: Column, features: Sequence[str]) -> DataFrame:
    """Mean of each feature at boundaries and at controls, their ratio and difference."""
    means = df.agg(*[F.avg(F.when(is_boundary, F.col(f))).alias(f"b_{f}") for f in features],
                   *[F.avg(F.when(~is_boundary, F.col(f))).alias(f"c_{f}") for f in features])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").alias("boundary_mean"),
                                        F.col(f"c_{f}").alias("control_mean")) for f in features]))
    return means.select(rows.alias("_r")).select("_r.*").select(
        "feature", "boundary_mean", "control_mean",
        (F.col("boundary_mean") / F.nullif("control_mean", F.lit(0.0))).alias("boundary_to_control_ratio"),
        (F.col("boundary_mean") - F.col("control_mean")).alias("difference"))
