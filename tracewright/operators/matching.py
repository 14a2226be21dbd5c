"""One-to-one matching and suppression whose outcome depends on order.

A greedy rule is sequential, but most of its decisions hang on little around them.  Rows are cut into
pieces; each piece takes every decision that nothing outside can change and hands on the rest.  What was
decided leaves the work, pieces double in width, and the rest is tried again: after log2(pieces) + 1 rounds
a piece holds all that can hang together, so nothing is left open.  The result is exactly the sequential
one, and a row is read again only while it is undecided.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.operators.timeline import as_list, floor_div, in_groups, with_next, with_previous
from tracewright.session import release, staged

PIECE = "_piece"


def by_piece(width: int, solve: Callable, schema: pa.Schema):
    """An Arrow map: ``solve`` turns the rows of a piece (without the first ``width`` columns, which name it) into result rows."""
    def made(out):
        columns = list(zip(*out)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != now:
                    if rows:
                        out += [now[:-1] + r for r in solve(rows)]
                    now, rows = row[:width], []
                rows.append(row[width:])
            if len(out) >= 4096:
                yield made(out)
                out = []
        if rows:
            out += [now[:-1] + r for r in solve(rows)]
        yield made(out)
    return run


def _solved(rows: DataFrame, key: list[str], order: list[str], solve: Callable, fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([*[rows.schema[k] for k in key], *fields])
    group = [*key, PIECE]
    rest = [c for c in rows.columns if c not in group]
    return in_groups(rows.select(*group, *rest), group, order).mapInArrow(by_piece(len(group), solve, to_arrow_schema(schema)), schema)


def _anti(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner, null keys being equal."""
    named = other.select(*[F.col(c).alias(f"_x{i}") for i, c in enumerate(on)])
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_x{i}"))
    return rows.join(named, same, "left_anti")


# --- points --------------------------------------------------------------------------------

def match_piece(rows: list[tuple]) -> list[tuple]:
    """Rows (role, ts, id, tol) in time order to (role, ts, id, target id, target ts).

    Roles: g target, p prediction of this piece, o undecided prediction of the piece before.  A target that
    an undecided prediction may take is unknown.  A prediction whose nearest target not taken is unknown is
    itself undecided, and may take any up to its nearest certainly free one.  Results: m match, and for the
    next round p the undecided predictions and g the targets that they may take.
    """
    times = [r[1] for r in rows if r[0] == "g"]
    ids = [r[2] for r in rows if r[0] == "g"]
    n, tol, out = len(times), rows[0][3], []
    unknown, right, left, kept = bytearray(n), list(range(n + 1)), list(range(n + 1)), set()

    def find(up, i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    done = 0
    for role, t, _, _ in rows:
        if role == "o":
            low, high = bisect_left(times, t - tol, done), bisect_right(times, t + tol, done)
            unknown[low:high] = b"\1" * (high - low)
            done = max(done, low)
    for role, t, id, _ in rows:
        if role != "p":
            continue
        low, high, at = bisect_left(times, t - tol), bisect_right(times, t + tol), bisect_left(times, t)
        r, l = find(right, at), find(left, at) - 1  # nearest targets not taken on both sides
        if l >= low and (r >= high or t - times[l] <= times[r] - t):
            j = find(right, bisect_left(times, times[l]))  # of equal times the first id
        elif r < high:
            j = r
        else:
            continue
        if not unknown[j]:
            out.append(("m", t, id, ids[j], times[j]))
            right[j], left[j + 1] = j + 1, j
            continue
        near = [k for k in range(low, high) if right[k] == k]
        sure = min((k for k in near if not unknown[k]), key=lambda k: (abs(times[k] - t), k), default=None)
        if sure is not None:
            unknown[sure] = 1
        out.append(("p", t, id, None, None))
        kept.update(near)
    return out + [("g", times[k], ids[k], None, None) for k in sorted(kept) if right[k] == k]


def match_points(pred: DataFrame, gt: DataFrame, key, ts: str, pred_id: str, gt_id: str, tol: int | str,
                 chunk: int, rule: str = "nearest_within", rounds: list | None = None) -> DataFrame:
    """Greedy one-to-one temporal match (J09; ``rule="nearest_then_test"`` is J10).

    Choosing the nearest free target and testing it afterwards picks the same pairs as
    choosing among the free targets in reach, so both rules share one computation.
    Returns key, pred_id, gt_id, pred_ts, gt_ts, error.  Ids must be integers; among points
    of equal time the smaller id comes first.  ``tol`` may name a key column holding the
    tolerance, so that many tolerances are matched in one job; ``chunk`` must then be at
    least twice the largest one.  ``rounds`` collects the width of the pieces of each round.
    """
    if rule not in ("nearest_within", "nearest_then_test"):
        raise ValueError(rule)
    key = as_list(key)
    reach = (F.col(tol) if isinstance(tol, str) else F.lit(int(tol))).cast("long")
    width = max(int(chunk), 1) if isinstance(tol, str) else max(int(chunk), 2 * int(tol), 1)

    def points(df, id, role):
        return df.select(*key, F.lit(role).alias("_role"), F.col(ts).cast("long").alias("_ts"), F.col(id).cast("long").alias("_id"), reach.alias("_tol"))

    alive = points(pred, pred_id, "p").unionByName(points(gt, gt_id, "g"))
    alive = staged(alive.filter(F.col("_ts").isNotNull()), "points")
    begin = alive.agg(F.min("_ts")).first()[0] or 0
    fields = [T.StructField("_role", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("_ts", "_id", "_gt_id", "_gt_ts")]
    parts, at = [], F.col("_ts") - F.lit(begin)
    while True:
        if rounds is not None:
            rounds.append(width)
        own = floor_div(at, width)
        low = F.when(F.col("_role") == "p", own).otherwise(floor_div(at - F.col("_tol"), width))
        high = floor_div(at + F.when(F.col("_role") == "p", 2 * F.col("_tol")).otherwise(F.col("_tol")), width)
        spread = alive.withColumn("_own", own).withColumn(PIECE, F.explode(F.sequence(low, high)))
        spread = spread.withColumn("_role", F.when((F.col("_role") == "p") & (F.col(PIECE) != F.col("_own")), "o").otherwise(F.col("_role"))).drop("_own")
        made = staged(_solved(spread, key, ["_ts", "_id"], match_piece, fields), "matches")
        parts.append(made.filter("_role = 'm'"))
        if made.filter("_role = 'p'").isEmpty():
            break
        taken = made.filter("_role = 'm'").select(*key, F.col("_gt_id").alias("_id"), F.lit("g").alias("_role"))
        left = made.filter("_role != 'm'").select(*key, "_role", "_ts", "_id", reach.alias("_tol")).distinct()
        last, alive = alive, staged(_anti(left, taken, [*key, "_id", "_role"]), "points")
        release(last)
        width *= 2
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select(*key, F.col("_id").alias(pred_id), F.col("_gt_id").alias(gt_id), F.col("_ts").alias("pred_ts"), F.col("_gt_ts").alias("gt_ts"),
                        F.abs(F.col("_ts") - F.col("_gt_ts")).alias("error"))


# --- peaks ---------------------------------------------------------------------------------

def suppress_piece(rows: list[tuple]) -> list[tuple]:
    """Rows (own, reach, ts, score, ...) to (state, ...): k kept and u undecided of this piece, d dropped of a neighbour.

    By falling score, then time.  A peak near a kept one is dropped; one near an undecided one that comes
    before it is undecided; peaks of neighbouring pieces are undecided here.  Kept and undecided peaks are
    found by stretches as wide as the reach, of which the outermost two times tell enough.
    """
    kept: dict[int, list] = {}
    unknown: dict[int, list] = {}
    out = []

    def near(marks, stretch, t, reach):
        return (stretch in marks or (stretch - 1 in marks and marks[stretch - 1][1] >= t - reach)
                or (stretch + 1 in marks and marks[stretch + 1][0] <= t + reach))

    def mark(marks, stretch, t):
        ends = marks.setdefault(stretch, [t, t])
        ends[0], ends[1] = min(ends[0], t), max(ends[1], t)

    for row in sorted(rows, key=lambda r: (-r[3], r[2])):
        own, reach, t = row[:3]
        if reach < 0:
            out += [("k",) + row[4:]] if own else []
            continue
        stretch = t // (reach + 1)
        if near(kept, stretch, t, reach):
            if not own:
                out.append(("d",) + row[4:])
        elif not own or near(unknown, stretch, t, reach):
            mark(unknown, stretch, t)
            if own:
                out.append(("u",) + row[4:])
        else:
            mark(kept, stretch, t)
            out.append(("k",) + row[4:])
    return out


def local_maxima(df: DataFrame, key, ts: str, score: str, chunk: int) -> DataFrame:
    """Points whose score neither neighbour in time exceeds."""
    key = as_list(key)
    near = with_next(with_previous(df, key, ts, {"_before": score}, chunk), key, ts, {"_after": score}, chunk)
    s = F.col(score)
    return near.filter((s >= F.coalesce("_before", s)) & (s >= F.coalesce("_after", s))).select(*df.columns)


def suppress(peaks: DataFrame, key, ts: str, score: str, min_dist: int | str, chunk: int, rounds: list | None = None) -> DataFrame:
    """Non-maximum suppression: by falling score (earlier first on a tie), a peak nearer than ``min_dist`` to a kept one goes.

    ``min_dist`` may name a key column, so that many distances run in one job; ``chunk`` must then be at
    least twice the largest one.  Of rows that share a time one is kept.
    """
    key, columns = as_list(key), peaks.columns
    reach = (F.col(min_dist) if isinstance(min_dist, str) else F.lit(int(min_dist))).cast("long") - 1
    width = max(int(chunk), 1) if isinstance(min_dist, str) else max(int(chunk), 2 * int(min_dist), 1)
    time = F.col(ts).cast("long")
    alive = staged(peaks.filter(time.isNotNull() & F.col(score).isNotNull()), "peaks")
    begin = alive.agg(F.min(time)).first()[0] or 0
    rest = [c for c in columns if c not in key]
    fields = [T.StructField("_state", T.StringType()), *[alive.schema[c] for c in rest]]
    parts, at = [], time - F.lit(begin)
    while True:
        if rounds is not None:
            rounds.append(width)
        low, high = (floor_div(at + way * F.greatest(reach, F.lit(0)), width) for way in (-1, 1))
        spread = alive.withColumn(PIECE, F.explode(F.sequence(low, high))).select(
            *key, PIECE, (floor_div(at, width) == F.col(PIECE)).alias("_own"), reach.alias("_reach"), time.alias("_t"), F.col(score).cast("double").alias("_s"), *rest)
        made = staged(_solved(spread, key, ["_t"], suppress_piece, fields), "peaks")
        parts.append(made.filter("_state = 'k'").select(columns))
        if made.filter("_state = 'u'").isEmpty():
            break
        last, alive = alive, staged(_anti(made.filter("_state = 'u'"), made.filter("_state = 'd'"), [*key, ts]).select(columns), "peaks")
        release(last)
        width *= 2
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def local_peaks(df: DataFrame, key, ts: str, score: str, threshold: float, min_dist: int,
                chunk: int, rounds: list | None = None) -> DataFrame:
    """Local maxima, then non-maximum suppression.

    A point counts when its score reaches the threshold and neither neighbour is higher.
    Peaks are taken by falling score (earlier first on a tie); one nearer than ``min_dist``
    to a taken peak is dropped.
    """
    peaks = local_maxima(df, key, ts, score, chunk).filter(F.col(score) >= threshold)
    return suppress(peaks, key, ts, score, min_dist, chunk, rounds)


# --- intervals -----------------------------------------------------------------------------

def pair_piece(rows: list[tuple]) -> list[tuple]:
    """Rows (pred, truth, iou, best pair of the truth in other pieces as iou, pred, truth) to (state, pred, truth, iou).

    By falling IoU.  A pair with a taken side goes; one with a side that is undecided, or whose truth has a
    better pair elsewhere, is undecided, and so are its sides; any other is taken (m).
    """
    taken, unknown, out = set(), set(), []
    for pred, truth, iou, o_iou, o_pred, o_truth in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        p, t = ("p", pred), ("t", truth)
        if p in taken or t in taken:
            continue
        better = o_iou is not None and (-o_iou, o_pred, o_truth) < (-iou, pred, truth)
        if better or p in unknown or t in unknown:
            unknown.update((p, t))
            out.append(("u", pred, truth, iou))
        else:
            taken.update((p, t))
            out.append(("m", pred, truth, iou))
    return out


def match_intervals(pairs: DataFrame, key, pred_id: str, truth_id: str, iou: str = "iou",
                    threshold: float | None = None, width: int = 4096, rounds: list | None = None) -> DataFrame:
    """Greedy one-to-one interval match, highest IoU first.

    ``pairs`` holds the overlapping pairs (see ``overlaps``).  Equal IoUs keep (pred_id, truth_id) order.
    Ids must be integers; pieces are ranges of ``width`` prediction ids, which best follow time.
    """
    key = as_list(key)
    live = pairs.filter(F.col(iou).isNotNull() if threshold is None else F.col(iou) >= threshold)
    live = staged(live.select(*key, F.col(pred_id).cast("long").alias("_p"), F.col(truth_id).cast("long").alias("_t"), F.col(iou).cast("double").alias("_s")), "pairs")
    begin = live.agg(F.min("_p")).first()[0] or 0
    fields = [T.StructField("_state", T.StringType()), *live.schema.fields[len(key):]]
    same, parts = [*key, "_t"], []
    while True:
        if rounds is not None:
            rounds.append(width)
        rows = live.withColumn(PIECE, floor_div(F.col("_p") - F.lit(begin), width))
        order = F.struct(F.col("_s").alias("s"), (-F.col("_p")).alias("p"), (-F.col("_t")).alias("t"))
        best = rows.groupBy(*same, PIECE).agg(F.max(order).alias("_o"))
        # the best pair of a truth, and the best one outside that pair's piece, for truths met in several pieces
        first = best.groupBy(*same).agg(F.max(F.struct("_o", PIECE)).alias("_a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        other = staged(first.join(best, same).groupBy(*same).agg(F.first("_a").alias("_a"), F.max(F.when(F.col(PIECE) != F.col(f"_a.{PIECE}"), F.col("_o"))).alias("_b")), "best")
        outside = F.when(F.col(PIECE) == F.col(f"_a.{PIECE}"), F.col("_b")).otherwise(F.col("_a._o"))
        rows = rows.join(other, same, "left").withColumn("_out", outside).select(
            *key, PIECE, "_p", "_t", "_s", F.col("_out.s").alias("_os"), (-F.col("_out.p")).alias("_op"), (-F.col("_out.t")).alias("_ot"))
        made = staged(_solved(rows, key, ["_p", "_t"], pair_piece, fields), "pairs")
        parts.append(made.filter("_state = 'm'"))
        if made.filter("_state = 'u'").isEmpty():
            break
        last, live = live, staged(_anti(made.filter("_state = 'u'").drop("_state"), made.filter("_state = 'm'"), same), "pairs")
        release(last, other)
        width *= 2
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*key, F.col("_p").alias(pred_id), F.col("_t").alias(truth_id), F.col("_s").alias(iou))
