"""Phase folding with composable maps.

An event joins the running phase by rules on the event that opened it, so what a stretch of events does
to an opener is a map "incoming opener -> outgoing opener".  The first event that an incoming opener does
not absorb decides, whatever the opener's own time; so the map is a short list: for every class of events
(family, app, route known or not) the first one, and the first with another route, each with the opener
that rules at the end if a phase begins there.  Its length depends on the classes, not on the events.

Three steps, each once: pieces of long segments are reduced to their maps; one pass that applies map after
map, a few rows for each piece, gives every piece its incoming opener; all pieces are folded in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.timeline import as_list, floor_div, in_groups
from tracewright.session import staged

OPENER = ("family", "app", "route", "ts", "oid")
UNKNOWN = "UNKNOWN_ROUTE"
_FOLD_IN = {"DOCUMENT", "TRANSFER", "BROWSER_FORM"}
_WEB = {"BROWSER", "BROWSER_FORM"}
_JOINS, _OPENS, _BY_ROUTE = 0, 1, 2


def relation(event: tuple, opener: tuple) -> int:
    """What an event of a class (family, app, route known) does under an opener of a class."""
    (family, app, known), (o_family, o_app, o_known) = event, opener
    same_app = not app or not o_app or app == o_app
    if same_app and (family == o_family or family in ("DESKTOP_INPUT", "CONTEXT")):
        return _JOINS
    if family == "TRANSFER":
        return _JOINS if o_family in _FOLD_IN else _OPENS
    if family in _WEB and o_family in _WEB and same_app:
        return _BY_ROUTE if known and o_known else _JOINS
    return _OPENS


def kind(family: str, app: str, route: str) -> tuple:
    return family, app, route != UNKNOWN


def absorbed(family: str, app: str, route: str, opener: tuple) -> bool:
    """Whether an event stays in the phase opened by ``opener`` (family, app, route, ...)."""
    how = relation(kind(family, app, route), kind(*opener[:3]))
    return how == _JOINS or (how == _BY_ROUTE and route == opener[2])


class Events:
    """Rows of a batch, group by group in order: columns family, app, route and the place where each group begins.

    All groups are worked on at once; what would come next is only looked for inside a row's own group.
    """

    def __init__(self, family: pa.Array, app: pa.Array, route: pa.Array, begins: np.ndarray):
        (f, families), (a, apps), (self.route, routes) = (_coded(c) for c in (family, app, route))
        self.size, self.begins = len(f), begins
        self.ends = np.repeat(np.append(begins[1:], self.size), np.diff(np.append(begins, self.size)))
        known = np.array([r != UNKNOWN for r in routes], bool)[self.route]
        values, self.code = np.unique((f * len(apps) + a) * 2 + known, return_inverse=True)
        self.kinds = [(families[v // 2 // len(apps)], apps[v // 2 % len(apps)], bool(v % 2)) for v in values.tolist()]

    def steps(self) -> np.ndarray:
        """For each row, if it opens a phase, the row of its group that opens the next one (``size``: none)."""
        out = np.empty(self.size, np.int64)
        for code, one in enumerate(self.kinds):
            place = np.flatnonzero(self.code == code)
            how = np.array([relation(k, one) for k in self.kinds])[self.code]

            def following(rows: np.ndarray) -> np.ndarray:
                return np.append(rows, self.size)[np.searchsorted(rows, place, "right")]

            found = following(np.flatnonzero(how == _OPENS))
            by_route = np.flatnonzero(how == _BY_ROUTE)
            if len(by_route):
                theirs = np.append(self.route[by_route], -1)
                last = np.flatnonzero(theirs[:-1] != theirs[1:])  # of each run of one route
                behind = last[np.searchsorted(last, np.arange(len(by_route)))] + 1
                at = np.searchsorted(by_route, place, "right")
                other = np.where(theirs[at] != self.route[place], at, np.append(behind, len(by_route))[at])
                found = np.minimum(found, np.append(by_route, self.size)[other])
            out[place] = np.where(found < self.ends[place], found, self.size)
        return out

    def last_openers(self) -> np.ndarray:
        """For each row, if it opens a phase, the opener that rules at the end of its group; paths are halved each time."""
        step = self.steps()
        last = np.where(step < self.size, step, np.arange(self.size))
        while (last[last] != last).any():
            last = last[last]
        return last

    def deciding(self) -> np.ndarray:
        """The rows that can end an incoming phase: the first of each class in a group, and its first with another route."""
        group = np.repeat(np.arange(len(self.begins)), np.diff(np.append(self.begins, self.size)))
        key = group * len(self.kinds) + self.code
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        others = np.flatnonzero(self.route != self.route[first][number])
        second = others[np.unique(key[others], return_index=True)[1]]
        return np.sort(np.concatenate([first, second]))

    def openers(self) -> np.ndarray:
        """The row that opened each row's phase; the first row of a group always opens one."""
        step, opens = self.steps().tolist(), np.zeros(self.size, np.int64)
        for at in self.begins.tolist():
            while at < self.size:
                opens[at] = at
                at = step[at]
        return np.maximum.accumulate(opens)


def _coded(column: pa.Array) -> tuple[np.ndarray, list]:
    made = column.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary.to_pylist()


def _begins(columns: list[pa.Array]) -> np.ndarray:
    """Where a group begins among rows that are sorted by these columns."""
    change = np.ones(len(columns[0]), bool)
    change[1:] = False
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def outgoing(made: list[tuple], incoming: tuple | None) -> tuple | None:
    """The opener after rows with this map, ((family, app, route), opener if a phase begins there) in order."""
    for event, opener in made:
        if incoming is None or not absorbed(*event, incoming):
            return opener
    return incoming


def _maps(width: int, schema: pa.Schema):
    """Rows (group, seed, family, app, route, ts, oid) to one row (group, part, map) for each group and batch."""
    def run(batches):
        for part, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            columns = batch.columns[width + 1:]
            events = Events(*columns[:3], _begins(batch.columns[:width]))
            place = events.deciding()
            last = pa.array(events.last_openers()[place])
            at = pa.array(place)
            entries = pa.StructArray.from_arrays([*(c.take(at) for c in columns[:3]), *(c.take(last) for c in columns)], fields=list(schema.field("map").type.value_type))
            offsets = pa.array(np.append(np.searchsorted(place, events.begins), len(place)), pa.int32())
            first = pa.array(events.begins)
            lists = pa.ListArray.from_arrays(offsets, entries, type=schema.field("map").type)
            yield pa.RecordBatch.from_arrays([*(c.take(first) for c in batch.columns[:width]), pa.array([part] * len(events.begins), pa.int64()), lists], schema=schema)
    return run


def _incoming(width: int, schema: pa.Schema):
    """Rows (key, piece, part, map) in order to (key, piece, 0, incoming opener) for every piece but a key's first."""
    def run(batches):
        now, piece, opener = None, None, None
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if now != values[:width]:
                    now, piece, opener = values[:width], None, None
                if piece != values[width] and opener is not None:
                    out.append((*now, values[width], 0, *opener))
                piece = values[width]
                opener = outgoing([((m["e_family"], m["e_app"], m["e_route"]), tuple(m[n] for n in OPENER)) for m in values[-1]], opener)
            columns = list(zip(*out)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _folded(width: int):
    """Rows (group, seed, family, app, route, ts, oid), an incoming opener as a first row with seed 0, to (group, opener, ts, oid)."""
    def run(batches):
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # the opener that rules at the end of a batch goes first in the next one; where a new group begins it stays alone
            rows = batch if carried is None else pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            columns = rows.columns[width + 1:]
            opened = Events(*columns[:3], _begins(rows.columns[:width])).openers()
            real = np.flatnonzero(rows.columns[width].to_numpy(zero_copy_only=False) == 1)
            at, of = pa.array(real), pa.array(opened[real])
            names = [*rows.schema.names[:width], *[f"_{n}_open" for n in OPENER], "_ts", "_oid"]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in rows.columns[:width]), *(c.take(of) for c in columns), columns[3].take(at), columns[4].take(at)], names=names)
            last, end = pa.array([int(opened[-1])]), pa.array([rows.num_rows - 1])
            carried = pa.RecordBatch.from_arrays([*(c.take(end) for c in rows.columns[:width]), pa.array([0], rows.columns[width].type), *(c.take(last) for c in columns)], schema=rows.schema)
    return run


def _arrow(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T.StructType(list(fields)))


def fold_phases(actions: DataFrame, key, ts: str, order: str, chunk: int, family: str = "action_family",
                app: str = "app", route: str = "route") -> DataFrame:
    """Label each event with the opener of its phase (W11); columns phase_ts and phase_order_id.

    Segments are cut in time pieces.  Only pieces of segments that have several are reduced to maps; each
    piece is then folded once, from its incoming opener.  Rows stream through a task in sorted order, an
    Arrow batch at a time, so neither a segment nor a piece is held whole.  ``order`` must be an integer
    that is unique in a segment and breaks ties of ``ts``.  Null families, apps and routes count as empty.
    """
    key = as_list(key)
    rows = staged(actions.select(
        *key, floor_div(F.col(ts).cast("long"), chunk).alias("_piece"), F.lit(1).alias("_seed"), F.coalesce(family, F.lit("")).alias("_family"),
        F.coalesce(app, F.lit("")).alias("_app"), F.coalesce(route, F.lit("")).alias("_route"), F.col(ts).cast("long").alias("_ts"),
        F.col(order).cast("long").alias("_oid")), "actions")
    group, inner = [*key, "_piece"], ["_seed", "_ts", "_oid"]
    heads = [f for f in rows.schema.fields if f.name in group]
    several = staged(rows.groupBy(*key).agg(F.min("_piece").alias("_a"), F.max("_piece").alias("_b")).filter("_a < _b").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]), "several")
    every = rows
    if not several.isEmpty():
        same = F.lit(True)
        for i, k in enumerate(key):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        entry = T.StructType([T.StructField(n, T.LongType() if n in ("ts", "oid") else T.StringType()) for n in ("e_family", "e_app", "e_route", *OPENER)])
        map_fields = [*heads, T.StructField("_part", T.LongType()), T.StructField("map", T.ArrayType(entry))]
        long = in_groups(rows.join(several, same, "left_semi"), group, inner)
        maps = staged(long.select(rows.columns).mapInArrow(_maps(len(group), _arrow(map_fields)), T.StructType(map_fields)), "maps")
        seeds = in_groups(maps, key, ["_piece", "_part"]).mapInArrow(_incoming(len(key), _arrow(rows.schema.fields)), rows.schema)
        every = rows.unionByName(seeds)
    names = [T.StructField(f"_{n}_open", T.LongType() if n in ("ts", "oid") else T.StringType()) for n in OPENER]
    out = T.StructType([*heads, *names, T.StructField("_ts", T.LongType()), T.StructField("_oid", T.LongType())])
    done = in_groups(every, group, inner).mapInArrow(_folded(len(group)), out)
    return done.select(*key, F.col("_ts").alias(ts), F.col("_oid").alias(order), F.col("_family_open").alias("phase_class"), F.col("_app_open").alias("phase_app"),
                       F.col("_route_open").alias("phase_route"), F.col("_ts_open").alias("phase_ts"), F.col("_oid_open").alias("phase_order_id"))
