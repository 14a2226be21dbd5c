"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points, in order.  Vectors meet in the inverted list of
every reference point they name; within a list, pairs that share enough points are candidates and are
verified by their exact cosine.  A pair is counted only in the list of the smallest point it shares.

Lists that are long are compared chunk by chunk.  A comparison reports, per vector, how many links it
found, and links that span each group it found: never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import small_batches
from tracewright.llm.components import components
from tracewright.llm.vectors import as_bytes, by_group, stacked, usable
from tracewright.session import staging_path

NAMED = 12        # reference points that describe a vector
SHARED = 2        # of them, shared by a candidate pair
CHUNK = 512
LEAST_POINTS, MOST_POINTS = 64, 8192


def reference_points(dims: int, points: int, seed: int = 23) -> np.ndarray:
    """Random unit vectors: the same for every run, whatever the data."""
    found = np.random.default_rng([seed, dims, points]).normal(size=(points, dims))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def described(vector: Column, points: int) -> Column:
    """The numbers of the nearest reference points, nearest first."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.to_pylist()
            out: list = [None] * len(rows)
            by_dims: dict[int, list[int]] = {}
            for i, row in enumerate(rows):
                by_dims.setdefault(len(row) // 8, []).append(i)
            for dims, at in by_dims.items():
                if dims not in known:
                    known[dims] = reference_points(dims, points)
                near = stacked([rows[i] for i in at]) @ known[dims].T
                top = np.argpartition(-near, NAMED - 1, axis=1)[:, :NAMED]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                for i, row in zip(at, top.tolist()):
                    out[i] = row
            yield pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(vector)


def compared(least: float):
    """Work on one block: rows (point, own, other, node, weight, vector, named)."""

    def work(block, rows):
        if len(rows) < 2:
            return None
        point, own, node, weight, vector, named = (list(c) for c in zip(*rows))
        units = stacked(vector)
        units = units / np.linalg.norm(units, axis=1, keepdims=True)
        named = np.array(named)
        own = np.array(own)
        flat, place = np.unique(named, return_inverse=True)
        names = np.zeros((len(rows), len(flat)), np.float32)
        names[np.arange(len(rows))[:, None], place.reshape(named.shape)] = 1
        wanted = np.triu((names @ names.T) >= SHARED, 1)
        if (own != own[0]).any():  # two chunks: only pairs across
            wanted &= own[:, None] != own[None, :]
        i, j = np.nonzero(wanted & (units @ units.T >= least))
        mine = np.empty(len(i), bool)
        for at in range(0, len(i), 50_000):
            a, b = named[i[at: at + 50_000]], named[j[at: at + 50_000]]
            same = (a[:, :, None] == b[:, None, :]).any(2)
            mine[at: at + 50_000] = np.where(same, a, 1 << 30).min(1) == point[0]
        i, j = i[mine], j[mine]
        if not len(i):
            return None
        weight = np.array(weight, np.int64)
        links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        root = np.arange(len(rows))
        while True:  # smallest row reachable
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array([node[k] for k in some], pa.int64()), pa.array(links[some].astype(np.int64)),
                                           pa.array([node[root[k]] for k in some], pa.int64())], ["node", "links", "root"])

    return work


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_duplicate_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                           least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors of the same length and label are linked when their cosine, in double precision, is ``least``
    or more.  Vectors that are null, empty or zero or hold a null or non-finite component, and rows with
    a null label, have no links.  A row with a null id takes no part: component_id null, kept.  Equal
    vectors of one label are compared once, but each counts as a link of the other; rows that repeat an
    id count once and come out as often.  The number of reference points grows with the rows, from 64 to
    8192.  Other columns are neither needed nor returned.
    """
    small_batches(rows.sparkSession)
    plain = rows.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    told = plain.withColumn("v", F.when(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("v")))
    told = _staged(told.withColumn("v", as_bytes(F.col("v"))), "vectors")
    some = told.filter("v is not null")
    points = 1 << max(LEAST_POINTS, min(MOST_POINTS, told.count() // 64)).bit_length() - 1
    nodes = some.groupBy("label", "v").agg(F.min("id").alias("node"), F.count_distinct("id").alias("weight"))
    nodes = _staged(nodes.withColumn("named", described(F.col("v"), points)), "nodes")
    # the inverted lists
    entries = nodes.select("node", "label", F.length("v").alias("size"), F.explode("named").alias("point"))
    lists = entries.groupBy("label", "size", "point").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(CHUNK))
    listed = (entries.join(lists, ["label", "size", "point"])
              .withColumn("own", F.pmod(F.xxhash64("node"), chunks))
              .select("node", "label", "size", "point", "own", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other")))
    block = F.xxhash64("label", "size", "point", F.least("own", "other"), F.greatest("own", "other")).alias("block")
    dealt = (listed.select(block, "node", "label", "point", "own").join(nodes.select("node", "label", "weight", "v", "named"), ["node", "label"])
             .select("block", "point", "own", "node", "weight", "v", "named")
             .repartition(F.xxhash64("block")).sortWithinPartitions("block", "node"))
    found = _staged(dealt.mapInArrow(by_group(compared(least), 7), "node long, links long, root long"), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found, "node", "root").withColumnRenamed("component", "reached")
    classes = (nodes.select("label", "v", "node", "weight").join(sums, "node", "left").join(parts, "node", "left")
               .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("reached", "node").alias("component_id")))
    out = told.join(classes, ["label", "v"], "left")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"),
                      F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
