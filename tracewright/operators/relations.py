"""Joins with declared cardinality, reconciliation, reference resolution, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.timeline import as_list, rank_in_buckets


class CheckFailed(ValueError):
    """A declared property of the data does not hold."""


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def assert_keys(df: DataFrame, keys, unique: bool = True) -> DataFrame:
    """Columns present, keys not null and unique, else fail."""
    keys = as_list(keys)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise CheckFailed(f"missing columns {missing}")
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    found = per_key.agg(F.count_if(null).alias("nulls"), F.count_if(~null & (F.col("_n") > 1)).alias("dups")).first()
    if found["nulls"]:
        raise CheckFailed(f"null values in {keys}")
    if unique and found["dups"]:
        raise CheckFailed(f"{found['dups']} duplicate values of {keys}")
    return df


def join_checked(a: DataFrame, b: DataFrame, on, how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """Equi join that fails unless its declared cardinality holds."""
    on = as_list(on)
    sides = {"one_to_one": (a, b), "many_to_one": (b,), "one_to_many": (a,)}[validate]
    for side in sides:
        if not duplicate_keys(side, on).isEmpty():
            raise CheckFailed(f"join keys {on} repeat on a side declared unique ({validate})")
    return a.join(b, on, how)


def diff_tables(a: DataFrame, b: DataFrame, on, cols: Sequence[str]) -> DataFrame:
    """Full-outer comparison of two versions of a table with changed flags."""
    on = as_list(on)
    left = a.select(*on, F.struct(*cols).alias("_a"))
    right = b.select(*on, F.struct(*cols).alias("_b"))
    both = left.join(right, on, "full_outer")
    side = F.when(F.col("_b").isNull(), "LEFT_ONLY").when(F.col("_a").isNull(), "RIGHT_ONLY").otherwise("BOTH")
    out = both.withColumn("side", side)
    for c in cols:
        out = (out.withColumn(f"{c}_a", F.col("_a")[c]).withColumn(f"{c}_b", F.col("_b")[c])
               .withColumn(f"{c}_changed", ~F.col("_a")[c].eqNullSafe(F.col("_b")[c])))
    return out.drop("_a", "_b")


def disagreement(diff: DataFrame, col: str) -> DataFrame:
    """Counts by old and new value."""
    return diff.groupBy(f"{col}_a", f"{col}_b").agg(F.count(F.lit(1)).alias("rows"))


def left_fill(a: DataFrame, b: DataFrame, on, fill: Mapping[str, object]) -> DataFrame:
    """Left join with missing values filled."""
    return a.join(b, as_list(on), "left").na.fill(dict(fill))


def resolve_refs(refs: DataFrame, inventory: DataFrame, on, ref_id: str, path: str = "path") -> DataFrame:
    """RESOLVED / AMBIGUOUS / MISSING, one row per physical match, numbered by path."""
    on = as_list(on)
    per_name = inventory.groupBy(*on).agg(F.count(F.lit(1)).alias("match_count"))
    # a text prefix keeps the order, so a name with very many copies is numbered in pieces
    numbered = rank_in_buckets(inventory.select(*on, path), on, F.substring(F.col(path), 1, 128),
                               [F.col(path)], "match_number")
    status = (F.when(F.coalesce("match_count", F.lit(0)) == 0, "MISSING")
              .when(F.col("match_count") == 1, "RESOLVED").otherwise("AMBIGUOUS"))
    return (refs.join(per_name, on, "left").withColumn("status", status)
            .na.fill({"match_count": 0}).join(numbered, on, "left"))


def resolve_first(refs: DataFrame, inventory: DataFrame, ref_id: str, candidates: Sequence[str],
                  name: str = "name", path: str = "path") -> DataFrame:
    """Resolve by ordered candidate names; records which one hit."""
    tries = F.posexplode(F.array(*[F.col(c).cast("string") for c in candidates]))
    long = refs.select(ref_id, tries.alias("_pos", "_name")).filter(F.col("_name").isNotNull())
    firsts = inventory.groupBy(F.col(name).alias("_name")).agg(F.min(path).alias(path))
    hit = (long.join(firsts, "_name").groupBy(ref_id)
           .agg(F.min_by(path, "_pos").alias(path), F.min("_pos").alias("_pos")))
    method = F.coalesce(F.try_element_at(F.array(*[F.lit(c) for c in candidates]), F.col("_pos") + 1), F.lit("MISSING"))
    return refs.join(hit, ref_id, "left").withColumn("method", method).drop("_pos")


def attach_semantics(segs: DataFrame, records: DataFrame, on, texts: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Roll records up per segment (sorted distinct texts, mean scores), then left join."""
    on = as_list(on)
    rolled = records.groupBy(*on).agg(
        F.count(F.lit(1)).alias("record_count"),
        *[F.sort_array(F.collect_set(t)).alias(f"{t}_values") for t in texts],
        *[F.avg(m).alias(f"{m}_mean") for m in means])
    return segs.join(rolled, on, "left").na.fill({"record_count": 0})


def restrict_sessions(df: DataFrame, sessions: DataFrame, key) -> DataFrame:
    """Rows of the given sessions only."""
    return df.join(sessions.select(*as_list(key)), as_list(key), "left_semi")


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_on(df: DataFrame, cols) -> DataFrame:
    """One row per value of the columns."""
    return df.select(*as_list(cols)).distinct()


def shared_keys(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Keys present in both."""
    return a.select(*as_list(key)).intersect(b.select(*as_list(key)))


def split_leaks(df: DataFrame, key, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return (df.groupBy(*as_list(key)).agg(F.count_distinct(split).alias("splits")).filter("splits > 1"))


def missing_keys(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*as_list(key)).distinct().join(b.select(*as_list(key)), as_list(key), "left_anti")
