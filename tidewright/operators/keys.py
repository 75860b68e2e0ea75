"""Rows by key: first and last, additive merge, difference of snapshots, quotas, chunks, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in an explicit total order (Spark's rows have none of their own)."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def pick_per_key(df: DataFrame, keys: Sequence[str], by: Column, columns: Sequence[str], latest: bool = True) -> DataFrame:
    """The named columns of the row with the largest (smallest) ``by``: an aggregation, so combined before the shuffle."""
    pick = F.max_by if latest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*columns), by).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def additive_merge(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows, and new rows whose key isn't in the base; a column ``origin`` says which."""
    fresh = new.join(base.select(*keys).distinct(), list(keys), "left_anti")
    return base.withColumn("origin", F.lit("base")).unionByName(fresh.withColumn("origin", F.lit("new")), allowMissingColumns=True)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys with their state: added, removed, changed or same; values are compared null-safely."""
    a = before.select(*keys, F.struct(*values).alias("_before"))
    b = after.select(*keys, F.struct(*values).alias("_after"))
    state = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(F.col("_before").eqNullSafe(F.col("_after")), "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))


def missing_from(sub: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other table lacks: empty if ``sub`` is a subset. Null-safe, unlike NOT IN."""
    condition = reduce(lambda x, y: x & y, [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys])
    return sub.alias("s").join(whole.select(*keys).distinct().alias("w"), condition, "left_anti")


def quota(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group, the first in order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def round_robin(df: DataFrame, group: str, slot: str, order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group, one of each slot in turn: by rank within the slot, then by slot."""
    inside = df.withColumn("turn", F.row_number().over(Window.partitionBy(group, slot).orderBy(*order)))
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("turn", slot))).where(F.col("rank") <= n)


def every_kth(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """Systematic sample: the first and then every k-th row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where((F.col("_rn") - 1) % k == 0).drop("_rn")


def chunks(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """Batch number of each row: groups cut into runs of at most ``n``."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / n))


def duplicate_suffix(df: DataFrame, key: str, order: Sequence[Column], out: str = "unique_key") -> DataFrame:
    """The key itself for its first row, ``key~2``, ``key~3`` and so on for later ones."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("~"), n.cast("string"))))


def first_groups(df: DataFrame, family: str, group: str, order: Column, n: int) -> DataFrame:
    """Rows of the first ``n`` groups of each family, groups ranked by their first appearance."""
    seen = df.groupBy(family, group).agg(F.min(order).alias("_first"))
    seen = seen.withColumn("group_rank", F.row_number().over(Window.partitionBy(family).orderBy("_first", group))).where(F.col("group_rank") <= n)
    return df.join(seen.drop("_first"), [family, group])


def mode_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label of each key; ties go to the label that sorts first."""
    counted = df.groupBy(key, label).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(F.col(label), F.col("n")), F.struct((-F.col("n")).alias("_n"), F.col(label)))
    return counted.groupBy(key).agg(best.alias("_best")).select(key, F.col(f"_best.{label}").alias(label), F.col("_best.n").alias("n"))


def multiset_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values with how often more (or less) they stand left than right."""
    both = left.select(*columns, F.lit(1).alias("_d")).unionByName(right.select(*columns, F.lit(-1).alias("_d")))
    return both.groupBy(*columns).agg(F.sum("_d").alias("surplus")).where("surplus != 0")


def set_hash(df: DataFrame, group: str, signature: Column) -> DataFrame:
    """One digest of each group's distinct signatures, whatever their order."""
    listed = F.array_join(F.sort_array(F.collect_set(signature)), "\n")
    return df.groupBy(group).agg(F.sha2(listed, 256).alias("set_hash"), F.countDistinct(signature).alias("n"))
