"""Chains and as-of joins over dated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(df: DataFrame, key: str, at: str, ident: str, max_gap_days: int) -> DataFrame:
    """Consecutive rows of a key as links (from_id, to_id, gap_days), if no more than ``max_gap_days`` lie between."""
    w = Window.partitionBy(key).orderBy(at, ident)
    nxt = df.select(key, F.col(ident).alias("from_id"), F.lead(ident).over(w).alias("to_id"), F.datediff(F.lead(at).over(w), F.col(at)).alias("gap_days"))
    return nxt.where(F.col("to_id").isNotNull() & (F.col("gap_days") <= max_gap_days))


def previous_matching(df: DataFrame, key: str, at: str, ident: str, is_event: Column, is_trigger: Column, max_gap_days: int | None = None) -> DataFrame:
    """As-of backward: each event row with the last trigger row before it on the same key (strictly, by (at, ident)).

    One pass over rows ordered by key, no self join.
    """
    w = Window.partitionBy(key).orderBy(at, ident).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_trigger, F.struct(F.col(ident).alias("i"), F.col(at).alias("t"))), ignorenulls=True).over(w)
    found = df.withColumn("_last", last).where(is_event & F.col("_last").isNotNull())
    found = found.select(key, F.col("_last.i").alias("from_id"), F.col(ident).alias("to_id"), F.datediff(F.col(at), F.col("_last.t")).alias("gap_days"))
    return found if max_gap_days is None else found.where(F.col("gap_days") <= max_gap_days)


def both_directions(links: DataFrame) -> DataFrame:
    """Every link as seen from each end: (node, other, direction). Two equi-joinable frames rather than an OR."""
    out = links.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(links.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), F.lit("in").alias("direction")))


def age_status(last: Column, as_of: Column, open_days: int = 90, dormant_days: int = 180) -> Column:
    """open, dormant or closed, by the age against the corpus's own latest date."""
    age = F.datediff(as_of, last)
    return F.when(last.isNull() | as_of.isNull() | (age <= open_days), "open").when(age <= dormant_days, "dormant").otherwise("closed")


def sessions(df: DataFrame, key: str, at: str, ident: str, gap_days: int) -> DataFrame:
    """A thread number within each key: a new one starts after more than ``gap_days`` without a row."""
    w = Window.partitionBy(key).orderBy(at, ident)
    new = F.when(F.lag(at).over(w).isNull() | (F.datediff(F.col(at), F.lag(at).over(w)) > gap_days), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("thread", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
