"""Merging of records: layered histories, entities by name, events by anchor and title, ids kept from before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import similarity


def layered_history(layers: Sequence[DataFrame], key: str, line: str) -> DataFrame:
    """Union of layers, each line once per key (the earliest layer's), dated lines first and in order."""
    tagged = [layer.select(key, line).withColumn("layer", F.lit(i)) for i, layer in enumerate(layers)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    once = union.groupBy(key, line).agg(F.min("layer").alias("layer"))
    day = F.nullif(F.regexp_extract(line, r"^(\d{4}(?:-\d{2}){0,2})", 1), F.lit(""))
    order = Window.partitionBy(key).orderBy(day.isNull(), day, "layer", line)
    return once.withColumn("place", F.row_number().over(order))


def merge_entities(layers: DataFrame, name: str, display: str, aliases: str, layer: str) -> DataFrame:
    """One entity per canonical name: the first layer's display name and the union of aliases."""
    spread = layers.select(name, display, layer, F.explode_outer(aliases).alias("alias"))
    return spread.groupBy(name).agg(F.min_by(display, F.struct(layer, display)).alias("display"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.countDistinct(layer).alias("layers"))


def same_event_pairs(events: DataFrame, ident: str, anchor: str, title: str, least: float = 0.7) -> DataFrame:
    """Pairs of events on the same anchor whose titles' token sets are similar: (a, b) with a < b."""
    rows = events.select(F.col(anchor).alias("block"), F.col(ident).alias("id"), text.tokens(F.col(title), 2).alias("set"))
    # equal titles of an anchor are compared once; anchors with many events don't pair titles without a common token
    pairs, members = similarity.token_classes(rows)
    return similarity.expanded(pairs.where(F.col("shared") >= least * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9), members)


def inherited_ids(groups: DataFrame, prior: DataFrame, group: str, member: str, prior_id: str) -> DataFrame:
    """(group, stable_id): the id that most members had before (ties: the smallest), else the group's own."""
    votes = groups.join(prior.select(member, prior_id), member).groupBy(group, prior_id).agg(F.count("*").alias("n"))
    best = votes.groupBy(group).agg(F.min_by(prior_id, F.struct((-F.col("n")).alias("n"), F.col(prior_id))).alias("_kept"))
    own = groups.select(group).distinct()
    return own.join(best, group, "left").select(group, F.coalesce(F.col("_kept"), F.col(group)).alias("stable_id"))
