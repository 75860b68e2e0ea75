"""Connected components of a link table, as distributed joins.

Every vertex holds the smallest id it has heard of. A round takes the minimum over the neighbours and
then follows the label's own label, so labels shrink towards the smallest id of the component and
long chains halve. Each round is written to the shared folder; the loop stops when no label changed.
Nothing is gathered on the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import drop, materialise


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, label) for every end of a link (a, b); label is the smallest id of the component."""
    ends = materialise(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct(), "ends")
    labels = materialise(ends.groupBy("src").agg(F.least("src", F.min("dst")).alias("label")).withColumnRenamed("src", "id"), "labels")
    for _ in range(rounds):
        heard = ends.join(labels.select("id", "label"), ends.dst == F.col("id")).groupBy("src").agg(F.min("label").alias("heard"))
        new = labels.join(heard, labels.id == heard.src).select("id", F.col("label").alias("old"), F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("further"))
        new = new.join(jump, new.next == jump.at, "left").select("id", "old", F.least("next", "further").alias("label"))
        before, labels = labels, materialise(new, "labels")
        changed = labels.where("old != label").limit(1).count()
        drop(before)
        if not changed:
            drop(ends)
            return labels.select("id", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def connected_components(nodes: DataFrame, ident: str, links: DataFrame) -> DataFrame:
    """(ident, component): the smallest id that is reachable; nodes without links are their own component."""
    found = nodes.select(F.col(ident).alias("id")).join(components(links), "id", "left")
    return found.select(F.col("id").alias(ident), F.coalesce("label", "id").alias("component"))
