"""Bounded training samples: which rows, by a hash of their id; then their whole texts in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_id(column: str = "doc_id"):
    return F.xxhash64(F.col(column))


def first_by_hash(rows: DataFrame, n: int, column: str = "doc_id") -> int | None:
    """The ``n``-th smallest hash of the ids (null: there are no rows). Only ids are read and sent."""
    cut = rows.select(hashed_id(column).alias("h")).orderBy("h").limit(n).agg(F.max("h").alias("h")).first()
    return None if cut is None else cut["h"]


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, n: int) -> list[tuple[str, int]]:
    """At most ``n`` (text, label) pairs, chosen by the ids' hash; null texts and labels don't count.

    If an id has several label rows, the largest label holds.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    cut = first_by_hash(known, n)
    if cut is None:
        return []
    chosen = F.broadcast(known.where(hashed_id() <= cut).limit(n))  # at most n rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where("text is not null")
    return [(r["text"], r["y"]) for r in rows.select("text", "y").limit(n).collect()]
