"""Filters over tagged news items, tables with pages, flags, and lists with a waiting part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevant(title: Column, keywords: Sequence[str], persons: Sequence[str]) -> Column:
    """A keyword occurs and a person's pattern matches, both in any case."""
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(title), k)) & title.rlike("(?i)" + "|".join(f"(?:{p})" for p in persons))


def of_place(title: Column, aliases: Sequence[str], company: str, public: str) -> Column:
    """An alias occurs, and none of them only as the beginning of a company's name."""
    low = F.lower(title)
    named = F.lit(False)
    firm = F.lit(False)
    for alias in aliases:
        quoted = r"\Q" + alias.lower() + r"\E"
        named = named | F.contains(low, F.lit(alias.lower()))
        firm = firm | (low.rlike(rf"{quoted}\s+(?:{company})\b") & ~low.rlike(rf"{quoted}\s+(?:{public})"))
    return named & ~firm


def tagged(tags: Column, wanted: Sequence[str], every: bool = False) -> Column:
    """One of the wanted tags is there; ``every``: all of them are."""
    asked = F.array(*[F.lit(t) for t in wanted])
    return F.size(F.array_except(asked, tags)) == 0 if every else F.arrays_overlap(asked, tags)


def tag_or_keyword(tags: Column, place: str, text: Column, keywords: Sequence[str]) -> Column:
    """By the tags where there are any, else by keywords in the text."""
    found = F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(text), k))
    return F.when(F.size(tags) > 0, F.array_contains(tags, place)).otherwise(found)


def noise(category: Column, title: Column, categories: Sequence[str], words: Sequence[str]) -> Column:
    """Items of some categories whose title holds one of the words."""
    return category.isin(*categories) & F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(title), w))


def searched(df: DataFrame, text: str, columns: Sequence[str], **equal: str | None) -> DataFrame:
    """Rows with ``text`` in one of the columns, joined by blanks, and equal values where one is asked for."""
    out = df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))
    for column, value in equal.items():
        out = out if value is None else out.where(F.col(column) == value)
    return out


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """The page ``number`` (from 1) of a table in a total order: the feature is the bound."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def flagged(df: DataFrame, key: str, members: DataFrame, out: str) -> DataFrame:
    """All rows, with a flag for those whose key is a member."""
    known = members.select(F.col(key)).distinct().withColumn(out, F.lit(True))
    return df.join(known, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def waiting_first(df: DataFrame, waiting: Column, newest: Column, ident: Column, most: int) -> DataFrame:
    """Items carried over come first, then newer ones; the cap is the feature, what it leaves stays waiting."""
    return df.orderBy(F.desc(waiting), F.desc_nulls_last(newest), ident).limit(most)
