"""Names, titles, markup and numbers as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Honorifics at the beginning of a name, titles inside it, and particles between its parts (a few; callers pass their own).
HONORIFICS = ("datuk seri", "dato' seri", "datuk", "dato'", "tan sri", "tun", "dr", "ir")
TITLES = ("haji", "hajah", "muhammad", "mohammad", "mohamad", "mohd", "muhd", "md")
PARTICLES = r"(?i)\s+(?:bin|binti|bte|bt|a/l|a/p)\s+"


def _quoted(word: str) -> str:
    return r"\Q" + word + r"\E"


def person_key(name: Column, honorifics: Sequence[str] = HONORIFICS, titles: Sequence[str] = TITLES, overrides: dict[str, str] | None = None) -> Column:
    """Key of a person's name: no brackets, dots, trailing dates, leading honorific (the first that fits), particles or titles."""
    n = F.regexp_replace(F.coalesce(name, F.lit("")), r"[(\[].*?[)\]]", " ")
    n = F.regexp_replace(n, r"\.", " ")
    n = F.regexp_replace(n, r"(?i)\s+(?:from|since|until|as of)\s+(?:\d{1,2}\s+[A-Za-z]+\s+)?\d{4}\s*$", " ")
    n = F.lower(F.trim(F.regexp_replace(n, r"\s+", " ")))
    n = F.trim(F.regexp_replace(n, f"^(?:{'|'.join(map(_quoted, honorifics))})(?= |$)", ""))
    n = F.regexp_replace(n, PARTICLES, " ")
    n = F.regexp_replace(n, rf"\b(?:{'|'.join(map(_quoted, titles))})\b", " ")
    n = F.trim(F.regexp_replace(n, r"\s+", " "))
    for old, new in (overrides or {}).items():
        n = F.when(n == old, new).otherwise(n)
    return n


def clean_markdown(text: Column) -> Column:
    """Bold, italic and code marks go; runs of white space become one blank."""
    t = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\*\*(.+?)\*\*", "$1")
    t = F.regexp_replace(t, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1")
    return F.trim(F.regexp_replace(F.replace(t, F.lit("`"), F.lit("")), r"\s+", " "))


def dedupe_words(text: Column) -> Column:
    """Of adjacent equal words, whatever their case, the first."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    kept = F.filter(w, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(w, i - 1))))
    return F.array_join(kept, " ")


def significance(kind: Column, text: Column, base: dict[str, str], escalate: str) -> Column:
    """The kind's significance (low without one), one step higher for a medium or high one whose text escalates."""
    of_kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), kind), F.lit("low"))
    up = text.rlike(escalate)
    return F.when((of_kind == "high") & up, "critical").when((of_kind == "medium") & up, "high").otherwise(of_kind)


def confidence(n_sources: Column, precision: Column, text: Column, unverified: str) -> Column:
    """high, medium or low by sources, by how exact the date is, and by words that mark a claim as unverified."""
    doubt, sourced = text.rlike(unverified), n_sources > 0
    vague = precision.isin("unknown", "year")
    return F.when(doubt, F.when(sourced, "medium").otherwise("low")).when(~sourced, F.when(vague, "low").otherwise("medium")).when(precision.isin("day", "month"), "high").otherwise("medium")


def signed(x: Column, digits: int = 2) -> Column:
    """A number with its sign, the minus as U+2212."""
    return F.concat(F.when(x < 0, "−").otherwise("+"), F.format_string(f"%.{digits}f", F.abs(x)))


def trimmed(x: Column, digits: int = 2) -> Column:
    """At most ``digits`` decimals, no zeros at the end but one decimal."""
    t = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), "0+$", ""), r"\.$", "")
    return F.when(F.contains(t, F.lit(".")), t).otherwise(F.concat(t, F.lit(".0")))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    teens, last = (n % 100).between(10, 20), n % 10
    return F.concat(n.cast("string"), F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def expanded(tokens: Column, synonyms: dict[str, Sequence[str]]) -> Column:
    """Tokens and those of the synonyms of every phrase whose words are all there."""
    out = tokens
    for phrase, others in synonyms.items():
        more = F.array(*[F.lit(w) for o in others for w in o.split()])
        present = F.size(F.array_except(F.array(*[F.lit(w) for w in phrase.split()]), tokens)) == 0
        out = F.when(present, F.array_union(out, more)).otherwise(out)
    return F.array_sort(F.array_distinct(out))


def profile(*parts: tuple[str, Column]) -> Column:
    """'label: value' of all parts that have one, with bars between them."""
    return F.concat_ws(" | ", *[F.when(F.length(value) > 0, F.concat(F.lit(f"{label}: "), value)) for label, value in parts])
