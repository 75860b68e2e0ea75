"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def seat_code(raw: Column) -> Column:
    """'p 7', 'P.007' and 'P007' as P007; 'n.3' and 'N03' as N.03; null for anything else."""
    letter = F.upper(F.regexp_extract(raw, r"^\s*([PpNn])[\s.]*(\d{1,3})\s*$", 1))
    digits = F.regexp_extract(raw, r"^\s*([PpNn])[\s.]*(\d{1,3})\s*$", 2)
    number = F.regexp_replace(digits, "^0+", "")
    return F.when(letter == "P", F.concat(F.lit("P"), F.lpad(number, 3, "0"))).when(letter == "N", F.concat(F.lit("N."), F.when(F.length(number) < 3, F.lpad(number, 2, "0")).otherwise(number)))


def tokens(text: Column, least: int = 3, stop: Sequence[str] = ()) -> Column:
    """Distinct lower-case runs of ASCII letters and digits, at least ``least`` long, without stop words, sorted."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    if stop:
        words = F.array_except(words, F.array(*[F.lit(w) for w in stop]))
    return F.array_sort(F.array_distinct(words))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule (name, regular expression) that the text matches."""
    out: Column | None = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def first_match_unless(text: Column, rules: Sequence[tuple[str, str]], guard: str, look_back: int = 24, default: str = "other") -> Column:
    """Like :func:`first_match`, but a match with ``guard`` in the ``look_back`` characters before it doesn't count.

    Every match is tested by itself, so one without a guard counts whatever stands before the others. The guard
    and up to ``look_back`` characters, of any kind, lie in a look-behind of bounded length.
    """
    out: Column | None = None
    for name, pattern in rules:
        plain = text.rlike(f"(?<!(?:{guard})(?s:.{{0,{look_back}}}))(?:{pattern})")
        out = F.when(plain, name) if out is None else out.when(plain, name)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Whether one of the keywords occurs, in any case."""
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(text), k))


def urls_in(text: Column) -> Column:
    """Links in a text in order of first appearance, without punctuation at their ends."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>)\]]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def strip_tags(html: Column) -> Column:
    """Markup to text: tags go, runs of white space become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def headline_source(title: Column) -> Column:
    """The publisher in 'Headline - Publisher'; null without one."""
    return F.nullif(F.regexp_extract(title, r"^.* - ([^-]+)$", 1), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def fact_tokens(text: Column) -> Column:
    """Tokens that a report must be able to prove: seat codes, ISO dates, numbers; in that priority, masked in turn."""
    seats = F.regexp_extract_all(text, F.lit(r"\b(P\d{3}|N\.\d{2})\b"), F.lit(1))
    rest = F.regexp_replace(text, r"\b(P\d{3}|N\.\d{2})\b", " ")
    dates = F.regexp_extract_all(rest, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    rest = F.regexp_replace(rest, r"\b\d{4}-\d{2}-\d{2}\b", " ")
    numbers = F.regexp_extract_all(rest, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(seats, dates, numbers)))
