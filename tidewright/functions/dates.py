"""Dates in running text: ten ways to write them, the date that names an event, and window tests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month abbreviations in order, and the years that may stand alone (fixed values).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONE_YEARS = "202[5-8]"
HIT = "struct<start:int,iso:string,iso_end:string,precision:string>"

_DASH = "[–—-]"
_NAMED = "(?:" + "|".join(m.capitalize() for m in MONTHS) + r")[a-z]*\.?"
_DAY = r"\d{1,2}"


def _grammars() -> list[tuple[re.Pattern, str]]:
    """(pattern, precision), specific ones first; groups a and b are the first and last day, m and n their months."""
    month, last = rf"(?P<m>{_NAMED})", rf"(?P<n>{_NAMED})"
    year = r"(?P<y>20\d\d)"
    iso = r"(?P<y>20\d\d)-(?P<i>\d\d)-(?P<a>\d\d)"
    written = [
        (rf"\b{iso}\s*(?:to|until|{_DASH})\s*(?P<z>20\d\d)-(?P<j>\d\d)-(?P<b>\d\d)", "day"),
        (rf"\b{iso}\b", "day"),
        (rf"\b(?P<a>{_DAY})\s+{month}\s*{_DASH}\s*(?P<b>{_DAY})\s+{last}\s+{year}", "day"),
        (rf"\b(?P<a>{_DAY})\s*{_DASH}\s*(?P<b>{_DAY})\s+{month}\s+{year}", "day"),
        (rf"\b(?P<a>{_DAY})\s+{month}\s+{year}", "day"),
        (rf"\b{month}\s*{_DASH}\s*{last}\s+{year}", "month"),
        (rf"\b{month}\s+{year}", "month"),
        (rf"\bQ(?P<q>[1-4])\s*{year}\b", "quarter"),
        (rf"\b{year}\s*-?\s*Q(?P<q>[1-4])\b", "quarter"),
        (rf"\b(?P<y>{LONE_YEARS})\b", "year"),
    ]
    return [(re.compile(p), precision) for p, precision in written]


GRAMMARS = _grammars()


def dates_in(text: str) -> list[dict]:
    """All dates of a text in order; no two share a character, and a more specific grammar goes first."""
    taken = bytearray(len(text))
    found = []
    for pattern, precision in GRAMMARS:
        for hit in pattern.finditer(text):
            if any(taken[hit.start() : hit.end()]):
                continue
            part = {"y": None, "z": None} | hit.groupdict()

            def month(number: str, named: str, part: dict = part) -> int | None:
                if part.get(number):
                    return int(part[number])
                return 1 + MONTHS.index(part[named][:3].lower()) if part.get(named) else None

            first = month("i", "m") or (3 * int(part["q"]) - 2 if part.get("q") else 1)
            iso = f"{part['y']}-{first:02d}-{int(part.get('a') or 1):02d}"
            end = None
            if part.get("b") or part.get("n"):
                last = month("j", "n") or first
                end = f"{part['z'] or part['y']}-{last:02d}-{int(part.get('b') or 1):02d}"
            taken[hit.start() : hit.end()] = b"\1" * (hit.end() - hit.start())
            found.append({"start": hit.start(), "iso": iso, "iso_end": end, "precision": precision})
    return sorted(found, key=lambda x: x["start"])


def extract_dates(text: Column) -> Column:
    """:func:`dates_in` as array<struct>, in Arrow batches; null for a null text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("iso", pa.string()), ("iso_end", pa.string()), ("precision", pa.string())]))
        for texts in batches:
            yield pa.array([None if t is None else dates_in(t) for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, f"array<{HIT}>")(text)


def primary_date(hits: Column, years: tuple[str, ...] = ("2025", "2026", "2027")) -> Column:
    """The hit that names an event: the first within ``years``, else the first at all."""
    inside = F.filter(hits, lambda h: F.substring(h["iso"], 1, 4).isin(*years))
    return F.coalesce(F.get(inside, F.lit(0)), F.get(hits, F.lit(0)))


def is_recent(text: Column, cutoff: Column) -> Column:
    """Not older than the cutoff; what can't be read as a time, or is missing, passes."""
    at = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*(?:GMT|UTC|[+-]0000)$", ""), F.lit("d MMM yyyy HH:mm:ss")))
    return F.coalesce(at >= cutoff, F.lit(True))


def in_window(text: Column, first: str, last: str) -> Column:
    """The text's first ten characters lie in the window, compared as text; a missing or empty date doesn't."""
    day = F.substring(text, 1, 10)
    return F.coalesce((F.length(text) > 0) & day.between(first, last), F.lit(False))
