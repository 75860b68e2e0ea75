"""Threads of related rows, and the greedy passes whose order defines their result.

Greedy passes look at rows in one sequence and compare each with those kept so far; that order is their
meaning. Candidates are cut down by Spark first; the pass itself runs per group, and a group is what
one task holds, so groups must be bounded by the caller (a source's feed, a theme's threads).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_feed(rows: DataFrame, group: str, order: str, tokens: str, ident: str, per_source: int = 5, source: str = "source", shared: int = 3, cap: int = 120) -> DataFrame:
    """Rows kept by a feed: newest first, at most ``per_source`` of a source, none with ``shared`` tokens in common with a kept row, at most ``cap``."""
    kind = rows.schema[ident].dataType.simpleString()
    gkind = rows.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, ident], ascending=[False, True])
        kept, counts = [], {}
        seen: list[set] = []
        for row in pdf.itertuples(index=False):
            own, src = set(getattr(row, tokens)), getattr(row, source)
            if len(kept) >= cap or counts.get(src, 0) >= per_source or any(len(own & s) >= shared for s in seen):
                continue
            kept.append(getattr(row, ident))
            counts[src] = counts.get(src, 0) + 1
            seen.append(own)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(kept), ident: kept, "place": range(1, len(kept) + 1)})

    return rows.select(*dict.fromkeys([group, order, tokens, ident, source])).groupBy(group).applyInPandas(one, f"{group} {gkind}, {ident} {kind}, place int")


def consolidate(threads: DataFrame, group: str, ident: str, tokens: str, size: str, least: float = 0.34, cap: int = 48) -> DataFrame:
    """(ident, merged_into): threads of a group merged in id order where sets overlap enough and the sum stays within ``cap``."""
    kind = threads.schema[ident].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident)
        heads: list[list] = []  # id, tokens, size
        out = []
        for row in pdf.itertuples(index=False):
            own, n = set(getattr(row, tokens)), int(getattr(row, size))
            for head in heads:
                union = len(own | head[1])
                if union and len(own & head[1]) / union >= least and head[2] + n <= cap:
                    head[1] |= own
                    head[2] += n
                    out.append((getattr(row, ident), head[0]))
                    break
            else:
                heads.append([getattr(row, ident), own, n])
                out.append((getattr(row, ident), getattr(row, ident)))
        return pd.DataFrame(out, columns=[ident, "merged_into"])

    return threads.select(group, ident, tokens, size).groupBy(group).applyInPandas(one, f"{ident} {kind}, merged_into {kind}")


def longest_matches(rows: DataFrame, ident: str, text: str, needles: list[tuple[str, str]]) -> DataFrame:
    """(id, name, start, end): dictionary phrases at word boundaries, longest first, without overlap.

    The dictionary is a parameter list of the call and goes to the tasks as an automaton.
    """
    kind = rows.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase, name in needles:
            automaton.add_word(phrase.lower(), (len(phrase), name))
        automaton.make_automaton()
        for pdf in frames:
            out = []
            for i, t in zip(pdf[ident], pdf[text].fillna(""), strict=True):
                low = t.lower()
                if len(low) != len(t):
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
                found = []
                for last, (n, name) in automaton.iter(low):
                    start, end = last - n + 1, last + 1
                    if (start == 0 or not low[start - 1].isalnum()) and (end == len(low) or not low[end].isalnum()):
                        found.append((start, end, name))
                taken: list[tuple[int, int]] = []
                for start, end, name in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
                    if all(end <= a or start >= b for a, b in taken):
                        taken.append((start, end))
                        out.append((i, name, start, end))
            yield pd.DataFrame(out, columns=[ident, "name", "start", "end"])

    return rows.select(ident, text).mapInPandas(run, f"{ident} {kind}, name string, start long, end long")
