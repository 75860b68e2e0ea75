"""Secret scans (operator 3).

Method: trigram inverted index. From each rule's regular expression a Boolean query over trigrams is
derived that every match's text must satisfy. A slice of documents gets an index, trigram to the list
of its documents, made in one vectorised pass over the slice's bytes (ASCII letters in lower case) and
only for trigrams that some query names. The lists are intersected and united as the queries say;
only the candidates are verified with the regular expression. A rule without mandatory trigrams scans
every document.

Indexes are of slices of about a megabyte and live in the task, so nothing is shuffled and no
posting list grows with the table.

Matches are leftmost and do not overlap within a kind; a match that fails its rule's further test is
dropped, after it was found. Spans count code points, the end is exclusive; they are ordered by start,
then by the rules' order.

Defined results: null and empty texts have no spans, and the digest is that of the empty string.
Repeated rows get equal results; very long texts are scanned whole; an empty table gives no rows; extra
columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.common import text_columns

_sre, _op = re._parser, re._constants


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


#: The base rules. A run of hexadecimal digits is matched whole or not at all, so the least length can stand in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published formats of further secrets.
FURTHER = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE + FURTHER

# --- from a regular expression to a Boolean trigram query -----------------------------------------
# A query is True (no condition), a trigram, or ("and" | "or", queries).

MOST_STRINGS, MOST_CHARACTERS = 64, 8


def all_of(queries: list) -> object:
    kept = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def any_of(queries: list) -> object:
    kept = list(dict.fromkeys(queries))
    return True if True in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def of_strings(strings: set[str]) -> object:
    """The condition that one of the strings occurs."""
    return any_of([all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _characters(items: list) -> set[str] | None:
    """The characters of a bracket, in lower case; None: too many, or not a plain list."""
    out: set[str] = set()
    for kind, value in items:
        if kind is _op.LITERAL:
            out.add(chr(value).lower())
        elif kind is _op.RANGE and value[1] - value[0] < MOST_CHARACTERS * 4:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= MOST_CHARACTERS else None


def _sequence(nodes) -> tuple[set[str] | None, object]:
    """The exact strings of a sequence (None: not a small set) and the condition on its matches."""
    run: set[str] = {""}
    conditions, exact = [], True
    for node in nodes:
        strings, condition = _node(node)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        conditions.append(of_strings(run))
        exact = False
        run = strings if strings is not None else {""}
        if strings is None:
            conditions.append(condition)
    return (run, True) if exact else (None, all_of([*conditions, of_strings(run)]))


def _node(node) -> tuple[set[str] | None, object]:
    kind, value = node
    if kind is _op.LITERAL:
        return {chr(value).lower()}, True
    if kind is _op.IN:
        return _characters(value), True
    if kind is _op.AT:
        return {""}, True
    if kind is _op.SUBPATTERN:
        return _sequence(value[3])
    if kind is _op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), True
        return None, any_of([c if s is None else of_strings(s) for s, c in parts])
    if kind in (_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, condition = _sequence(inner)
        if strings is not None and most <= 4:
            out: set[str] = set()
            for n in range(least, most + 1):
                if len(strings) ** n > MOST_STRINGS:
                    break
                out |= {"".join(x) for x in product(strings, repeat=n)}
            else:
                if len(out) <= MOST_STRINGS:
                    return out, True
        if least == 0:
            return None, True
        if strings is None:
            return None, condition
        n = least
        while n and len(strings) ** n > MOST_STRINGS:
            n -= 1
        return None, of_strings({"".join(x) for x in product(strings, repeat=min(n, 8))})
    return None, True


def trigram_query(rule: Rule) -> object:
    """The Boolean query of a rule; True: it has no mandatory trigrams."""
    strings, condition = _sequence(_sre.parse(rule.pattern, rule.flags))
    return of_strings(strings) if strings is not None else condition


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# --- index, candidates, verification ---------------------------------------------------------------


class Scanner:
    """Rules with their queries, and the table from a trigram's 24 bits to its number (0: not wanted)."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        self.find = [re.compile(r.pattern, r.flags).finditer for r in rules]
        wanted = sorted(t for t in set().union(*map(trigrams_of, self.queries)) if t.isascii())
        self.number = {t: k + 1 for k, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.int16)
        for t, k in self.number.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = k

    def postings(self, texts: list[bytes]) -> list[set[int]]:
        """By trigram number: the documents of the slice that hold it."""
        out: list[set[int]] = [set() for _ in range(len(self.number) + 1)]
        raw = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8)
        if raw.size < 3:
            return out
        code = raw[:-2].astype(np.uint32) << 16
        code |= raw[1:-1].astype(np.uint32) << 8
        code |= raw[2:]
        found = self.table[code]
        at = np.flatnonzero(found)
        ends = np.cumsum([len(t) + 2 for t in texts])
        pairs = np.unique(found[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        for k, doc in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
            out[k].add(doc)
        return out

    def candidates(self, query: object, postings: list[set[int]], everyone: range) -> set[int] | range:
        if query is True:
            return everyone
        if isinstance(query, str):
            return postings[self.number[query]] if query in self.number else everyone
        parts = [self.candidates(q, postings, everyone) for q in query[1]]
        if query[0] == "or":
            return set().union(*parts)
        out = set(parts[0])
        for p in parts[1:]:
            out.intersection_update(p)
        return out

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per document: (start, rule number, end), in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings, everyone = self.postings(texts), range(len(texts))
        decoded: dict[int, str] = {}
        for k, rule in enumerate(self.rules):
            for doc in self.candidates(self.queries[k], postings, everyone):
                text = decoded.get(doc)
                if text is None:
                    decoded[doc] = text = texts[doc].decode("utf-8", "replace")
                for m in self.find[k](text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[doc].append((m.start(), k, m.end()))
        for found in out:
            found.sort()
        return out


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Per document, beside the columns ``keep`` (doc_id): found array<struct<kind, start, end>>."""

    def setup() -> Callable[[list[bytes]], list[pa.Array]]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def each(texts: list[bytes]) -> list[pa.Array]:
            return [pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in found] for found in scanner.spans(texts)], kind)]

        return each

    return text_columns(docs, "found array<struct<kind:string,start:bigint,end:bigint>>", setup, keep or ["doc_id"])


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def setup() -> Callable[[list[bytes]], list[pa.Array]]:
        scanner = Scanner(rules)

        def each(texts: list[bytes]) -> list[pa.Array]:
            found = scanner.spans(texts)
            base = [[x for x in f if x[1] < len(BASE)] for f in found]
            counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(len(BASE))]
            hashes = [hashlib.sha256(joined(b, rules).encode()).hexdigest() for b in base]
            return [*counts, pa.array(hashes), pa.array([joined(f, rules) for f in found])]

        return each

    return text_columns(docs, fields, setup, ["doc_id"])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (spans that touch or overlap: one mark), and n_chars to match."""

    def setup() -> Callable[[list[bytes]], list[pa.Array]]:
        scanner = Scanner(rules)

        def each(texts: list[bytes]) -> list[pa.Array]:
            out = []
            for raw, found in zip(texts, scanner.spans(texts), strict=True):
                text = raw.decode("utf-8", "replace")
                parts, at = [], 0
                for start, _, end in found:
                    if start > at or not parts:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]))
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return each

    order = docs.columns
    return text_columns(docs, "text string, n_chars long", setup).select(*[f"`{c}`" for c in order])
