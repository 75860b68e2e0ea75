"""JSON texts: a canonical form with its digest, and nested payloads as plain text."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_bytes(text: str) -> bytes:
    """Keys sorted at every level, two blanks of indentation, no escapes of letters, a line feed at the end."""
    return (json.dumps(json.loads(text), ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()


def canonical_hash(text: Column) -> Column:
    """SHA-256 of the canonical form; null for a null text or one that isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else hashlib.sha256(canonical_bytes(t)).hexdigest()
        except ValueError:
            return None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def leaves(value, key: str = "") -> Iterator[str]:
    """Keys that hold a plain value and these values, in order; keys of objects and lists aren't said."""
    stack = [(key, value)]
    while stack:
        name, item = stack.pop()
        if isinstance(item, dict):
            stack += reversed(list(item.items()))
        elif isinstance(item, list):
            stack += [(name if not isinstance(x, (dict, list)) else "", x) for x in reversed(item)]
        elif item is not None:
            yield from (x for x in (name, str(item)) if x)


def flattened(text: Column) -> Column:
    """struct<said: all leaves, urls: links among them, distinct, in order>; null where the text isn't JSON."""
    kind = pa.struct([("said", pa.string()), ("urls", pa.list_(pa.string()))])

    def one(t: str | None) -> dict | None:
        try:
            words = list(leaves(json.loads(t))) if t is not None else None
        except ValueError:
            return None
        return words and {"said": " ".join(words), "urls": list(dict.fromkeys(w for w in words if w.startswith(("http://", "https://"))))}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([one(t) or None for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, "struct<said:string,urls:array<string>>")(text)
