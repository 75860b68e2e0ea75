"""BPE encoding and decoding (operator 9).

Method: a priority queue of merge ranks over a doubly linked list of symbols. Each popped entry is
checked against the symbols that stand at its place now; entries made stale by an earlier merge are
skipped. Decoding concatenates the vocabulary strings of the ids.

The vocabulary file is a parameter; it describes byte-level symbols with word ends, text in lower
case and NFC, and pre-tokens by the pattern in the file. White space never lies inside a pre-token,
so a text is cut at ASCII white space and each distinct chunk is encoded once per worker and kept in
a bounded cache. The chunk's ids are kept as little-endian unsigned 32-bit bytes, so a document's ids
are one join of byte strings.

Defined results: a null or empty text has no ids, and its digests are those of the empty string. Rows
are independent: ties, repeated rows, empty tables and extra columns need no care.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewright.llm.common import map_batches, text_slices

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Distinct chunks a worker keeps; about 200 bytes each. The cache is emptied when it is full.
CACHE_CHUNKS = 500_000
_POS = 32  # bits of a queue entry that hold the place; the rank stands above


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where the public vocabulary file lies on this machine (each executor asks for itself)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte, by the usual byte-level rule.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on.
    """
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def little_endian(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class WordBpe(dict):
    """Encoder and decoder; as a dict, it is the cache from a chunk's bytes to its ids' bytes."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.cache_chunks = cache_chunks
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # \s of the file's regex engine is the White_Space property
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pre_tokens = regex.compile(pattern).findall
        self.inner = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + end] for c in byte_symbols()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = n
            self.made.append(vocab[a + b])
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.raw_strings = [s.encode() + b" " for s in self.strings]

    def word(self, token: str) -> list[int]:
        """Ids of one pre-token (already normalised): the queue of ranks over the linked symbols."""
        raw = token.encode()
        inner, rank = self.inner, self.rank.get
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        queue = []
        for i in range(n - 1):
            r = rank(symbols[i] << 32 | symbols[i + 1])
            if r is not None:
                queue.append(r << _POS | i)
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, made, mask = heapq.heappop, heapq.heappush, self.made, (1 << _POS) - 1
        while queue:
            entry = pop(queue)
            at, r = entry & mask, entry >> _POS
            right = after[at]
            if symbols[at] < 0 or right >= n or rank(symbols[at] << 32 | symbols[right]) != r:
                continue  # stale: one of its symbols was merged away or changed
            symbols[at] = new = made[r]
            symbols[right] = -1
            after[at] = follow = after[right]
            if follow < n:
                before[follow] = at
                r = rank(new << 32 | symbols[follow])
                if r is not None:
                    push(queue, r << _POS | at)
            lead = before[at]
            if lead >= 0:
                r = rank(symbols[lead] << 32 | new)
                if r is not None:
                    push(queue, r << _POS | lead)
        return [s for s in symbols if s >= 0]

    def chunk(self, raw: bytes) -> list[int]:
        """Ids of a stretch of text without ASCII white space."""
        text, ids = raw.decode("utf-8", "replace"), []
        for k, part in enumerate(self.special_at.split(text) if "<|" in text else (text,)):
            if k % 2:
                ids.append(self.special[part])
                continue
            # a capital sigma becomes the same letter wherever it stands
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for token in self.pre_tokens(part):
                ids += self.word(token)
        return ids

    def __missing__(self, raw: bytes) -> bytes:
        ids = little_endian(self.chunk(raw))
        if len(self) >= self.cache_chunks:
            self.clear()
        self[raw] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole UTF-8 text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, text.split()))

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary strings of the ids, with a blank between them, as UTF-8."""
        return b"".join(map(self.raw_strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))[:-1]


_LOADED: dict[str, WordBpe] = {}


def loaded(name: str = DEFAULT_VOCABULARY) -> WordBpe:
    """The encoder of this Python worker: made once, kept while the worker is reused."""
    if name not in _LOADED:
        _LOADED[name] = WordBpe(vocabulary_path(name))
    return _LOADED[name]


def encode_texts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, digests of ids and of the decoded text, and if asked both themselves.

    ``ids`` is array<int>, ``decoded`` is string. No shuffle: one pass over the rows as they lie.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def setup() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        bpe = loaded(vocabulary)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for start, texts in text_slices(batch, "text", 4_000_000):
                counts, id_digests, text_digests, ids, decoded = [], [], [], [], []
                for text in texts:
                    raw = bpe.encode(text)
                    back = bpe.decode(raw)
                    counts.append(len(raw) // 4)
                    id_digests.append(hashlib.sha256(raw).hexdigest())
                    text_digests.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    if with_text:
                        decoded.append(back.decode())
                columns = [batch.column(0).slice(start, len(texts)).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    columns.append(pa.array(decoded, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

        return each

    return map_batches(docs.select("doc_id", "text"), setup, schema)


def digests(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The digest columns of :func:`encode_texts`, for comparison with another encoder."""
    return encode_texts(docs, vocabulary, with_ids=False, with_text=False)
