"""Token ids of whole texts by the tokenizers library, for the operators that only need ids.

Texts are cut at ASCII white space, which no pre-token of the vocabulary crosses. A chunk that is a
word of Latin letters with punctuation behind it is cut once more, as the vocabulary's pre-token
pattern does, and the word counts in lower case; so "Word" and "word," share one entry. Cutting,
hashing, looking up and putting ids together are array operations over a window of texts; words are
told apart by 64-bit hashes. What a worker's bounded table doesn't have goes to the library in one call
for a window: plain words as one text with blanks between them, whose ids are told apart by the
numbers of their pre-tokens.

Memory: arrays of about 60 bytes for each byte of a window, which is WINDOW long or as long as the longest
chunk without white space, beside a table of WORDS words.
"""

from __future__ import annotations

import os

import numpy as np

from tidewright.llm.bpe import DEFAULT_VOCABULARY, vocabulary_path
from tidewright.llm.shingles import _BYTES, _SPACE, Shingler, mix

#: Bytes of texts worked on at once, and distinct words that a worker keeps (about 40 bytes each).
WINDOW, WORDS = 150_000, 1 << 19
_U = np.uint64
_TAIL = np.isin(np.arange(256), list(b".,!?%&$*#;:"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_ALPHA = _UPPER | np.isin(np.arange(256), np.arange(97, 123))
_LOWER = np.where(_UPPER, np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_BLANKS = b" \t\n\r\x0b\x0c"


class Table:
    """From hashes to runs of ids in one pool; open addressing, at most half full."""

    def __init__(self, most: int):
        self.clear(most)

    def clear(self, most: int) -> None:
        size = 2 * (1 << (max(most, 1) - 1).bit_length())
        self.most, self.mask, self.count = most, _U(size - 1), 0
        self.keys, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.first = np.zeros(most + 1, np.int64)  # of entry k its ids are pool[first[k] : first[k + 1]]
        self.pool = np.zeros(4 * most, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(hashes.size, -1, np.int64)
        at, live = (hashes & self.mask).astype(np.int64), np.arange(hashes.size)
        while live.size:
            keys = self.keys[at[live]]
            hit = keys == hashes[live]
            out[live[hit]] = self.numbers[at[live[hit]]]
            live = live[~hit & (keys != 0)]
            at[live] = (at[live] + 1) & int(self.mask)
        return out

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New entries, whose ids lie one after the other in ``ids``."""
        k, held = self.count, int(self.first[self.count])
        if held + ids.size > self.pool.size:
            self.pool = np.concatenate([self.pool[:held], np.zeros(held + 2 * ids.size, np.uint32)])
        self.pool[held : held + ids.size] = ids
        self.first[k + 1 : k + 1 + hashes.size] = held + np.cumsum(lengths)
        at, live = (hashes & self.mask).astype(np.int64), np.arange(hashes.size)
        while live.size:
            free = live[self.keys[at[live]] == 0]
            self.keys[at[free]] = hashes[free]
            won = free[self.keys[at[free]] == hashes[free]]  # of two that met on one place, one
            self.numbers[at[won]] = k + won
            live = np.setdiff1d(live, won, assume_unique=True)
            at[live] = (at[live] + 1) & int(self.mask)
        self.count = k + hashes.size


class ChunkIds:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table, self.powers = Table(WORDS), Shingler(1)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of texts encoded one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([len(f) for f in found], np.int64), np.array([i for f in found for i in f], np.uint32)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words that are one pre-token each."""
        found = self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False)
        number = np.array(found.word_ids, np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [number.size]])
        if cuts.size != len(words) + 1:  # they aren't
            return self._each([w.decode() for w in words])
        return np.diff(cuts), np.array(found.ids, np.uint32)

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self._sums(raw) if sums is None else sums
        return np.maximum(mix((sums[ends] - sums[starts]) * self.powers.inverse[starts]), _U(1))

    def _sums(self, raw: np.ndarray) -> np.ndarray:
        if raw.size + 1 > self.powers.power.size:
            self.powers._grow(raw.size + 1)
        sums = np.zeros(raw.size + 1, np.uint64)
        np.cumsum(_BYTES[raw] * self.powers.power[: raw.size], out=sums[1:])
        return sums

    def _window(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        edges = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8), prepend=1))
        starts, ends = edges[::2], edges[1::2]
        second = np.zeros(raw.size, bool)  # of the two bytes of a letter from À to ÿ
        second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        low = _LOWER[raw]
        low[second & (raw <= 0x9E)] += 0x20
        letter = _ALPHA[raw] | second
        letter[:-1] |= second[1:]
        last = np.maximum.accumulate(np.where(_TAIL[raw], -1, np.arange(raw.size)))
        middles = np.maximum(last[ends - 1] + 1, starts)  # a word ends, its punctuation begins
        others = np.concatenate([[0], np.cumsum(~letter)])
        plain = (others[middles] == others[starts]) & (middles > starts)
        sums = self._sums(low)
        # entries in order: a chunk's word and its punctuation, or the whole of another chunk
        is_odd, tailed = np.flatnonzero(~plain), np.flatnonzero(plain & (ends > middles))
        hashes = np.zeros((starts.size, 2), np.uint64)
        hashes[:, 0] = self._hashes(low, starts, middles, sums)
        hashes[tailed, 1] = mix(self._hashes(low, middles[tailed], ends[tailed], sums))
        if is_odd.size:
            odd = [joined[a:b] for a, b in zip(starts[is_odd].tolist(), ends[is_odd].tolist(), strict=True)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in odd])])
            hashes[is_odd, 0] = mix(mix(self._hashes(np.frombuffer(b"".join(odd), np.uint8), at[:-1], at[1:])))
        flat = hashes.reshape(-1)
        used = np.flatnonzero(flat)
        numbers = np.full(flat.size, -1, np.int64)
        numbers[used] = self.table.find(flat[used])
        missing = used[numbers[used] < 0]
        if missing.size:
            new, place = np.unique(flat[missing], return_index=True)
            if self.table.count + new.size > self.table.most:
                new, place = np.unique(flat[used], return_index=True)
                missing = used
                self.table.clear(max(WORDS, new.size))
            chunk, kind = np.divmod(missing[place], 2)
            self._learn(joined, low.tobytes(), new, chunk, np.where(kind == 1, 2, np.where(plain[chunk], 0, 1)), starts, middles, ends)
            numbers[used] = self.table.find(flat[used])
        first, known = self.table.first, np.maximum(numbers, 0)
        lengths = np.where(numbers >= 0, first[known + 1] - first[known], 0)
        after = np.cumsum(lengths)
        ids = self.table.pool[np.repeat(first[known] - (after - lengths), lengths) + np.arange(int(after[-1]) if after.size else 0)]
        chunk_of = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        cuts = (4 * np.concatenate([[0], after])[2 * chunk_of]).tolist()
        out = ids.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, joined: bytes, low: bytes, hashes: np.ndarray, chunk: np.ndarray, kind: np.ndarray, starts: np.ndarray, middles: np.ndarray, ends: np.ndarray) -> None:
        """Ask for new entries by kind: 0 a plain word, 1 another whole chunk, 2 punctuation behind a word."""
        for k, begin, end in ((0, starts, middles), (1, starts, ends), (2, middles, ends)):
            own = np.flatnonzero(kind == k)
            if own.size:
                source = joined if k == 1 else low
                words = [source[a:b] for a, b in zip(begin[chunk[own]].tolist(), end[chunk[own]].tolist(), strict=True)]
                self.table.add(hashes[own], *(self._each([w.decode("utf-8", "replace") for w in words]) if k else self._words(words)))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each whole UTF-8 text, as bytes."""
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            if size + len(text) > WINDOW:
                out += self._window(held) if held else []
                held, size = [], 0
            if len(text) > WINDOW:
                out.append(b"".join(ids for part in _parts(text) for ids in self._window([part])))
                continue
            held.append(text)
            size += len(text)
        return out + self._window(held) if held else out


def _parts(text: bytes):
    """A long text, cut at white space into parts of about WINDOW bytes."""
    start = 0
    while start < len(text):
        end = min(start + WINDOW, len(text))
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        yield text[start:end]
        start = end


_LOADED: dict[str, ChunkIds] = {}


def loaded(name: str = DEFAULT_VOCABULARY) -> ChunkIds:
    """The table of this Python worker: made once, kept while the worker is reused."""
    if name not in _LOADED:
        _LOADED[name] = ChunkIds(vocabulary_path(name))
    return _LOADED[name]
