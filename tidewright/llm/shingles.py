"""Word shingles of texts as 64-bit hashes, vectorised over a slice of documents.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return, with A-Z in lower case. A word's hash is a polynomial over its bytes, cut out of prefix sums
over the whole slice; a shingle's hash mixes those of its words in order. A text with fewer words than
the width has its whole sequence as one shingle; one without words has none.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64."""
    out, step = np.ones(1, np.uint64), base
    while out.size < n:
        out = np.concatenate([out, out * _U(step)])
        step = step * step % (1 << 64)
    return out[:n]


class Shingler:
    def __init__(self, width: int):
        self.width = width
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        n = 1 << (n - 1).bit_length()
        self.power, self.inverse = powers(_BASE, n), powers(_INVERSE, n)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        if raw.size + 1 > self.power.size:
            self._grow(raw.size + 1)
        space = _SPACE[raw]
        edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(raw.size + 1, np.uint64)
        np.cumsum(_BYTES[raw] * self.power[: raw.size], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * self.inverse[starts])
        after = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(starts, np.concatenate([[0], after]))
        rolled, k = words.copy(), self.width
        for j in range(1, k):
            rolled = mix(rolled[: rolled.size - 1] * _U(0xD6E8FEB86659FD93) + words[j:]) if rolled.size > 1 else rolled[:0]
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for w in range(a, b):
                    whole = mix(whole * _U(0xA0761D6478BD642F) + words[w : w + 1])
                out.append(whole)
            else:
                out.append(words[:0])
        return out
