"""Language of texts (operator 6).

Method: segmentation-marginalised unigrams. Every language has a probability for each piece of one
fixed public vocabulary. A word's probability is the sum over all its segmentations into pieces, by
the forward algorithm; a text's is the product over its words (runs of letters in lower case, with the
vocabulary's word-begin mark). The piece probabilities come from expectation maximisation on word
counts of a bounded sample: each round shares a word's count over its segmentations (forward-backward).

A character that is no piece counts as one piece of a small probability that is equal in all
languages. Words of more than 40 characters are scored position by position with scaling. A worker keeps the log
probabilities of distinct words in a bounded cache.

Defined results: null texts and texts without a letter are ``und`` with score 0. Without training rows
every text is ``und``. Ties go to the language that sorts first. Score is the language's posterior,
with languages equally likely beforehand. Repeated rows get equal results; columns other than the
named ones are ignored. Very long texts are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import sampling
from tidewright.llm.common import fold, materialise, text_columns
from tidewright.llm.shingles import _BASE, _INVERSE, mix, powers
from tidewright.llm.token_ids import Table

DEFAULT_PIECES = "piece_bpe_32k.model"
UNKNOWN = 1e-7
LONGEST_WORD = 40
CACHE_WORDS = 300_000
_U = np.uint64
#: Runs of letters, of the Unicode categories L.
words_of = regex.compile(r"\p{L}+").findall


@dataclass(frozen=True)
class Settings:
    rows_per_language: int = 500
    rounds: int = 3
    smoothing: float = 0.02


def vocabulary(name: str = DEFAULT_PIECES) -> dict[str, int]:
    """Pieces of the public vocabulary that hold letters only (besides the word-begin mark)."""
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    out: dict[str, int] = {}
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i)) and piece.removeprefix("▁").isalpha() | (piece == "▁") and piece == piece.lower():
            out.setdefault(piece, len(out))
    return out


class Index:
    """Finds the pieces among all stretches of words by their 64-bit hashes, as array operations."""

    def __init__(self, pieces: dict[str, int]):
        self.longest, self.unknown = max(map(len, pieces)), len(pieces)
        self.table = Table(len(pieces))
        order = sorted(pieces, key=pieces.__getitem__)  # entry k of the table is piece k
        hashes = np.empty(len(order), np.uint64)
        sizes = np.array([len(x) for x in order])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            hashes[at] = self._sums([order[i] for i in at])[:, n]
        self.table.add(mix(hashes), np.ones(len(order), np.int64), np.arange(len(order), dtype=np.uint32))

    @staticmethod
    def _sums(words: list[str]) -> np.ndarray:
        """Sums [word, position] of mixed characters times powers, for words of one length."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
        out = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * powers(_BASE, n), axis=1, out=out[:, 1:])
        return out

    def lattice(self, words: list[str], at_once: int = 4096) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, end) -> words and pieces that lie there, for words of one length; every character has a piece, the last id at least."""
        n = len(words[0])
        spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + self.longest) + 1)]
        start, end = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
        shift, parts = powers(_INVERSE, n)[start], []
        for k in range(0, len(words), at_once):
            sums = self._sums(words[k : k + at_once])
            hashes = mix((sums[:, end] - sums[:, start]) * shift)
            parts.append(self.table.find(hashes.reshape(-1)).astype(np.int32).reshape(hashes.shape))
        found = np.concatenate(parts).T.copy()
        found[(end == start + 1)[:, None] & (found < 0)] = self.unknown
        out = {}
        for span, pieces in zip(spans, found, strict=True):
            k = np.flatnonzero(pieces >= 0)
            if k.size:
                out[span] = k, pieces[k]
        return out


def forward(words: list[str], edges: dict, prob: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]; words of up to LONGEST_WORD + 1 characters don't underflow."""
    alpha = np.zeros((max(map(len, words)) + 1, len(words), prob.shape[1]))
    alpha[0] = 1.0
    for (i, j), (k, p) in sorted(edges.items(), key=lambda e: e[0][1]):
        alpha[j, k] += alpha[i, k] * prob[p]
    return alpha


def scaled(word: str, pieces: dict[str, int], longest: int, prob: np.ndarray) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Forward algorithm over a word of any length, at each position j: its pieces as (length, id), the sum over the
    segmentations that end there relative to the position before, and each piece's share of it."""
    recent = [np.ones(prob.shape[1])]  # alpha of the last positions, latest first, in units of the latest
    for j in range(1, len(word) + 1):
        ends = []
        for n in range(1, min(j, longest) + 1):
            p = pieces.get(word[j - n : j], len(pieces) if n == 1 else None)
            if p is not None:
                ends.append((n, p))
        terms = np.stack([recent[n - 1] * prob[p] for n, p in ends])
        step = terms.sum(axis=0)
        yield ends, step, terms / step
        recent = [np.ones(prob.shape[1])] + [a / step for a in recent[: longest - 1]]


def add_expected(expected: np.ndarray, word: str, weight: np.ndarray, pieces: dict[str, int], longest: int, prob: np.ndarray) -> None:
    """Adds a long word's count of each piece: from the end, a position's weight is shared over the pieces that end there."""
    steps = [(ends, shares) for ends, _, shares in scaled(word, pieces, longest, prob)]
    mass = [weight]  # of positions j, j - 1, ...
    for ends, shares in reversed(steps):
        here = mass.pop(0)
        for (n, p), share in zip(ends, shares, strict=True):
            while len(mass) < n:
                mass.append(np.zeros_like(weight))
            mass[n - 1] = mass[n - 1] + here * share
            expected[p] += here * share


def word_scores(words: list[str], pieces: dict[str, int], index: Index, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        group = ["▁" + words[i] for i in at]
        if n > LONGEST_WORD:
            for i, word in zip(at, group, strict=True):
                for _, step, _ in scaled(word, pieces, index.longest, prob):
                    out[i] += np.log(step)
            continue
        alpha = forward(group, index.lattice(group), prob)
        out[at] = np.log(alpha[n + 1])
    return out


def expectation_maximisation(counts: dict[str, Counter], pieces: dict[str, int], settings: Settings) -> tuple[list[str], np.ndarray]:
    """Languages and prob[piece, language], from word counts of each language."""
    languages = sorted(counts)
    index = Index(pieces)
    longest = index.longest
    words = sorted({"▁" + w for c in counts.values() for w in c})
    slot = {w: k for k, w in enumerate(words)}
    weight = np.zeros((len(words), len(languages)))
    for l, name in enumerate(languages):
        for w, n in counts[name].items():
            weight[slot["▁" + w], l] += n
    sizes = np.array([len(w) for w in words])
    groups = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        group = [words[i] for i in at]
        groups.append((n, at, group, index.lattice(group) if n <= LONGEST_WORD + 1 else None))
    v = len(pieces)
    # start: longer pieces are likelier than the product of their characters
    prob = np.full((v + 1, len(languages)), 1.0 / v)
    prob[v] = UNKNOWN
    for _ in range(settings.rounds):
        expected = np.zeros((v + 1, len(languages)))
        for n, at, group, edges in groups:
            if edges is None:
                for i, word in zip(at, group, strict=True):
                    add_expected(expected, word, weight[i], pieces, longest, prob)
                continue
            alpha = forward(group, edges, prob)
            beta = np.zeros_like(alpha)
            beta[n] = 1.0
            for (i, j), (k, p) in sorted(edges.items(), key=lambda e: -e[0][0]):
                beta[i, k] += beta[j, k] * prob[p]
            share = weight[at] / alpha[n]
            for (i, j), (k, p) in edges.items():
                np.add.at(expected, p, alpha[i, k] * prob[p] * beta[j, k] * share[k])
        total = expected[:v] + settings.smoothing
        prob[:v] = total / total.sum(axis=0)
    return languages, prob


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: dict[str, int]
    prob: np.ndarray


def train(texts: list[tuple[str, str]], settings: Settings = Settings(), pieces_name: str = DEFAULT_PIECES) -> Model:
    """From (language, text) pairs."""
    counts: dict[str, Counter] = {}
    for language, text in texts:
        counts.setdefault(language, Counter()).update(words_of(text.lower()))
    counts = {k: c for k, c in counts.items() if c}
    pieces = vocabulary(pieces_name)
    if not counts:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    return Model(*(lambda got: (got[0], pieces, got[1]))(expectation_maximisation(counts, pieces, settings)))


def fit(docs: DataFrame, settings: Settings = Settings(), pieces_name: str = DEFAULT_PIECES) -> Model:
    """Train on a bounded sample of rows with a language, a hash's first of each (the caller leaves out held-out rows)."""
    known = docs.where("lang is not null").select("lang", sampling.hashed_id().alias("h"))
    # first which of 4,096 ranges of hashes hold a language's first rows, so that no task gets all rows of one
    part, order = F.shiftright("h", 52), Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = known.groupBy("lang", part.alias("part")).agg(F.count("*").alias("n"))
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < settings.rows_per_language)
    reach = materialise(counted.groupBy("lang").agg(F.max("part").alias("last")), "language-ranges")
    near = known.join(reach, "lang").where(part <= F.col("last")).select("lang", "h")
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= settings.rows_per_language)
    bounds = materialise(first.groupBy("lang").agg(F.max("h").alias("cut"), F.max("nth").alias("nth")), "language-cuts")
    rows = docs.select("lang", "text", "doc_id").join(bounds, "lang").where(sampling.hashed_id() <= F.col("cut")).where("text is not null")
    # rows that tie with the last one beyond the bound are left out again
    sample = rows.select("lang", "text").limit(bounds.agg(F.sum("nth")).first()[0] or 0).collect()
    return train(sorted((r["lang"], r["text"]) for r in sample), settings, pieces_name)


class Scorer(dict):
    """Cache from a word to its row of log probabilities."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.index = model, Index(model.pieces)
        self.rows = np.zeros((CACHE_WORDS, len(model.languages)))

    def add(self, words: set[str]) -> None:
        missing = list(words - self.keys())
        if not missing:
            return
        if len(self) + len(missing) > len(self.rows):
            self.clear()
            missing = list(words)
        scores = word_scores(missing, self.model.pieces, self.index, self.model.prob)
        first = len(self)
        if len(missing) > len(self.rows):
            self.rows = np.zeros((len(missing), self.rows.shape[1]))
        self.rows[first : first + len(missing)] = scores
        self.update(zip(missing, range(first, first + len(missing)), strict=True))

    def best(self, texts: list[str]) -> list[tuple[str, float]]:
        words = [words_of(t.lower()) for t in texts]
        if not self.model.languages:
            return [("und", 0.0)] * len(texts)
        self.add(set().union(*words))
        out = []
        for own in words:
            if not own:
                out.append(("und", 0.0))
                continue
            z = self.rows[np.fromiter(map(self.__getitem__, own), np.int64, len(own))].sum(axis=0)
            k = int(np.argmax(z))
            out.append((self.model.languages[k], float(1 / np.exp(z - z[k]).sum())))
        return out


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Language and score of every whole text as the columns ``names``, beside the columns ``keep`` (doc_id)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup() -> Callable[[list[bytes]], list[pa.Array]]:
        scorer = Scorer(shared.value)

        def each(texts: list[bytes]) -> list[pa.Array]:
            found = scorer.best([t.decode("utf-8", "replace") for t in texts])
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return each

    return text_columns(docs, f"{names[0]} string, {names[1]} double", setup, keep or ["doc_id"], 2_000_000)


def held_out_predictions(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Languages of all documents by a model that never saw fold 1 of 3."""
    found = predict(docs, fit(docs.where(fold("doc_id", 3) != 1), settings))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
