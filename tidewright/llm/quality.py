"""Quality scores (operator 8).

Method: naive Bayes support vectors. A text is the set of its byte n-grams (one to three bytes,
three-byte ones hashed) and of marks for repeated word pairs. Each indicator is scaled by the
log-count ratio of its n-gram between the classes; on these, scaled to length one, a linear hinge-loss
model is fitted by dual coordinate descent. Its margin becomes a probability through a logistic curve
fitted to margins of cross-validation.

The model is trained on the driver from a bounded sample of labelled rows, chosen by a hash of the id;
its weights are one array of fixed size. Scoring is one pass without a shuffle.

Defined results: null and empty texts get the score of a text without n-grams. With one class or no
labels at all every score is the share of good rows (0.5 without rows). Repeated rows get equal
scores; very long texts are scored whole; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import sampling
from tidewright.llm.common import fold, text_columns

HASHED = 1 << 18
#: Shares of adjacent equal words from which a mark is set.
REPEATS = (0.02, 0.05, 0.1, 0.2, 0.4)
PAIRS_AT, TRIPLES_AT = 256, 256 + 65_536
MARKS_AT = TRIPLES_AT + HASHED
DIMENSIONS = MARKS_AT + len(REPEATS)


@dataclass(frozen=True)
class Settings:
    rows: int = 4_000
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    folds: int = 3


class NGrams:
    """The indices of a text's n-grams; keeps one array of flags to find distinct ones without sorting."""

    def __init__(self) -> None:
        self.flags = np.zeros(DIMENSIONS, bool)

    def __call__(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        flags, raw = self.flags, np.frombuffer(text, np.uint8)
        flags[raw] = True
        if raw.size > 1:
            pair = raw[:-1].astype(np.uint32) << 8 | raw[1:]
            flags[PAIRS_AT + pair] = True
            triple = (pair[:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(14)
            flags[TRIPLES_AT + triple] = True
        words = text.split()
        if len(words) > 1:
            share = sum(map(eq, words, words[1:])) / (len(words) - 1)
            for k, least in enumerate(REPEATS):
                if share >= least:
                    flags[MARKS_AT + k] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        return found


@dataclass(frozen=True)
class Model:
    """Margin: sum of ``weights`` over the n-grams, over the root of the sum of ``squares``, plus ``bias``."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.shift, -60, 60))))

    def margin(self, grams: np.ndarray) -> float:
        length = np.sqrt(self.squares[grams].sum()) if grams.size else 0.0
        return float(self.weights[grams].sum() / length + self.bias) if length else self.bias


def log_ratio(rows: list[np.ndarray], y: np.ndarray, smoothing: float) -> np.ndarray:
    """Naive Bayes log-count ratio of each n-gram: class 1 against class 0."""
    total = []
    for k in (1, 0):
        picked = [r for r, label in zip(rows, y, strict=True) if label == k]
        count = smoothing + np.bincount(np.concatenate(picked), minlength=DIMENSIONS)
        total.append(np.log(count / count.sum()))
    return total[0] - total[1]


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model by dual coordinate descent; the bias is one more constant feature."""
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _linear(rows: list[np.ndarray], y: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    ratio = log_ratio(rows, y, settings.smoothing)
    values = []
    for r in rows:
        length = np.sqrt((ratio[r] ** 2).sum())
        values.append(ratio[r] / length if length else np.zeros(r.size))
    share = y.mean()
    cost = np.where(y == 1, settings.cost * 0.5 / share, settings.cost * 0.5 / (1 - share))
    w, bias = dual_descent(rows, values, 2.0 * y - 1, cost, settings.epochs)
    return w * ratio, ratio**2, bias


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve for margins ``z`` (Newton's steps with a small ridge)."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g = x.T @ (p - y) + 1e-3 * np.array([a, b])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(max(a, 0.0)), float(b)


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    grams, y = NGrams(), np.array(labels, dtype=np.int64)
    rows = [grams(t.encode("utf-8", "replace")) for t in texts]
    if len(set(labels)) < 2:
        share = min(max(y.mean() if y.size else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0, float(np.log(share / (1 - share))))
    weights, squares, bias = _linear(rows, y, settings)
    part, margins = np.arange(y.size) % settings.folds, np.zeros(y.size)
    for k in range(settings.folds):
        inside = np.flatnonzero(part != k)
        if len(set(y[inside])) < 2:
            inside = np.arange(y.size)
        w, s, b = _linear([rows[i] for i in inside], y[inside], settings)
        fitted = Model(w, s, b, 1.0, 0.0)
        for i in np.flatnonzero(part == k):
            margins[i] = fitted.margin(rows[i])
    slope, shift = _logistic(margins, y)
    return Model(weights.astype(np.float32), squares.astype(np.float32), bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:
    """Train on a bounded sample of labelled rows (the caller leaves out held-out rows)."""
    sample = sampling.labelled_texts(docs, labels, label, settings.rows)
    sample.sort()  # the order of rows that Spark returns doesn't matter
    order = np.random.default_rng(11).permutation(len(sample))
    return train([sample[i][0] for i in order], [sample[i][1] for i in order], settings)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The score of every whole text as the column ``name``, beside the columns ``keep`` (doc_id)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup() -> Callable[[list[bytes]], list[pa.Array]]:
        fitted, grams = shared.value, NGrams()
        return lambda texts: [pa.array([fitted.score(grams(t)) for t in texts], pa.float64())]

    return text_columns(docs, f"{name} double", setup, keep or ["doc_id"])


def held_out_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores of all documents by a model that never saw fold 0 of 5; predicted is 1 from 0.3 on."""
    train_docs, train_labels = docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0)
    scored = score(docs, fit(train_docs, train_labels, settings=settings))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
