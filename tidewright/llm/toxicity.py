"""Toxicity scores (operator 1).

Method: non-negative positive-unlabelled learning. The classifier sees confirmed toxic texts (P) and
texts without any label (U, which hold toxic ones in the share ``prior``). The risk of a linear
logistic model is estimated as

    prior * loss(P, +1) + max(0, loss(U, -1) - prior * loss(P, -1)),

and where the second term falls below zero its gradient is turned round. Features are indicators of
words (runs of letters in lower case) and of their beginnings of three to seven letters, as far as
they are markedly more frequent in P than in U; an L1 step after each update leaves few of them with a
weight.

Both samples are bounded by parameters and chosen by a hash of the id, so the model doesn't grow with
the table; it is trained on the driver and its words go to the tasks. Scoring is one pass without a
shuffle.

Defined results: null, empty and wordless texts get the score of a text without known words. Without
positive examples every score is 0. Very long texts are scored whole. Repeated rows get equal scores; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import sampling
from tidewright.llm.common import fold, text_columns

words_of = re.compile(r"[^\W\d_]+").findall
#: Lengths of word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    positives: int = 3_000
    unlabelled: int = 5_000
    least_documents: int = 4
    least_lift: float = 2.0
    steps: int = 300
    rate: float = 0.08
    l1: float = 2.5e-4


def features_of(text: str) -> set[str]:
    """Distinct words of a text and their beginnings; a beginning ends in ``*``."""
    words = set(words_of(text.lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: bytes) -> float:
        found = self.weights.keys() & features_of(text.decode("utf-8", "replace"))
        z = self.bias + sum(self.weights[w] for w in sorted(found))
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def frequent_features(texts: list[str], least: int) -> list[str]:
    """Features of at least ``least`` texts, sorted. A first pass counts hashes, so rare features are never held."""
    counts = np.zeros(1 << 22, np.int32)
    mask = counts.size - 1
    for t in texts:
        np.add.at(counts, np.fromiter((hash(w) & mask for w in features_of(t)), np.int64), 1)
    enough = (counts >= least).tobytes()
    exact: Counter = Counter()
    for t in texts:
        exact.update(w for w in features_of(t) if enough[hash(w) & mask])
    return sorted(w for w, c in exact.items() if c >= least)


def _rows(texts: list[str], slot: dict[str, int]) -> list[np.ndarray]:
    """The known features of each text as sorted numbers."""
    return [np.array(sorted(slot[w] for w in slot.keys() & features_of(t)), np.int32) for t in texts]


def _flat(rows: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat (feature, row) arrays of the features that have a place (not -1)."""
    cols = place[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [r.size for r in rows])
    return cols[cols >= 0], owner[cols >= 0]


Sample = tuple[np.ndarray, np.ndarray, int]


def risk(w: np.ndarray, positive: Sample, unlabelled: Sample, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two terms of the risk at weights ``w`` (the bias last), the second not yet cut off at zero, and their gradients.

    A sample has flat (feature, row) arrays and its number of rows. The loss is the logistic one.
    """

    def margins(sample: Sample) -> np.ndarray:
        return np.bincount(sample[1], weights=w[sample[0]], minlength=sample[2]) + w[-1]

    def back(sample: Sample, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(sample[0], weights=slope[sample[1]], minlength=w.size)[: w.size]
        g[-1] = slope.sum()
        return g

    zp, zu = margins(positive), margins(unlabelled)
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -60, 60))), 1 / (1 + np.exp(-np.clip(zu, -60, 60)))
    n_p, n_u = positive[2], unlabelled[2]
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_neg = back(unlabelled, su / n_u) - back(positive, prior * sp / n_p)
    return prior * np.logaddexp(0, -zp).mean(), negative, back(positive, prior * (sp - 1) / n_p), g_neg


def train(positive: list[str], unlabelled: list[str], prior: float, settings: Settings = Settings()) -> Model:
    """The model of confirmed toxic texts, unlabelled texts and the share of toxic ones among the latter."""
    if not positive or not unlabelled or prior <= 0:
        return Model({}, -1000.0)
    least = min(settings.least_documents, 1 + len(positive) // 4)
    names = frequent_features(positive, least)
    slot = {w: k for k, w in enumerate(names)}
    pos, unl = _rows(positive, slot), _rows(unlabelled, slot)
    in_p, in_u = (np.bincount(np.concatenate(r), minlength=len(names)) for r in (pos, unl))
    chosen = np.flatnonzero(in_p > settings.least_lift * len(pos) / len(unl) * in_u)
    vocabulary = [names[k] for k in chosen]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(chosen.size)
    (pc, pr), (uc, ur) = _flat(pos, place), _flat(unl, place)
    n_p, n_u, d = len(pos), len(unl), len(vocabulary)
    prior = min(prior, 0.9)
    w, b = np.zeros(d + 1), np.log(prior / (1 - prior))
    w[-1] = b
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    l1 = settings.l1 * np.sqrt(settings.positives / n_p)  # few examples: only strong words keep a weight
    for step in range(1, settings.steps + 1):
        _, negative, g_pos, g_neg = risk(w, (pc, pr, n_p), (uc, ur, n_u), prior)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = settings.rate * (1 - 0.9 * step / settings.steps)
        scale = np.sqrt(v / (1 - 0.999**step)) + 1e-8
        w -= rate * m / (1 - 0.9**step) / scale
        # soft threshold in the same metric as the step
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate * l1 / scale[:-1])
    return Model({word: float(x) for word, x in zip(vocabulary, w[:-1], strict=True) if x}, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Train on bounded samples of ``docs`` and ``labels`` (the caller leaves out held-out rows)."""
    known = labels.where(F.col(label).isNotNull())
    prior = known.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    ids = known.where(F.col(label) == 1).select("doc_id").distinct()
    cut = sampling.first_by_hash(ids, settings.positives)
    others = sampling.first_by_hash(docs, settings.unlabelled)
    if cut is None or others is None:
        return Model({}, -1000.0)
    chosen = F.broadcast(ids.where(sampling.hashed_id() <= cut).limit(settings.positives).withColumn("p", F.lit(True)))
    rows = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id", "left")
    rows = rows.select("text", F.coalesce("p", F.lit(False)).alias("p"), (sampling.hashed_id() <= others).alias("u")).where("p or u")
    sample = sorted(rows.limit(settings.positives + settings.unlabelled).collect())  # whatever order Spark returns them in
    return train([r["text"] for r in sample if r["p"]], [r["text"] for r in sample if r["u"]], prior, settings)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The score of every whole text as the column ``name``, beside the columns ``keep`` (doc_id)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup() -> Callable[[list[bytes]], list[pa.Array]]:
        one = shared.value.score
        return lambda texts: [pa.array([one(t) for t in texts], pa.float64())]

    return text_columns(docs, f"{name} double", setup, keep or ["doc_id"])


def held_out_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores of all documents by a model that never saw fold 0 of 5."""
    train_docs, train_labels = docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0)
    scored = score(docs, fit(train_docs, train_labels, settings=settings))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
