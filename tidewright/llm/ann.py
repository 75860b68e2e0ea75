"""Approximate nearest neighbours (operator 4).

Method: score-aware anisotropic quantisation. The smallest distance is the largest inner product
q.x - |x|^2 / 2. Vectors are product-quantised in pairs of dimensions with 16 centroids each, four
bits a pair. The loss of a residual r of x weighs its part along x more than the rest,

    |r|^2 + (weight - 1) * (r.x)^2 / |x|^2,

because the part along x is what changes large inner products; codes are chosen by coordinate descent
on it, and centroids solve its normal equations. A query becomes tables of 16 small integers for each
pair of dimensions; scanning adds table entries, and a block's best are reranked at once by the exact
distance on the original vectors. Then every other row of the block that could still be among the best is
reranked too: the residual's length bounds what its inner product hides (|q.r| <= |q||r|), the rows that
this bound leaves are narrowed by a matrix product, and theirs are exact distances as well. So no row is
lost to its codes, and groups of equal vectors and of near copies keep their true neighbours.

Codebooks are fitted on a bounded sample (``Settings.sample``), every row is indexed. Queries go in
blocks of bounded size to all tasks; each task keeps ten results a query, so that little is shuffled.
Within a block of rows equal table sums are ordered by id.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part. Repeated rows of one id count once (the nearest). Ties go to the smaller id.
With fewer candidates than asked for, all are returned; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import materialise, shared_dir
from tidewright.llm.sampling import first_by_hash, hashed_id


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    threshold: float = 0.2
    lloyd: int = 8
    rounds: int = 3
    query_block: int = 8_192
    #: Of each block of rows, this share and at least this many are reranked first; they set the bound for the others.
    rerank_share: float = 0.02
    rerank_least: int = 100


CENTROIDS, WIDTH = 16, 2


@dataclass(frozen=True)
class Codebook:
    """centroids[pair, centroid, 2]; ``weight`` is the loss factor of the residual's part along the vector."""

    centroids: np.ndarray
    dimensions: int
    weight: float

    @property
    def pairs(self) -> int:
        return len(self.centroids)

    def split(self, x: np.ndarray) -> np.ndarray:
        """[row, pair, 2], the last pair filled up with zero."""
        if x.shape[1] < self.pairs * WIDTH:
            x = np.pad(x, ((0, 0), (0, self.pairs * WIDTH - x.shape[1])))
        return x.reshape(len(x), self.pairs, WIDTH)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes [row, pair] by coordinate descent on the anisotropic loss."""
        parts = self.split(x.astype(np.float64))
        codes = np.empty(parts.shape[:2], np.uint8)
        along = np.empty(parts.shape[:2])  # r.x of each pair
        for m in range(self.pairs):
            codes[:, m] = self._plain(parts[:, m], self.centroids[m])
            along[:, m] = ((parts[:, m] - self.centroids[m][codes[:, m]]) * parts[:, m]).sum(-1)
        total, norm = along.sum(-1), np.maximum((parts**2).sum((1, 2)), 1e-30)
        for _ in range(sweeps):
            for m in range(self.pairs):
                p, c = parts[:, m], self.centroids[m]
                r = p[:, None, :] - c[None]
                dot = (r * p[:, None, :]).sum(-1)
                loss = (r**2).sum(-1) + (self.weight - 1) * ((total - along[:, m])[:, None] + dot) ** 2 / norm[:, None]
                codes[:, m] = loss.argmin(1)
                picked = np.take_along_axis(dot, codes[:, m : m + 1].astype(np.int64), 1)[:, 0]
                total += picked - along[:, m]
                along[:, m] = picked
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The centroids of codes, [row, pair, 2]."""
        return self.centroids[np.arange(self.pairs), codes]

    @staticmethod
    def _plain(p: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((p[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)


def fit(x: np.ndarray, settings: Settings = Settings()) -> Codebook:
    """Codebooks of a sample, [row, dimension]."""
    n, d = x.shape
    x = x.astype(np.float64)
    pairs = -(-d // WIDTH)
    weight = max(1.0, (d - 1) * settings.threshold**2 / (1 - settings.threshold**2))
    rng = np.random.default_rng(3)
    book = Codebook(np.zeros((pairs, CENTROIDS, WIDTH)), d, weight)
    parts = book.split(x)
    for m in range(pairs):
        c = parts[rng.choice(n, CENTROIDS, replace=n < CENTROIDS), m].copy()
        for _ in range(settings.lloyd):
            code = Codebook._plain(parts[:, m], c)
            for k in np.unique(code):
                c[k] = parts[code == k, m].mean(0)
        book.centroids[m] = c
    norm = np.maximum((x**2).sum(1), 1e-30)
    for _ in range(settings.rounds):
        codes = book.encode(x)
        along = np.stack([((parts[:, m] - book.centroids[m][codes[:, m]]) * parts[:, m]).sum(-1) for m in range(pairs)], 1)
        total = along.sum(1)
        for m in range(pairs):
            p = parts[:, m]
            lean = (weight - 1) / norm
            for k in np.unique(codes[:, m]):
                at = codes[:, m] == k
                q, l = p[at], lean[at]
                left = at.sum() * np.eye(WIDTH) + (q * l[:, None]).T @ q
                right = q.sum(0) + (q * (l * ((total - along[:, m])[at] + (q**2).sum(1)))[:, None]).sum(0)
                book.centroids[m][k] = np.linalg.solve(left, right)
            new = ((p - book.centroids[m][codes[:, m]]) * p).sum(-1)
            total += new - along[:, m]
            along[:, m] = new
    return book


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpacked(raw: np.ndarray, pairs: int) -> np.ndarray:
    out = np.empty((len(raw), raw.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = raw & 15, raw >> 4
    return out[:, :pairs]


def query_tables(book: Codebook, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer tables [pair, query, 16] that grow with -q.x, each query's scale, and its -q.x where all entries are 0."""
    parts = book.split(queries.astype(np.float64))
    value = -np.einsum("qmw,mcw->mqc", parts, book.centroids)
    base = value.min(axis=2).sum(axis=0)
    value -= value.min(axis=2, keepdims=True)
    top = max(1, min(255, 60_000 // book.pairs))
    scale = top / np.maximum(value.max(axis=(0, 2)), 1e-30)
    return np.rint(value * scale[None, :, None]).astype(np.uint8), scale, base


class Nearest:
    """The best ``k`` of each query so far: distances and ids, in order."""

    def __init__(self, n: int, k: int):
        self.distance = np.full((n, k), np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def merge(self, at: slice, distance: np.ndarray, ids: np.ndarray) -> None:
        d = np.concatenate([self.distance[at], distance], 1)
        i = np.concatenate([self.ids[at], ids], 1)
        order = np.lexsort((i, d), axis=1)[:, : self.distance.shape[1]]
        self.distance[at], self.ids[at] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


def best_of_pairs(q: np.ndarray, ids: np.ndarray, distance: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids [n, k] of each query's best among (query, id, distance), filled up with infinity."""
    order = np.lexsort((ids, distance, q))
    q, ids, distance = q[order], ids[order], distance[order]
    rank = np.arange(q.size) - np.searchsorted(q, q)
    out = Nearest(n, k)
    first = (rank < k) & np.isfinite(distance)
    out.distance[q[first], rank[first]], out.ids[q[first], rank[first]] = distance[first], ids[first]
    return out.distance, out.ids


def scan_block(near: Nearest, book: Codebook, tables: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, settings: Settings, step: int = 128, chunk: int = 65_536) -> None:
    """Table scan of one block of rows (ids ascending) for all queries, then exact distances of each query's best
    and of all further rows that the scan doesn't rule out."""
    entries, scale, base = tables
    n, k = len(ids), near.ids.shape[1]
    wide = vectors.astype(np.float64)
    square = (wide**2).sum(1)
    least = square.min() / 2
    half = square / 2 - least
    hidden = np.sqrt(((book.split(wide) - book.decode(codes)) ** 2).sum((1, 2)))
    rounding = book.pairs / 2 + 1  # of a table sum, half a step an entry and for the length
    columns = [np.ascontiguousarray(codes[:, m]) for m in range(book.pairs)]
    keep = min(n, max(settings.rerank_least, k + 1, int(n * settings.rerank_share)))
    place = np.arange(n, dtype=np.int64)
    for start in range(0, len(queries), step):
        at = slice(start, min(len(queries), start + step))
        asked = queries[at].astype(np.float64)
        total = np.zeros((at.stop - start, n), np.int64)
        small = np.zeros((at.stop - start, n), np.uint16)
        for m, code in enumerate(columns):
            small += np.take(entries[m, at], code, axis=1)
        total += small
        if half.max() * scale[at].max() >= 0.5:
            total += np.rint(np.minimum(half[None, :] * scale[at, None], 1e9)).astype(np.int64)
        key = total * n + place[None, :]  # equal sums: the smaller id first
        own = query_ids[at, None] == ids[None, :]
        key[own] = np.iinfo(np.int64).max
        best = np.argpartition(key, keep - 1, axis=1)[:, :keep] if keep < n else np.broadcast_to(place, key.shape)
        distance = np.sqrt(((wide[best] - asked[:, None, :]) ** 2).sum(-1))
        found = ids[best]
        distance[np.take_along_axis(own, best, 1)] = np.inf
        found = np.where(np.isinf(distance), np.iinfo(np.int64).max, found)
        near.merge(at, distance, found)
        if keep == n:
            continue
        # half of the squared distance is |q|^2/2 + |x|^2/2 - q.c - q.r for the centroids c and the residual r
        size = (asked**2).sum(1)
        cut = near.distance[at, -1] ** 2 / 2
        bound = (total - rounding) / scale[at, None] + (base[at] + size / 2 + least)[:, None] - np.sqrt(size)[:, None] * hidden[None, :]
        rest = ~(bound > cut[:, None] + 1e-9 * (size[:, None] + square[None, :])) & ~own
        np.put_along_axis(rest, best, False, 1)
        open_rows = np.flatnonzero(rest.any(axis=0))
        if not open_rows.size:
            continue
        close = (size[:, None] + square[None, open_rows]) / 2 - asked @ wide[open_rows].T
        q, j = np.nonzero(rest[:, open_rows] & ~(close > cut[:, None] + 1e-11 * (size[:, None] + square[None, open_rows])))
        j = open_rows[j]
        distance = np.empty(q.size)
        for s in range(0, q.size, chunk):
            distance[s : s + chunk] = np.sqrt(((wide[j[s : s + chunk]] - asked[q[s : s + chunk]]) ** 2).sum(-1))
        if q.size:
            near.merge(at, *best_of_pairs(q, ids[j], distance, at.stop - start, k))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows that take part as (vec_id, embedding), and their number of dimensions (0: no rows)."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists(e, lambda v: v != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = 0 if sizes is None else sizes["d"]
    return rows.where(F.size("embedding") == d), d


def build_index(rows: DataFrame, book: Codebook) -> DataFrame:
    """(vec_id, code, vector) of every row, written to the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(book)
    double = isinstance(rows.schema["embedding"].dataType.elementType, T.DoubleType)
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, book.dimensions)
                code = packed(book.encode(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "code", "vector"])

    element = "double" if double else "float"
    return materialise(rows.withColumn("embedding", F.col("embedding").cast(f"array<{element}>")).mapInArrow(run, "vec_id long, code binary, vector binary"), "ann-index")


def search(vectors: DataFrame, k: int = 10, every: int = 100, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the ``k`` nearest found for rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows, d = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], schema)
    cut = first_by_hash(rows, settings.sample, "vec_id")
    sample = rows.where(hashed_id("vec_id") <= cut).limit(settings.sample).select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in sorted(sample, key=lambda r: (r["vec_id"], r["embedding"]))])
    book = fit(x, settings)
    index = build_index(rows, book)
    kind = np.float64 if isinstance(rows.schema["embedding"].dataType.elementType, T.DoubleType) else np.float32
    asked = index.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-asked.count() // settings.query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))

    def found_by(block: int) -> DataFrame:
        got = sorted((r["vec_id"], bytes(r["vector"])) for r in asked.where(F.col("block") == block).select("vec_id", "vector").collect())
        ids = np.array([g[0] for g in got], np.int64)
        queries = np.frombuffer(b"".join(g[1] for g in got), kind).reshape(-1, d)
        shared = spark.sparkContext.broadcast((book, ids, queries))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book, query_ids, queries = shared.value
            tables = query_tables(book, queries)
            near = Nearest(len(queries), k)
            for batch in batches:
                if not batch.num_rows or not len(queries):
                    continue
                _, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # ascending; an id once a block
                ids = batch.column(0).to_numpy()[first]
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)[first]
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(batch.num_rows, -1)[first]
                scan_block(near, book, tables, queries, query_ids, ids, unpacked(raw, book.pairs), x, settings)
            q, j = np.nonzero(np.isfinite(near.distance))
            if q.size:
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(near.ids[q, j]), pa.array(near.distance[q, j])], ["query_id", "vec_id", "score"])

        return index.mapInArrow(run, "query_id long, vec_id long, score double")

    if n_blocks == 1:
        found = found_by(0)
    else:
        path = shared_dir(spark, "ann-found")
        for block in range(n_blocks):
            found_by(block).write.mode("append").parquet(path)
        found = spark.read.parquet(path)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
