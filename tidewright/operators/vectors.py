"""Exact vector search and projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def top_k(rows: DataFrame, ident: str, vector: str, query: DataFrame, k: int) -> DataFrame:
    """(id, score): the ``k`` most similar rows to a one-row frame (column ``q``)."""
    scored = rows.crossJoin(F.broadcast(query.limit(1).select("q"))).select(F.col(ident).alias("id"), cosine(F.col(vector), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def _regular(vector: str, size: int) -> Column:
    """Vectors of ``size`` numbers whose products neither overflow nor vanish, or of zeros only."""
    v = F.col(vector)
    sane = F.forall(v, lambda x: x.isNotNull() & ((x == 0) | F.abs(x.cast("double")).between(1e-100, 1e100)))
    return F.coalesce((F.size(v) == size) & sane, F.lit(False))


def _best(names: np.ndarray, asked: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches (id, vector) that gives a task's ``k`` best rows (query_id, id, score) for each query.

    A product of matrices leaves the rows near the k-th or above; their scores add up in the order of :func:`dot`.
    """

    def length(m: np.ndarray) -> np.ndarray:
        total = np.zeros(len(m))
        for d in range(m.shape[1]):
            total += m[:, d] * m[:, d]
        return np.sqrt(total)

    def unit(m: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return m / np.where(norms > 0, norms, 1.0)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_norm = length(asked)
        q_unit = unit(asked, q_norm)
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            norm = length(rows)
            across = np.ascontiguousarray(unit(rows, norm).T)
            found = []
            for at in range(0, len(asked), 256):
                near = q_unit[at : at + 256] @ across
                least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(near), -np.inf)
                if held is not None:  # the k-th so far; -inf with fewer
                    least = np.maximum(least, held[at : at + 256])
                q, r = np.nonzero(near >= least[:, None] - 1e-9)
                q += at
                total = np.zeros(len(q))
                for d in range(rows.shape[1]):
                    total += rows[r, d] * asked[q, d]
                both = norm[r] * q_norm[q]
                found.append((q, ids[r], np.where(both > 0, total / np.where(both > 0, both, 1.0), 0.0)))
            if held is not None:
                found.append(best)  # noqa: F821
            q, i, score = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((i, -score, q))
            q, i, score = q[order], i[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            kept = place < k
            best = q[kept], i[kept], score[kept]
            held = np.full(len(asked), -np.inf)
            held[q[place == k - 1]] = score[place == k - 1]
        if held is not None:
            q, i, score = best
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(i), pa.array(score)], names=["query_id", "id", "score"])

    return run


def top_k_each(rows: DataFrame, ident: str, vector: str, queries: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank) for any number of queries (columns query_id, q), in blocks of about ``most`` by a hash.

    All rows count for every query. Vectors of the queries' largest size are compared as matrices; others, and
    those with missing, endless or extreme numbers, one by one.
    """
    about = queries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("size")).first()
    n_blocks, size = max(1, -(-about["n"] // most)), about["size"] or 0
    base = rows.select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    kinds, key = dict(base.dtypes), dict(queries.dtypes)["query_id"]
    numeric = {"tinyint", "smallint", "int", "bigint"}
    plain = size > 0 and kinds["id"] in numeric and key in numeric and kinds["v"] in ("array<float>", "array<double>")
    fit_rows = _regular("v", size) & F.col("id").isNotNull() if plain else F.lit(False)
    fit_queries = _regular("q", size) & F.col("query_id").isNotNull() if plain else F.lit(False)

    def one_by_one(base: DataFrame, asked: DataFrame) -> DataFrame:
        return base.crossJoin(F.broadcast(asked)).select("query_id", "id", cosine(F.col("v"), F.col("q")).alias("score"))

    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    asked = queries.select("query_id", "q", fit_queries.alias("fit"), block.alias("block"))
    odd_rows, odd_queries = bool(base.where(~fit_rows).limit(1).count()), bool(asked.where("not fit").limit(1).count())
    parts = []
    for b in range(n_blocks):
        of_block = asked.where(F.col("block") == b)
        regular = of_block.where("fit").select("query_id", "q").toArrow() if plain else None
        if regular is not None and regular.num_rows:
            names = regular.column(0).to_numpy()
            matrix = regular.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), size)
            parts.append(base.where(fit_rows).mapInArrow(_best(names, matrix, k), f"query_id {key}, id {kinds['id']}, score double"))
        if odd_queries:
            parts.append(one_by_one(base, of_block.where("not fit").select("query_id", "q")))
        if odd_rows:
            parts.append(one_by_one(base.where(~fit_rows), of_block.where("fit").select("query_id", "q")))
    found = reduce(DataFrame.unionByName, parts) if parts else one_by_one(base, asked.select("query_id", "q"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def pca_2d(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, x, y): the two main components, each axis scaled to at most 1; the sign makes the largest weight positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    base = rows.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), array_to_vector(F.col(vector)).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="mid", withMean=True, withStd=False).fit(base).transform(base)
    model = PCA(k=2, inputCol="mid", outputCol="pc").fit(centred)
    weights = model.pc.toArray()
    signs = [1.0 if weights[abs(weights[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    flat = model.transform(centred).select("id", vector_to_array("pc").alias("p")).select("id", (F.col("p")[0] * signs[0]).alias("x"), (F.col("p")[1] * signs[1]).alias("y"))
    top = flat.agg(F.max(F.abs("x")).alias("mx"), F.max(F.abs("y")).alias("my"))
    return flat.crossJoin(F.broadcast(top)).select("id", (F.col("x") / F.greatest("mx", F.lit(1e-12))).alias("x"), (F.col("y") / F.greatest("my", F.lit(1e-12))).alias("y"))


def hashing_embedder(text: Column, dimensions: int = 64) -> Column:
    """Signed token counts by hash, scaled to length one: an embedding that needs no model.

    Spark puts an expression's text wherever it is used, so each step stands in a lambda and is computed once.
    """

    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), then)[0]

    def counted(w: Column) -> Column:
        places = F.transform(w, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimensions)).alias("at"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
        return once(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(ps, F.lit(0.0), lambda s, p: s + F.when(p["at"] == d, p["v"]).otherwise(0.0))))

    def scaled(raw: Column) -> Column:
        return once(norm(raw), lambda length: F.transform(raw, lambda x: F.when(length > 0, x / length).otherwise(0.0)))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return once(once(words, counted), scaled)
