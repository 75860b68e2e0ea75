"""Full-text search: index, Boolean and phrase match, BM25 order, snippets, hybrid scores."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Usual parameters of BM25.
K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters with marks up to U+024F, and the letters without them."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if c.islower()]
    pairs = [(c, base) for c, base in pairs if base != c]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def folded(text: Column) -> Column:
    """Lower case, letters without their marks."""
    return F.translate(F.lower(text), *_plain_letters())


def text_index(docs: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    """(token, id, tf, len) over several columns with accents folded; written once by the caller, looked up by token."""
    whole = folded(F.concat_ws(" ", *columns))
    return postings(docs.select(F.col(ident), whole.alias("_text")), ident, "_text").select("token", "id", "tf", "len")


def index_search(index: DataFrame, query: Sequence[str], totals: DataFrame, prefix: bool = False) -> DataFrame:
    """(id, score) of documents that hold all query tokens (``prefix``: the last one as a beginning), by BM25.

    Only the postings of the query's tokens are read; ``totals`` is the one-row frame of :func:`index_totals`.
    """
    asked = [unicodedata.normalize("NFD", q.lower()) for q in query]
    asked = ["".join(c for c in q if not unicodedata.combining(c)) for q in asked]
    which = F.lit(None).cast("int")
    for k, q in enumerate(asked):
        hit = F.col("token").startswith(q) if prefix and k == len(asked) - 1 else F.col("token") == q
        which = F.when(hit, k).otherwise(which)
    hits = index.withColumn("k", which).where("k is not null").groupBy("id", "k").agg(F.sum("tf").alias("tf"), F.max("len").alias("len"))
    df = F.broadcast(hits.groupBy("k").agg(F.count("*").alias("df")))  # a row for each query token
    weight = F.ln(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.join(df, "k").join(F.broadcast(totals)).groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("n"))
    return scored.where(F.col("n") == len(asked)).select("id", "score")


def index_totals(index: DataFrame, n_docs: int) -> DataFrame:
    """One row: the number of documents, and their mean length."""
    return index.agg(F.lit(n_docs).alias("n_docs"), (F.sum("tf") / float(max(n_docs, 1))).alias("avg_len"))


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, token, tf, len): one row per document and token."""
    listed = docs.select(F.col(ident).alias("id"), words(F.col(text)).alias("w"))
    return listed.select("id", F.size("w").alias("len"), F.explode("w").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def bm25(docs: DataFrame, ident: str, text: str, query: Sequence[str]) -> DataFrame:
    """(id, score) of documents with all query tokens.

    Documents are filtered to the query's tokens before anything is counted; averages are one-row frames.
    """
    listed = docs.select(F.col(ident).alias("id"), words(F.col(text)).alias("w"))
    totals = listed.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avg_len"))
    wanted = F.array(*[F.lit(q.lower()) for q in query])
    hits = listed.where(F.size(F.array_except(wanted, "w")) == 0)
    every = listed.select("id", F.explode(F.array_intersect("w", wanted)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    tf = hits.select("id", F.size("w").alias("len"), F.explode(F.filter("w", lambda w: F.array_contains(wanted, w))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    weight = F.ln(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return tf.join(F.broadcast(every), "token").crossJoin(F.broadcast(totals)).groupBy("id").agg(F.sum(part).alias("score"))


def match(text: Column, query: str) -> Column:
    """Whether a text matches a query of words, "phrases", prefix*, AND (or nothing), OR, NOT and parentheses.

    A word with other characters in it is the phrase of its parts.
    """
    padded = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    items = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def phrase(raw: str) -> Column:
        inner = " ".join(re.findall(r"\w+", raw.lower()))
        return F.contains(padded, F.lit(f" {inner}" if raw.endswith("*") else f" {inner} "))

    def atom() -> Column:
        nonlocal at
        item = items[at]
        at += 1
        if item == "(":
            out = any_of()
            at += 1
            return out
        if item == "NOT":
            return ~atom()
        return phrase(item)

    def all_of() -> Column:
        nonlocal at
        out = atom()
        while at < len(items) and items[at] not in (")", "OR"):
            if items[at] == "AND":
                at += 1
            out = out & atom()
        return out

    def any_of() -> Column:
        nonlocal at
        out = all_of()
        while at < len(items) and items[at] == "OR":
            at += 1
            out = out | all_of()
        return out

    return any_of() if items else F.lit(False)


def snippet(text: Column, query: Sequence[str], size: int = 10, left: str = "[", right: str = "]") -> Column:
    """The window of ``size`` words with the most query words (the first of those), hits in brackets."""
    wanted = F.array(*[F.lit(q.lower()) for q in query])
    listed = words(text)
    last = F.greatest(F.size(listed) - size + 1, F.lit(1))

    def hits(start: Column) -> Column:
        return F.size(F.filter(F.slice(listed, start, size), lambda w: F.array_contains(wanted, w)))

    windows = F.transform(F.sequence(F.lit(1), last), lambda s: F.struct((-hits(s)).alias("h"), s.alias("s")))
    best = F.array_min(windows)["s"]
    return F.array_join(F.transform(F.slice(listed, best, size), lambda w: F.when(F.array_contains(wanted, w), F.concat(F.lit(left), w, F.lit(right))).otherwise(w)), " ")


def lexical_overlap(fields: Sequence[tuple[Column, float]], query: Sequence[str]) -> Column:
    """Weighted share of query tokens in each field (token arrays)."""
    wanted = F.array(*[F.lit(q.lower()) for q in query])
    return sum((F.size(F.array_intersect(wanted, field)) / float(len(query)) * weight for field, weight in fields), F.lit(0.0))


def hybrid(lexical: Column, cosine: Column, share: float = 0.6) -> Column:
    return lexical * share + cosine * (1 - share)
