"""From raw documents to packed training sequences, by five operators of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of ``documents``. Models are
trained on the stage's own input, from bounded samples.

Null, empty and letterless texts have no language, so they go in the first stage. Null ids, languages and
sources are kept as they are. Very long texts are worked on whole; packing cuts them. Of repeated rows the
near-duplicate stage keeps one. Further columns are kept, whatever their names, up to the last stage, which
returns its own. An empty table runs through all stages and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import langid, neardup, packing, secret_scan, toxicity
from tidewright.llm.common import fold, materialise, table, unused

#: A language is accepted from this posterior on.
LEAST_LANGUAGE_SCORE = 0.5
TOXIC_FROM = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an unsure one, go."""
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    names = unused(docs, "language"), unused(docs, "language_score")
    found = langid.predict(docs, model, keep=docs.columns, names=names)
    known = (F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score from TOXIC_FROM on go."""
    learn = fold("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    name = unused(docs, "toxicity")
    return toxicity.score(docs, model, keep=docs.columns, name=name).where(F.col(name) < TOXIC_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the first stays."""
    return neardup.without_near_duplicates(docs, width=5, part=80, whole=100)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", deduplicated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can't express the trained stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
