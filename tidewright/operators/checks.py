"""Integrity: constraints as queries whose rows are violations; coverage; manifests and chains; guarded SQL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Functions that run code of the JVM (fixed values).
_UNSAFE = {"reflect", "java_method", "try_reflect"}


def _below(node: JavaObject) -> Iterator[JavaObject]:
    """A plan or an expression and all that stands below it, expressions and subqueries included."""
    jvm = SparkSession.active().sparkContext._jvm
    kind = jvm.java.lang.Class.forName
    plan, subquery = kind("org.apache.spark.sql.catalyst.plans.QueryPlan"), kind("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    waiting = [node]
    while waiting:
        node = waiting.pop()
        yield node
        lists = [node.children(), node.innerChildren()] + ([node.expressions()] if plan.isInstance(node) else [])
        waiting += [x.apply(i) for x in lists for i in range(x.size())] + ([node.plan()] if subquery.isInstance(node) else [])


def guarded_sql(spark: SparkSession, statement: str, **frames: DataFrame) -> DataFrame:
    """A query that only reads, as Spark's parser understands it; ``frames`` are named in braces in the statement.

    Refused are statements that don't parse as one query (so also two of them), commands and statements that
    write, and functions that call into the JVM. Words in names and literals don't matter.
    """
    text = statement.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.format(**{k: k for k in frames}) if frames else text)
    except Exception as e:
        raise ValueError("only a single read-only query is allowed") from e
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    kinds = [spark.sparkContext._jvm.java.lang.Class.forName(logical + k) for k in ("Command", "ParsedStatement")]
    for node in _below(plan):
        name = node.getClass().getSimpleName()
        if any(k.isInstance(node) for k in kinds) or name == "UnresolvedFunction" and node.nameParts().last().lower() in _UNSAFE:
            raise ValueError("only a single read-only query is allowed")
    return spark.sql(text, **frames)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, total, pct): share of rows with a value, to 0.1 percent."""
    counted = df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("filled"), F.col("total").alias("total")) for i, c in enumerate(columns)])
    pct = F.when(F.col("total") > 0, F.round(F.col("filled") * 100.0 / F.col("total"), 1))
    return counted.select(F.inline(rows)).withColumn("pct", pct)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key isn't in the parent; null keys refer to nothing and don't count."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for named conditions that every row must meet; null counts as a violation."""
    counted = df.agg(*[F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(f"_{i}") for i, ok in enumerate(rules.values())])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("violations")) for i, name in enumerate(rules)])))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): ok, corrupt, lost, or extra."""
    m = manifest.select("path", F.col("sha256").alias("_want"))
    a = actual.select("path", F.col("sha256").alias("_have"))
    state = F.when(F.col("_have").isNull(), "lost").when(F.col("_want").isNull(), "extra").when(F.col("_have") == F.col("_want"), "ok").otherwise("corrupt")
    return m.join(a, "path", "full_outer").select("path", state.alias("state"))


def verify_chain(editions: DataFrame) -> DataFrame:
    """(edition_id, state) along a chain of snapshots: root, ok, missing_prior or not_older."""
    prior = editions.select(F.col("edition_id").alias("prior"), F.col("created_at").alias("_prior_at"))
    state = F.when(F.col("prior").isNull(), "root").when(F.col("_prior_at").isNull(), "missing_prior").when(F.col("_prior_at") >= F.col("created_at"), "not_older").otherwise("ok")
    return editions.join(prior, "prior", "left").select("edition_id", state.alias("state"))


def carried_forward(counts: DataFrame, order: str, value: str) -> DataFrame:
    """Missing counts take the last recorded one before them."""
    w = Window.partitionBy("name").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn(value, F.last(value, ignorenulls=True).over(w))


def floors(found: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(name, n, ok): one-row counts against what a store must never fall below."""
    out = None
    for name, count in found.items():
        row = count.select(F.lit(name).alias("name"), F.col("n"), (F.col("n") >= least[name]).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def lost(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of the old edition that the new one lacks; any at all refuse it."""
    return before.join(after.select(key).distinct(), key, "left_anti")


def partitioned(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """One row: the size of each part, the total, and whether every row lies in exactly one part."""
    held = sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts.values()), F.lit(0))
    sizes = [F.count_if(p).alias(name) for name, p in parts.items()]
    return df.agg(*sizes, F.count("*").alias("total"), F.coalesce(F.bool_and(held == 1), F.lit(True)).alias("ok"))
