"""Readers: CSV, JSON lines with order and recovery, Markdown, feeds, sitemaps; all through Spark's own file access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def csv_strings(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with all columns as strings; None where there is no such file."""
    try:
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    except AnalysisException:
        return None


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose types Spark infers in a pass over the data."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", True).csv(path)


def csv_or_empty(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with all columns as strings; a missing file is an empty table of ``columns``."""
    found = csv_strings(spark, path)
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)) if found is None else found


def json_or_default(spark: SparkSession, path: str, schema: str, default: dict | None = None) -> DataFrame:
    """One JSON document as a row; the default's row (or none) where the file is missing or isn't JSON."""
    empty = spark.createDataFrame([default] if default is not None else [], schema)
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    bad = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")
    rows = raw.select(bad).where("r is not null and r._bad is null").select("r.*").drop("_bad")
    return rows if rows.limit(1).count() else empty


def last_block(text: Column, heading: str = "\n## ") -> Column:
    """The last block of a log that starts with a heading; the whole text without one."""
    return F.element_at(F.split(text, heading), -1)


def csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV by an explicit schema; lines that don't fit it are kept in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def csv_by_folder(spark: SparkSession, pattern: str, folder: str, out: str = "state") -> DataFrame:
    """CSVs of several folders at once; ``folder`` is a regular expression whose group 1 names the folder."""
    found = spark.read.option("header", True).csv(pattern)
    return found.withColumn(out, F.regexp_extract(F.regexp_replace(F.input_file_name(), "%20", " "), folder, 1))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with file, line number and a parse error flag.

    Line numbers come from the files read whole, so a file must fit a task (shards are small).
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "raw")).where("trim(raw) != ''")
    record = F.from_json("raw", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("record", record)
    bad = F.col("record").isNull() | F.col("record._bad").isNotNull()
    return rows.select("file", "line", bad.alias("bad"), "record.*").drop("_bad")


def recovered(lines: DataFrame) -> DataFrame:
    """Good lines; only a file's last line may be bad (a torn write), anything else raises when it runs."""
    last = lines.groupBy("file").agg(F.max("line").alias("_last"))
    rows = lines.join(last, "file")
    torn = F.col("bad") & (F.col("line") < F.col("_last"))
    good = F.when(torn, F.raise_error(F.concat(F.lit("bad line inside "), F.col("file"))).cast("boolean")).otherwise(~F.col("bad"))
    return rows.where(good).drop("_last", "bad")


def feed_items(xml: Column) -> Column:
    """Items of RSS 2.0 or Atom as array<struct<title, link, published, description>>."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))

    def inner(block: Column, name: str) -> Column:
        raw = F.regexp_extract(block, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]*>", ""))

    def item(b: Column) -> Column:
        link = F.coalesce(F.nullif(inner(b, "link"), F.lit("")), F.regexp_extract(b, r'(?i)<link\b[^>]*href="([^"]*)"', 1))
        when = F.coalesce(F.nullif(inner(b, "pubDate"), F.lit("")), F.nullif(inner(b, "published"), F.lit("")), inner(b, "updated"))
        return F.struct(inner(b, "title").alias("title"), link.alias("link"), when.alias("published"), F.coalesce(F.nullif(inner(b, "description"), F.lit("")), inner(b, "summary")).alias("description"))

    return F.transform(blocks, item)


def sitemap_entries(xml: Column) -> Column:
    """array<struct<loc, lastmod>> of a sitemap or a sitemap index."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:url|sitemap)\b[^>]*>(.*?)</(?:url|sitemap)>"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"(?is)<loc>(.*?)</loc>", 1)).alias("loc"), F.trim(F.regexp_extract(b, r"(?is)<lastmod>(.*?)</lastmod>", 1)).alias("lastmod")))


def published_date(text: Column) -> Column:
    """ISO day from an RFC 822 or ISO time; null for anything else."""
    rfc = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*(?:GMT|UTC|Z|[+-]\d{4})$", "")
    stamp = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy")))
    return F.date_format(stamp, "yyyy-MM-dd")


def markdown_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, section, kind, body): headings name sections; bullets, table rows and numbered lines are records."""
    from pyspark.sql import Window

    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    kind = F.when(F.col("raw").rlike(r"^#{1,6}\s"), "heading").when(F.col("raw").rlike(r"^\s*\|?\s*:?-{3,}"), "rule").when(F.col("raw").rlike(r"^\s*\|"), "row").when(F.col("raw").rlike(r"^\s*[-*]\s"), "bullet").when(F.col("raw").rlike(r"^\s*\d+\.\s"), "numbered").when(F.trim("raw") == "", "blank").otherwise("text")
    rows = lines.withColumn("kind", kind)
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("kind") == "heading", F.regexp_replace("raw", r"^#+\s*", "")), ignorenulls=True).over(w)
    body = F.trim(F.regexp_replace("raw", r"^\s*(?:[-*]|\d+\.|#+)\s+", ""))
    return rows.select("file", "line", section.alias("section"), "kind", body.alias("body")).where("kind not in ('heading', 'rule', 'blank')")


def table_cells(row: Column) -> Column:
    """Cells of a Markdown table row."""
    return F.transform(F.split(F.regexp_replace(row, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))


def compact_verdict(line: Column) -> Column:
    """'batch:index:accept[:category:blocs:parties:seats:lang:score]' as a struct; null unless it has 3 or 9 fields."""
    p = F.split(line, ":")

    def listed(c: Column) -> Column:
        return F.when(c == "-", F.array().cast("array<string>")).otherwise(F.split(c, r"\+"))

    def at(i: int) -> Column:
        return F.get(p, F.lit(i))

    full = F.size(p) == 9
    body = F.struct(at(0).alias("batch"), at(1).try_cast("int").alias("idx"), at(2).isin("1", "true", "accept").alias("accept"), F.when(full, at(3)).alias("category"), F.when(full, listed(at(4))).alias("blocs"), F.when(full, listed(at(5))).alias("parties"), F.when(full, listed(at(6))).alias("seats"), F.when(full, at(7)).alias("lang"), F.when(full, at(8).try_cast("double") / 10.0).alias("score"))
    return F.when(full | (F.size(p) == 3), body)


def compact_line(verdict: Column) -> Column:
    """The line that :func:`compact_verdict` reads as this struct; empty lists are '-'."""

    def listed(c: Column) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, "+")).otherwise("-")

    head = F.concat_ws(":", verdict["batch"], verdict["idx"].cast("string"), F.when(verdict["accept"], "1").otherwise("0"))
    rest = F.concat_ws(":", verdict["category"], listed(verdict["blocs"]), listed(verdict["parties"]), listed(verdict["seats"]), verdict["lang"], F.round(verdict["score"] * 10).cast("int").cast("string"))
    return F.when(verdict["category"].isNull(), head).otherwise(F.concat_ws(":", head, rest))


def latest_verdicts(lines: DataFrame, line: str, order: str) -> DataFrame:
    """Verdicts of a log: of the lines for one item (batch, idx) the last one counts; unreadable lines don't."""
    rows = lines.select(F.col(order), compact_verdict(F.col(line)).alias("v")).where("v is not null")
    return rows.groupBy("v.batch", "v.idx").agg(F.max_by("v", F.col(order)).alias("v")).select("v.*")


def reply_verdict(reply: Column, vocabulary: Sequence[str], default: str) -> Column:
    """A model's JSON reply, with or without text around it: the category in the vocabulary (else the default), the score in [0, 1]."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    v = F.from_json(body, "accept boolean, category string, score double")
    category = F.lower(F.trim(v["category"]))
    score = F.least(F.greatest(F.coalesce(v["score"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    known = F.when(category.isin(*vocabulary), category).otherwise(default)
    return F.when(v.isNotNull() & (body != ""), F.struct(F.coalesce(v["accept"], F.lit(False)).alias("accept"), known.alias("category"), score.alias("score")))
