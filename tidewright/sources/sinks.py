"""Writers: sorted JSON lines, append of new keys, staged replacement, manifests."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sorted_json_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines in a fixed order with fields sorted by name; ranges of the order are files."""
    names = sorted(df.columns)
    df.orderBy(*order).select(F.to_json(F.struct(*names)).alias("value")).write.mode("overwrite").text(path)


def csv_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """CSV byte for byte the same for the same rows: in order, one file, lines ended by carriage return and line feed.

    One file is the feature; tables of any size go to :func:`sorted_json_lines`.
    """
    quoted = [F.when(F.col(c).cast("string").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    rows = df.select(F.lit(1).alias("part"), F.struct(*order).alias("at"), F.concat_ws(",", *quoted).alias("value"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(rows.schema["at"].dataType).alias("at"), F.lit(",".join(df.columns)).alias("value"))
    head.unionByName(rows).repartition(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def changed_files(staged: DataFrame, live: DataFrame) -> DataFrame:
    """(path, step) of a promotion by digests (path, sha256): copy what is new or differs, keep the rest; nothing is deleted."""
    known = live.select("path", F.col("sha256").alias("_old"))
    return staged.join(known, "path", "left").select("path", F.when(F.col("_old") == F.col("sha256"), "keep").otherwise("copy").alias("step"))


def same_day_history(history: DataFrame, today: DataFrame, day: str = "day") -> DataFrame:
    """The history with today's rows in place of those of the same day."""
    return history.join(today.select(day).distinct(), day, "left_anti").unionByName(today)


def append_new(df: DataFrame, path: str, keys: Sequence[str], partition: str | None = None) -> int:
    """Append rows whose key isn't in the table yet; the first of equal keys counts. Returns how many."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(list(keys))
    if _exists(df, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    fresh.write.parquet(staged)
    rows = spark.read.schema(fresh.schema).parquet(staged)
    n = rows.count()
    if n:
        writer = rows.write.mode("append")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    _fs(df, staged).delete(_path(df, staged), True)
    return n


def replace_staged(df: DataFrame, path: str, check=None) -> None:
    """Write beside, check, then swap in: a failed check leaves the old table as it was.

    The old table is set aside before the new one takes its name, and deleted last; a run that breaks off
    between the two loses nothing, as :func:`put_back` (and the next call) restores it.
    """
    put_back(df.sparkSession, path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if check is not None:
        problems = check(df.sparkSession.read.schema(df.schema).parquet(staged))
        if problems:
            _fs(df, staged).delete(_path(df, staged), True)
            raise ValueError(f"not replaced: {problems}")
    fs = _fs(df, path)
    aside = f"{path.rstrip('/')}.aside"
    if _exists(df, path) and not fs.rename(_path(df, path), _path(df, aside)):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(_path(df, staged), _path(df, path)):
        put_back(df.sparkSession, path)
        raise OSError(f"could not rename {staged}")
    fs.delete(_path(df, aside), True)


def put_back(spark: SparkSession, path: str) -> None:
    """Undo a replacement that broke off: the table that was set aside gets its name again, unless the new one has it."""
    kept = spark.range(0)
    aside = f"{path.rstrip('/')}.aside"
    if _exists(kept, aside):
        if _exists(kept, path):
            _fs(kept, aside).delete(_path(kept, aside), True)
        else:
            _fs(kept, aside).rename(_path(kept, aside), _path(kept, path))


def upsert_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _path(df: DataFrame, path: str):
    return df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(df: DataFrame, path: str):
    return _path(df, path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())


def _exists(df: DataFrame, path: str) -> bool:
    return bool(_fs(df, path).exists(_path(df, path)))
