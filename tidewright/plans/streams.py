"""Incremental queries: events arrive as files of a stream and end in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans.base import Registry, table
from tidewright.session import shared_dir
from tidewright.streaming import incremental

R = Registry()
add = R.add


def _arrivals(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str]:
    """Three days' slices of events as files, each later one repeating some rows of the one before."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    path = shared_dir(spark, name)
    for k in range(3):
        e.where((F.col("event_id") % 3 == k) | (F.col("event_id") % 9 == k)).write.mode("append").parquet(path)
    each = max(1, len(spark.read.parquet(path).inputFiles()) // 3)
    return incremental.file_stream(spark, path, e.schema, each), path


@add("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    stream, path = _arrivals(spark, d, "arrivals")
    target = shared_dir(spark, "accepted")
    incremental.run_available(stream.select("event_id", "user_id", "event_type"), f"{path}-checkpoint", incremental.append_unseen(target, ["event_id"]))
    return spark.read.parquet(target)


@add("SELECT event_id, event_type FROM events WHERE value >= 5")
def stream_pending(spark: SparkSession, d: str) -> DataFrame:
    """Accepted rows move on, the others stay pending and are never lost or offered twice."""
    stream, path = _arrivals(spark, d, "queue")
    target, pending = shared_dir(spark, "judged"), shared_dir(spark, "pending")
    incremental.run_available(stream.select("event_id", "event_type", "value"), f"{path}-checkpoint", incremental.with_pending(target, pending, ["event_id"], F.col("value") >= 5))
    return spark.read.parquet(target).select("event_id", "event_type")


@add("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts kept by arriving batches of unseen events."""
    stream, path = _arrivals(spark, d, "counted")
    target = shared_dir(spark, "seen")
    incremental.run_available(stream.select("event_id", "ts", "event_type"), f"{path}-checkpoint", incremental.append_unseen(target, ["event_id"]))
    return spark.read.parquet(target).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
