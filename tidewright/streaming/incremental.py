"""Polled micro-batches: windows, deduplication against what was accepted, pending items, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.sinks import append_new


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process all that has arrived since the last run and stop; the checkpoint moves only with a batch that succeeded."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    query.awaitTermination()


def append_unseen(target: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose key the target lacks. The target is the state, so it never grows in memory, and a replayed batch adds nothing."""
    return lambda batch, _: (append_new(batch, target, keys), None)[1]


def with_pending(target: str, pending: str, keys: Sequence[str], accept: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: accepted rows go to the target, the others wait and are tried again before new ones."""
    import uuid

    from tidewright.sources.sinks import _exists, _fs, _path, put_back, replace_staged

    def each(batch: DataFrame, _: int) -> None:
        held = batch
        put_back(batch.sparkSession, pending)
        if _exists(batch, pending):
            held = batch.sparkSession.read.schema(batch.schema).parquet(pending).unionByName(batch)
        held = held.dropDuplicates(list(keys))
        snapshot = f"{pending}.batch-{uuid.uuid4().hex}"
        held.write.parquet(snapshot)
        held = batch.sparkSession.read.schema(batch.schema).parquet(snapshot)
        append_new(held.where(F.coalesce(accept, F.lit(False))), target, keys)
        replace_staged(held.where(~F.coalesce(accept, F.lit(False))), pending)
        _fs(batch, snapshot).delete(_path(batch, snapshot), True)

    return each


def window_since(last_end: Column, now: Column, look_back_days: int) -> tuple[Column, Column]:
    """Next window: from the last end, or the look-back if there is none, to now."""
    return F.coalesce(last_end, now - F.make_dt_interval(F.lit(look_back_days))), now


def look_back_days(interval_days: Column, gap_days: Column) -> Column:
    """The longer of the usual interval and the gap since the last run plus a day."""
    return F.greatest(interval_days, gap_days + 1)


def deduplicated_within(stream: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """Duplicates dropped as long as their state is kept: the delay bounds the memory, late rows go to :func:`append_unseen`."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def commit(items: DataFrame, verdicts: DataFrame, target: str) -> int:
    """Accept a judged run: items (batch, idx, ...) with their verdicts (batch, idx, accept) go to ``target``.

    Refused, with nothing written, if an item has no verdict or a verdict is of a batch that isn't in this run.
    That nothing is accepted is legal. A repeated call adds nothing. Returns how many were added.
    """
    unjudged = items.join(verdicts, ["batch", "idx"], "left_anti").limit(1).count()
    stale = verdicts.join(items, "batch", "left_anti").limit(1).count()
    if unjudged or stale:
        raise ValueError("not all items are judged" if unjudged else "verdicts of another run")
    accepted = items.join(verdicts.where("accept").select("batch", "idx").distinct(), ["batch", "idx"], "left_semi")
    return append_new(accepted, target, ["batch", "idx"])


def still_to_do(items: DataFrame, log: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """Items without a decision, or whose input has changed since their latest one; a run goes on where it stopped."""
    latest = log.groupBy(key).agg(F.max_by(digest, order).alias("_seen"))
    return items.join(latest, key, "left").where(F.col("_seen").isNull() | (F.col("_seen") != F.col(digest))).drop("_seen")
