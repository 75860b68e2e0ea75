"""Token counts of documents in flat token files (operator 10).

Method: separator scan. A flat token file is nothing but ids; a document ends at an end-of-document
id, and there is no index. Files are read in blocks of a fixed number of ids that know nothing of
documents. Each block is searched for the separator in one vectorised comparison; it reports its
number of ids, the places of its separators, and no more. A prefix scan over the blocks of a file
(sum of ids, count of separators, largest separator place) gives each block what came before it, and
stitches the document that lies across its start. The scan has two levels, blocks within groups and
groups within files, so that no task gathers all blocks of a file.

Defined results: ids after the last separator of a file are a document that isn't ended
(``ended`` false). Two separators in a row are an empty document. An empty file has no documents.
A null or empty text is a document of no ids; a very long text lies across several blocks. Repeated rows
and rows with equal ids are documents of their own. An empty table gives no rows. Columns other than doc_id
and text are ignored. An id that doesn't fit below the separator is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm import token_ids
from tidewright.llm.bpe import DEFAULT_VOCABULARY
from tidewright.llm.common import map_batches, shared_dir, text_slices

#: An id outside the vocabulary, so that no document holds it.
SEPARATOR = 65_535
BLOCK_IDS = 262_144
#: Blocks whose summaries one task of the scan's first level orders.
GROUP_BLOCKS = 4_096


def write_token_stream(docs: DataFrame, path: str, vocabulary: str = DEFAULT_VOCABULARY, block_ids: int = BLOCK_IDS, separator: int = SEPARATOR) -> None:
    """Tokenise ``docs`` and write one flat stream of unsigned 16-bit ids for each task below ``path``.

    Two folders: ``kind=ids`` has the stream cut into blocks of ``block_ids``, wherever documents end;
    ``kind=order`` has which documents were written in which order (the caller's own record; the scan
    doesn't read it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids.loaded(vocabulary).encode_all
        stop = np.array([separator], "<u2")
        shard = TaskContext.get().partitionId() if TaskContext.get() else 0
        parts: list[np.ndarray] = []
        held = block = written = 0

        def row(kind: str, at: int, payload: bytes | None, ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"shard-{shard:05d}"]), pa.array([at], pa.int64()), pa.array([payload], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([kind])],
                ["file", "block", "payload", "doc_ids", "kind"],
            )

        for batch in batches:
            names = batch.column(0).cast(pa.int64()).to_pylist()
            for start, texts in text_slices(batch, "text"):
                for raw in encode(texts):
                    ids = np.frombuffer(raw, "<u4")
                    if ids.size and ids.max() >= separator:
                        raise ValueError(f"id {ids.max()} doesn't fit a stream whose separator is {separator}")
                    parts += [ids.astype("<u2"), stop]
                    held += parts[-2].size + 1
                yield row("order", written, None, names[start : start + len(texts)])
                written += len(texts)
                if held >= block_ids:
                    stream = np.concatenate(parts)
                    whole = held // block_ids * block_ids
                    for at in range(0, whole, block_ids):
                        yield row("ids", block, stream[at : at + block_ids].tobytes(), None)
                        block += 1
                    parts, held = [stream[whole:]], held - whole
        if held:
            yield row("ids", block, np.concatenate(parts).tobytes(), None)

    schema = "file string, block long, payload binary, doc_ids array<long>, kind string"
    docs.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks (file, block, payload) of streams written by :func:`write_token_stream`."""
    return _stream(spark, path, "ids").select("file", "block", "payload")


def _stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the two folders; the partition filter prunes the other, and an empty table has neither."""
    return spark.read.schema("file string, block long, payload binary, doc_ids array<long>, kind string").parquet(path).where(F.col("kind") == kind)


def read_files(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (file, block, payload) of plain binary token files, each at most 2 GB (Spark's limit for one)."""
    size = width * block_ids
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))
    cut = files.select(F.col("path").alias("file"), "content", F.explode(blocks).alias("block"))
    return cut.select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("payload"))


def block_summaries(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Per block: file, block, n_ids, and the places of its separators."""

    def setup() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts, places = [], []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_py() or b"", dtype)
                counts.append(ids.size)
                places.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["file", "block", "n_ids", "places"])

        return each

    return map_batches(blocks.select("file", "block", "payload"), setup, "file string, block long, n_ids long, places array<long>")


def prefix_scan(summaries: DataFrame, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Add to each block what lies before it in its file: ids, separators, and the place of the last separator (-1: none)."""
    last = F.when(F.size("places") > 0, F.element_at("places", -1))
    rows = summaries.withColumns({"grp": F.floor(F.col("block") / group_blocks), "n_seps": F.size("places").cast("long"), "last": last})
    inside = Window.partitionBy("file", "grp").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base_in", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    rows = rows.withColumns({"seps_in": F.coalesce(F.sum("n_seps").over(before), F.lit(0).cast("long")), "last_in": F.max(F.col("base_in") + F.col("last")).over(before)})
    groups = rows.groupBy("file", "grp").agg(F.sum("n_ids").alias("g_ids"), F.sum("n_seps").alias("g_seps"), F.max(F.col("base_in") + F.col("last")).alias("g_last"))
    across = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("base_g", F.coalesce(F.sum("g_ids").over(across), F.lit(0).cast("long")))
    groups = groups.withColumns({"seps_g": F.coalesce(F.sum("g_seps").over(across), F.lit(0).cast("long")), "last_g": F.max(F.col("base_g") + F.col("g_last")).over(across)})
    joined = rows.join(groups.select("file", "grp", "base_g", "seps_g", "last_g"), ["file", "grp"])
    return joined.select(
        "file",
        "block",
        "n_ids",
        "places",
        (F.col("base_g") + F.col("base_in")).alias("base"),
        (F.col("seps_g") + F.col("seps_in")).alias("ordinal_base"),
        F.coalesce(F.greatest(F.col("base_g") + F.col("last_in"), F.col("last_g")), F.lit(-1).cast("long")).alias("before"),
    )


def separator_scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2", group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Per document of flat token files: file, ordinal, start, n_tokens (without the separator), ended."""
    scanned = prefix_scan(block_summaries(blocks, separator, dtype), group_blocks)
    ends = F.transform("places", lambda p: F.col("base") + p)
    starts = F.slice(F.concat(F.array("before"), ends), 1, F.greatest(F.size("places"), F.lit(1)))
    spans = F.when(F.size("places") > 0, F.arrays_zip(starts.alias("before"), ends.alias("end")))
    rows = scanned.select("file", "ordinal_base", F.posexplode(spans).alias("k", "span"))
    whole = rows.select("file", (F.col("ordinal_base") + F.col("k")).alias("ordinal"), (F.col("span.before") + 1).alias("start"), (F.col("span.end") - F.col("span.before") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    last = F.when(F.size("places") > 0, F.col("base") + F.element_at("places", -1))
    files = scanned.groupBy("file").agg(F.max(F.col("base") + F.col("n_ids")).alias("ids"), F.max(F.col("ordinal_base") + F.size("places")).alias("ordinal"), F.coalesce(F.max(last), F.lit(-1).cast("long")).alias("last"))
    rest = files.where("ids > last + 1").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def document_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Per document: doc_id, file, ordinal, start, n_tokens; by way of flat token files in the shared folder."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-stream")
    write_token_stream(docs, path, vocabulary, block_ids)
    counted = separator_scan(read_blocks(spark, path))
    order = _stream(spark, path, "order").select("file", "block", F.posexplode("doc_ids").alias("k", "doc_id"))
    order = order.select("file", (F.col("block") + F.col("k")).alias("ordinal"), "doc_id")
    return order.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
