"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewright.session import materialise, shared_dir

__all__ = ["fold", "map_batches", "materialise", "release", "shared_dir", "slices", "table", "text_columns", "text_slices", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``. A null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(column: pa.Array, max_bytes: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 values) for runs of rows of about ``max_bytes``; null is the empty text.

    A run holds one row at least. Spark delivers whole batches (10,000 rows or 64 MB, whichever ends
    first), so a worker holds a batch, one run of it, and at most one text beyond that.
    """
    start, size, out = 0, 0, []
    for i, value in enumerate(column):
        raw = value.as_buffer()
        raw = b"" if raw is None else raw.to_pybytes()
        if out and size + len(raw) > max_bytes:
            yield start, out
            start, size, out = i, 0, []
        out.append(raw)
        size += len(raw)
    if out:
        yield start, out


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """:func:`slices` of a batch's column."""
    return slices(batch.column(batch.schema.get_field_index(column)), max_bytes)


def release() -> None:
    """Give the memory that a finished task no longer needs back to the system; workers are reused."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_columns(df: DataFrame, fields: str, setup: Callable[[], Callable[[list[bytes]], list[pa.Array]]], keep: list[str] | None = None, max_bytes: int = 1_000_000) -> DataFrame:
    """The columns ``keep`` of ``df`` (all: None) and new ones made from the column ``text``; no shuffle.

    ``setup()`` is called once per task and returns the function of a list of UTF-8 texts that gives
    one Arrow array for each of ``fields`` (a DDL list). Texts go to Python only, and only the new columns
    come back; the others stay in the JVM. A new column takes the place of an old one of the same name.
    """
    new = [x.strip().split()[0] for x in fields.replace("<", " <").split(", ")]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    found = unused(df, "found")

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = setup()
        for column in texts:
            parts = [pa.StructArray.from_arrays(each(some), names=new) for _, some in slices(column, max_bytes)]
            yield pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else pa.array([], kind)
        del each
        release()

    # not deterministic, to Spark: else a filter on the result would compute it twice
    score = F.arrow_udf(run, fields).asNondeterministic()
    kind = to_arrow_type(score.returnType)
    out = df.select(*[F.col(f"`{c}`") for c in kept], score(F.col("text")).alias(found))
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(found)[c].alias(c) for c in new])


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes to be no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, setup: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with ``setup()`` called once per task; it returns the function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = setup()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)
        del each
        release()

    return df.mapInArrow(run, schema)
