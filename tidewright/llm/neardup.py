"""Near-duplicate documents (operator 5).

Method: HyperMinHash. A document is the set of its word shingles. Each shingle's hash picks a bucket;
a bucket keeps its largest leading-zero count and, among those, the smallest mantissa, 6 + 10 bits in
one register. Registers of empty buckets are borrowed from others by fixed probes (for banding only).
Bands of registers are keys; documents that share a key are candidates. A pair's similarity is
estimated from its registers, corrected for registers that agree by chance, and a pair that is far
below the threshold (five standard errors) is dropped. The rest is confirmed on the full shingle sets.

Groups of copies stay cheap without losing links:

1. Documents with equal shingle sets are one class; only its smallest id takes part further.
2. In each bucket all members are paired with one of them only, as many pairs as rows: the one whose
   buckets have most members over all bands, which in a group of edited copies is their original.
   Links found so give components.
3. Buckets that still hold several components go on: members are dealt to blocks of bounded size, and
   each pair of blocks is compared in one task, only across components, first on registers and then,
   where an estimate passes, on full sets; a pair is compared in the first band that both share. Thus
   every pair of different components that shares a bucket is examined, and there is no limit on
   partners, but only links are sent on, never pairs.

With 32 bands of 4 registers a pair at the threshold 0.8 shares no bucket with a chance of about
5e-8. Intermediate tables are written to the shared folder.

Defined results: null and empty texts (and those without words) have no shingles and are linked with
nothing. Rows with a null id get their own counts, a null component, and are kept. Rows that share an
id are one document in the links, and each is returned. An empty table gives no rows. Other columns
are ignored. Very long texts are shingled whole, one slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_batches, materialise, text_columns, unused
from tidewright.llm.shingles import Shingler, mix
from tidewright.operators.graph import components
from tidewright.session import drop

BUCKETS, BAND_ROWS = 128, 4
BANDS = BUCKETS // BAND_ROWS
EMPTY = 0xFFFF
MANTISSA = 10
PROBES = 48
#: Members of one block in the comparison of unsettled buckets.
BLOCK = 512
#: Ids up to which the filter of texts is broadcast (8 bytes each); beyond, it is a shuffled join.
BROADCAST_IDS = 1_000_000
#: Share of registers that agree by chance, for sets of equal size: a constant of the sketch.
CHANCE = 0.1699 / (1 << MANTISSA)

_U = np.uint64
_PROBE = np.random.default_rng(5).integers(0, BUCKETS, (PROBES, BUCKETS))
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers [document, bucket]; EMPTY where a bucket has no shingle."""
    out = np.full((len(sets), BUCKETS), EMPTY, np.uint16)
    sizes = [s.size for s in sets]
    if not sum(sizes):
        return out
    h = mix(np.concatenate(sets) + _U(0x632BE59BD9B4E019))
    bucket = (h >> _U(57)).astype(np.int64)
    rest = (h & _U((1 << 52) - 1)).astype(np.float64)
    zeros = np.where(rest > 0, 52 - np.frexp(rest)[1], 53).astype(np.int64)
    mantissa = (mix(h) >> _U(64 - MANTISSA)).astype(np.int64)
    code = ((63 - zeros) << MANTISSA | mantissa).astype(np.uint16)
    np.minimum.at(out.reshape(-1), np.repeat(np.arange(len(sets)), sizes) * BUCKETS + bucket, code)
    return out


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers with empty buckets borrowed: by fixed probes, then from the next bucket that has one."""
    out, full = regs.copy(), regs != EMPTY
    some = full.any(axis=1)
    row, col = np.nonzero(~full & some[:, None])
    for probe in _PROBE:
        if not row.size:
            break
        source = probe[col]
        ok = full[row, source]
        out[row[ok], col[ok]] = regs[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row.tolist(), col.tolist(), strict=True):
        own = np.flatnonzero(full[r])
        out[r, c] = regs[r, own[np.searchsorted(own, c) % own.size]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys [document, band]: a band's four registers are 64 bits, mixed with the band's number."""
    packed = np.ascontiguousarray(densified(regs)).view(np.uint64).reshape(len(regs), BANDS)
    return mix(packed ^ _BAND_SALT).view(np.int64)


def hopeful(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of register rows may reach ``least``: collision-corrected estimate plus five standard errors."""
    seen = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    both = ((a != EMPTY) & (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    estimate = (same - CHANCE * both) / np.maximum(seen, 1)
    return estimate + 5 * np.sqrt(least * (1 - least) / np.maximum(seen, 1)) >= least


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, (h1, h2) equal for equal sets, registers, bands; one pass over whole texts."""

    def setup() -> Callable[[list[bytes]], list[pa.Array]]:
        shingler = Shingler(width)

        def each(texts: list[bytes]) -> list[pa.Array]:
            sets = shingler(texts)
            regs = registers(sets)
            keys = band_keys(regs)
            sums = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))) for s in sets]
            halves = np.array(sums, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            bands = [keys[i] if s.size else None for i, s in enumerate(sets)]
            return [pa.array([s.size for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

        return each

    return text_columns(docs, "n_shingles long, h1 long, h2 long, registers binary, bands array<bigint>", setup, ["doc_id"])


def _estimated(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose registers don't rule out ``least``."""
    left = sketches.select(F.col("rep").alias("a"), F.col("registers").alias("ra"))
    right = sketches.select(F.col("rep").alias("b"), F.col("registers").alias("rb"))

    def setup() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            mask = hopeful(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
            yield batch.select(["a", "b"]).filter(pa.array(mask))

        return each

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb"), setup, "a long, b long")


def _hinted(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """The pairs with whole * intersection >= part * union on the full shingle sets."""
    ids = _hinted(materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def setup() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        shingler = Shingler(width)
        last: list = [None, None]  # the left text is often that of the row before

        def one(text: bytes) -> np.ndarray:
            return shingler([text])[0]

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            mask = []
            for ta, tb in zip(batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary()), strict=True):
                ta = ta.as_py() or b""
                if last[0] != ta:
                    last[:] = [ta, one(ta)]
                x, y = last[1], one(tb.as_py() or b"")
                small, large = (x, y) if x.size <= y.size else (y, x)
                if whole * small.size < part * large.size:
                    mask.append(False)
                    continue
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, large.size - 1)] == small).sum())
                mask.append(whole * shared >= part * (x.size + y.size - shared))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

        return each

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), setup, "a long, b long")


def _by_group(df: DataFrame, keys: tuple[str, ...], each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``each`` of the rows of every group, one group in memory at a time; groups are bounded by the caller."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = each(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held.clear()
                if out is not None and out.num_rows:
                    yield out

        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if current is not None and tuple(k[s]) != current:
                    yield from flush()
                current = tuple(k[s])
                held.append(batch.slice(s, e - s))
        yield from flush()

    return dealt.mapInArrow(run, schema)


def _open_pairs(rows: pa.RecordBatch, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a group of two blocks that are still to be compared: across components, not
    with the pivot, hopeful by their registers, and in the first band that both share."""
    own, lo, hi, rep, label, pivot = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("own", "lo", "hi", "rep", "label", "pivot"))
    regs = _matrix(rows.column(rows.schema.get_field_index("registers")))
    bands, band = band_keys(regs), rows.column(rows.schema.get_field_index("band"))[0].as_py()
    first, second = np.flatnonzero((own == lo) & (rep != pivot)), np.flatnonzero((own == hi) & (rep != pivot))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in first:
        j = second[label[second] != label[i]]
        if lo[0] == hi[0]:
            j = j[rep[j] > rep[i]]
        if j.size:
            j = j[hopeful(regs[i][None, :], regs[j], least)]
            j = j[bands[i][(bands[i][None, :] == bands[j]).argmax(axis=1)] == band]
            left.append(np.full(j.size, i))
            right.append(j)
    return np.concatenate(left), np.concatenate(right)


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k], by products of 0/1 matrices over the hashes that several sets hold."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    several = count[at] > 1
    owner, col = owner[several], place[at[several]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = int((count > 1).sum())
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, width, columns):
        x, y = np.searchsorted(col, [start, start + columns])
        marks = np.zeros((len(sets), min(columns, width - start)), np.float32)
        marks[owner[x:y], col[x:y] - start] = 1
        total += marks @ marks.T
    return total[a, b].astype(np.int64)


def _unsettled_links(members: DataFrame, docs: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Links across components within buckets that hold several; ``members``: band, rep, label, pivot, registers, n_members.

    A first pass over registers keeps the rows that have a hopeful partner (at most as many as it read);
    only these fetch their texts, and a second pass compares full sets within each pair of blocks. Pairs
    are never sent.
    """
    blocks = F.ceil(F.col("n_members") / BLOCK)
    placed = members.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("rep"), blocks)})
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("band", "rep", "label", "pivot", "registers", "own", others)
    names = ["band", "lo", "hi", "own", "rep", "label", "pivot", "registers"]
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select(*names)
    keys, least = ("band", "lo", "hi"), part / whole

    def keep(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = _open_pairs(rows, least)
        return rows.take(pa.array(np.unique(np.concatenate([a, b])))) if a.size else None

    kept = materialise(_by_group(dealt, keys, keep, "band long, lo long, hi long, own long, rep long, label long, pivot long, registers binary"), "unsettled")
    ids = _hinted(materialise(kept.select(F.col("rep").alias("id")).distinct(), "unsettled-ids"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi").withColumnRenamed("id", "rep")

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = _open_pairs(rows, least)
        if not a.size:
            return None
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        raw = rows.column(rows.schema.get_field_index("text")).take(pa.array(used)).cast(pa.large_binary())
        shingler = Shingler(width)
        sets = [s for start in range(0, used.size, 64) for s in shingler([v.as_py() or b"" for v in raw.slice(start, 64)])]
        x, y = place[: a.size], place[a.size :]
        size = np.array([s.size for s in sets])
        shared = shared_counts(sets, x, y)
        linked = whole * shared >= part * (size[x] + size[y] - shared)
        rep = rows.column(rows.schema.get_field_index("rep")).to_numpy(zero_copy_only=False)
        i, j = rep[a[linked]], rep[b[linked]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    return _by_group(kept.join(texts, "rep").select(*names, "text"), keys, compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked id), kept (it is the smallest itself)."""
    least = part / whole
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialise(signatures(docs, width), "signatures")
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    placed = sketched.join(classes, ["h1", "h2", "n_shingles"], "left")
    own = F.col("doc_id") == F.col("rep")
    placed = placed.select("doc_id", "n_shingles", "rep", F.when(own, F.col("registers")).alias("registers"), F.when(own, F.col("bands")).alias("bands"))
    placed = materialise(placed, "classes")
    drop(sketched)
    reps = placed.where("bands is not null")
    sketches = reps.select("rep", "registers")
    rows = reps.select(F.explode("bands").alias("band"), "rep")
    # only buckets with several members go on
    sizes = rows.groupBy("band").agg(F.count("*").alias("n_members")).where("n_members > 1")
    bands = rows = materialise(rows.join(sizes, "band"), "bands")
    company = rows.groupBy("rep").agg(F.sum("n_members").alias("company"))
    pivots = rows.select("band", "rep").join(company, "rep").groupBy("band").agg(F.max_by("rep", F.struct(F.col("company"), (-F.col("rep")).alias("r"))).alias("pivot"))
    rows = materialise(rows.join(pivots, "band"), "pivots")
    drop(bands)
    star = rows.where("rep != pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    star = materialise(_estimated(star, sketches, least), "star")
    links = materialise(_confirmed(star, docs, width, part, whole), "links")
    drop(star)
    labels = components(links)
    marked = rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    marked = materialise(marked, "marked")
    drop(rows)
    open_buckets = marked.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi and lo is not null")
    # a bucket of two has been examined: its only pair was with the pivot
    members = marked.where("n_members > 2").join(open_buckets.select("band"), "band", "left_semi").join(sketches.dropDuplicates(["rep"]), "rep")
    further = materialise(_unsettled_links(members, docs, width, part, whole), "further")
    drop(marked)
    if further.limit(1).count():
        labels = components(links.union(further))
    out = placed.select("doc_id", "n_shingles", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """``docs`` with all its columns, and one row of each group of near duplicates: the first as ``docs`` lies on disk.

    Rows are told apart by a number of their own, so rows that share an id, or have none, are documents
    like others: repeated ones leave one, and a row that is linked with nothing stays.
    """
    row = unused(docs, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), width, part, whole)
    dropped = _hinted(materialise(found.where(~F.col("kept")).select(F.col("doc_id").alias(row)), "dropped"))
    return numbered.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
