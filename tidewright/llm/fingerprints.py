"""Document fingerprints (operator 2), in DataFrame functions only.

Method: consistent weighted sampling. A document is the weighted set of its words (runs of characters
other than ASCII white space, in lower case) with their counts n. For each of ``samples`` slots and
each word, uniform numbers v1, v2 and a Gamma(2, 1) variate c come from hashes of word and slot. With
r = -ln(v1 v2), a Gamma(2, 1) variate, and b = ln v2 / ln(v1 v2), uniform and independent of r,

    t = floor(ln n / r + b),  y = exp(r (t - b)),  a = c / (y exp(r)) = c v1 (v1 v2)^t

the slot's sample is (word, t) of the smallest a. Two documents have equal samples in a slot with a
chance of sum(min) / sum(max) of their counts, the generalised Jaccard similarity. Where n v1 < 1, and so
for every word that stands once, t is 0: one logarithm, that of c, gives its a.

The fourth root of a as a fixed-point number stands in the upper 32 bits of a long, and 31 bits of the word
below, so a slot is a plain minimum of longs: hash aggregation in generated code. Of one word and slot, a
tells t, so equal longs are equal samples; both parts go into what is printed.

The text goes through one shuffle, by ranges of its order (id, hash of the text, row). The ranges' bounds
are quantiles of a bounded sample, so any distribution of ids, rows without an id and repeated rows
are spread evenly; they decide where a row is worked on, never what it gives. A range's rows meet in one
task, which knows every row's successor but the last one's; that is the first row of the next range
with rows. Counting and sampling need no shuffle of their own, as their groups lie within ranges.

Defined results: a null text is the empty text. A text without words has the empty fingerprint;
it is like another such text (1), and unlike all others (0). Rows of one id are ordered by the hash of
their texts; a null id counts as the smallest number. The only row of a table is its own successor. Very
long texts are worked on whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
#: Ranges for each configured shuffle partition, and at most.
SPREAD, MOST_RANGES = 4, 1 << 16
#: Keys that the ranges' bounds are taken from, for each range.
SAMPLED_KEYS = 16
_WORDS = r"[\x20\x09-\x0D]+"
_MASK31, _MASK32 = (1 << 31) - 1, (1 << 32) - 1


def sample(slot: int) -> Column:
    """The entry of a row's word (n times) for one slot: the fourth root of a in fixed point above, the word below.

    A SQL text, since some thousand column objects would take the driver ten seconds.
    """

    def uniform(bits: str) -> str:
        return f"((({bits}) + 0.5D) / {1 << 32}D)"

    first, second = f"xxhash64(word, {2 * slot})", f"xxhash64(word, {2 * slot + 1})"
    v1, v2 = uniform(f"{first} & {_MASK32}"), uniform(f"shiftrightunsigned({first}, 32)")
    u1, u2 = uniform(f"{second} & {_MASK32}"), uniform(f"shiftrightunsigned({second}, 32)")
    t = f"floor(-ln(n / {v2}) / ln({v1} * {v2}))"
    further = f"CASE WHEN n * {v1} < 1D THEN 1D ELSE pow({v1} * {v2}, {t}) END"
    a = f"-ln({u1} * {u2}) * {v1} * {further}"
    return F.expr(f"shiftleft(bigint(sqrt(sqrt({a})) * {1 << 30}D), 31) | (word & {_MASK31})")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the order's key (id, tie, row); the row's number only spreads equal rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))


def _bounds(rows: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """Ascending keys that cut the order into about ``ranges`` even ranges; fewer for a small table."""
    share = min(1.0, SAMPLED_KEYS * ranges / max(1, rows.count()))
    found = sorted(tuple(r) for r in rows.select("id", "tie", "row").sample(share, 17).limit(2 * SAMPLED_KEYS * ranges).collect())
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def _range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """How many bounds a row's key isn't below, by binary search in literal arrays."""
    steps = len(bounds).bit_length()
    filled = bounds + [((1 << 63) - 1,) * 3] * ((1 << steps) - 1 - len(bounds))
    ids, ties, rows = (F.split(F.lit(",".join(str(b[k]) for b in filled)), ",").cast("array<bigint>") for k in range(3))

    def further(at: Column, step: Column) -> Column:
        k = at + step - 1
        i, t = F.get(ids, k), F.get(ties, k)
        reached = (F.col("id") > i) | ((F.col("id") == i) & ((F.col("tie") > t) | ((F.col("tie") == t) & (F.col("row") >= F.get(rows, k)))))
        return F.when(reached, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), further) if steps else F.lit(0)


def _succeeded(docs: DataFrame) -> DataFrame:
    """rng, rn, doc_id, text, next_text (by descending id; after the last: the first), edge: last row of its range."""
    parts = min(MOST_RANGES, SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = _keyed(docs)
    keyed = keyed.withColumn("rng", _range_of(_bounds(keyed, parts))).repartition(parts, "rng")
    # doc_id adds nothing to the order, but makes both readers of the shuffle ask for the same columns, so that it runs once
    order = Window.partitionBy("rng").orderBy(F.desc("id"), F.desc("tie"), F.desc("row"), "doc_id")
    rows = keyed.select("rng", F.row_number().over(order).alias("rn"), "doc_id", "text", F.lead("text").over(order).alias("follow"))
    heads = rows.where("rn = 1").select(F.col("rng").alias("head"), F.col("text").alias("head_text"))
    # one row for each range, MOST_RANGES at most: few enough to be ordered in one task
    ranges = keyed.select("rng").distinct()
    everything = Window.orderBy(F.desc("rng"))
    lower = ranges.select("rng", F.coalesce(F.lead("rng").over(everything), F.max("rng").over(Window.partitionBy())).alias("head"))
    heads = heads.join(lower, "head").select("rng", "head_text")
    joined = rows.join(heads.repartition(parts, "rng").hint("merge"), "rng")
    return joined.select("rng", "rn", "doc_id", "text", F.coalesce("follow", "head_text").alias("next_text"), F.col("follow").isNull().alias("edge"))


def edited_text(text: Column, other: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def _fingerprinted(texts: DataFrame, samples: int) -> DataFrame:
    """rng, key, slots array<long> for each (rng, key, text) that has words."""
    words = texts.select("rng", "key", F.explode(F.split(F.lower("text"), _WORDS)).alias("word")).where("word != ''")
    counted = words.groupBy("rng", "key", F.xxhash64("word").alias("word")).agg(F.count("*").alias("n"))
    counted = counted.select("rng", "key", "word", F.col("n").cast("double").alias("n"))
    slots = [F.min(sample(k)).alias(f"s{k}") for k in range(samples)]
    return counted.groupBy("rng", "key").agg(*slots).select("rng", "key", F.array(*[f"s{k}" for k in range(samples)]).alias("slots"))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal slots; null arrays are texts without words."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal / float(samples))


def printed(slots: Column) -> Column:
    """The samples, both parts folded into eight hexadecimal digits each; the empty string for a text without words."""
    digits = F.transform(slots, lambda s: F.lpad(F.hex(s.bitwiseXOR(F.shiftright(s, 31)).bitwiseAND(F.lit(_MASK31))), 8, "0"))
    return F.coalesce(F.lower(F.array_join(digits, "")), F.lit(""))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = _succeeded(docs)
    edited = edited_text(F.col("text"), F.col("next_text"))
    # key: 4 * row + kind; kind 0 is the text, 1 the edited text, 2 the next text where that isn't in the range
    kinds = F.array(
        F.struct((F.col("rn") * F.lit(4)).cast("long").alias("key"), F.col("text").alias("text")),
        F.struct((F.col("rn") * F.lit(4) + 1).cast("long").alias("key"), edited.alias("text")),
        F.struct((F.col("rn") * F.lit(4) + 2).cast("long").alias("key"), F.when(F.col("edge"), F.col("next_text")).alias("text")),
    )
    texts = rows.select("rng", F.inline(kinds)).where("text is not null")
    slots = _fingerprinted(texts, samples)
    about = rows.select("rng", "rn", "doc_id", "edge", F.char_length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    keyed = slots.select("rng", F.shiftright("key", 2).cast("int").alias("rn"), F.col("key").bitwiseAND(F.lit(3)).alias("kind"), "slots")
    per_row = keyed.groupBy("rng", "rn").agg(*[F.max(F.when(F.col("kind") == k, F.col("slots"))).alias(f"k{k}") for k in range(3)])
    joined = about.join(per_row, ["rng", "rn"], "left")
    order = Window.partitionBy("rng").orderBy("rn")
    joined = joined.withColumn("after", F.when(F.col("edge"), F.col("k2")).otherwise(F.lead("k0").over(order)))
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("k0")).alias("fingerprint"),
        printed(F.col("k1")).alias("edited_fingerprint"),
        likeness(F.col("k0"), F.col("k1"), samples).alias("near_edited"),
        likeness(F.col("k0"), F.col("after"), samples).alias("near_next"),
    )
