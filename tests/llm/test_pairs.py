"""Operators 2, 4 and 5, the pipeline, and the guard: brute force and awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np
import pytest

from tidewright.llm import ann, fingerprints, neardup, shingles
from tidewright.operators import graph

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, width):
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) >= width:
        return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, width):
    sets, root = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, width))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for a in range(len(flat)):
        for b in range(a):
            (i, x), (j, y) = flat[a], flat[b]
            if i != j and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingles(awkward, width):
    rows = [(r["text"] or "").encode() for r in awkward.select("text").collect()]
    got = shingles.Shingler(width)(rows)
    assert [g.size for g in got] == [len(shingle_set(t.decode(), width)) for t in rows]
    for one, t in zip(got, rows, strict=True):
        assert np.array_equal(one, shingles.Shingler(width)([t])[0]), "a text's hashes don't depend on its neighbours"


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(documents, awkward, width):
    for df in (documents, awkward):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = brute_components([r for r in rows if r[0] is not None], width)
        got = neardup.near_duplicates(df, width).collect()
        assert len(got) == len(rows)
        assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(i), len(shingle_set(t, width))) for i, t in rows)
        for r in got:
            assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_near_duplicates_across_a_large_bucket(spark):
    """Two families share most of their text but aren't linked; chains inside a family are."""
    base = [f"a{i}" for i in range(100)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k):
            w[j] = f"b{j}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 1)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 1).collect()} == want


def test_unsettled_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    core = [f"c{i}" for i in range(60)]
    rows = [(k, " ".join(core + [f"f{k // 3}x{i}" for i in range(30)] + [f"o{k}x{i}" for i in range(rng.integers(0, 6))])) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 1).collect()} == brute_components(rows, 1)


def test_near_duplicates_empty(nothing):
    assert neardup.near_duplicates(nothing, 2).count() == 0
    assert neardup.without_near_duplicates(nothing).count() == 0


def test_register_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        n = 4000
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, int(n * (1 - share) / 2), dtype=np.uint64)])) for _ in range(2)]
        regs = neardup.registers(sets)
        same = (regs[0] == regs[1]).mean()
        assert abs(same - share) < 5 * math.sqrt(share * (1 - share) / neardup.BUCKETS) + 0.02


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["id"]: r["label"] for r in graph.components(links).collect()}
    assert all(got[i] == 0 for i in range(51)) and {got[i] for i in (90, 95, 100)} == {90}


# --- 2: fingerprints --------------------------------------------------------------------------------


def weights(text):
    return collections.Counter(WORDS.findall((text or "").lower()))


def generalised_jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_fingerprints(documents):
    rows = sorted(((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents).collect()}
    assert len(got) == len(rows)
    errors, prints = [], {}
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(r["near_edited"] - generalised_jaccard(weights(t), weights(edited)))
        errors.append(r["near_next"] - generalised_jaccard(weights(t), weights(other)))
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_fingerprints_of_frequent_words(spark):
    """Samples of counts from 1 to 400: unbiased, and one logarithm for a word that stands once."""
    rng = np.random.default_rng(4)
    texts = [" ".join(w for k in range(40) for w in [f"w{k}"] * int(rng.integers(1, 4) ** rng.integers(0, 6))) for _ in range(40)]
    got = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), samples=256).collect()
    by = {r["doc_id"]: r for r in got}
    errors = [by[i]["near_next"] - generalised_jaccard(weights(texts[i]), weights(texts[(i - 1) % 40])) for i in by]
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04
    always = re.sub(r"case when.*? end", "", str(fingerprints.sample(0)._jc.toString()), flags=re.I | re.S)
    assert len(re.findall(r"\bln\(", always, re.I)) == 1


def test_fingerprints_of_awkward_rows(awkward, nothing):
    got = fingerprints.fingerprints(awkward).collect()
    assert len(got) == awkward.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert {r["fingerprint"] for i in (3, 4, 5) for r in by[i]} == {""}
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == by[2][1]["fingerprint"] != ""
    order = sorted((r for r in awkward.collect() if r["doc_id"] is not None), key=lambda r: -r["doc_id"])
    assert by[order[0]["doc_id"]][0]["n_chars"] == len(order[0]["text"])
    assert fingerprints.fingerprints(nothing).count() == 0
    one = fingerprints.fingerprints(awkward.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0, "the only row is its own successor"


def test_successor_crosses_ranges(spark):
    ids = [0, 1, 255, 256, 3000, 5_000_000, 5_000_001]
    df = spark.createDataFrame([(i, f"text {i} of {i * 7}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(df).collect()}
    down = ids[::-1]
    for k, i in enumerate(down):
        t, o = f"text {i} of {i * 7}", f"text {down[(k + 1) % len(down)]} of {down[(k + 1) % len(down)] * 7}"
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + o[: len(t) // 2]).encode()).hexdigest()


def test_fingerprints_of_sparse_repeated_and_missing_ids(spark):
    """Random 64-bit ids, a third of all rows without an id or with one id, and equal rows."""
    import xxhash

    rng = np.random.default_rng(8)
    ids = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 1500)] + [None] * 500 + [77] * 500
    rows = [(i, f"w{k % 40} x{k % 7} the end") for k, i in enumerate(ids)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], int.from_bytes(xxhash.xxh64(r[1].encode(), seed=42).digest(), "big", signed=True)), reverse=True)
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        o, half = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + o[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    by_text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault((r["n_chars"], r["fingerprint"]), r)


# --- 4: nearest neighbours ---------------------------------------------------------------------------


def exact(x, ids, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    d[ids == q] = np.inf
    return ids[np.lexsort((ids, d))[:k]], np.sort(d)[:k]


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = rows.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    hits = total = 0
    for q, group in ann.search(rows).toPandas().groupby("query_id"):
        want, _ = exact(x, ids, q, 10)
        hits, total = hits + len(set(want) & set(group["vec_id"])), total + 10
        assert list(group.sort_values("rank")["rank"]) == list(range(1, 11))
    assert total == 200 and hits / total >= 0.9


def test_nearest_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (100, [0.0, 2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, score string, rank string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    far = math.sqrt(5.0)
    assert got == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 100, far), (100, 1, 0, far), (100, 2, 2, far), (100, 3, 3, far)]
    assert ann.search(df.limit(0)).count() == 0


def test_hot_vector_and_query_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    for settings in (ann.Settings(), ann.Settings(query_block=3)):
        for q, group in ann.search(df, settings=settings).toPandas().groupby("query_id"):
            want, dist = exact(x.astype(float), np.arange(900), q, 10)
            if q % 3 == 0:
                assert list(group.sort_values("rank")["vec_id"]) == list(want)
            assert np.allclose(group.sort_values("rank")["score"].to_numpy()[:1], dist[:1])


@pytest.mark.parametrize("noise", [0.002, 0.03])
def test_near_copies_share_codes(spark, noise):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[::3] = x[0] + noise * rng.normal(size=(2000, 64))
    rows = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    hits = total = 0
    for q, group in ann.search(rows).toPandas().groupby("query_id"):
        want, _ = exact(x.astype(float), np.arange(6000), q, 10)
        hits, total = hits + sum(a == b for a, b in zip(want, group.sort_values("rank")["vec_id"], strict=True)), total + 10
    assert total == 600 and hits == total, hits / total


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing):
    """Nulls in every column, empty and very long texts, repeated rows, names that clash with the stages' own."""
    import corpus_pipeline

    clashing = awkward.withColumnsRenamed({"rep": "language", "k0": "toxicity", "label": "row"})
    for docs in (clashing, clashing.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001").collect()
            rows = [tuple(r) for r in docs.collect()]
            if name == "packing":
                assert sum(r["length"] for r in out) == sum(dict((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0 and r["doc_id"] == i).get(i, 0) * n for i, n in collections.Counter(r[0] for r in rows).items())
                continue
            assert list(out[0].__fields__) == columns if out else not rows or name == "language"
            kept = [tuple(r) for r in out]
            if name == "language":
                assert not any(r[0] in (3, 4, 5) for r in kept) and set(kept) <= set(rows)
            if name == "toxicity":
                assert set(kept) <= set(rows)
            if name == "near_dedup":
                assert set(kept) <= set(rows)
                assert sum(r[1] == rows[0][1] for r in kept) == (1 if rows else 0), "of repeated texts one stays"
                assert {r[0] for r in rows} - {r[0] for r in kept} <= {1, 2, -5, None}
            if name == "secrets":
                assert len(kept) == len(rows) and not any("abcdef123" in (r[1] or "") for r in kept)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language", "toxicity", "near_dedup", "secrets", "packing"]
    kept, sizes = docs, [docs.count()]
    for _, stage in p.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, "/root/testdata/sf0.001").collect(), docs.schema)
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    root = brute_components([(r["doc_id"], r["text"]) for r in kept.collect()], 5)
    assert all(i == c for i, c in root.items()), "no near duplicates are left"
    out = p.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in kept.collect()}
