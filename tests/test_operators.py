"""Operators on small fixtures, with nulls, ties, empty tables and repeated rows."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import dates, json_text, names, links, numbers, text
from tidewright.operators import checks, forecast, graph, keys, merging, search, similarity, stories, temporal, vectors
from tidewright.sources import files, sinks
from tidewright.streaming import incremental


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_slug_and_codes(spark):
    assert column(spark, "  Hello, World-- 7 ", text.slug) == "hello-world-7"
    assert column(spark, None, text.slug) is None
    for raw, code in {"p 7": "P007", "P.007": "P007", "P222": "P222", "n.3": "N.03", "N03": "N.03", "x9": None, "": None}.items():
        assert column(spark, raw, text.seat_code) == code


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Ex.COM/a?utm_source=x&b=2&fbclid=9#top", "https://ex.com/a?b=2"),
        ("http://ex.com/a?a=1&amp;utm_x=3", "http://ex.com/a?a=1"),
        ("http://ex.com/?x=&y=1", "http://ex.com/?x=&y=1"),
        ("no link", "no link"),
        ("http://e.com?utm_a=1&utm_b=2", "http://e.com"),
        ("http://e.com/p?gclid=1&mc_cid=2&igshid=3", "http://e.com/p?gclid=1&mc_cid=2&igshid=3"),
        ("http://e.com/?a=x%20y&b=%C3%A9~*", "http://e.com/?a=x+y&b=%C3%A9~%2A"),
        ("http://e.com/?flag&&z=1=2", "http://e.com/?flag=&z=1%3D2"),
        ("A &lt;b&gt; &#8212; &#x26;amp; &amp;lt; &unknown;", "A <b> \u2014 &amp; &lt; &unknown;"),
        ("http://E.com:80/P%2fq/?UTM_Source=1#x", "http://e.com:80/P%2fq/"),
    ],
)
def test_normalize_link(spark, raw, want):
    assert column(spark, raw, links.normalize_link) == want


def test_url_date_and_numbers(spark):
    assert column(spark, "https://x.com/2024/05/06/story", links.url_date) == "2024-05-06"
    assert column(spark, "https://x.com/a-2024-05-06.html", links.url_date) == "2024-05-06"
    assert column(spark, "https://x.com/20245/06", links.url_date) is None
    assert column(spark, "4.0-5.0 percent", numbers.first_number) == 4.0
    assert column(spark, "n/a", numbers.number) is None
    assert column(spark, "NaN", numbers.number) is None
    assert abs(column(spark, 1.96, numbers.normal_cdf, "double") - 0.9750021) < 1e-6


def test_negation_guard(spark):
    rules = [("switch", "(?i)joins"), ("vote", "(?i)vote")]
    f = lambda c: text.first_match_unless(c, rules, "(?i)(?:not|denies)")
    assert column(spark, "Ali joins the party", f) == "switch"
    assert column(spark, "Ali denies he joins the party before the vote", f) == "vote"
    assert column(spark, "nothing here", f) == "other"


def test_negation_guard_of_each_match(spark):
    rules = [("token", r"(?i)\btoken\b"), ("that", r"(?i)\bthat\b")]
    f = lambda c: text.first_match_unless(c, rules, r"(?i)\b(?:not|no|of)\b")
    far = " and then a good while later a "
    assert column(spark, f"no token here{far}token", f) == "token"
    assert column(spark, f"a token first{far}of token", f) == "token"
    assert column(spark, f"no token, of\nthe token{far}that", f) == "that"
    assert column(spark, "not\na token", f) == "other"
    assert column(spark, "notes token", f) == "token"
    assert column(spark, "no" + " " + "y" * 22 + " token", f) == "other"
    assert column(spark, "no" + " " + "y" * 23 + " token", f) == "token"


def test_chain_and_asof(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("s", "a", "resign", day(0)), ("s", "b", "vacancy", day(10)), ("s", "c", "poll", day(10)), ("s", "d", "poll", day(500)), ("t", "e", "poll", day(1))]
    df = spark.createDataFrame(rows, "seat string, id string, kind string, at date")
    got = {(r["from_id"], r["to_id"], r["gap_days"]) for r in temporal.chain(df, "seat", "at", "id", 400).collect()}
    assert got == {("a", "b", 10), ("b", "c", 0)}
    found = temporal.previous_matching(df, "seat", "at", "id", F.col("kind") == "poll", F.col("kind").isin("resign", "vacancy"), 180)
    assert {(r["from_id"], r["to_id"]) for r in found.collect()} == {("b", "c")}
    assert temporal.chain(df.limit(0), "seat", "at", "id", 400).count() == 0


def test_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert {(r["k"], r["v"], r["origin"]) for r in keys.additive_merge(base, new, ["k"]).collect()} == {(1, "a", "base"), (2, None, "base"), (3, "y", "new")}
    assert {(r["k"], r["state"]) for r in keys.snapshot_diff(base, new, ["k"], ["v"]).collect()} == {(1, "removed"), (2, "changed"), (3, "added")}
    assert {r["k"] for r in keys.missing_from(base, new, ["k"]).collect()} == {1}
    same = keys.snapshot_diff(base, base, ["k"], ["v"]).select("state").distinct().collect()
    assert [r["state"] for r in same] == ["same"]
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, o int")
    assert {r["unique_key"] for r in keys.duplicate_suffix(twice, "k", [F.col("o")]).collect()} == {"a", "a~2", "b"}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).select(F.col("id").alias("n"))
    pairs = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["n"]: r["component"] for r in graph.connected_components(nodes, "n", pairs).collect()}
    assert all(got[i] == (0 if i <= 40 else i) for i in range(60))


def test_search(spark):
    df = spark.createDataFrame([(1, "the show-cause letter"), (2, "show a letter, cause unknown"), (3, None), (4, "")], "id int, t string")
    hit = lambda q: {r["id"] for r in df.where(search.match(F.col("t"), q)).collect()}
    assert hit("show-cause") == {1}
    assert hit("letter AND NOT the") == {2}
    assert hit('"a letter" OR the') == {1, 2}
    assert hit("unkn*") == {2}
    assert hit("") == set()
    assert column(spark, "one two three red four", lambda c: search.snippet(c, ["red"], 3)) == "two three [red]"


def test_top_k_in_blocks_of_queries(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id long, v array<double>")
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = [sorted(map(tuple, vectors.top_k_each(rows, "id", "v", asked, 4, most).collect())) for most in (100, 5)]
    assert found[0] == found[1] and len(found[0]) == 14 * 4


def test_guarded_sql(spark):
    assert checks.guarded_sql(spark, "SELECT 'drop table' AS x").first()["x"] == "drop table"
    named = spark.createDataFrame([(1, 2)], "`set` int, `add` int")
    assert tuple(checks.guarded_sql(spark, "WITH a AS (SELECT set, add AS `update` FROM {t}) SELECT * FROM a", t=named).first()) == (1, 2)
    bad_ones = ["DROP TABLE x", "SELECT 1; DELETE FROM x", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", "", "SET a = 1", "SHOW TABLES", "EXPLAIN SELECT 1"]
    bad_ones += ["SELECT reflect('java.lang.System', 'exit', 1)", "SELECT 1 WHERE EXISTS (SELECT java_method('java.lang.Math', 'abs', 1))", "WITH a AS (SELECT try_reflect('x', 'y')) SELECT * FROM a"]
    for bad in bad_ones:
        with pytest.raises(ValueError, match="read-only"):
            checks.guarded_sql(spark, bad)


def test_chain_and_manifest(spark):
    editions = spark.createDataFrame([("e1", "1", None), ("e2", "2", "e1"), ("e3", "1", "e2"), ("e4", "9", "gone")], "edition_id string, created_at string, prior string")
    assert {(r["edition_id"], r["state"]) for r in checks.verify_chain(editions).collect()} == {("e1", "root"), ("e2", "ok"), ("e3", "not_older"), ("e4", "missing_prior")}
    have, want = spark.createDataFrame([("a", "1"), ("b", "2"), ("x", "9")], "path string, sha256 string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, sha256 string")
    assert {(r["path"], r["state"]) for r in checks.verify_manifest(have, want).collect()} == {("a", "ok"), ("b", "corrupt"), ("c", "lost"), ("x", "extra")}


def test_forecast_edges(spark):
    rows = [("A", "S", "PH", "PN", 1.0, 50.0, 25.0), ("B", "S", "PH", None, 1.0, 50.0, 25.0), ("C", "S", "PH", "PN", None, None, None), ("D", "S", "PN", "PH", 0.0, 90.0, 10.0)]
    seats = spark.createDataFrame(rows, "code string, state string, winner string, runnerup string, margin double, malay_pct double, youth_pct double")
    swings = spark.createDataFrame([("S", "PH", -5.0), ("S", "PN", 5.0)], "state string, bloc string, swing_pp double")
    got = {r["code"]: (r["proj_winner"], r["flip"]) for r in forecast.projected(forecast.with_swings(seats, swings)).collect()}
    assert got["A"] == ("PN", True)
    assert got["B"] == ("PH", False), "no runner-up, no flip"
    assert got["C"] == ("PH", False), "missing numbers never flip"
    none = {r["code"]: r["flip"] for r in forecast.projected(forecast.with_swings(seats, swings.limit(0), None)).collect()}
    assert not any(none.values()), "no swings give back the base result"
    types = {r["code"]: r["t"] for r in seats.select("code", forecast.seat_type(F.col("malay_pct"), F.col("state")).alias("t")).collect()}
    assert types == {"A": "true_mixed", "B": "true_mixed", "C": "non_malay", "D": "pn_core"}


def test_longest_matches(spark):
    df = spark.createDataFrame([(1, "Red widget and widgets, RED WIDGET"), (2, None)], "i int, t string")
    got = stories.longest_matches(df, "i", "t", [("red widget", "rw"), ("widget", "w")]).collect()
    assert {(r["i"], r["name"], r["start"]) for r in got} == {(1, "rw", 0), (1, "rw", 24)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id": ')
    lines = files.json_lines(spark, f"file://{tmp_path}/a.jsonl", "id int")
    assert [r["id"] for r in files.recovered(lines).orderBy("line").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": \n{"id": 3}')
    with pytest.raises(Exception, match="bad line inside"):
        files.recovered(files.json_lines(spark, f"file://{tmp_path}/b.jsonl", "id int")).collect()
    (tmp_path / "d.md").write_text("# One\n- first\n\n## Two\n| a | b |\n|---|---|\n| 1 | 2 |\n1. last\n")
    rows = files.markdown_blocks(spark, f"file://{tmp_path}/d.md").orderBy("line").collect()
    assert [(r["section"], r["kind"]) for r in rows] == [("One", "bullet"), ("Two", "row"), ("Two", "row"), ("Two", "numbered")]
    assert files.csv_strings(spark, f"file://{tmp_path}/none.csv") is None
    v = column(spark, "b1:4:1:cat:PN+PH:-:P001:en:8", files.compact_verdict)
    assert v["accept"] and v["blocs"] == ["PN", "PH"] and v["parties"] == [] and v["score"] == 0.8
    assert column(spark, "b1:4", files.compact_verdict) is None


def test_sinks(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert sinks.append_new(df, target, ["k"]) == 2
    assert sinks.append_new(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), target, ["k"]) == 1
    assert spark.read.parquet(target).count() == 3
    with pytest.raises(ValueError, match="not replaced"):
        sinks.replace_staged(df.limit(0), target, lambda t: "" if t.count() else "empty")
    assert spark.read.parquet(target).count() == 3
    sinks.replace_staged(df.where("k = 2"), target)
    assert spark.read.parquet(target).count() == 1
    sinks.sorted_json_lines(df.select("v", "k").distinct(), f"file://{tmp_path}/j", ["k"])
    lines = [x for p in sorted((tmp_path / "j").glob("part-*")) for x in p.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}] and lines[0].index("k") < lines[0].index("v")


def test_dates(spark):
    got = column(spark, "On 2024-05-06, then 7 June 2023 and Q3 2021", dates.extract_dates)
    assert [(h["iso"], h["precision"]) for h in got] == [("2024-05-06", "day"), ("2023-06-07", "day"), ("2021-07-01", "quarter")]
    assert column(spark, None, dates.extract_dates) is None


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("2026-03-01 to 2026-04-02", [("2026-03-01", "2026-04-02", "day")]),
        ("from 3 March – 5 April 2026, then Q3 2027", [("2026-03-03", "2026-04-05", "day"), ("2027-07-01", None, "quarter")]),
        ("3–5 Mar 2026", [("2026-03-03", "2026-03-05", "day")]),
        ("Jan-Mar 2026; 2026 Q4; 2026-Q1", [("2026-01-01", "2026-03-01", "month"), ("2026-10-01", None, "quarter"), ("2026-01-01", None, "quarter")]),
        ("by September 2026 or 2028, not 1999 nor 2031", [("2026-09-01", None, "month"), ("2028-01-01", None, "year")]),
        ("12026-03-01, 2026-03-011, march 2026", [("2026-01-01", None, "year")] * 2),
        ("", []),
    ],
)
def test_dates_in(said, want):
    assert [(h["iso"], h["iso_end"], h["precision"]) for h in dates.dates_in(said)] == want


def test_person_keys_and_titles(spark):
    for raw, key in {"Dato' Seri Dr. Anwar bin Ibrahim": "dr anwar ibrahim", "Tun X (a) from 2 May 2020": "x", "Tun": "", None: "", "Haji Ali  Md Noor": "ali noor"}.items():
        assert column(spark, raw, names.person_key) == key
    assert column(spark, "A **bold**  *it* `c`", names.clean_markdown) == "A bold it c"
    assert column(spark, "GDP yoy H1 h1 2026 2026", names.dedupe_words) == "GDP yoy H1 2026"
    assert column(spark, "1.50", lambda c: names.trimmed(c.cast("double"))) == "1.5"
    assert column(spark, "2", lambda c: names.trimmed(c.cast("double"))) == "2.0"


def test_json_texts(spark):
    assert json_text.canonical_bytes('{"b":[1],"a":"é"}') == '{\n  "a": "é",\n  "b": [\n    1\n  ]\n}\n'.encode()
    assert column(spark, "no json", json_text.canonical_hash) is None
    got = column(spark, '{"a": {"b": "https://x.y", "c": [1, null, {"d": "https://x.y"}]}}', json_text.flattened)
    assert (got["said"], got["urls"]) == ("b https://x.y c 1 d https://x.y", ["https://x.y"])


def test_recent_and_window(spark):
    import datetime

    cutoff = F.lit(datetime.datetime(2026, 8, 1))
    for raw, passes in {"2026-08-02": True, "2026-07-31T10:00:00Z": False, "soon": True, None: True, "Sun, 02 Aug 2026 10:00:00 GMT": True, "Wed, 01 Jul 2026 10:00:00 GMT": False}.items():
        assert column(spark, raw, lambda c: dates.is_recent(c, cutoff)) is passes
    for raw, inside in {"2026-08-02": True, "2026-08-02 late": True, "": False, None: False, "soon": False}.items():
        assert column(spark, raw, lambda c: dates.in_window(c, "2026-01-01", "2026-09-24")) is inside


def test_more_sources(spark, tmp_path):
    gone = f"file://{tmp_path}/gone.csv"
    assert files.csv_or_empty(spark, gone, ["a", "b c"]).columns == ["a", "b c"] and files.csv_or_empty(spark, gone, ["a"]).count() == 0
    (tmp_path / "t.csv").write_text("n,s\n1,x\n2,\n")
    assert dict(files.csv_inferred(spark, f"file://{tmp_path}/t.csv").dtypes) == {"n": "int", "s": "string"}
    assert files.csv_or_empty(spark, f"file://{tmp_path}/t.csv", ["n"]).count() == 2
    (tmp_path / "good.json").write_text('{"a": 1,\n "b": "x"}')
    (tmp_path / "bad.json").write_text('{"a": ')
    schema = "a int, b string"
    assert tuple(files.json_or_default(spark, f"file://{tmp_path}/good.json", schema).first()) == (1, "x")
    for name in ("bad.json", "gone.json"):
        assert files.json_or_default(spark, f"file://{tmp_path}/{name}", schema).count() == 0
        assert tuple(files.json_or_default(spark, f"file://{tmp_path}/{name}", schema, {"a": 7, "b": "d"}).first()) == (7, "d")
    assert column(spark, "# t\nx\n## a\n1\n## b\n2", files.last_block) == "b\n2"


def test_verdict_round_trip(spark):
    lines = ["b1:3:1:event:PH+BN:-:P001:en:7", "b1:4:0", "b1:4:1", "b1:3", "b2:x:1:c:-:-:-:ms:10"]
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    again = rows.select("line", files.compact_verdict(F.col("line")).alias("v")).where("v is not null").select("line", files.compact_line(F.col("v")).alias("again")).collect()
    assert {r["line"] for r in again if r["line"] == r["again"]} == set(lines[:3])
    latest = {(r["batch"], r["idx"]): r["accept"] for r in files.latest_verdicts(rows, "line", "n").collect()}
    assert latest[("b1", 4)] is True and latest[("b1", 3)] is True
    reply = lambda t: column(spark, t, lambda c: files.reply_verdict(c, ["event", "poll"], "other"))
    assert tuple(reply('Sure: {"accept": true, "category": " POLL ", "score": 1.7} done')) == (True, "poll", 1.0)
    assert tuple(reply('{"category": "x", "score": -2}')) == (False, "other", 0.0)
    assert reply("no json") is None


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "b", c'), (1, None)], "k int, v string")
    sinks.csv_lines(df, f"file://{tmp_path}/c", ["k"])
    part = next(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part"))
    assert part.read_bytes() == b'k,v\r\n1,\r\n2,"a ""b"", c"\r\n'
    staged = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    live = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0")], "path string, sha256 string")
    assert {tuple(r) for r in sinks.changed_files(staged, live).collect()} == {("a", "keep"), ("b", "copy"), ("c", "copy")}
    history = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    assert {tuple(r) for r in sinks.same_day_history(history, spark.createDataFrame([("d2", 5)], "day string, n int")).collect()} == {("d1", 1), ("d2", 5)}


def test_replacement_that_broke_off_loses_nothing(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    sinks.replace_staged(spark.range(3), target)
    (tmp_path / "t").rename(tmp_path / "t.aside")  # as if the run had ended between the two renames
    sinks.put_back(spark, target)
    assert spark.read.parquet(target).count() == 3
    sinks.replace_staged(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_commit_of_a_judged_run(spark, tmp_path):
    items = spark.createDataFrame([("b1", 1, "x"), ("b1", 2, "y"), ("b2", 1, "z")], "batch string, idx int, title string")
    verdict = lambda rows: spark.createDataFrame(rows, "batch string, idx int, accept boolean")
    target = f"file://{tmp_path}/accepted"
    for bad in ([("b1", 1, True)], [("b1", 1, True), ("b1", 2, False), ("b2", 1, True), ("b0", 1, True)]):
        with pytest.raises(ValueError, match="judged|another run"):
            incremental.commit(items, verdict(bad), target)
    assert incremental.commit(items, verdict([("b1", 1, False), ("b1", 2, False), ("b2", 1, False)]), target) == 0
    good = verdict([("b1", 1, True), ("b1", 2, False), ("b2", 1, True)])
    assert incremental.commit(items, good, target) == 2 and incremental.commit(items, good, target) == 0


# --- similar rows -----------------------------------------------------------------------------------


def sets_of(spark, n=240):
    """Rows (id, t) with copies, near copies, one word that all have, empty and missing sets."""
    import random

    draw = random.Random(3)
    rows = []
    for i in range(n):
        words = {f"w{int(draw.paretovariate(0.7)) % 90}" for _ in range(draw.randint(1, 14))} | {"all"}
        if i % 3 == 0 and rows:
            words = set(draw.choice(rows)[1])
        if i % 5 == 0:
            words ^= {f"w{draw.randint(0, 90)}"}
        rows.append((i, sorted(words)))
    return rows, spark.createDataFrame([*rows, (n, []), (n + 1, None)], "id long, t array<string>").repartition(3)


@pytest.mark.parametrize("cell", [4096, 7])
def test_similar_pairs_and_brute_force(spark, monkeypatch, cell):
    """Also with the index dealt in cells and pairs compared in small steps."""
    monkeypatch.setattr(similarity, "CELL", cell)
    monkeypatch.setattr(similarity, "CHUNK", cell)
    rows, df = sets_of(spark)
    df_of = {}
    for _, t in rows:
        for w in t:
            df_of[w] = df_of.get(w, 0) + 1
    weight = {w: math.log((len(rows) + 3) / (k + 1)) + 1e-9 for w, k in df_of.items()}
    for least in (0.6, 0.85):
        want, heavy = set(), {}
        for (a, s), (b, t) in itertools.combinations(rows, 2):
            both, either = set(s) & set(t), set(s) | set(t)
            if len(both) >= least * len(either) - 1e-9:
                want.add((a, b, len(both), len(s), len(t)))
            score = sum(weight[w] for w in both) / sum(weight[w] for w in either)
            if score >= least:
                heavy[a, b] = score
        assert len(want) > 50
        assert {tuple(r) for r in similarity.jaccard_pairs(df, "id", "t", least).collect()} == want
        weights = similarity.idf(similarity.document_frequency(df, "id", "t"), df.agg(F.count("*").alias("n")))
        got = {(r["a"], r["b"]): r["score"] for r in similarity.weighted_jaccard_pairs(df, "id", "t", weights, least).collect()}
        assert got == pytest.approx(heavy)


def test_equal_sets_are_compared_once(spark):
    """800 copies and 800 sets of frequent words: few candidates, all pairs in the end."""
    copies = [(i, [f"c{k}" for k in range(30)]) for i in range(800)]
    others = [(1000 + i, [f"o{(i * k) % 61}" for k in range(1, 9)]) for i in range(60)]
    df = spark.createDataFrame(copies + others, "id long, t array<string>")
    pairs, members = similarity.similar_classes(df, "id", "t", 0.9)
    assert pairs.where("ca = 0").count() == 1 and members.count() == 860
    assert similarity.jaccard_pairs(df, "id", "t", 0.9).where("b < 1000").count() == 800 * 799 // 2


def test_pairs_of_tokens_through_classes(spark):
    """Copies within a block are paired with each other and with all that share two tokens; none across blocks, none without a block."""
    rows = [(i, "x" if i % 2 else "y", ["red", "ring"] if i % 4 < 2 else ["red", "ring", "hot"]) for i in range(700)] + [(900, None, ["red", "ring"]), (901, "x", ["red"]), (902, None, ["red", "ring"])]
    df = spark.createDataFrame(rows, "id long, block string, t array<string>")
    got = {(r["a"], r["b"]): r["shared"] for r in similarity.shared_token_pairs(df, "id", "t", 2, "block").collect()}
    assert len(got) == 2 * 350 * 349 // 2
    assert got[0, 4] == 2 and got[2, 6] == 3 and got[0, 2] == 2 and (0, 1) not in got
    classes, _ = similarity.token_classes(df.select("block", "id", F.col("t").alias("set")))
    assert classes.where("shared >= 2").count() == 2 + 4


def test_same_events_through_classes(spark):
    rows = [(i, "k1" if i % 2 else "k2", "Seat lost by Ali" if i < 300 else "Ali lost a Seat by") for i in range(600)] + [(900, None, "Seat lost by Ali"), (901, "k1", ""), (902, "k1", None)]
    df = spark.createDataFrame(rows, "id long, k string, title string")
    found = merging.same_event_pairs(df, "id", "k", "title")
    assert found.columns == ["a", "b"] and found.distinct().count() == found.count() == 2 * 300 * 299 // 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ids_a" in plan  # pairs of ids come from pairs of classes


def test_top_k_of_copies_and_odd_vectors(spark):
    """Copies, zeros, missing and other vectors, against the scores one by one."""
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)] + [(60, [0.0] * 3), (61, None), (62, [1.0, 2.0]), (63, [1.0, None, 2.0]), (64, [float("nan"), 1.0, 1.0]), (65, [1e200, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = df.where("id % 4 = 0 or id > 58").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    scored = df.crossJoin(asked).select("query_id", "id", vectors.cosine(F.col("v"), F.col("q")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    want = sorted(repr(tuple(r)) for r in scored.withColumn("rank", F.row_number().over(order)).where("rank <= 4").collect())
    for most in (100, 6):
        assert sorted(repr(tuple(r)) for r in vectors.top_k_each(df, "id", "v", asked, 4, most).collect()) == want
    plan = vectors.top_k_each(df.where("id < 60"), "id", "v", asked.where("query_id < 60"), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_hashing_embedder_computes_words_once(spark):
    df = spark.createDataFrame([("a a b C d",), ("",), (None,)], "t string")
    got = df.select(vectors.hashing_embedder(F.col("t"), 8).alias("v"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    first, empty, missing = (r["v"] for r in got.collect())
    assert first == pytest.approx([0, 0, 0.3779645, -0.3779645, 0.7559289, 0, 0.3779645, 0], abs=1e-6) and empty == missing == [0.0] * 8
