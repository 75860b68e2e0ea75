"""Every registered query with SQL gives DuckDB's rows; the others give a stable schema."""

from __future__ import annotations

import math
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(n for r in entry.REGISTRIES for n in r.queries)
SQL = {n: s for r in entry.REGISTRIES for n, s in r.sql.items()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        x = float(v)
        return "nan" if math.isnan(x) else float(f"{x:.7g}")
    return v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = {k: q for r in entry.REGISTRIES for k, q in r.queries.items()}[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert rows
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["seats"] for r in rows) == 150


def test_no_name_of_a_row_subset():
    """Queries run over whole tables: no limits but in the queries whose feature they are."""
    limited = {n for n, s in SQL.items() if re.search(r"\bLIMIT\b", s)}
    assert limited <= {"event_timeline", "entity_exact_first", "closest_margins", "null_date_last", "cosine_topk", "table_search_page", "waiting_items_first", "tightest_flips", "indexed_search"}
