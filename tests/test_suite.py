"""Registered queries against their SQL on the smallest tables."""

import importlib
from pathlib import Path

import duckdb
import pytest

CHEAP = ["messy_urls", "page_features", "page_out_links", "fetch_outcomes", "duplicate_pages",
         "robots_check", "odd_links", "odd_dates", "large_fetches", "index_segments", "search_boolean", "search_near", "postings", "index_verification"]


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def tables(sf_dir):
    base = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return base


def test_registration(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHEAP) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, sf_dir, entry, tables, name):
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in want.fetchall()]
    got = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_flagship(spark, entry):
    rows = entry.entry(spark).collect()
    assert [r.place for r in sorted(rows)] == list(range(1, 11))
