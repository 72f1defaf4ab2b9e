"""Every query with an SQL twin, against DuckDB on the small tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return Counter(tuple(tidy(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["rmat_edges", "ba_edges"])
def test_generators_are_repeatable(spark, name):
    f = entry.queries()[name]
    assert rows(["src", "dst"], map(tuple, f(spark, FOLDER).collect())) == rows(["src", "dst"], map(tuple, f(spark, FOLDER).collect()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value"]
