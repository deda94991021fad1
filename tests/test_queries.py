"""Every registered query against its SQL on the same tables, value by value."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(ours.columns)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in ours.collect()) == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


def with_one_thread(spark, name, sf):
    """Rows of a query, and those of its SQL as one thread of DuckDB finds them."""
    c = duckdb.connect()
    c.execute("SET threads = 1")
    for t in ("orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = c.execute(SQL[name])
    names = [d[0] for d in cur.description]
    return sorted(tuple(plain(r[x]) for x in names) for r in QUERIES[name](spark, sf).collect()), sorted(tuple(map(plain, r)) for r in cur.fetchall())


def test_equal_periods_as_duckdb_has_them(spark):
    ours, theirs = with_one_thread(spark, "d3_check_no_overlap", "/root/testdata/sf0.1")
    assert ours == theirs


def test_equal_begins_and_values_as_duckdb_has_them(spark):
    ours, theirs = with_one_thread(spark, "j12_merge_periods", "/root/testdata/sf0.01")
    assert ours == theirs
