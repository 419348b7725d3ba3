"""Every registered query with SQL against DuckDB on the same files."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from conftest import DATA_DIR
from starwright import workload
from starwright.workload.registry import TABLE_NAMES


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(DATA_DIR, name)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def sorted_rows(records, names, columns):
    """Rows sorted by their exact values first; floats, which may differ in the last digit, last."""
    at = [names.index(c) for c in columns]
    out = [tuple(plain(r[i]) for i in at) for r in records]
    return sorted(out, key=lambda r: (
        repr([v for v in r if not isinstance(v, float)]), [round(v, 2) for v in r if isinstance(v, float)]))


def assert_same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        if a != b:  # rounding of a tie may go either way
            for x, y in zip(a, b):
                if isinstance(x, float) and isinstance(y, float):
                    assert x == pytest.approx(y, rel=1e-6, abs=2e-4), (a, b)
                else:
                    assert x == y, (a, b)


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_query_matches_sql(spark, oracle, name):
    df = workload.QUERIES[name](spark, DATA_DIR)
    got = df.collect()
    cursor = oracle.execute(workload.SQL[name])
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert_same(sorted_rows(got, df.columns, columns), sorted_rows(want, names, columns))
    assert want, "a query over whole tables returns rows"


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.SQL)))
def test_query_without_sql_returns_rows(spark, name):
    assert workload.QUERIES[name](spark, DATA_DIR).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
