"""Each query with SQL gives DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from waymark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data, columns):
    at = [names.index(c) for c in columns]
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got.columns, got.collect(), columns) == rows(list(want.columns), want.fetchall(), columns)


def test_entry(spark):
    assert [r["amount_out"] for r in entry.entry(spark).collect()] == [262]


def test_golden_totals(spark):
    got = {r["hops"]: (r["routes"], r["total"], r["best"]) for r in plans.QUERIES["route_totals"](spark, SF).collect()}
    assert got == {1: (4, 192, 90), 2: (210, 11132, 262), 3: (21842, 325653, 227)}
