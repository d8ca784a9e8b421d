"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from tonearm.plans import analysed, catalog, kept, more  # noqa: F401
from tonearm.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    result = duck.execute(catalog.ORACLE[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in result.fetchall()]
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
