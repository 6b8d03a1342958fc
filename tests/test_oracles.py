"""Every registered query with a SQL twin against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import catalogue
from tidewell.plans.views import TABLES, VIEWS

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: entry.queries()[name] for name in catalogue.QUERIES}
ORACLES = catalogue.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return con


def _text(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = sorted(tuple(_text(row[c]) for c in columns) for row in frame.collect())
    result = duck.execute(ORACLES[name])
    header = [d[0] for d in result.description]
    assert sorted(header) == columns
    at = [header.index(c) for c in columns]
    theirs = sorted(tuple(_text(row[i]) for i in at) for row in result.fetchall())
    assert ours == theirs
    assert ours


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


def test_views_cover_whole_tables():
    for text in VIEWS.values():
        assert "where mod(" not in text and "limit" not in text.lower() and "<>" not in text.partition("where")[2]
