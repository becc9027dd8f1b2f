"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 9


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
