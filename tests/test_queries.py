"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftgraph import oracles, queries, source_oracles, source_queries

QUERIES = queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | source_oracles.ORACLE_SQL
# SQL can't open nodes in the order they were found; test_operators.py compares with plain Python.
WITHOUT_SQL = {"g23_impact_soft_cap"}
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        if hasattr(v, "year"):
            return str(v)[:10]
        return float(v) if isinstance(v, float) else v

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def test_each_query_has_an_oracle():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).fetchdf())
