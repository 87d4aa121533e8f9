"""Registered operator queries with an oracle give DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from weftgraph.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLE_SQL[name]).fetchdf())


KEYS = {"op11_whitening": ("vec_id", "embeddings"), "op12_html_extraction": ("page_id", "pages")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_returns_all_rows(spark, name):
    key, source = KEYS.get(name, ("doc_id", "documents"))
    found = QUERIES[name](spark, DATA)
    assert found.select(key).distinct().count() == spark.read.parquet(f"{DATA}/{source}.parquet").count()
