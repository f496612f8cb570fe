"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

from surefact import catalogue


def rows(df):
    def text(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "~"
        if type(x).__name__ in ("bool", "bool_"):
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x):.5f}"
        return str(x)

    return sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_leaks_of_passages_without_inner_words(spark, tmp_path):
    spark.createDataFrame([(1, "b"), (2, "a b"), (3, "a b b"), (4, "a c b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "xa by"), (2, "a c b"), (3, "ya b bz"), (4, "none"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.surface_leak_hits(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (3, 3, 1)}
