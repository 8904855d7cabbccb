"""Each registered query beside its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

D = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()
CORE = [n for n in entry_module.queries() if not n.startswith("p") or n in ("parse_entities", "parse_reflection", "parse_boundary", "per_type_prf", "perdoc_dump", "pipeline_align_counts", "pipeline_m1", "pipeline_m2")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{D}/{f}')")
    return c


def rows(df):
    def plain(x):
        x = x.tolist() if hasattr(x, "tolist") else x
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "~"
        return str(int(x)) if isinstance(x, float) and x == int(x) else repr(x) if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    got = entry_module.queries()[name](spark, D).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_token_vectors_of_the_whole_vocabulary(spark, con):
    subset = " WHERE split IN ('dev', 'test') AND ord % 20 = 0"
    assert SQL["token_vectors"].count(subset) == 1
    want = con.execute(SQL["token_vectors"].replace(subset, "")).fetch_df()
    got = entry_module.queries()["token_vectors_all"](spark, D).toPandas()
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["dataset", "token", "n_e", "n_c", "n_o"] and df.count() > 0
