"""Every named query against its SQL on the same tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from skyloom.plans.catalog import ORACLE, QUERIES

#: Empty at this size.
SPARSE = {"ensemble_fit", "isolated_doubles", "neighbour_count"}
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(tuple(None if pd.isna(x) else round(float(x), 9) if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)) else str(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE:
        assert got.count() > 0
        return
    want = db.sql(ORACLE[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 or name in SPARSE
    a, b = rows(got), rows(want)
    key = lambda r: tuple(("", "") if x is None else (str(type(x)), x) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)
