"""Every registered query against its SQL on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

from slidegrid.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(frame):
    def value(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return str(x) if isinstance(x, str | bool | np.bool_) else round(float(x), 5)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)
