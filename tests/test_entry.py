import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from cellgrain import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).columns == ["segment", "year", "revenue", "n"]


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLES)
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_agrees_with_its_oracle(spark, sf_dir, con, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    for c in cols:
        if len(got) and hasattr(got[c].iloc[0], "year"):
            got[c], want[c] = pd.to_datetime(got[c]), pd.to_datetime(want[c])
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)
