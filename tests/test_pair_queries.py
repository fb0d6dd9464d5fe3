"""Queries whose result is all pairs of keys: no row is made for each pair of cells."""

import pytest
from pyspark.sql import functions as F

from cellgrain import queries


def test_rounding_of_pairs(spark):
    values = [0.00005, -0.00005, 0.00004, -0.00004, 1.23456, -1.23456, 0.0, -0.0, 1e300, -1e16, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    got, want = ([r["value"] for r in f(df, 4).collect()] for f in (queries.rounded_pairs, queries.rounded))
    assert repr(got) == repr(want)


@pytest.mark.parametrize("name", ["contract_matmul", "positional_product", "semiring_max_prod", "semiring_min_plus", "semiring_bool"])
def test_pairs_are_made_once(spark, sf_dir, name):
    """A join has a row for each pair and summed key, gathered by a shuffle of the pairs."""
    df = queries.QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join Cross")]
    assert "Aggregate" not in top and "MapInArrow" in top
    x, y = df.columns[:2]
    assert df.groupBy(x, y).count().where("count > 1").isEmpty()
    assert df.select(F.max(x)).first()[0] == df.select(F.max(y)).first()[0]
