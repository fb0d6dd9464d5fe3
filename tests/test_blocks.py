"""Products by blocks against products by joins."""

import math

import numpy as np
import pytest

from cellgrain import Tensor
from cellgrain.functions.semirings import SEMIRINGS
from cellgrain.operators import blocks


def rows_of(t):
    return {tuple(r)[:-1]: r["value"] for r in t.df.collect()}


def agree(a, b, blocked=True, **kw):
    fast, slow = a.product(b, blocks=True, **kw), a.product(b, **kw)
    assert fast.axes == slow.axes and fast.sizes == slow.sizes and fast.df.dtypes == slow.df.dtypes
    assert ("MapInArrow" in fast.df._jdf.queryExecution().optimizedPlan().toString()) == blocked
    fast, slow = fast.df.collect(), slow.df.collect()
    assert len(fast) == len(slow)  # no cell twice
    fast, slow = ({tuple(r)[:-1]: r["value"] for r in x} for x in (fast, slow))
    assert fast.keys() == slow.keys()
    for k, v in slow.items():
        assert math.isclose(fast[k], v, rel_tol=1e-12, abs_tol=1e-12) or math.isnan(v) and math.isnan(fast[k]) or v == fast[k], (k, v, fast[k])


@pytest.mark.parametrize("fill", [1.0, 0.3])
@pytest.mark.parametrize("ring", SEMIRINGS)
def test_blocks_agree_with_joins(spark, monkeypatch, ring, fill):
    """Several chunks, absent cells, vectors without a common key, negative values."""
    monkeypatch.setattr(blocks, "CHUNK", 7)
    monkeypatch.setattr(blocks, "ROWS", 3)
    r = np.random.default_rng(5)
    a, b = (np.where(r.random(s) < fill, r.integers(1, 9, s) * r.choice([-1, 1], s), 0) for s in ((40, 4), (4, 71)))
    agree(Tensor.from_dense(spark, a, "xk"), Tensor.from_dense(spark, b, "ky"), ring=ring)


@pytest.mark.parametrize("ring", SEMIRINGS)
def test_odd_cells(spark, ring):
    """Null and text keys, cells that come twice, NaN and infinity, several axes of each role; both operands lack some keys."""
    nan, inf = float("nan"), float("inf")
    a = [("p", None, 1, "u", 2.0), ("p", None, 1, "u", -3.0), ("p", "q", 2, "u", nan), ("p", "q", 1, "u", 1.0), (None, "q", 1, None, 5.0), ("", "r", 1, "v", inf), ("", "r", 2, "u", -1.0), ("", "s", 9, "u", 1.0)]
    b = [(1, "u", 7, 4.0), (1, "u", 7, -5.0), (2, "u", 8, 0.5), (1, "v", 8, 2.0), (2, "u", None, nan), (1, None, 3, 1.0), (3, "u", 5, 1.0)]
    a = Tensor(spark.createDataFrame(a, "x string, y string, k int, l string, value double"), "xykl")
    b = Tensor(spark.createDataFrame(b, "k int, l string, z long, value double"), "klz")
    agree(a, b, ring=ring)


def test_what_is_left_to_the_join(spark, monkeypatch):
    a = Tensor(spark.createDataFrame([(0, 0, None), (0, 1, 2.0), (1, 0, 1.0)], "x int, k int, value double"), "xk")
    b = a.rename(x="y")
    assert rows_of(a.product(b, blocks=True)) == rows_of(a.product(b))  # null values
    full = a.where(k=[1])
    agree(full, full.rename(x="y"), blocked=True)
    agree(full, full.rename(x="y"), blocked=False, keep=["k"])
    agree(full, full.rename(x="y").slice(y=0), blocked=False)  # no free axis
    none = a.where(k=[])
    agree(none, none.rename(x="y"))
    monkeypatch.setattr(blocks, "MOST_KEYS", 1)
    c = Tensor.from_dense(spark, np.ones((3, 2)), "xk")
    agree(c, c.rename(x="y"), blocked=False)
