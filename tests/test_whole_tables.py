"""Queries that read their whole table, counted against it."""

import pytest

from cellgrain import queries

PAIRS = ("contract_matmul", "positional_product", "semiring_max_prod", "semiring_min_plus")
VECTORS = ("elementwise_broadcast", "project_max", "product_reduce", "unit_identity", "weighted_window", "tensor_running")


@pytest.mark.parametrize("name", [*PAIRS, *VECTORS])
def test_every_vector_is_read(spark, sf_dir, name):
    n = queries.table(spark, sf_dir, "embeddings").count()
    got = queries.QUERIES[name](spark, sf_dir)
    assert n > 60 and got.select(got.columns[0]).distinct().count() == n
    if name in PAIRS:
        assert got.count() == n * n


def test_every_line_and_supplier_is_read(spark, sf_dir):
    lines = queries.table(spark, sf_dir, "lineitem")
    cells = queries.QUERIES["cell_suppression"](spark, sf_dir)
    assert cells.agg({"n": "sum"}).first()[0] == lines.count()
    assert 0 < cells.where("s IS NULL").count() == cells.where("n < 5").count()
    pairs = queries.QUERIES["semiring_bool"](spark, sf_dir)
    assert pairs.select("supp").distinct().count() == pairs.select("other").distinct().count() == lines.select("l_suppkey").distinct().count()
