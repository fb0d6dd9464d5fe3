import re

import pytest

from cellgrain import Engine
from cellgrain.catalog import dense_ordinals
from cellgrain.sources import loaders


def test_ordinals_are_dense_over_many_partitions(spark):
    df = spark.range(0, 5000, 7).selectExpr("id * 13 % 4001 as k").repartition(9)
    rows = dense_ordinals(df, "k").collect()
    keys = sorted({r["k"] for r in rows})
    assert sorted((r["k"], r["ordinal"]) for r in rows) == [(k, i) for i, k in enumerate(keys)]
    assert dense_ordinals(df.limit(0), "k").count() == 0


def test_nan_is_null(spark):
    df = loaders.to_frame(spark, {"a": [1.0, float("nan")], "v": [float("nan"), 2.0]})
    assert df.where("a is null").count() == 1
    e = Engine(spark)
    e.load_frame(df, ["a"], "v", "f")
    assert e.sql("SELECT a, SUM(v) AS s, COUNT(v) AS k, COUNT(*) AS n FROM f GROUP BY a").rows == [(1.0, 0.0, 0, 1), (None, 2.0, 1, 1)]


@pytest.mark.parametrize(("agg", "want"), [("sum", 6.0), ("max", 3.0), ("min", 1.0), ("count", 3.0), ("mean", 2.0)])
def test_load_aggregates(spark, agg, want):
    e = Engine(spark)
    e.load_frame({"a": [0, 0, 0], "v": [1.0, 2.0, 3.0]}, ["a"], "v", "f", agg=agg)
    assert e.sql("SELECT SUM(v) AS s FROM f").rows == [(want,)]


def test_last_row_of_a_key_stands(spark):
    e = Engine(spark)
    e.load_frame({"k": [1, 2, 3], "v": [1.0, 1.0, 1.0]}, ["k"], "v", "f")
    e.load_dimension({"k": [1, 2, 1], "name": ["old", "x", "new"], "m": [1.0, None, 5.0]}, "k", attributes=["name"], measures=["m"])
    assert e.sql("SELECT k, SUM(v * m) AS s FROM f GROUP BY k").rows == [(1, 5.0), (2, 0.0), (3, 0.0)]
    assert [r["k"] for r in e.catalog.dimension("k").attribute_mask("name", lambda c: c == "new").collect()] == [1]


def test_masks(spark):
    e = Engine(spark)
    cube = e.load_frame({"k": [1, 2, 3, None], "v": [1.0, 1.0, 1.0, 1.0]}, ["k"], "v", "f")
    d = e.catalog.dimension("k")
    assert cube.cells.where(d.mask_of(1, None)).count() == 2 and cube.cells.where(d.mask_range(2)).count() == 2
    assert cube.cells.where(d.mask_range(1, 2, inclusive=False)).count() == 0 and cube.cells.where(d.mask_all()).count() == 4
    e.load_frame({"t": ["a"], "v": [1.0]}, ["t"], "v", "g")
    with pytest.raises(ValueError):
        e.catalog.dimension("t").mask_range("a")


def test_scans_read_what_a_query_needs(spark, sf_dir):
    """Columns are pruned and filters pushed down to Parquet."""
    from cellgrain.queries import QUERIES

    plan = QUERIES["range_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    columns = re.search(r"FileScan parquet \[(.*?)\]", plan)[1]
    assert {c.split("#")[0] for c in columns.split(",")} == {"l_suppkey", "l_quantity", "l_shipdate"}
    assert "l_suppkey" in re.search(r"DataFilters: \[(.*?)\]", plan)[1]


def test_jdbc(spark, tmp_path, monkeypatch):
    """The executors' path: rows of a query by a JDBC url."""
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:facts"
    spark.createDataFrame([(i % 3, float(i)) for i in range(10)], "A int, V double").write.jdbc(f"{url};create=true", "F")
    df = loaders.read_sql(spark, "SELECT A, V FROM F WHERE V > 2", url)
    e = Engine(spark)
    e.load_frame(df, ["A"], "V", "f")
    assert e.sql("SELECT A, SUM(V) AS s FROM f GROUP BY A").rows == [(0, 18.0), (1, 11.0), (2, 13.0)]
    e.load_sql("SELECT A, V FROM F", url, ["A"], "V", "g")
    assert e.sql("SELECT COUNT(*) AS n FROM g").rows == [(10,)]


def test_cells_laid_out_by_a_dimension_spare_the_shuffle(spark):
    rows = spark.range(500).selectExpr("id % 7 AS a", "id % 11 AS b", "CAST(id AS DOUBLE) AS v")
    query = "SELECT a, b, SUM(v) AS s FROM f GROUP BY a, b"
    plain, laid = Engine(spark), Engine(spark, cache=True)
    plain.load_frame(rows, ["a", "b"], "v", "f")
    laid.load_frame(rows, ["a", "b"], "v", "f", cluster_by="a")
    assert laid.sql(query).rows == plain.sql(query).rows
    result = laid.frame(query)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]
    with pytest.raises(KeyError):
        laid.load_frame(rows, ["a", "b"], "v", "g", cluster_by="c")


def test_paging_and_order_of_a_service(spark):
    from cellgrain.rest import Service

    e = Engine(spark)
    e.load_frame({"k": [3, 1, 2], "v": [1.0, 2.0, 3.0]}, ["k"], "v", "f")
    service, ask = Service(e), {"sql": "SELECT k, SUM(v) AS s FROM f GROUP BY k"}
    assert service.handle("POST", "/query", ask)[1]["rows"] == [[1, 2.0], [2, 3.0], [3, 1.0]]
    page = service.handle("POST", "/query", ask | {"limit": 1, "offset": 1})[1]
    assert page["rows"] == [[2, 3.0]] and page["more"]
    assert not service.handle("POST", "/query", ask | {"limit": 5, "offset": 2})[1]["more"]
    assert service.handle("POST", "/query", ask | {"limit": -1})[0] == 400
