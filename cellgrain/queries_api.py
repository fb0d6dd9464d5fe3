"""Operators around the query itself (loads, results, refusals, rights, plans, shells) as queries that return tables."""

from __future__ import annotations

import contextlib
import io
import json
from argparse import Namespace
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .catalog import Catalog, Cube, check_budget, choose_layout, estimate_bytes
from .doctor import checks
from .engine import Engine
from .operators.tensors import SIGNATURE, Tensor, build_einsum, build_spec
from .plans import explain
from .queries import _G, _S, ORACLES, QUERIES, _graph, _register, _supply, _tensor, rounded, scratch, star, table
from .rest import Service
from .sources import store


def _values(rows: list[tuple], names: str) -> str:
    """The rows as SQL."""

    def one(v) -> str:
        return "NULL" if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


def _rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _nations(spark: SparkSession, sf_dir: str) -> Engine:
    """A cube of 25 nations by region, for what goes through the driver."""
    e = Engine(spark)
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("r"), F.col("n_nationkey").cast("long").alias("k"), F.lit(1.0).alias("one"))
    e.load_frame(nation, ["r", "k"], "one", "nations")
    return e


_ASK = "SELECT r, COUNT(*) AS n, SUM(one) AS s FROM nations GROUP BY r"
_ASKED = "SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n, CAST(count(*) AS DOUBLE) AS s FROM nation GROUP BY ALL"


# Loads and stores


@_register("dict_scan", "SELECT n_regionkey AS r, CAST(sum(n_nationkey) AS DOUBLE) AS s, count(*) AS n FROM nation GROUP BY ALL")
def dict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact from a dict of columns."""
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect()
    e = Engine(spark)
    e.load_frame({"r": [x[0] for x in rows], "v": [x[1] for x in rows]}, ["r"], "v", "f")
    return e.frame("SELECT r, SUM(v) AS s, COUNT(*) AS n FROM f GROUP BY r").withColumn("r", F.col("r").cast("int"))


@_register("pandas_scan", _ASKED)
def pandas_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.load_frame(table(spark, sf_dir, "nation").toPandas().assign(one=1.0), ["n_regionkey", "n_name"], "one", "nations")
    return e.frame("SELECT n_regionkey AS r, COUNT(*) AS n, SUM(one) AS s FROM nations GROUP BY n_regionkey").withColumn("r", F.col("r").cast("long"))


@_register("load_narrow", "SELECT l_returnflag, round(sum(CAST(CAST(l_quantity AS INTEGER) AS DOUBLE)), 2) AS s FROM lineitem GROUP BY ALL")
def load_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact whose values are taken as whole numbers."""
    e = Engine(spark)
    e.load_frame(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "f", dtype="int")
    return rounded(e.frame("SELECT l_returnflag, SUM(l_quantity) AS s FROM f GROUP BY l_returnflag"))


_UNCOUNTED = "SELECT {0} AS flag, round(sum(v), 2) AS s, count(*) FILTER (v <> 0) AS n FROM (SELECT l_suppkey, l_returnflag, sum(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_quantity END) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL HAVING count(*) FILTER (v <> 0) > 0"


@_register("registered_cube", _UNCOUNTED.format("l_returnflag"))
def registered_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells registered as a cube, without counts: COUNT is that of cells that aren't zero."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"))
    cells = cells.agg(F.sum(F.when(F.col("l_suppkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity"))).alias("value"))
    e = Engine(spark)
    e.add_cube(Cube("f", "v", ["supp", "flag"], cells))
    return rounded(e.frame("SELECT flag, SUM(v) AS s, COUNT(*) AS n FROM f GROUP BY flag"))


@_register("load_uncounted", _UNCOUNTED.format("l_returnflag"))
def load_uncounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact loaded without counts."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_suppkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity")).alias("v"))
    e = Engine(spark)
    e.load_frame(lines, ["supp", "flag"], "v", "f", with_count=False)
    return rounded(e.frame("SELECT flag, SUM(v) AS s, COUNT(*) AS n FROM f GROUP BY flag"))


@_register("last_row_stands", "SELECT l_returnflag, round(sum(l_quantity * w), 2) AS s FROM lineitem JOIN (SELECT p_size, arg_max(p_retailprice, p_partkey) AS w FROM part GROUP BY ALL) ON l_linenumber = p_size GROUP BY ALL")
def last_row_stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a dimension's rows with one key, that of the largest order column."""
    e = Engine(spark)
    e.load_frame(table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_linenumber")), ["l_returnflag", "size"], "l_quantity", "f")
    e.load_dimension(table(spark, sf_dir, "part"), "p_size", "size", measures=["p_retailprice"], order_by="p_partkey")
    return rounded(e.frame("SELECT l_returnflag, SUM(l_quantity * p_retailprice) AS s FROM f GROUP BY l_returnflag"))


_tensor("tensor_store", f"SELECT supp, flag, round(v, 2) AS value FROM {_S}", lambda s, d: _stored(s, d))
_tensor("tensor_store_pruned", f"SELECT supp, flag, round(v, 2) AS value FROM {_S} WHERE supp > 5 AND flag = 'A'", lambda s, d: _stored(s, d, "supp > 5 AND flag = 'A'"))


def _stored(spark: SparkSession, sf_dir: str, condition: str | None = None) -> Tensor:
    path = scratch(spark, "tensor")
    _supply(spark, sf_dir).save(path, partition_by=["flag"])
    return Tensor.open(spark, path, condition)


@_register("lazy_cube_read", "SELECT l_returnflag, round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_suppkey < 7 GROUP BY ALL")
def lazy_cube_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of a stored cube: the condition reaches the files."""
    path, e = scratch(spark, "cubes"), Engine(spark)
    e.load_frame(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", "f")
    e.save(path)
    return rounded(store.read_cube(spark, f"{path}/cubes/0", "l_suppkey < 7").groupBy("l_returnflag").agg(F.sum("value").alias("value")))


# Results


@_register("result_rows", "SELECT row_number() OVER (ORDER BY n_regionkey) - 1 AS place, CAST(n_regionkey AS BIGINT) AS r, count(*) AS n, CAST(count(*) AS DOUBLE) AS s FROM nation GROUP BY n_regionkey")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by iteration, by position and by length."""
    result = _nations(spark, sf_dir).sql(_ASK)
    assert list(result) == [result[i] for i in range(len(result))] == result.rows
    return _rows(spark, [(i, *r) for i, r in enumerate(result)], "place long, r long, n long, s double")


@_register("result_column", "SELECT count(*) AS n FROM nation GROUP BY n_regionkey")
def result_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(n,) for n in _nations(spark, sf_dir).sql(_ASK).column("n")], "n long")


@_register("result_dicts", _ASKED)
def result_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(d["r"], d["n"], d["s"]) for d in _nations(spark, sf_dir).sql(_ASK).to_dicts()], "r long, n long, s double")


@_register("result_pandas", _ASKED)
def result_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_nations(spark, sf_dir).sql(_ASK).to_pandas())


_TEXT = """SELECT * FROM (
    SELECT 0 AS line, 'r  n  s' AS text UNION ALL SELECT 1, '-  -  -'
    UNION ALL SELECT r + 2, r || '  ' || n || '  ' || n FROM (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY ALL)
    UNION ALL SELECT 2 + count(DISTINCT n_regionkey), '(' || count(DISTINCT n_regionkey) || ' rows)' FROM nation)"""


@_register("result_text", _TEXT)
def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, enumerate(_nations(spark, sf_dir).sql(_ASK).to_text().splitlines()), "line int, text string").withColumn("line", F.col("line").cast("long"))


@_register("result_text_cut", "SELECT * FROM (VALUES (0, 'r'), (1, '-'), (2, '0'), (3, '1'), (4, '... 3 more'), (5, '(5 rows)')) t(line, text)")
def result_text_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _nations(spark, sf_dir).sql("SELECT r FROM nations GROUP BY r")
    return _rows(spark, enumerate(result.to_text(2).splitlines()), "line int, text string")


@_register("default_labels", _values([(0, "r"), (1, "SUM(one)"), (2, "COUNT(*)"), (3, "(SUM(one) / COUNT(*))")], "place, label"))
def default_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _nations(spark, sf_dir).sql("SELECT r, SUM(one), COUNT(*), SUM(one) / COUNT(*) FROM nations GROUP BY r")
    return _rows(spark, enumerate(result.columns), "place int, label string")


@_register("query_stats", _values([("cache hits", "1"), ("cache misses", "1"), ("engine", "spark"), ("group", "r"), ("timed", "True")], "what, value"))
def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a result says of its making. The second query differs from the first in spacing alone."""
    e = _nations(spark, sf_dir)
    e.sql(_ASK)
    result = e.sql("  " + _ASK.replace(" ", "\n ", 3))
    result.rows
    s = result.stats
    timed = all(s[k] >= 0 for k in ("compile_seconds", "compute_seconds", "total_seconds"))
    return _rows(spark, [("engine", s["engine"]), ("group", ",".join(s["group_shape"])), ("cache hits", str(s["plan_cache"]["hits"])), ("cache misses", str(s["plan_cache"]["misses"])), ("timed", str(timed))], "what string, value string")


@_register("plan_cache", _values([("again", 1, 1), ("spaced otherwise", 2, 1), ("a text that differs by spaces", 2, 2), ("for a role", 2, 3), ("after a load", 2, 4)], "step, hits, misses"))
def plan_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, seen = _nations(spark, sf_dir), []

    def after(step: str, query: str = "SELECT SUM(one) AS s FROM nations", role: str | None = None) -> None:
        e.compile(query, role)
        seen.append((step, e.hits, e.misses))

    e.compile("SELECT SUM(one) AS s FROM nations")
    after("again")
    after("spaced otherwise", "select  SUM( one )  AS s\nFROM nations")
    e.grant("all", "r")  # a grant clears the cache, so the next three are compiled
    after("a text that differs by spaces", "SELECT SUM(one) AS s FROM nations WHERE r = 1")
    after("for a role", role="all")
    e.add_cube(Cube("other", "x", ["r"], e.cube("nations").cells.select("r", "value")))
    after("after a load")
    return _rows(spark, seen, "step string, hits int, misses int")


@_register("null_order", "SELECT row_number() OVER (ORDER BY p ASC NULLS FIRST) - 1 AS up, row_number() OVER (ORDER BY p DESC NULLS LAST) - 1 AS down, p FROM (SELECT DISTINCT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS p FROM orders)")
def null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORDER BY: NULL goes before numbers and texts, and last where the order is turned."""
    e = star(spark, sf_dir, "null_orders")
    up, down = ([r[0] for r in e.sql(f"SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority {way}").rows] for way in ("ASC", "DESC"))
    return _rows(spark, [(i, down.index(p), p) for i, p in enumerate(up)], "up long, down long, p string")


@_register("order_several_keys", "SELECT row_number() OVER (ORDER BY n DESC, l_returnflag, l_linestatus DESC) - 1 AS place, l_returnflag, l_linestatus, n FROM (SELECT l_returnflag, l_linestatus, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL)")
def order_several_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.load_frame(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity", "f")
    result = e.sql("SELECT l_returnflag, l_linestatus, COUNT(DISTINCT l_linenumber) AS n FROM f GROUP BY l_returnflag, l_linestatus ORDER BY n DESC, 1, l_linestatus DESC")
    return _rows(spark, [(i, *r) for i, r in enumerate(result)], "place long, l_returnflag string, l_linestatus string, n long")


@_register("default_order", "SELECT row_number() OVER (ORDER BY load, k) - 1 AS place, k FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey >= 20 THEN 0 ELSE 1 END AS load FROM nation)")
def default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ORDER BY rows stand by the dictionary's positions: members of a later load come after earlier ones."""
    e, nation = Engine(spark), table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit(1.0).alias("one"))
    e.load_frame(nation.where("k >= 20"), ["k"], "one", "late")
    e.load_frame(nation, ["k"], "one", "f")
    return _rows(spark, enumerate(r[0] for r in e.sql("SELECT k, COUNT(*) AS n FROM f GROUP BY k")), "place int, k long").withColumn("place", F.col("place").cast("long"))


# Filters, rights and refusals


@_register("on_filter", "SELECT l_returnflag, round(sum(l_quantity * plan), 2) AS x, count(*) AS n FROM lineitem a JOIN (SELECT l_partkey, l_tax AS plan FROM lineitem WHERE quarter(l_shipdate) = 2) USING (l_partkey) GROUP BY ALL")
def on_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition in ON that compares no columns is a filter."""
    e = star(spark, sf_dir, "lineitem", "supply")
    return rounded(e.frame("SELECT l_returnflag, SUM(l_quantity * plan) AS x, COUNT(*) AS n FROM lineitem JOIN supply ON lineitem.l_partkey = supply.l_partkey AND plan_quarter = 2 GROUP BY l_returnflag"))


@_register("key_masks", "SELECT l_returnflag, sum(l_quantity) AS value FROM lineitem WHERE l_suppkey IN (1, 3, 5) OR l_suppkey > 6 AND l_suppkey < 9 GROUP BY ALL")
def key_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions made by a dimension: a set of keys, a range with open ends, all."""
    e = Engine(spark)
    cube = e.load_frame(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", "f")
    d = e.catalog.dimension("l_suppkey")
    kept = cube.cells.where(d.mask_all() & (d.mask_of(1, 3, 5) | d.mask_range(6, 9, inclusive=False)))
    return kept.groupBy("l_returnflag").agg(F.sum("value").alias("value"))


@_register("rls_min_max", "SELECT l_linestatus, round(min(v), 2) AS low, round(max(v), 2) AS high FROM (SELECT l_suppkey, l_partkey, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL) GROUP BY ALL")
def rls_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star(spark, sf_dir, "lineitem")
    e.grant("analyst", "l_returnflag", ["A", "N"])
    return rounded(e.frame("SELECT l_linestatus, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem GROUP BY l_linestatus", "analyst"))


@_register("rls_projection", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL")
def rls_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis that a role may not sum over may still be grouped by."""
    e = star(spark, sf_dir, "lineitem")
    e.grant("grouper", "l_returnflag", can_project=False)
    return rounded(e.frame("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", "grouper"))


def _refusals(name: str, engine: Callable[[SparkSession, str], Engine], cases: dict[str, tuple[str, Callable[[Engine], object]]]) -> None:
    """A query of the cases and the errors they end in."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, out = engine(spark, sf_dir), []
        for case, (_, ask) in cases.items():
            try:
                ask(e)
                out.append((case, "none"))
            except Exception as error:  # what is asked for is the error itself
                out.append((case, type(error).__name__))
        return _rows(spark, out, "what string, error string")

    QUERIES[name], ORACLES[name] = run, _values([(case, error) for case, (error, _) in cases.items()], "what, error")


def _granted(spark: SparkSession, sf_dir: str) -> Engine:
    e = _nations(spark, sf_dir)
    e.grant("grouper", "r", can_project=False)
    e.grant("strict", "r", [0, 1], permissive=False)
    return e


_refusals("load_refusals", _nations, {
    "unknown aggregate": ("ValueError", lambda e: e.load_frame({"k": [1], "v": [1.0]}, ["k"], "v", "f", agg="median")),
    "unknown column": ("KeyError", lambda e: e.load_frame({"k": [1], "v": [1.0]}, ["j"], "v", "f")),
    "two parents": ("ValueError", lambda e: e.add_hierarchy("r", "p", e.spark.createDataFrame([(0, 1), (0, 2)], "r long, p long"))),
    "a member without parent": ("KeyError", lambda e: e.add_hierarchy("r", "p", {0: 1})),
    "axes that the cells lack": ("ValueError", lambda e: e.add_cube(Cube("g", "v", ["x"], e.cube("nations").cells))),
})
_refusals("join_refusals", _nations, {
    "a dimension below itself": ("BindError", lambda e: e.compile("SELECT COUNT(*) AS n FROM nations JOIN r ON nations.r < r.r")),
    "unknown source": ("BindError", lambda e: e.compile("SELECT COUNT(*) AS n FROM nowhere")),
    "a fact twice": ("BindError", lambda e: e.compile("SELECT COUNT(*) AS n FROM nations JOIN nations")),
})
_refusals("window_refusals", _nations, {
    "FOLLOWING": ("QuerySyntaxError", lambda e: e.compile("SELECT r, SUM(one) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS s FROM nations GROUP BY r")),
    "one bound": ("QuerySyntaxError", lambda e: e.compile("SELECT r, SUM(one) OVER (ORDER BY r ROWS 2 PRECEDING) AS s FROM nations GROUP BY r")),
    "no ORDER BY": ("BindError", lambda e: e.compile("SELECT r, SUM(one) OVER (PARTITION BY r) AS s FROM nations GROUP BY r")),
    "order outside GROUP BY": ("BindError", lambda e: e.compile("SELECT r, SUM(one) OVER (ORDER BY k) AS s FROM nations GROUP BY r")),
})
_refusals("access_refusals", _granted, {
    "summing a protected axis": ("AccessDenied", lambda e: e.compile("SELECT SUM(one) AS s FROM nations", "grouper")),
    "grouping by it": ("none", lambda e: e.compile("SELECT r, SUM(one) AS s FROM nations GROUP BY r", "grouper")),
    "an axis without a grant": ("AccessDenied", lambda e: e.compile("SELECT r, SUM(one) AS s FROM nations GROUP BY r", "strict")),
    "unknown role": ("KeyError", lambda e: e.compile("SELECT SUM(one) AS s FROM nations", "nobody")),
})
_refusals("size_refusals", _nations, {
    "a product of too many cells": ("MemoryError", lambda e: _sized(e.spark).product(_sized(e.spark).rename(a="b"), ring="min-plus", max_cells=10)),
    "a grid of too many cells": ("MemoryError", lambda e: Tensor(e.cube("nations").cells, ["r", "k"], {"r": 1 << 30, "k": 1 << 30}) + 1.0),
    "a dense array beyond the budget": ("MemoryError", lambda e: check_budget(10, 1 << 40, 2, "dense")),
    "an intermediate beyond the budget": ("MemoryError", lambda e: explain.optimize_step(e.compile(_ASK).steps[0], {"r": 100}, 10)),
})


def _sized(spark: SparkSession) -> Tensor:
    return Tensor(spark.createDataFrame([(0, 0, 1.0)], "a long, k long, value double"), ["a", "k"], {"a": 4, "k": 3})


# The catalog


@_register("cube_stats", "SELECT 'nations' AS cube, count(*) AS nnz, count(DISTINCT n_regionkey) * count(DISTINCT n_nationkey) AS total_cells, round(count(*) / (count(DISTINCT n_regionkey) * count(DISTINCT n_nationkey)), 6) AS fill_factor, 'dense' AS recommended_layout, 1 AS version FROM nation")
def cube_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir).stats("nations")
    return _rows(spark, [(s["cube"], s["nnz"], s["total_cells"], round(s["fill_factor"], 6), s["recommended_layout"], s["version"])], "cube string, nnz long, total_cells long, fill_factor double, recommended_layout string, version int")


@_register("catalog_summary", _values([(0, "1 cubes, 2 dimensions, 0 hierarchies, 0 roles"), (1, "cube nations(r, k) measure one, version 1"), (2, "dimension r"), (3, "dimension k")], "line, text"))
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, enumerate(_nations(spark, sf_dir).summary().splitlines()), "line int, text string")


@_register("facade_lists", _values([("cubes", "nations"), ("dimensions", "r,k"), ("axes", "r,k"), ("measure", "nations"), ("other session", "5")], "what, value"))
def facade_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nations(spark, sf_dir)
    rows = [("cubes", ",".join(e.cubes)), ("dimensions", ",".join(e.dimensions)), ("axes", ",".join(e.catalog.axes_of("nations"))), ("measure", e.catalog.cube_for_measure("one"))]
    return _rows(spark, [*rows, ("other session", str(len(e.use_engine(spark.newSession()).sql(_ASK))))], "what string, value string")


@_register("dimension_api", "SELECT count(*) + 1 AS members, max(CASE WHEN n_nationkey = 7 THEN 7 END) AS ordinal_of_7, TRUE AS has_null, 12 AS label_12, count(*) AS ordinal_of_null FROM nation")
def dimension_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _nations(spark, sf_dir).catalog.dimension("k")
    d.ensure_null()
    return _rows(spark, [(len(d), d.ordinal(7), None in d, d.label(12), d.ordinal(None))], "members long, ordinal_of_7 int, has_null boolean, label_12 int, ordinal_of_null long")


@_register("layout_policy", _values([(10, 10_000_000, "sparse_coo", 320), (90, 100, "dense", 800), (1 << 40, 1 << 50, "chunked_sparse", 32 << 40)], "nnz, total, layout, size"))
def layout_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(10, 10_000_000), (90, 100), (1 << 40, 1 << 50)]
    rows = [(n, t, (x := choose_layout(n, t, 3)), estimate_bytes(n, t, 3, x)) for n, t in cases]
    return _rows(spark, rows, "nnz long, total long, layout string, size long")


# Plans


def _two_facts(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("r"), F.col("n_nationkey").cast("long").alias("k"), F.lit(1.0).alias("v"))
    e.load_frame(nation, ["r", "k"], "v", "f")
    e.load_frame(nation.select("r", F.lit(0).cast("long").alias("z"), F.lit(2.0).alias("w")), ["r", "z"], "w", "g")
    return e


_PRODUCT = "SELECT r, SUM(v * w) AS s FROM f JOIN g GROUP BY r"


@_register("einsum_specs", _values([("SELECT r, SUM(v * w) AS s FROM f JOIN g GROUP BY r", "ab,ac->a"), ("SELECT SUM(v) AS s FROM f", "ab->"), ("SELECT z, r, COUNT(*) AS n FROM g GROUP BY z, r", "ab->ba")], "query, spec"))
def einsum_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _two_facts(spark, sf_dir)
    return _rows(spark, [(q, ";".join(e.einsum_of(q))) for q in (_PRODUCT, "SELECT SUM(v) AS s FROM f", "SELECT z, r, COUNT(*) AS n FROM g GROUP BY z, r")], "query string, spec string")


@_register("decomposition", _values([(0, "f", "g", "r", "", "r,k,z")], "step, left_side, right_side, kept, summed, result"))
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of binary products behind a query."""
    (chain,) = _two_facts(spark, sf_dir).decompose(_PRODUCT)
    return _rows(spark, [(i, c["left"], c["right"], ",".join(c["lambda"]), ",".join(c["mu"]), ",".join(c["result"])) for i, c in enumerate(chain)], "step int, left_side string, right_side string, kept string, summed string, result string")


@_register("algebraic_term", _values([("sum[k, z](product[1,0](f, g))",)], "term"))
def algebraic_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(t,) for t in _two_facts(spark, sf_dir).term(_PRODUCT)], "term string")


@_register("explain_text", _values([(0, "groups: r"), (1, "columns: r, s"), (2, "SUM((v * w)) = f.v * g.w"), (3, "frame f, g: ab,ac->a; about 1000 operations, 10 cells; parts by r"), (4, "  (1,0)-product with g: keeps r, sums -")], "line, text"))
def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, enumerate(_two_facts(spark, sf_dir).explain(_PRODUCT).splitlines()), "line int, text string")


@_register("partition_helpers", _values([("kind of r", "shared"), ("letters", "a"), ("ranges", "0-3,3-6,6-10"), ("replicated by r", "0"), ("replicated by z", "1"), ("split", "r")], "what, value"))
def partition_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _two_facts(spark, sf_dir).compile(_PRODUCT).steps[0]
    rows = [
        ("split", explain.split_axis(step, {})), ("kind of r", explain.axis_kinds(step)["r"]), ("replicated by r", str(explain.replication_factor(step, "r"))), ("replicated by z", str(explain.replication_factor(step, "z"))),
        ("ranges", ",".join(f"{a}-{b}" for a, b in explain.chunk_ranges(10, 3))), ("letters", "".join(explain.shared_letters(explain.spec(step)))),
    ]
    return _rows(spark, rows, "what string, value string")


@_register("plan_tools", _values([("cost of ab,bc->ac", "24 208"), ("decomposition needed", "False"), ("largest", "5"), ("operations", "5"), ("pushed", "f:k g:z"), ("spec", "a,a->a")], "what, value"))
def plan_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections pushed below a product, what it then costs, and the cost of a specification over operands of given shapes."""
    step = _two_facts(spark, sf_dir).compile(_PRODUCT).steps[0]
    pushed, gone = explain.push_projections(step)
    cost = explain.optimize_step(step, {"r": 5, "k": 25, "z": 1})
    rows = [
        ("spec", explain.spec(pushed)), ("pushed", " ".join(f"{o}:{','.join(axes)}" for o, axes in gone)), ("operations", str(cost["operations"])), ("largest", str(cost["largest"])),
        ("decomposition needed", str(explain.needs_decomposition(step))), ("cost of ab,bc->ac", "{} {}".format(*explain.spec_cost("ab,bc->ac", (2, 3), (3, 4)))),
    ]
    return _rows(spark, rows, "what string, value string")


# The algebra


@_register("spec_builders", _values([("ab,bc->ac",), ("abc,bcd->abd",)], "spec"))
def spec_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(build_spec([["x", "y"], ["y", "z"]], ["x", "z"]),), (build_einsum(3, 3, 1, 1),)], "spec string")


@_register("product_roles", _values([("supp", "summed"), ("flag", "kept")], "axis, role"))
def product_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _supply(spark, sf_dir)
    kept, gone = t.roles(t, keep=["flag"])
    return _rows(spark, [(a, "kept") for a in kept] + [(a, "summed") for a in gone], "axis string, role string")


@_register("algebra_signature", _values([(k, len(v), v[0]) for k, v in SIGNATURE.items()], "part, n, first_one"))
def algebra_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.tensors import describe_signature

    rows = [(k, [x.strip() for x in v.split(";")]) for k, _, v in (line.partition(": ") for line in describe_signature().splitlines())]
    return _rows(spark, [(k, len(v), v[0]) for k, v in rows], "part string, n int, first_one string")


_tensor("dense_roundtrip", f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, w AS value FROM {_G}", lambda s, d: Tensor.from_dense(s, _graph(s, d).to_dense(), ("a", "b")))
_tensor("reference_product", f"SELECT CAST(x.a AS BIGINT) AS a, CAST(y.b AS BIGINT) AS c, sum(x.w * y.w) AS value FROM {_G} x JOIN {_G} y ON x.b = y.a GROUP BY ALL", lambda s, d: _by_arrays(s, d))
for _ring, _fold in (("sum-prod", "sum(x.v * y.v)"), ("min-prod", "min(x.v * y.v)"), ("max-plus", "max(x.v + y.v)")):
    _tensor(f"semiring_{_ring.replace('-', '_')}", f"SELECT x.flag, y.flag AS other, round({_fold}, 2) AS value FROM {_S} x JOIN {_S} y USING (supp) GROUP BY ALL", lambda s, d, ring=_ring: (lambda t: t.product(t.rename(flag="other"), ring=ring, check=True))(_supply(s, d)))


def _by_arrays(spark: SparkSession, sf_dir: str) -> Tensor:
    """The product of a small tensor with itself by NumPy, which others are held against."""
    import numpy as np

    array = _graph(spark, sf_dir).to_dense()
    return Tensor.from_dense(spark, np.einsum("ab,bc->ac", array, array[: array.shape[1], :] if array.shape[0] >= array.shape[1] else np.vstack([array, np.zeros((array.shape[1] - array.shape[0], array.shape[1]))])), ("a", "c"))


# Shells


def _saved(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "catalog")
    _nations(spark, sf_dir).save(path)
    return path


def _typed(argv: list[str]) -> list[str]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = cli.main(argv)
    return [*out.getvalue().splitlines(), f"exit {code}"]


_LINES = "SELECT n_regionkey + 1 AS line, {0} AS text FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL)"


@_register("cli_csv", f"{_LINES.format("n_regionkey || ',' || n || ',' || n || '.0'")} UNION ALL SELECT 0, 'r,n,s' UNION ALL SELECT 6, 'exit 0'")
def cli_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, enumerate(_typed(["--db", _saved(spark, sf_dir), "--format", "csv", "query", _ASK])), "line int, text string")


@_register("cli_json", _ASKED)
def cli_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json.loads(_typed(["--db", _saved(spark, sf_dir), "--format", "json", "query", _ASK])[0])
    return _rows(spark, [(r["r"], r["n"], r["s"]) for r in rows], "r long, n long, s double")


@_register("cli_exit_codes", _values([("a query", 0), ("bad syntax", 2), ("unknown measure", 2), ("unknown role", 3)], "what, code"))
def cli_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = _saved(spark, sf_dir), []
    for what, more in {"a query": ["query", _ASK], "bad syntax": ["query", "SELECT FROM"], "unknown measure": ["query", "SELECT SUM(q_) FROM nations WHERE zz = 1"], "unknown role": ["--role", "nobody", "query", _ASK]}.items():
        with contextlib.redirect_stderr(io.StringIO()):
            out.append((what, int(_typed(["--db", path, *more])[-1].removeprefix("exit "))))
    return _rows(spark, out, "what string, code int")


@_register("repl", _values([(0, "1 cubes, 2 dimensions, 0 hierarchies, 0 roles"), (1, "groups: (one)"), (2, "[[]]"), (3, "n"), (4, "BindError: unknown source 'x'")], "place, first_line"))
def repl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session of the shell: what there is, an explanation, a decomposition, a query, an error."""
    lines = iter([r"\i", r"\e SELECT SUM(one) AS s FROM nations", r"\s SELECT SUM(one) AS s FROM nations", "SELECT COUNT(*) AS n FROM nations", "SELECT COUNT(*) AS n FROM x", r"\q"])
    said: list[str] = []
    cli.shell(Namespace(db=_saved(spark, sf_dir), role=None, format="text", limit=5), lambda _: next(lines), said.append)
    return _rows(spark, [(i, s.splitlines()[0]) for i, s in enumerate(said)], "place int, first_line string")


@_register("rest_query", _ASKED)
def rest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a query by the service, fetched in pages of two."""
    service, rows, more = Service(_nations(spark, sf_dir)), [], True
    while more:
        status, answer = service.handle("POST", "/query", {"sql": _ASK, "limit": 2, "offset": len(rows)})
        assert status == 200 and answer["columns"] == ["r", "n", "s"]
        rows, more = rows + answer["rows"], answer["more"]
    assert rows == service.handle("POST", "/query", {"sql": _ASK})[1]["rows"]
    return _rows(spark, rows, "r long, n long, s double")


@_register("rest_statuses", _values([("GET /health", 200), ("GET /catalog", 200), ("GET /cube/nations", 200), ("GET /cube/none", 404), ("POST /explain", 200), ("POST /query, bad", 400), ("POST /query, no sql", 400), ("POST /query, denied", 403), ("POST /query, unknown role", 404), ("DELETE /", 404)], "request, status"))
def rest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Service(_granted(spark, sf_dir))
    ask = {"sql": "SELECT SUM(one) AS s FROM nations"}
    out = [(f"GET {p}", s.handle("GET", p)[0]) for p in ("/health", "/catalog", "/cube/nations", "/cube/none")]
    out += [
        ("POST /explain", s.handle("POST", "/explain", ask)[0]), ("POST /query, bad", s.handle("POST", "/query", {"sql": "SELECT"})[0]), ("POST /query, no sql", s.handle("POST", "/query")[0]),
        ("POST /query, denied", s.handle("POST", "/query", ask | {"role": "other"}, {"X-Role": "grouper"})[0]), ("POST /query, unknown role", s.handle("POST", "/query", ask | {"role": "other"})[0]), ("DELETE /", s.handle("DELETE", "/")[0]),
    ]
    return _rows(spark, out, "request string, status int")


@_register("doctor", _values([("a job runs", True), ("numpy", True), ("pandas", True), ("pyarrow", True), ("pyspark", True), ("python", True)], "what, good"))
def doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of the environment whose outcome doesn't hang on the session's settings."""
    wanted = ("python", "pyspark", "a job runs", "pandas", "pyarrow", "numpy")
    return _rows(spark, [(what, good) for what, good, _ in checks(spark) if what in wanted], "what string, good boolean")


@_register("catalog_lookups", _values([("cube", "nations"), ("path", "k>half>all"), ("holders of one", "nations"), ("rollup", "25")], "what, value"))
def catalog_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nations(spark, sf_dir)
    e.add_hierarchy("k", "half", lambda k: (k >= 12).cast("int"))
    e.add_hierarchy("half", "all", lambda h: h * 0)
    c: Catalog = e.catalog
    rows = [("cube", c.cube("nations").name), ("path", ">".join(["k", *(s.parent for s in c.hierarchy_path("k", "all"))])), ("holders of one", ",".join(c.measures()["one"])), ("rollup", str(c.rollup("k", "all").count()))]
    return _rows(spark, rows, "what string, value string")
