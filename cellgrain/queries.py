"""The engine's operators as queries over the star schema of the test tables, each with the SQL it must agree with."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .operators.tensors import Tensor, contract, convolve, suppressed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (or else the warehouse), deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _month(day):
    return F.date_format(day, "yyyy-MM")


def _quarter(month):
    return F.concat(F.substring(month, 1, 4), F.lit("Q"), F.ceil(F.substring(month, 6, 2).cast("int") / 3).cast("string"))


def _year(quarter):
    return F.substring(quarter, 1, 4).cast("int")


def star(spark: SparkSession, sf_dir: str, *parts: str, cache: bool = False, cluster_by: str | None = None) -> Engine:
    """An engine with the parts that a query needs; ``cluster_by`` lays out lineitem's cached cells."""
    e = Engine(spark, cache=cache)
    lineitem_dims = ["l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "ship_day"]
    for part in parts:
        if part in ("lineitem", "extended"):
            lines = table(spark, sf_dir, "lineitem").withColumn("ship_day", F.to_date("l_shipdate"))
            e.load_frame(lines, lineitem_dims, "l_quantity" if part == "lineitem" else "l_extendedprice", part, cluster_by=cluster_by)
        elif part == "orders":
            orders = table(spark, sf_dir, "orders").withColumn("order_day", F.to_date("o_orderdate"))
            e.load_frame(orders, ["o_custkey", "o_orderstatus", "o_orderpriority", "order_day"], "o_totalprice", "orders")
        elif part == "null_orders":
            # every seventh order without a priority, every fifth without a price
            orders = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
            orders = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
            e.load_frame(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "orders")
        elif part == "events":
            events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
            e.load_frame(events, ["user_id", "event_type", "day"], "value", "events")
        elif part == "part":
            e.load_dimension(table(spark, sf_dir, "part"), "p_partkey", "l_partkey", attributes=["p_brand", "p_type", "p_size"], measures=["p_retailprice"])
        elif part == "supplier":
            e.load_dimension(table(spark, sf_dir, "supplier"), "s_suppkey", "l_suppkey", attributes=["s_name"], measures=["s_acctbal"])
        elif part == "customer":
            e.load_dimension(table(spark, sf_dir, "customer"), "c_custkey", "o_custkey", attributes=["c_mktsegment"], measures=["c_acctbal"])
        elif part == "ship_calendar":
            e.add_hierarchy("ship_day", "ship_month", _month, True)
            e.add_hierarchy("ship_month", "ship_quarter", _quarter, True)
            e.add_hierarchy("ship_quarter", "ship_year", _year, True)
        elif part == "order_calendar":
            e.add_hierarchy("order_day", "order_month", _month, True)
            e.add_hierarchy("order_month", "order_quarter", _quarter, True)
            e.add_hierarchy("order_quarter", "order_year", _year, True)
        elif part == "customer_geography":
            nation = table(spark, sf_dir, "nation")
            customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            e.add_hierarchy("o_custkey", "nation", customers.select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("nation")))
            regions = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            e.add_hierarchy("nation", "region", regions.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region")))
        elif part == "supply":
            # a second fact that shares parts with lineitem: a plan for each part and quarter
            plan = table(spark, sf_dir, "lineitem").select("l_partkey", F.quarter("l_shipdate").alias("plan_quarter"), F.col("l_tax").alias("plan"))
            e.load_frame(plan, ["l_partkey", "plan_quarter"], "plan", "supply")
        elif part == "flags":
            # a fact that shares parts and return flags with lineitem
            flags = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.col("l_discount").alias("discount"))
            e.load_frame(flags, ["l_partkey", "l_returnflag"], "discount", "flags")
        elif part == "sizes":
            sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
            e.load_frame(sizes, ["size"], "price", "sizes")
        elif part == "quantities":
            quantities = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("quantity"), "l_returnflag", F.col("l_tax").alias("tax"))
            e.load_frame(quantities, ["quantity", "l_returnflag"], "tax", "quantities")
    return e


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def rounded_pairs(df: DataFrame, digits: int) -> DataFrame:
    """As ``rounded``, for very many rows: no decimal is made for a double, halves go away from zero as in DuckDB."""
    scale = 10.0**digits

    def of(c: Column) -> Column:
        whole = F.floor(F.abs(c) * scale + 0.5)
        return F.when(F.abs(c) < 1e15 / scale, F.when(c < 0, -whole).otherwise(whole) / scale).otherwise(F.round(c, digits))

    return df.withColumns({f.name: of(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def _ask(name: str, parts: str, query: str, oracle: str, digits: int = 2, role: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(star(spark, sf_dir, *parts.split()).frame(query), digits)

    QUERIES[name] = run
    ORACLES[name] = oracle


def _register(name: str, oracle: str | None):
    def put(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return put


_CELLS = "(SELECT l_suppkey, l_partkey, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS ship_day, sum(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY ALL)"
_QUARTER = "strftime({0}, '%Y') || 'Q' || CAST(quarter({0}) AS VARCHAR)"

# Aggregates and groups
_ask("scan_sum", "lineitem", "SELECT SUM(l_quantity) AS s, COUNT(*) AS n FROM lineitem", "SELECT round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem")
_ask("group_sum_1d", "lineitem", "SELECT l_suppkey, SUM(l_quantity) AS s FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL")
_ask("group_sum_2d", "lineitem", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY ALL")
_ask("group_sum_wide", "lineitem", "SELECT l_suppkey, l_partkey, ship_day, SUM(l_quantity) AS s FROM lineitem GROUP BY l_suppkey, l_partkey, ship_day", "SELECT l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS ship_day, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL")
_ask("star_projection", "lineitem", "SELECT *, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL")
_ask("scalar_agg", "extended", "SELECT SUM(l_extendedprice) AS s, AVG(l_extendedprice) AS a, 2 AS two FROM extended", "SELECT round(sum(l_extendedprice), 2) AS s, round(avg(l_extendedprice), 2) AS a, 2.0 AS two FROM lineitem")
_ask("count_star", "lineitem ship_calendar", "SELECT ship_month, COUNT(*) AS n FROM lineitem GROUP BY ship_month", "SELECT strftime(l_shipdate, '%Y-%m') AS ship_month, count(*) AS n FROM lineitem GROUP BY ALL")
_ask("count_measure", "null_orders", "SELECT o_orderstatus, COUNT(o_totalprice) AS k, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END) AS k, count(*) AS n FROM orders GROUP BY ALL")
_ask("avg", "lineitem ship_calendar", "SELECT ship_quarter, AVG(l_quantity) AS a FROM lineitem GROUP BY ship_quarter", f"SELECT {_QUARTER.format('l_shipdate')} AS ship_quarter, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY ALL", 4)
_ask("ratio_of_aggs", "lineitem extended", "SELECT l_returnflag, SUM(l_extendedprice) / SUM(l_quantity) AS r, -(100 * COUNT(l_quantity) - 1) AS z FROM lineitem JOIN extended GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS r, 1.0 - 100 * count(*) AS z FROM lineitem GROUP BY ALL", 4)
_ask("division_by_zero", "lineitem", "SELECT l_returnflag, SUM(l_quantity) / (SUM(l_quantity) - SUM(l_quantity)) AS r FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, 0.0 AS r FROM lineitem")
_ask("linear_expr", "lineitem part", "SELECT l_returnflag, SUM(l_quantity * p_retailprice / 4 - 3 * l_quantity) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity * p_retailprice / 4 - 3 * l_quantity), 2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
_ask("const_sum", "lineitem", "SELECT l_returnflag, SUM(2) AS two, SUM(l_quantity + 1) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, 2.0 * count(*) AS two, round(sum(l_quantity + 1), 2) AS p FROM lineitem GROUP BY ALL")
_ask("count_distinct", "lineitem", "SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS d FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY ALL")
_ask("count_distinct_filtered", "lineitem part ship_calendar", "SELECT l_returnflag, COUNT(DISTINCT ship_day) AS d, SUM(l_quantity) AS s FROM lineitem WHERE p_size > 25 AND ship_year = 1998 GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT CAST(l_shipdate AS DATE)) AS d, round(sum(l_quantity), 2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 AND year(l_shipdate) = 1998 GROUP BY ALL")
_ask("select_distinct", "lineitem ship_calendar", "SELECT DISTINCT l_returnflag, ship_year FROM lineitem", "SELECT DISTINCT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem")
_ask("min_cells", "lineitem", "SELECT l_returnflag, MIN(l_quantity) AS m FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, round(min(v), 2) AS m FROM {_CELLS} GROUP BY ALL")
_ask("max_cells", "lineitem part", "SELECT l_linestatus, MAX(l_quantity) AS m FROM lineitem WHERE p_size < 10 GROUP BY l_linestatus", f"SELECT l_linestatus, round(max(v), 2) AS m FROM {_CELLS} JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY ALL")
_ask("max_rollup", "lineitem ship_calendar", "SELECT ship_year, MAX(l_quantity) AS m, MIN(l_quantity) AS k FROM lineitem GROUP BY ship_year", f"SELECT CAST(year(ship_day) AS INTEGER) AS ship_year, round(max(v), 2) AS m, round(min(v), 2) AS k FROM {_CELLS} GROUP BY ALL")
_ask("cell_square", "lineitem", "SELECT l_returnflag, SUM(l_quantity * l_quantity) AS s, AVG(l_quantity * l_quantity) AS a FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, round(sum(v * v), 4) AS s, round(sum(v * v) / sum(n), 4) AS a FROM {_CELLS} GROUP BY ALL", 4)
_ask("case_sum", "lineitem part", "SELECT l_returnflag, SUM(CASE WHEN p_size > 25 THEN l_quantity ELSE 0 END) AS big FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(CASE WHEN p_size > 25 THEN l_quantity ELSE 0 END), 2) AS big FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
_ask("case_multi_branch", "lineitem part ship_calendar", "SELECT l_linestatus, SUM(CASE WHEN p_size > 40 THEN l_quantity * 2 WHEN ship_year = 1997 THEN l_quantity * p_retailprice ELSE 1 END) AS x FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(sum(CASE WHEN p_size > 40 THEN l_quantity * 2 WHEN year(l_shipdate) = 1997 THEN l_quantity * p_retailprice ELSE 1 END), 2) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
_ask("case_count_as_sum", "lineitem", "SELECT SUM(CASE WHEN l_returnflag = 'R' THEN 1 END) AS r, COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS c, AVG(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS a FROM lineitem", "SELECT sum(CASE WHEN l_returnflag = 'R' THEN 1.0 END)::DOUBLE AS r, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS c, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS a FROM lineitem", 4)
_ask("having", "lineitem", "SELECT l_suppkey, SUM(l_quantity) AS s, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING s > 1000 AND NOT COUNT(*) < 20 OR l_suppkey = 3", "SELECT l_suppkey, round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 1000 AND NOT count(*) < 20 OR l_suppkey = 3")
_ask("order_limit", "lineitem", "SELECT l_suppkey, SUM(l_quantity) AS s FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC, l_suppkey LIMIT 7", "SELECT l_suppkey, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 7")

# Filters
_ask("attr_filter", "lineitem part", "SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem WHERE p_brand = 'Brand#11' AND l_partkey.p_size <> 7 GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11' AND p_size <> 7 GROUP BY ALL")
_ask("range_filter", "lineitem ship_calendar", "SELECT ship_month, SUM(l_quantity) AS s FROM lineitem WHERE ship_day >= '1998-05-01' AND l_suppkey < 8 GROUP BY ship_month", "SELECT strftime(l_shipdate, '%Y-%m') AS ship_month, round(sum(l_quantity), 2) AS s FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1998-05-01' AND l_suppkey < 8 GROUP BY ALL")
_ask("between_filter", "lineitem", "SELECT l_suppkey, SUM(l_quantity) AS s FROM lineitem WHERE l_suppkey BETWEEN 3 AND 6 AND ship_day NOT BETWEEN '1996-01-01' AND '1999-12-31' GROUP BY l_suppkey", "SELECT l_suppkey, round(sum(l_quantity), 2) AS s FROM lineitem WHERE l_suppkey BETWEEN 3 AND 6 AND CAST(l_shipdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY ALL")
_ask("in_list", "lineitem", "SELECT l_linestatus, SUM(l_quantity) AS s FROM lineitem WHERE l_suppkey IN (1, 2, 5, 99999) AND l_returnflag IN ('A', R) GROUP BY l_linestatus", "SELECT l_linestatus, round(sum(l_quantity), 2) AS s FROM lineitem WHERE l_suppkey IN (1, 2, 5, 99999) AND l_returnflag IN ('A', 'R') GROUP BY ALL")
_ask("not_in", "null_orders", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS p FROM orders) WHERE p NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
_ask("or_across_axes", "lineitem part", "SELECT l_linestatus, SUM(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'A' OR p_size = 5 OR l_suppkey > 9 AND l_returnflag != 'N' GROUP BY l_linestatus", "SELECT l_linestatus, round(sum(l_quantity), 2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' OR p_size = 5 OR l_suppkey > 9 AND l_returnflag <> 'N' GROUP BY ALL")
_ask("not_predicate", "null_orders", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE NOT (o_orderpriority = '1-URGENT' OR o_orderstatus = 'F') GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END = '1-URGENT' OR o_orderstatus = 'F') GROUP BY ALL")
_ask("in_subquery", "lineitem part", "SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM l_partkey WHERE p_size < 5 AND p_type <> 'x') GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5 AND p_type <> 'x') GROUP BY ALL")
_ask("not_in_subquery", "lineitem part", "SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM l_partkey WHERE p_size >= 5) GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 5) GROUP BY ALL")
_ask("is_null", "null_orders", "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders WHERE o_orderpriority IS NULL GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, round(coalesce(sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END), 0), 2) AS s FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL")
_ask("is_not_null", "null_orders", "SELECT o_orderpriority, COUNT(*) AS n, AVG(o_totalprice) AS a FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END), 2) AS a FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL")
_ask("null_group", "null_orders", "SELECT o_orderpriority, SUM(o_totalprice) AS s, COUNT(*) AS n FROM orders GROUP BY o_orderpriority", "SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority, round(coalesce(sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END), 0), 2) AS s, count(*) AS n FROM orders GROUP BY 1")

# Dimensions and hierarchies
_ask("dim_measure_join", "lineitem part", "SELECT l_returnflag, SUM(l_quantity * p_retailprice) AS revenue FROM lineitem JOIN l_partkey ON lineitem.l_partkey = l_partkey.l_partkey GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity * p_retailprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
_ask("two_dim_measures", "lineitem part supplier", "SELECT l_returnflag, SUM(l_quantity * (p_retailprice + s_acctbal)) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity * (p_retailprice + s_acctbal)), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
_ask("dimension_only", "part", "SELECT SUM(p_retailprice) AS s, COUNT(*) AS n FROM l_partkey WHERE p_size > 10", "SELECT round(sum(p_retailprice), 2) AS s, count(*) AS n FROM part WHERE p_size > 10")
_ask("hierarchy_rollup_month", "lineitem ship_calendar", "SELECT ship_month, SUM(l_quantity) AS s FROM lineitem GROUP BY ship_month", "SELECT strftime(l_shipdate, '%Y-%m') AS ship_month, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL")
_ask("hierarchy_chain_year", "orders customer order_calendar", "SELECT order_year, COUNT(DISTINCT o_custkey) AS d, SUM(o_totalprice) AS s FROM orders WHERE c_mktsegment = 'BUILDING' GROUP BY order_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(DISTINCT o_custkey) AS d, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
_ask("hierarchy_geo_region", "orders customer_geography", "SELECT region, SUM(o_totalprice) AS s, COUNT(*) AS n FROM orders GROUP BY region", "SELECT r_name AS region, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
_ask("ancestor_filter", "orders customer_geography order_calendar", "SELECT nation, AVG(o_totalprice) AS a FROM orders WHERE region = 'ASIA' AND order_quarter >= '1998Q2' GROUP BY nation", f"SELECT n_name AS nation, round(avg(o_totalprice), 2) AS a FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND {_QUARTER.format('o_orderdate')} >= '1998Q2' GROUP BY ALL")

# Joins of facts
_PLAN = "(SELECT l_partkey, CAST(quarter(l_shipdate) AS INTEGER) AS plan_quarter, l_tax AS plan FROM lineitem)"
_FLAGS = "(SELECT l_partkey, l_returnflag, l_discount AS discount FROM lineitem)"
_ask("two_fact_lam1_mu1", "lineitem supply", "SELECT l_returnflag, plan_quarter, SUM(l_quantity * plan) AS x FROM lineitem JOIN supply ON lineitem.l_partkey = supply.l_partkey GROUP BY l_returnflag, plan_quarter", f"SELECT l_returnflag, plan_quarter, round(sum(l_quantity * plan), 2) AS x FROM lineitem JOIN {_PLAN} USING (l_partkey) GROUP BY ALL")
_ask("two_fact_mu2", "lineitem flags", "SELECT l_linestatus, SUM(l_quantity * discount) AS x, COUNT(*) AS n FROM lineitem JOIN flags GROUP BY l_linestatus", f"SELECT l_linestatus, round(sum(l_quantity * discount), 2) AS x, count(*) AS n FROM lineitem JOIN {_FLAGS} USING (l_partkey, l_returnflag) GROUP BY ALL")
_ask("two_fact_lam2_mu0", "lineitem flags", "SELECT l_partkey, l_returnflag, SUM(l_quantity * discount) AS x FROM lineitem JOIN flags GROUP BY l_partkey, l_returnflag", f"SELECT l_partkey, l_returnflag, round(sum(l_quantity * discount), 2) AS x FROM lineitem JOIN {_FLAGS} USING (l_partkey, l_returnflag) GROUP BY ALL")
_ask("pair_count", "lineitem supply", "SELECT COUNT(*) AS n, SUM(l_quantity * plan) AS s FROM lineitem JOIN supply", f"SELECT count(*) AS n, round(sum(l_quantity * plan), 2) AS s FROM lineitem JOIN {_PLAN} USING (l_partkey)")
_ask("avg_over_pairs", "lineitem supply", "SELECT plan_quarter, AVG(l_quantity * plan) AS a FROM lineitem JOIN supply GROUP BY plan_quarter", f"SELECT plan_quarter, round(avg(l_quantity * plan), 6) AS a FROM lineitem JOIN {_PLAN} USING (l_partkey) GROUP BY ALL", 6)
_ask("no_fan_out", "lineitem supply", "SELECT l_partkey, SUM(l_quantity) AS q, SUM(plan) AS p, COUNT(*) AS n FROM lineitem JOIN supply GROUP BY l_partkey", f"SELECT l_partkey, q, round(p, 2) AS p, a.n * b.n AS n FROM (SELECT l_partkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL) a JOIN (SELECT l_partkey, sum(plan) AS p, count(*) AS n FROM {_PLAN} GROUP BY ALL) b USING (l_partkey)")
_ask("left_join", "lineitem flags", "SELECT l_partkey, SUM(l_quantity) AS q, SUM(discount) AS d, COUNT(*) AS n FROM lineitem LEFT JOIN flags GROUP BY l_partkey", f"SELECT l_partkey, max(q) AS q, round(coalesce(max(d), 0), 2) AS d, sum(n) AS n FROM (SELECT l_partkey, CAST(sum(a.n * coalesce(b.n, 1)) AS BIGINT) AS n FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) a LEFT JOIN (SELECT l_partkey, l_returnflag, count(*) AS n FROM {_FLAGS} GROUP BY ALL) b USING (l_partkey, l_returnflag) GROUP BY ALL) JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) USING (l_partkey) LEFT JOIN (SELECT l_partkey, sum(discount) AS d FROM {_FLAGS} GROUP BY ALL) USING (l_partkey) GROUP BY ALL".replace("sum(n) AS n FROM (SELECT l_partkey, CAST", "CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_partkey, CAST"))
_QUANTITIES = "(SELECT CAST(l_quantity AS INTEGER) AS quantity, l_returnflag, l_tax AS tax FROM lineitem)"
_SIZES = "(SELECT p_size AS size, p_retailprice AS price FROM part)"
_ask("theta_join_le", "quantities sizes", "SELECT l_returnflag, SUM(tax * price) AS x, COUNT(*) AS n FROM quantities JOIN sizes ON quantities.quantity <= sizes.size GROUP BY l_returnflag", f"SELECT l_returnflag, round(sum(tax * price), 2) AS x, CAST(sum(m) AS BIGINT) AS n FROM (SELECT l_returnflag, quantity, sum(tax) AS tax, count(*) AS k FROM {_QUANTITIES} GROUP BY ALL) JOIN (SELECT size, sum(price) AS price, count(*) AS j FROM {_SIZES} GROUP BY ALL) ON quantity <= size, LATERAL (SELECT k * j AS m) GROUP BY ALL")
_ask("theta_join_ne", "quantities sizes", "SELECT size, COUNT(*) AS n FROM quantities JOIN sizes ON quantities.quantity <> sizes.size GROUP BY size", f"SELECT size, CAST(sum(k * j) AS BIGINT) AS n FROM (SELECT quantity, count(*) AS k FROM {_QUANTITIES} GROUP BY ALL) JOIN (SELECT size, count(*) AS j FROM {_SIZES} GROUP BY ALL) ON quantity <> size GROUP BY ALL")
_ask("equi_join_renamed", "quantities sizes", "SELECT quantity, SUM(tax * price) AS x FROM quantities JOIN sizes ON quantities.quantity = sizes.size GROUP BY quantity", f"SELECT quantity, round(sum(tax) * max(price), 2) AS x FROM {_QUANTITIES} JOIN (SELECT size, sum(price) AS price FROM {_SIZES} GROUP BY ALL) ON quantity = size GROUP BY ALL")
_ask("cross_product", "quantities sizes", "SELECT l_returnflag, COUNT(*) AS n, SUM(tax * price) AS x FROM quantities JOIN sizes GROUP BY l_returnflag", f"SELECT l_returnflag, count(*) * (SELECT count(*) FROM part) AS n, round(sum(tax) * (SELECT sum(price) FROM {_SIZES}), 2) AS x FROM {_QUANTITIES} GROUP BY ALL")
_ask("levels_of_a_hierarchy", "orders order_calendar", "SELECT order_year, SUM(o_totalprice) AS s FROM orders WHERE order_month BETWEEN '1997-03' AND '1998-02' GROUP BY order_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, round(sum(o_totalprice), 2) AS s FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1997-03' AND '1998-02' GROUP BY ALL")

# Windows. The order is that of the dictionary of all members, so that a frame of n preceding ones counts members, not rows.
_DAYS = "(SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)"
_ask("running_sum", "lineitem ship_calendar", "SELECT ship_year, SUM(l_quantity) OVER (ORDER BY ship_year) AS r FROM lineitem GROUP BY ship_year", "SELECT ship_year, round(sum(s) OVER (ORDER BY ship_year), 2) AS r FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, sum(l_quantity) AS s FROM lineitem GROUP BY ALL)")
_ask("moving_sum_3", "events", "SELECT event_type, day, SUM(value) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM events GROUP BY event_type, day", f"SELECT event_type, day, round(sum(v) OVER (PARTITION BY event_type ORDER BY pos RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS m FROM {_DAYS} JOIN (SELECT day, row_number() OVER (ORDER BY day) AS pos FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)) USING (day)")
_ask("moving_sum_gaps", "events", "SELECT user_id, day, SUM(value) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM events GROUP BY user_id, day", "SELECT user_id, day, round(sum(v) OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS m FROM (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL) JOIN (SELECT day, row_number() OVER (ORDER BY day) AS pos FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)) USING (day)")
_ask("running_sum_partitioned", "events", "SELECT event_type, day, SUM(value) OVER (PARTITION BY event_type ORDER BY day) AS r, COUNT(*) OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM events GROUP BY event_type, day", f"SELECT event_type, day, round(sum(v) OVER (PARTITION BY event_type ORDER BY day), 2) AS r, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day DESC) AS BIGINT) AS k FROM {_DAYS}")
_ask("running_avg", "events", "SELECT event_type, day, AVG(value) OVER (ORDER BY day) AS a FROM events GROUP BY event_type, day", f"SELECT event_type, day, round(sum(v) OVER w / sum(n) OVER w, 4) AS a FROM {_DAYS} WINDOW w AS (PARTITION BY event_type ORDER BY day)", 4)


@_register("flagship", "SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment and year: a fact joined with its orders, a calendar, and customers by segment."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    e = Engine(spark)
    e.load_frame(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), ["o_custkey", "day"], "revenue", "sales")
    e.add_hierarchy("day", "year", lambda d: F.year(d))
    e.add_hierarchy("o_custkey", "segment", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")))
    return rounded(e.frame("SELECT segment, year, SUM(revenue) AS revenue, COUNT(*) AS n FROM sales GROUP BY segment, year"))


@_register("rls_masked_total", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, count(DISTINCT l_suppkey) AS d FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey IN (1, 2, 3) AND year(l_shipdate) = 1997 GROUP BY ALL")
def rls_masked_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star(spark, sf_dir, "lineitem", "ship_calendar")
    e.grant("analyst", "l_suppkey", [1, 2, 3])
    e.grant("analyst", "ship_year", [1997])
    return rounded(e.frame("SELECT l_returnflag, SUM(l_quantity) AS s, COUNT(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_returnflag", "analyst"))


@_register("cell_suppression", "SELECT l_suppkey, l_partkey, CAST(year(l_shipdate) AS INTEGER) AS ship_year, CASE WHEN count(*) >= 5 THEN round(sum(l_quantity), 2) END AS s, count(*) AS n FROM lineitem GROUP BY ALL")
def cell_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by supplier, part and year are fine enough for some to have fewer than 5 lines."""
    e = star(spark, sf_dir, "lineitem", "ship_calendar")
    return rounded(suppressed(e.frame("SELECT l_suppkey, l_partkey, ship_year, SUM(l_quantity) AS s, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey, ship_year"), "s", "n", 5))


for _agg, _sql in (("max", "max(l_quantity)"), ("min", "min(l_quantity)"), ("count", "CAST(count(*) AS DOUBLE)"), ("mean", "avg(l_quantity)")):

    def _load(spark: SparkSession, sf_dir: str, agg: str = _agg) -> DataFrame:
        e = Engine(spark)
        e.load_frame(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", "cube", agg=agg)
        return rounded(e.frame("SELECT l_returnflag, SUM(l_quantity) AS s, MAX(l_quantity) AS m FROM cube GROUP BY l_returnflag"))

    QUERIES[f"load_agg_{_agg}"] = _load
    ORACLES[f"load_agg_{_agg}"] = f"SELECT l_returnflag, round(sum(v), 2) AS s, round(max(v), 2) AS m FROM (SELECT l_suppkey, l_returnflag, {_sql} AS v FROM lineitem GROUP BY ALL) GROUP BY ALL"


@_register("incremental_merge", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading is additive: the cube of two halves is the sum of their cubes."""
    parts = []
    for rest in (0, 1):
        e = Engine(spark)
        cube = e.load_frame(table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 2 == rest), ["l_returnflag", "l_linestatus"], "l_quantity", "cube")
        parts.append(Tensor(cube.cells, cube.dims))
    return rounded((parts[0] + parts[1]).df)


@_register("save_open_roundtrip", "SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS ship_year, round(sum(l_quantity * p_retailprice), 2) AS r, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 AND l_suppkey <> 2 GROUP BY ALL")
def save_open_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "catalog")
    e = star(spark, sf_dir, "lineitem", "part", "ship_calendar")
    e.grant("analyst", "l_suppkey", table(spark, sf_dir, "supplier").where("s_suppkey <> 2").select(F.col("s_suppkey").alias("l_suppkey")))
    e.save(path)
    return rounded(Engine.open(spark, path).frame("SELECT l_returnflag, ship_year, SUM(l_quantity * p_retailprice) AS r, COUNT(*) AS n FROM lineitem WHERE p_size > 10 GROUP BY l_returnflag, ship_year", "analyst"))


@_register("csv_roundtrip", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n, round(sum(n_nationkey * 1.5), 2) AS s FROM nation GROUP BY ALL")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "nations")
    table(spark, sf_dir, "nation").withColumn("weight", F.col("n_nationkey") * 1.5).write.option("header", True).csv(path)
    e = Engine(spark)
    e.load_csv(path, ["n_regionkey", "n_name"], "weight", "nations", schema="n_nationkey int, n_name string, n_regionkey int, weight double")
    return rounded(e.frame("SELECT n_regionkey, COUNT(*) AS n, SUM(weight) AS s FROM nations GROUP BY n_regionkey"))


# Tensors


def _embeddings(spark: SparkSession, sf_dir: str) -> Tensor:
    """All vectors as a matrix vec x k."""
    df = table(spark, sf_dir, "embeddings")
    size = df.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).alias("n")).first()["n"]
    df = df.select(F.col("vec_id").alias("vec"), F.posexplode("embedding").alias("k", "value")).withColumn("k", F.col("k").cast("long"))
    return Tensor(df, ("vec", "k"), {"vec": size, "k": 64})


def _supply(spark: SparkSession, sf_dir: str) -> Tensor:
    """Quantities by supplier and return flag."""
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("value"))
    return Tensor(df, ("supp", "flag"))


_E = "(SELECT vec_id AS vec, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"
_S = "(SELECT l_suppkey AS supp, l_returnflag AS flag, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _tensor(name: str, oracle: str, make: Callable[[SparkSession, str], Tensor], digits: int = 2, by: Callable[[DataFrame, int], DataFrame] = rounded) -> None:
    QUERIES[name] = lambda spark, sf_dir: by(make(spark, sf_dir).df, digits)
    ORACLES[name] = oracle


def _vectors(name: str, oracle: str, make: Callable[[Callable[[], Tensor]], Tensor], digits: int = 2, by: Callable[[DataFrame, int], DataFrame] = rounded) -> None:
    _tensor(name, oracle, lambda s, d: make(lambda: _embeddings(s, d)), digits, by)


_vectors("contract_matmul", f"SELECT a.vec, b.vec AS other, round(sum(a.v * b.v), 4) AS value FROM {_E} a JOIN {_E} b USING (k) GROUP BY ALL", lambda e: e().product(e().rename(vec="other"), blocks=True), 4, rounded_pairs)
_tensor("batched_product", f"SELECT a.supp, a.flag, round(sum(a.v * b.v), 2) AS value FROM {_S} a JOIN {_S} b USING (supp, flag) GROUP BY ALL", lambda s, d: _supply(s, d).product(_supply(s, d), keep=("supp", "flag")))
_tensor("outer_product", f"SELECT a.flag, b.flag AS other, round(a.v * b.v, 2) AS value FROM (SELECT flag, sum(v) AS v FROM {_S} GROUP BY ALL) a, (SELECT flag, sum(v) AS v FROM {_S} GROUP BY ALL) b", lambda s, d: (lambda t: t.product(t.rename(flag="other")))(_supply(s, d).reduce(["supp"])))
_vectors("positional_product", f"SELECT a.vec AS x0, b.vec AS y0, round(sum(a.v * b.v), 4) AS value FROM {_E} a JOIN {_E} b USING (k) GROUP BY ALL", lambda e: convolve(e(), e().transpose(("k", "vec")), 0, 1, blocks=True), 4, rounded_pairs)
_vectors("chain_contraction", f"SELECT round(sum(a.v * b.v * c.v), 3) AS value FROM {_E} a JOIN {_E} b USING (k) JOIN {_E} c ON c.vec = b.vec AND c.k = 1", lambda e: contract([e(), e().rename(vec="other"), e().rename(vec="other").slice(k=1)], ()), 3)
_tensor("elementwise_add", f"SELECT supp, flag, round(v + coalesce(w, 0), 2) AS value FROM {_S} LEFT JOIN (SELECT supp, flag, 2 * v AS w FROM {_S} WHERE flag = 'A') USING (supp, flag)", lambda s, d: _supply(s, d) + _supply(s, d).where(flag=["A"]) * 2.0)
_tensor("elementwise_div", f"SELECT supp, flag, round(CASE WHEN coalesce(w, 0) <> 0 THEN v / w ELSE 0 END, 4) AS value FROM {_S} LEFT JOIN (SELECT supp, flag, v + 1 - 1 AS w FROM {_S} WHERE flag <> 'A') USING (supp, flag)", lambda s, d: _supply(s, d) / _supply(s, d).where(flag=["N", "R"]), 4)
_vectors("elementwise_broadcast", f"SELECT a.vec, a.k, round(a.v - b.v, 4) AS value FROM {_E} a JOIN {_E} b ON a.k = b.k AND b.vec = 0", lambda e: e() - e().slice(vec=0), 4)
_vectors("trace", f"SELECT round(sum(v), 4) AS value FROM {_E} WHERE vec = k", lambda e: e().trace("vec", "k"), 4)
_tensor("slice", f"SELECT vec // 2 AS vec, round(v, 4) AS value FROM {_E} WHERE k = 3 AND vec BETWEEN 10 AND 19 AND vec % 2 = 0".replace("vec // 2 AS vec", "(vec - 10) // 2 AS vec"), lambda s, d: _embeddings(s, d).slice(k=3, vec=slice(10, 20, 2)), 4)
_vectors("project_max", f"SELECT vec, round(max(v), 4) AS value FROM {_E} GROUP BY ALL", lambda e: e().project(["k"], "max"), 4)
_vectors("project_mean", f"SELECT k, round(avg(v), 4) AS value FROM {_E} GROUP BY ALL", lambda e: e().project(["vec"], "mean"), 4)
_vectors("product_reduce", f"SELECT vec, round(product(1 + v / 10), 4) AS value FROM {_E} GROUP BY ALL", lambda e: (e() * 0.1 + 1.0).reduce(["k"], "prod"), 4)
_tensor("indicator", f"SELECT supp, flag, 1.0 AS value FROM {_S} WHERE v <> 0", lambda s, d: _supply(s, d).indicator())
_tensor("rollup_max", f"SELECT CASE WHEN flag = 'A' THEN 'x' ELSE 'y' END AS half, supp, round(max(v), 2) AS value FROM {_S} GROUP BY ALL", lambda s, d: _supply(s, d).rollup("flag", "half", {"A": "x", "N": "y", "R": "y"}, "max"))
_tensor("tensor_count_distinct", f"SELECT flag, CAST(count(DISTINCT supp) AS DOUBLE) AS value FROM {_S} WHERE v <> 0 GROUP BY ALL", lambda s, d: _supply(s, d).count_distinct("supp", ("flag",)))
_vectors("semiring_max_prod", f"SELECT a.vec, b.vec AS other, round(max(abs(a.v) * abs(b.v)), 4) AS value FROM {_E} a JOIN {_E} b USING (k) GROUP BY ALL", lambda e: (lambda t: t.product(t.rename(vec="other"), ring="max-prod", check=True, blocks=True))(_absolute(e())), 4, rounded_pairs)
_vectors("semiring_min_plus", f"SELECT a.vec, b.vec AS other, round(min(a.v + b.v), 4) AS value FROM {_E} a JOIN {_E} b USING (k) GROUP BY ALL", lambda e: e().product(e().rename(vec="other"), ring="min-plus", blocks=True), 4, rounded_pairs)
_tensor("semiring_bool", f"SELECT a.supp, b.supp AS other, 1.0 AS value FROM {_S} a JOIN {_S} b USING (flag) GROUP BY ALL", lambda s, d: (lambda t: t.product(t.rename(supp="other"), ring="bool-or-and", blocks=True))(_supply(s, d).indicator()), by=rounded_pairs)
_vectors("unit_identity", f"SELECT vec, k2, round(v, 4) AS value FROM (SELECT vec, k AS k2, v FROM {_E})", lambda e: e().product(Tensor.unit(e().df.sparkSession, {"k": ("k2", 64)})), 4)
_vectors("weighted_window", f"SELECT a.vec, w.t AS k, round(sum(a.v * w.w), 4) AS value FROM {_E} a JOIN (SELECT i AS f, j AS t, 1.0 / (1 + j - i) AS w FROM range(64) x(i), range(64) y(j) WHERE j - i BETWEEN 0 AND 3) w ON a.k = w.f GROUP BY ALL", lambda e: e().weighted_window("k", [[1.0 / (1 + j - i) if 0 <= j - i <= 3 else 0.0 for j in range(64)] for i in range(64)]), 4)
_vectors("tensor_running", f"SELECT a.vec, CAST(j AS BIGINT) AS k, round(sum(a.v), 4) AS value FROM {_E} a JOIN range(64) y(j) ON a.k <= j AND a.k >= j - 4 GROUP BY ALL", lambda e: e().running("k", 4), 4)


def _absolute(t: Tensor) -> Tensor:
    return t._like(t.df.withColumn("value", F.abs("value")), t.axes)


def _graph(spark: SparkSession, sf_dir: str) -> Tensor:
    """Nations of one region follow each other; the weight is the difference of their keys."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    b = nation.select(F.col("k").alias("b"), "n_regionkey")
    edges = nation.withColumnRenamed("k", "a").join(b, "n_regionkey").where("b > a and b < a + 9").select("a", "b", (F.col("b") - F.col("a")).cast("double").alias("value"))
    return Tensor(edges, ("a", "b"))


_G = "(SELECT x.n_nationkey AS a, y.n_nationkey AS b, CAST(y.n_nationkey - x.n_nationkey AS DOUBLE) AS w FROM nation x JOIN nation y USING (n_regionkey) WHERE y.n_nationkey > x.n_nationkey AND y.n_nationkey < x.n_nationkey + 9)"
QUERIES["graph_walks"] = lambda spark, sf_dir: _graph(spark, sf_dir).walks(3)
ORACLES["graph_walks"] = f"SELECT CAST(e.a AS BIGINT) AS v0, CAST(e.b AS BIGINT) AS v1, CAST(f.b AS BIGINT) AS v2, CAST(g.b AS BIGINT) AS v3, e.w * f.w * g.w AS value FROM {_G} e JOIN {_G} f ON f.a = e.b JOIN {_G} g ON g.a = f.b"
_tensor("shortest_paths", f"WITH RECURSIVE p(a, b, w) AS (SELECT a, b, w FROM {_G} UNION SELECT p.a, g.b, p.w + g.w FROM p JOIN {_G} g ON g.a = p.b) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, min(w) AS value FROM p GROUP BY ALL", lambda s, d: _graph(s, d).closure("min-plus", 4))


@_register("dimension_ordinals", "SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS ordinal FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def dimension_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "orders").catalog.dimension("o_orderpriority").members()


@_register("rollup_map", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS order_day, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders")
def rollup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "orders", "order_calendar").catalog.rollup("order_day", "order_year")


def _derby(spark: SparkSession, nation: DataFrame) -> str:
    """The JDBC url of a database with table NATION that any JVM can read at once.

    Several JVMs can't open one embedded database, unless it is read-only and in a jar: the driver fills it (rows pass one by one)
    and puts the jar into the shared folder, which must be one that executors see as a local path.
    """
    jvm, drivers = spark._jvm, spark._jvm.java.sql.DriverManager
    jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    folder = jvm.org.apache.hadoop.fs.Path(scratch(spark, "database"))
    to = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if to.getScheme() != "file":
        raise ValueError(f"an embedded database can't be read from {folder.toString()}")
    with tempfile.TemporaryDirectory() as own:
        base = f"{os.path.realpath(own)}/nation"
        con = drivers.getConnection(f"jdbc:derby:{base};create=true")
        con.createStatement().execute("CREATE TABLE NATION (R INT, N VARCHAR(32672), K INT)")
        put = con.prepareStatement("INSERT INTO NATION VALUES (?, ?, ?)")
        for row in nation.toLocalIterator():
            for i, value in enumerate(row, 1):
                put.setNull(i, jvm.java.sql.Types.VARCHAR if i == 2 else jvm.java.sql.Types.INTEGER) if value is None else put.setString(i, value) if i == 2 else put.setInt(i, value)
            put.executeUpdate()
        con.close()
        try:
            drivers.getConnection(f"jdbc:derby:{base};shutdown=true")
        except Py4JJavaError as e:  # Derby's way to say that it is done
            if e.java_exception.getSQLState() != "08006":
                raise
        with zipfile.ZipFile(f"{own}/nation.jar", "w") as jar:
            for at, _, names in os.walk(base):
                for x in names:
                    if not x.endswith(".lck"):
                        jar.write(f"{at}/{x}", os.path.relpath(f"{at}/{x}", os.path.dirname(base)))
        to.mkdirs(folder)
        to.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{os.path.dirname(base)}/nation.jar"), folder)
    return f"jdbc:derby:jar:({to.makeQualified(folder).toUri().getPath()}/nation.jar)nation"


@_register("jdbc_scan", "SELECT n_regionkey, count(*) AS n, CAST(sum(n_nationkey) AS DOUBLE) AS s FROM nation GROUP BY ALL")
def jdbc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a database query by JDBC, read by the executors."""
    url = _derby(spark, table(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey"))
    e = Engine(spark)
    e.load_sql(url, "SELECT R, N, K FROM NATION", ["R", "N"], "K", "nations")
    return e.frame("SELECT R AS n_regionkey, COUNT(*) AS n, SUM(K) AS s FROM nations GROUP BY R").withColumn("n_regionkey", F.col("n_regionkey").cast("int"))


@_register("db_api_scan", "SELECT n_regionkey, count(*) AS n, CAST(sum(n_nationkey) AS DOUBLE) AS s FROM nation GROUP BY ALL")
def db_api_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a database query through a DB-API connection, on the driver: for small tables."""
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE nation (n_nationkey INT, n_name TEXT, n_regionkey INT)")
    con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in table(spark, sf_dir, "nation").collect()])
    e = Engine(spark)
    e.load_sql(con, "SELECT n_regionkey, n_name, n_nationkey FROM nation", ["n_regionkey", "n_name"], "n_nationkey", "nations")
    return e.frame("SELECT n_regionkey, COUNT(*) AS n, SUM(n_nationkey) AS s FROM nations GROUP BY n_regionkey").withColumn("n_regionkey", F.col("n_regionkey").cast("int"))


@_register("streamed_cube", "SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS value, count(value) AS count, count(*) AS rows FROM events GROUP BY ALL")
def streamed_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube kept by a stream: the events, read as a stream of files, until all are in."""
    from .streaming.cubes import maintain

    base = scratch(spark, "stream")
    source = table(spark, sf_dir, "events").repartition(3)
    source.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withColumn("day", F.to_date("ts"))
    return rounded(maintain(stream, ["event_type", "day"], "value", f"{base}/cube", f"{base}/checkpoint").select("event_type", "day", "value", F.col("__count").alias("count"), F.col("__rows").alias("rows")))


from . import queries_api as _api  # noqa: E402, F401  registers the operators of the API
