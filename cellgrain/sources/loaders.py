"""From files, frames and databases to cubes and dimensions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Cube, Dimension, Hierarchy

LOAD_AGGREGATES = ("sum", "max", "min", "count", "mean")


def to_frame(spark: SparkSession, data) -> DataFrame:
    """A Spark DataFrame of what is given: one, a pandas frame or a dict of columns; NaN becomes NULL."""
    if isinstance(data, DataFrame):
        return data
    import pandas as pd

    frame = pd.DataFrame({k: list(v) for k, v in data.items()}) if isinstance(data, Mapping) else data
    return nan_to_null(spark.createDataFrame(frame))


def nan_to_null(df: DataFrame) -> DataFrame:
    fractions = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractions}) if fractions else df


def column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise KeyError(f"no column {name!r}; there are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def read_csv(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """A CSV file with a header; give ``schema`` for large ones, to spare the pass that infers it."""
    reader = spark.read.options(header=True, **options)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_sql(spark: SparkSession, query: str, connection, chunksize: int = 50_000, **options) -> DataFrame:
    """Rows of a query: from a JDBC url (read by the executors), or through a DB-API connection on the driver, in chunks."""
    if isinstance(connection, str):
        return spark.read.format("jdbc").options(url=connection, query=query, **options).load()
    import pandas as pd

    cursor = connection.cursor()
    try:
        cursor.execute(query)
        names = [d[0] for d in cursor.description]
        out = None
        while rows := cursor.fetchmany(chunksize):
            part = nan_to_null(spark.createDataFrame(pd.DataFrame.from_records(rows, columns=names)))
            out = part if out is None else out.unionByName(part)
    finally:
        cursor.close()
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names))


def load_fact(catalog: Catalog, df: DataFrame, dims: Sequence[str], measure: str, name: str | None = None, measure_col: str | None = None, agg: str = "sum", layout: str = "cells", ordered_dims: Sequence[str] = (), cache: bool = False, dtype: str = "double", with_count: bool = True, cluster_by: str | None = None) -> Cube:
    """Rows of a fact as a cube: one cell for each combination of dimension keys that occurs.

    ``dtype``: the type that values are taken as before they are added up. Without counts (``with_count``), COUNT is that of non-zero cells.
    ``cluster_by``: a dimension by whose keys cached cells are laid out, so that groups by it, and by it and others, need no shuffle. For
    dimensions without hot keys: all cells of one key stand in one partition.
    """
    if agg not in LOAD_AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; there are {', '.join(LOAD_AGGREGATES)}")
    value = column(df, measure_col or measure).cast(dtype).cast("double")
    rows = df.select(*[column(df, d).alias(d) for d in dims], F.nanvl(value, F.lit(None).cast("double")).alias("value"))
    by = {"sum": F.sum("value"), "max": F.max("value"), "min": F.min("value"), "count": F.count(F.lit(1)).cast("double"), "mean": F.avg("value")}[agg]
    if cluster_by is not None and cluster_by not in dims:
        raise KeyError(f"{cluster_by!r} is none of {', '.join(dims)}")
    laid = rows.repartition(F.col(f"`{cluster_by}`")) if cluster_by and cache else rows
    cells = laid.groupBy(*dims).agg(F.coalesce(by, F.lit(0.0)).alias("value"), F.count("value").alias("__count"), F.count(F.lit(1)).alias("__rows"))
    if not with_count:
        cells, rows = cells.drop("__count", "__rows"), None
    if cache:
        cells = cells.persist()
    for d in dims:
        catalog.ensure_dimension(d, None, d in ordered_dims)
    return catalog.add_cube(Cube(name or measure, measure, list(dims), cells, rows, agg, layout, cached=cache))


def load_dimension(catalog: Catalog, df: DataFrame, key: str, name: str | None = None, attributes: Sequence[str] = (), measures: Sequence[str] = (), ordered: bool = False, order_by: str | None = None, cache: bool = False) -> Dimension:
    """Attributes and measures of a dimension's members; of a key that comes twice the last row stands.

    The last row is that of the largest ``order_by`` (a column of ``df``), and without it the last in the order of files
    and partitions, which is that of the rows for a frame made on the driver or read from one file.
    Measures that are missing count as 0. The table's rows are counted, so that small ones may be broadcast.
    """
    name = name or key
    at = column(df, order_by) if order_by else F.monotonically_increasing_id()
    table = df.select(at.alias("__at"), column(df, key).alias(name), *[column(df, a) for a in attributes], *[F.coalesce(F.nanvl(column(df, m).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(m) for m in measures])
    rows = table.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(F.col(name).cast("string"), F.lit("\0"))).alias("keys")).first()
    if rows["n"] != rows["keys"]:
        last = Window.partitionBy(name).orderBy(F.desc("__at"))
        table = table.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")
    table = table.drop("__at")
    if cache:
        table = table.persist()
    out = catalog.ensure_dimension(name, table, ordered)
    out.set_attributes(table, attributes, measures, rows["keys"])
    return out


def add_hierarchy(catalog: Catalog, spark: SparkSession, child: str, parent: str, mapping, parent_ordered: bool = False) -> Hierarchy:
    """A step up: a dict or a list (by ordinal) of parents, a DataFrame of both columns, or a function from the child's column to the parent's.

    A dict must cover every member of a child that has any.
    """
    if callable(mapping):
        return catalog.add_hierarchy(Hierarchy(child, parent, expression=mapping), parent_ordered)
    if isinstance(mapping, DataFrame):
        table = mapping.select(child, parent).distinct()
        rows = table.count()
    else:
        if not isinstance(mapping, Mapping):
            labels = catalog.dimension(child).labels()
            if len(labels) != len(mapping):
                raise ValueError(f"{len(mapping)} parents for {len(labels)} members of {child!r}")
            mapping = dict(zip(labels, mapping))
        dimension = catalog.dimensions.get(child)
        kind = dimension.data_type if dimension and dimension.data_type else None
        pairs = list(mapping.items())
        rows = len(pairs)
        table = spark.createDataFrame(pairs, [child, parent])
        if kind is not None:
            table = table.withColumn(child, F.col(child).cast(kind))
        if dimension and dimension._batches:
            lost = dimension.members().where(F.col(child).isNotNull()).join(table, child, "left_anti").first()
            if lost is not None:
                raise KeyError(f"hierarchy {child} -> {parent} lacks {lost[child]!r}")
    if (twice := table.groupBy(child).count().where("count > 1").first()) is not None:
        raise ValueError(f"{twice[child]!r} has several parents in {parent!r}")
    step = catalog.add_hierarchy(Hierarchy(child, parent, table, rows=rows), parent_ordered)
    catalog.ensure_dimension(parent, table.select(parent))
    return step
