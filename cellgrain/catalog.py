"""Registry of dimensions, hierarchies, cubes and roles, all of them over DataFrames.

A dimension is known by its name alone: every cube with a column of that name shares it. Keys stay
values; ordinals are made only where an order by dictionary position is asked for (windows).
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of no more than so many bytes, by their counted rows and the width of their columns, may be broadcast.
BROADCAST_BYTES = 64 << 20


def small_enough(table: DataFrame | None, rows: int | None) -> bool:
    """Whether a table of a counted number of rows may be broadcast. Texts count for 64 bytes each, nested columns never do."""
    if table is None or rows is None:
        return False
    nested = any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in table.schema)
    width = 16 + sum(64 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 for f in table.schema)
    return not nested and rows * width <= BROADCAST_BYTES


def dense_ordinals(keys: DataFrame, column: str, start: int = 0, by: str | None = None) -> DataFrame:
    """column and ordinal: positions of distinct keys in ascending order (of ``by`` before them), without a global window.

    Keys are range-partitioned; the number of rows in each partition (one row a partition) shifts the next ones.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*([F.col(by)] if by else []), F.col(column).asc_nulls_last()]
    laid = (keys if by else keys.select(column).distinct()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = laid.select(column, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")).persist()
    within = (F.col("__id") - (F.col("__part").cast("long") * F.lit(1 << 33))).alias("__within")
    sizes = {r["__part"]: r["count"] for r in laid.groupBy("__part").count().collect()}
    shift, total = {}, start
    for p in sorted(sizes):
        shift[p] = total
        total += sizes[p]
    if not shift:
        return laid.select(column, F.lit(0).cast("long").alias("ordinal"))
    offsets = keys.sparkSession.createDataFrame(list(shift.items()), "__part int, __shift long")
    return laid.select(column, "__part", within).join(F.broadcast(offsets), "__part").select(column, (F.col("__shift") + F.col("__within")).alias("ordinal"))


class Dimension:
    """A shared axis: its keys, attributes and whether its keys have an order."""

    def __init__(self, name: str, ordered: bool = False, data_type: T.DataType | None = None):
        self.name, self.ordered, self.data_type = name, ordered, data_type
        self.table: DataFrame | None = None  # key, attributes, measures
        self.attributes: list[str] = []
        self.measures: list[str] = []
        self.rows: int | None = None
        self._batches: list[DataFrame] = []  # distinct keys of each load, in the order of loads
        self._ordinals: DataFrame | None = None

    @property
    def comparable(self) -> bool:
        return self.ordered or isinstance(self.data_type, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))

    @property
    def small(self) -> bool:
        return small_enough(self.table, self.rows)

    def extend(self, keys: DataFrame) -> None:
        """Make the keys of ``keys`` members; ones that are new come after those there are."""
        self._batches.append(keys.select(self.name))
        self._ordinals = None
        if self.data_type is None:
            self.data_type = keys.schema[self.name].dataType

    def ensure_null(self) -> None:
        """Make NULL a member, after those there are."""
        if not self._batches:
            raise KeyError(f"dimension {self.name!r} has no members")
        first = self._batches[0]
        self.extend(first.sparkSession.createDataFrame([(None,)], T.StructType([T.StructField(self.name, first.schema[self.name].dataType)])))

    def members(self) -> DataFrame:
        """Key and ordinal: sorted within a load, later loads after earlier ones."""
        if self._ordinals is None:
            if not self._batches:
                raise KeyError(f"dimension {self.name!r} has no members")
            if len(self._batches) == 1:
                self._ordinals = dense_ordinals(self._batches[0], self.name).persist()
            else:
                # The load in which a key came first, then the key: one aggregation and one sort, however many loads there were.
                loads = [b.select(self.name, F.lit(i).alias("__load")) for i, b in enumerate(self._batches)]
                first = functools.reduce(DataFrame.unionByName, loads).groupBy(self.name).agg(F.min("__load").alias("__load"))
                self._ordinals = dense_ordinals(first, self.name, by="__load").persist()
        return self._ordinals

    def __len__(self) -> int:
        return self.members().count()

    def __contains__(self, key) -> bool:
        return not self.members().where(F.col(self.name).eqNullSafe(F.lit(key))).isEmpty()

    def ordinal(self, key) -> int:
        row = self.members().where(F.col(self.name).eqNullSafe(F.lit(key))).first()
        if row is None:
            raise KeyError(f"{key!r} is no member of {self.name!r}")
        return row["ordinal"]

    def label(self, ordinal: int):
        row = self.members().where(F.col("ordinal") == ordinal).first()
        if row is None:
            raise KeyError(f"{self.name!r} has no member {ordinal}")
        return row[self.name]

    def labels(self) -> list:
        """Keys by ordinal; for dimensions of a size that fits the driver."""
        return [r[self.name] for r in self.members().orderBy("ordinal").collect()]

    def encode(self, df: DataFrame, into: str = "ordinal") -> DataFrame:
        """``df`` with the ordinal of its key column; unknown keys raise."""
        known = self.members().select(F.col(self.name).alias("__key"), F.col("ordinal").alias(into))
        out = df.join(known, df[self.name].eqNullSafe(F.col("__key")), "left").drop("__key")
        if (bad := out.where(F.col(into).isNull()).first()) is not None:
            raise KeyError(f"{bad[self.name]!r} is no member of {self.name!r}")
        return out

    def set_attributes(self, table: DataFrame, attributes: Iterable[str], measures: Iterable[str] = (), rows: int | None = None) -> None:
        self.table, self.attributes, self.measures, self.rows = table, list(attributes), list(measures), rows

    # Predicates over keys

    def mask_all(self) -> Column:
        return F.lit(True)

    def mask_of(self, *keys) -> Column:
        return F.col(self.name).isin(*[k for k in keys if k is not None]) | (F.col(self.name).isNull() if None in keys else F.lit(False))

    def mask_range(self, low=None, high=None, inclusive: bool = True) -> Column:
        if not self.comparable:
            raise ValueError(f"dimension {self.name!r} has no order")
        c, out = F.col(self.name), F.lit(True)
        if low is not None:
            out = out & (c >= low if inclusive else c > low)
        if high is not None:
            out = out & (c <= high if inclusive else c < high)
        return out

    def attribute_mask(self, attribute: str, holds: Callable[[Column], Column]) -> DataFrame:
        """The keys whose attribute meets a condition."""
        if self.table is None or attribute not in self.attributes:
            raise KeyError(f"dimension {self.name!r} has no attribute {attribute!r}")
        return self.table.where(holds(F.col(f"`{attribute}`"))).select(self.name)


@dataclass
class Hierarchy:
    """A many-to-one step from ``child`` to ``parent``: a table of both columns, or a column expression of the child."""

    child: str
    parent: str
    table: DataFrame | None = None
    expression: Callable[[Column], Column] | None = None
    rows: int | None = None

    def climb(self, df: DataFrame) -> DataFrame:
        """``df``, which has the child's column, with the parent's."""
        if self.parent in df.columns:
            return df
        if self.expression is not None:
            return df.withColumn(self.parent, self.expression(F.col(self.child)))
        table = F.broadcast(self.table) if small_enough(self.table, self.rows) else self.table
        return df.join(table.withColumnRenamed(self.child, "__child"), df[self.child].eqNullSafe(F.col("__child")), "left").drop("__child")


@dataclass
class Cube:
    """A named measure over dimensions.

    ``rows`` is the raw fact (dimensions, value) where there is one; ``cells`` has one row for each
    combination that occurs: dimensions, value, and, if counted, __count (rows with a measure) and __rows (all rows).
    """

    name: str
    measure: str
    dims: list[str]
    cells: DataFrame
    rows: DataFrame | None = None
    agg: str = "sum"
    layout: str = "cells"
    version: int = 1
    cached: bool = False

    def scan(self, cell_grain: bool) -> DataFrame:
        """dimensions, value, __count, __rows; raw rows serve sums as well as cells do, and spare a shuffle.

        A cube that was registered without counts counts its non-zero cells.
        """
        if cell_grain or self.cached or self.rows is None or self.agg != "sum":
            filled = (F.coalesce("value", F.lit(0.0)) != 0).cast("long")
            missing = {c: filled for c in ("__count", "__rows") if c not in self.cells.columns}
            return self.cells.withColumns(missing) if missing else self.cells
        has = F.col("value").isNotNull().cast("long").alias("__count")
        return self.rows.select(*self.dims, F.coalesce("value", F.lit(0.0)).alias("value"), has, F.lit(1).cast("long").alias("__rows"))


@dataclass
class Grant:
    """allowed: keys (list), or a DataFrame with the axis's column, or None for all."""

    allowed: list | DataFrame | None = None
    can_project: bool = True


@dataclass
class Role:
    name: str
    permissive: bool = True
    grants: dict[str, Grant] = field(default_factory=dict)


class Catalog:
    def __init__(self):
        self.dimensions: dict[str, Dimension] = {}
        self.cubes: dict[str, Cube] = {}
        self.hierarchies: dict[tuple[str, str], Hierarchy] = {}
        self.roles: dict[str, Role] = {}

    def dimension(self, name: str) -> Dimension:
        if name not in self.dimensions:
            raise KeyError(f"no dimension {name!r}")
        return self.dimensions[name]

    def ensure_dimension(self, name: str, keys: DataFrame | None = None, ordered: bool = False) -> Dimension:
        out = self.dimensions.setdefault(name, Dimension(name, ordered))
        out.ordered = out.ordered or ordered
        if keys is not None:
            out.extend(keys)
        return out

    def add_cube(self, cube: Cube) -> Cube:
        missing = [d for d in cube.dims if d not in cube.cells.columns]
        if missing or len(set(cube.dims)) != len(cube.dims):
            raise ValueError(f"cube {cube.name!r}: axes {cube.dims} don't fit columns {cube.cells.columns}")
        if cube.name in self.cubes:
            cube.version = self.cubes[cube.name].version + 1
        for d in cube.dims:
            self.ensure_dimension(d, cube.cells)
        self.cubes[cube.name] = cube
        return cube

    def cube(self, name: str) -> Cube:
        if name not in self.cubes:
            raise KeyError(f"no cube {name!r}")
        return self.cubes[name]

    def axes_of(self, name: str) -> list[str]:
        return list(self.cube(name).dims)

    def measures(self) -> dict[str, list[str]]:
        """Cubes and dimensions by the measures they hold."""
        out: dict[str, list[str]] = {}
        for c in self.cubes.values():
            out.setdefault(c.measure, []).append(c.name)
        for d in self.dimensions.values():
            for m in d.measures:
                out.setdefault(m, []).append(d.name)
        return out

    def cube_for_measure(self, measure: str, among: Iterable[str] = ()) -> str:
        """The one holder of a measure, those named first."""
        if measure in self.cubes:
            return measure
        holders = self.measures().get(measure, [])
        near = [h for h in holders if h in set(among)] or holders
        if len(near) != 1:
            raise KeyError(f"measure {measure!r} is unknown" if not near else f"measure {measure!r} is in {', '.join(near)}")
        return near[0]

    def add_hierarchy(self, step: Hierarchy, ordered: bool = False) -> Hierarchy:
        self.hierarchies[step.child, step.parent] = step
        self.ensure_dimension(step.parent, None, ordered)
        return step

    def path(self, child: str, ancestor: str) -> list[Hierarchy] | None:
        """The fewest steps from a dimension up to another; [] for itself, None where there is no way."""
        seen, queue = {child}, deque([(child, [])])
        while queue:
            at, steps = queue.popleft()
            if at == ancestor:
                return steps
            for (c, p), step in self.hierarchies.items():
                if c == at and p not in seen:
                    seen.add(p)
                    queue.append((p, [*steps, step]))
        return None

    hierarchy_path = path

    def rollup(self, child: str, ancestor: str) -> DataFrame:
        """child and ancestor of each member."""
        steps = self.path(child, ancestor)
        if steps is None:
            raise KeyError(f"no way from {child!r} to {ancestor!r}")
        out = self.dimension(child).members().select(child)
        for s in steps:
            out = s.climb(out)
        return out.select(child, ancestor)

    def role(self, name: str) -> Role:
        if name not in self.roles:
            raise KeyError(f"no role {name!r}")
        return self.roles[name]

    def grant(self, role: str, axis: str, allowed=None, can_project: bool = True, permissive: bool = True) -> Role:
        out = self.roles.setdefault(role, Role(role, permissive))
        out.grants[axis] = Grant(allowed, can_project)
        return out

    def stats(self, name: str) -> dict:
        """Filled and possible cells of a cube, and what a dense or a sparse array of them would take."""
        cube = self.cube(name)
        counts = cube.cells.agg(F.count(F.lit(1)).alias("nnz"), *[F.countDistinct(F.coalesce(F.col(d).cast("string"), F.lit("\0"))).alias(d) for d in cube.dims]).first()
        total = 1
        for d in cube.dims:
            total *= max(1, counts[d])
        fill = counts["nnz"] / total if total else 0.0
        layout = choose_layout(counts["nnz"], total, len(cube.dims))
        return {
            "cube": name, "nnz": counts["nnz"], "total_cells": total, "fill_factor": fill, "layout": cube.layout,
            "bytes": estimate_bytes(counts["nnz"], total, len(cube.dims), layout), "recommended_layout": layout, "version": cube.version,
        }

    def summary(self) -> str:
        lines = [f"{len(self.cubes)} cubes, {len(self.dimensions)} dimensions, {len(self.hierarchies)} hierarchies, {len(self.roles)} roles"]
        lines += [f"cube {c.name}({', '.join(c.dims)}) measure {c.measure}, version {c.version}" for c in self.cubes.values()]
        lines += [f"dimension {d.name}" + (f", attributes {', '.join(d.attributes)}" if d.attributes else "") for d in self.dimensions.values()]
        lines += [f"hierarchy {c} -> {p}" for c, p in self.hierarchies]
        return "\n".join(lines)


def estimate_bytes(nnz: int, total: int, rank: int, layout: str) -> int:
    """An array's size: 8 bytes a cell, or 8 a coordinate and 8 a value."""
    return 8 * total if layout == "dense" else nnz * 8 * (rank + 1)


def choose_layout(nnz: int, total: int, rank: int, budget: int = 8 << 30) -> str:
    """Which layout an array engine would take; reported only, since cell tables are columnar throughout."""
    dense, sparse = estimate_bytes(nnz, total, rank, "dense"), estimate_bytes(nnz, total, rank, "sparse_coo")
    if dense > budget:
        return "chunked_sparse" if sparse > budget else "sparse_coo"
    return "sparse_coo" if total and nnz / total < 0.02 and sparse < dense else "dense"


def check_budget(nnz: int, total: int, rank: int, layout: str, budget: int = 8 << 30) -> None:
    if (size := estimate_bytes(nnz, total, rank, layout)) > budget:
        raise MemoryError(f"{size} bytes exceed the budget of {budget}")
