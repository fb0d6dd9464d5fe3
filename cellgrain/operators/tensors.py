"""Algebra of named-axis tensors, each a DataFrame of coordinates and values.

A tensor's frame has one row for each cell that is given: its axes' columns and ``value``. Cells that
aren't there are 0, or the zero of the semiring that a product uses. Joins are on shared
axes, sums are aggregations, so products of any rank and fill run as shuffles or broadcasts
that Spark picks. ``sizes`` (axis -> number of keys 0..n-1) are needed only where absent cells count:
means, dense minima and elementwise operations against missing axes.
"""

from __future__ import annotations

import functools
import operator
import string
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TooManyIndicesError
from ..functions.semirings import Semiring, semiring
from .blocks import product as by_blocks

HOWS = ("sum", "min", "max", "mean", "prod")
#: Cells that an operation may make of absent ones (a number added to a tensor, an axis that one side lacks).
MOST_CELLS = 1 << 40


def _check_cells(sizes: Mapping[str, int], axes: Iterable[str], most: int) -> None:
    """Sizes that aren't known count as 1."""
    cells = functools.reduce(operator.mul, [sizes.get(a, 1) for a in axes], 1)
    if cells > most:
        raise MemoryError(f"{cells} cells exceed {most}")


class Tensor:
    def __init__(self, df: DataFrame, axes: Sequence[str], sizes: Mapping[str, int] | None = None):
        if len(set(axes)) != len(axes):
            raise ValueError(f"axes {list(axes)} repeat")
        if missing := [a for a in [*axes, "value"] if a not in df.columns]:
            raise ValueError(f"no column {missing[0]!r} among {df.columns}")
        self.df = df.select(*[F.col(f"`{a}`") for a in axes], F.col("value").cast("double"))
        self.axes = tuple(axes)
        self.sizes = {a: int(n) for a, n in (sizes or {}).items() if a in self.axes}

    # from and to arrays

    @classmethod
    def from_dense(cls, spark: SparkSession, array, axes: Sequence[str], keep_zeros: bool = False) -> Tensor:
        """A small NumPy array, by its non-zero cells (or all of them)."""
        import numpy as np
        import pandas as pd

        array = np.asarray(array, dtype=float)
        if array.ndim != len(axes):
            raise ValueError(f"an array of rank {array.ndim} for axes {list(axes)}")
        at = np.indices(array.shape).reshape(array.ndim, -1) if keep_zeros else np.nonzero(array)
        frame = pd.DataFrame({a: np.asarray(x, dtype=np.int64) for a, x in zip(axes, at)} | {"value": array.ravel() if keep_zeros else array[at]})
        schema = ", ".join(f"`{a}` long" for a in axes) + (", " if axes else "") + "value double"
        return cls(spark.createDataFrame(frame, schema), axes, dict(zip(axes, array.shape)))

    @classmethod
    def scalar(cls, spark: SparkSession, value: float) -> Tensor:
        return cls(spark.createDataFrame([(float(value),)], "value double"), ())

    @classmethod
    def unit(cls, spark: SparkSession, summed: Mapping[str, tuple[str, int]], kept: Mapping[str, int] | None = None) -> Tensor:
        """The product's neutral element: 1 where each pair of summed axes agrees, for all keys of the kept axes.

        ``summed``: axis -> (its partner's name, size).
        """
        df, axes, sizes = spark.range(1).select(F.lit(1.0).alias("value")), [], {}
        for a, n in (kept or {}).items():
            df = df.crossJoin(spark.range(n).withColumnRenamed("id", a))
            axes.append(a)
            sizes[a] = n
        for a, (partner, n) in summed.items():
            df = df.crossJoin(spark.range(n).select(F.col("id").alias(a), F.col("id").alias(partner)))
            axes += [a, partner]
            sizes |= {a: n, partner: n}
        return cls(df, axes, sizes)

    def to_dense(self):
        """A NumPy array; for tensors that fit the driver. Sizes default to the largest key."""
        import numpy as np

        frame = self.df.toPandas()
        shape = [self.sizes.get(a) or (int(frame[a].max()) + 1 if len(frame) else 0) for a in self.axes]
        out = np.zeros(shape)
        np.add.at(out, tuple(frame[a].to_numpy(dtype=np.int64) for a in self.axes), frame["value"].to_numpy())
        return out

    def item(self) -> float:
        row = self.df.agg(F.sum("value").alias("value")).first()
        return row["value"] or 0.0

    def save(self, path: str, compression: str = "zstd", partition_by: Sequence[str] = ()) -> None:
        """Cells as Parquet; axes and sizes go with them as the table's own metadata."""
        shape = {"axes": list(self.axes), "sizes": [self.sizes.get(a, 0) for a in self.axes]}
        df = self.df.withColumn("value", F.col("value").alias("value", metadata=shape))
        df.write.mode("overwrite").option("compression", compression).partitionBy(*partition_by).parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, condition: Column | str | None = None) -> Tensor:
        """A stored tensor, lazily: ``condition`` is pushed to the files."""
        df = spark.read.parquet(path)
        shape = df.schema["value"].metadata
        sizes = {a: n for a, n in zip(shape["axes"], shape["sizes"]) if n}
        return cls(df.where(condition) if condition is not None else df, shape["axes"], sizes)

    @property
    def rank(self) -> int:
        return len(self.axes)

    def nnz(self) -> int:
        return self.df.where("value <> 0").count()

    def fill_factor(self) -> float:
        return self.nnz() / max(1, functools.reduce(operator.mul, [self.sizes[a] for a in self.axes], 1))

    def _like(self, df: DataFrame, axes: Sequence[str], more: Mapping[str, int] | None = None) -> Tensor:
        return Tensor(df, axes, self.sizes | dict(more or {}))

    def _need(self, axes: Iterable[str]) -> list[str]:
        out = list(axes)
        if lost := [a for a in out if a not in self.axes]:
            raise KeyError(f"no axis {lost[0]!r} among {list(self.axes)}")
        return out

    # one tensor

    def coalesce(self) -> Tensor:
        """Cells of the same coordinates added up, zeros left out."""
        return self._like(_grouped(self.df, self.axes, F.sum("value")).where("value <> 0"), self.axes)

    def transpose(self, order: Sequence[str]) -> Tensor:
        if sorted(order) != sorted(self.axes):
            raise ValueError(f"{list(order)} is no order of {list(self.axes)}")
        return self._like(self.df, order)

    def rename(self, **names: str) -> Tensor:
        self._need(names)
        axes = [names.get(a, a) for a in self.axes]
        df = self.df.select(*[F.col(f"`{a}`").alias(names.get(a, a)) for a in self.axes], "value")
        return Tensor(df, axes, {names.get(a, a): n for a, n in self.sizes.items()})

    def astype(self, kind: str) -> Tensor:
        return self._like(self.df.withColumn("value", F.col("value").cast(kind)), self.axes)

    def where(self, **allowed) -> Tensor:
        """Cells whose keys are among those allowed for each axis (a list, or a condition on the column)."""
        df = self.df
        for axis, keys in allowed.items():
            self._need([axis])
            c = F.col(f"`{axis}`")
            df = df.where(keys if isinstance(keys, Column) else keys(c) if callable(keys) else c.isin(*list(keys)))
        return self._like(df, self.axes)

    mask = where

    def slice(self, **at) -> Tensor:
        """A key drops its axis; a ``slice`` or a list of keys keeps it, renumbered from 0 (integer axes)."""
        df, axes, sizes = self.df, list(self.axes), dict(self.sizes)
        for axis, key in at.items():
            self._need([axis])
            c = F.col(f"`{axis}`")
            if isinstance(key, slice):
                begin, stop, step = key.indices(sizes[axis]) if axis in sizes else (key.start or 0, key.stop if key.stop is not None else 1 << 62, key.step or 1)
                if step <= 0:
                    raise ValueError("slices go forward")
                df = df.where((c >= begin) & (c < stop) & ((c - begin) % step == 0)).withColumn(axis, ((c - begin) / step).cast("long"))
                sizes[axis] = len(range(begin, stop, step))
            elif isinstance(key, (list, tuple, range)):
                places = self.df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(key)], "__key long, __place long")
                df = df.join(F.broadcast(places), c == F.col("__key")).withColumn(axis, F.col("__place")).drop("__key", "__place")
                sizes[axis] = len(key)
            else:
                df = df.where(c == F.lit(key)).drop(axis)
                axes.remove(axis)
                sizes.pop(axis, None)
        return Tensor(df, axes, sizes)

    def slice_labels(self, **at) -> Tensor:
        """By keys as they are: one key drops its axis, a list keeps it."""
        out = self
        for axis, key in at.items():
            out = out.where(**{axis: key}) if isinstance(key, (list, tuple)) else out.slice(**{axis: key})
        return out

    def reduce(self, axes: Iterable[str], how: str = "sum") -> Tensor:
        """Axes gone by sum, min, max, mean or prod over all their keys; absent cells are zeros."""
        gone = self._need(axes)
        if how not in HOWS:
            raise ValueError(f"unknown reduction {how!r}; there are {', '.join(HOWS)}")
        keep = [a for a in self.axes if a not in gone]
        df = _grouped(self.df, self.axes, F.sum("value")) if how != "sum" else self.df
        if how == "sum":
            return self._like(_grouped(df, keep, F.sum("value")), keep)
        cells = functools.reduce(operator.mul, [self._size(a) for a in gone], 1)
        some = F.count(F.lit(1)) < cells  # some of the cells are absent, so 0 takes part
        by = {
            "mean": F.sum("value") / cells,
            "min": F.when(some, F.least(F.min("value"), F.lit(0.0))).otherwise(F.min("value")),
            "max": F.when(some, F.greatest(F.max("value"), F.lit(0.0))).otherwise(F.max("value")),
            "prod": F.when(some, F.lit(0.0)).otherwise(F.product("value")),
        }[how]
        return self._like(_grouped(df, keep, by), keep)

    def _size(self, axis: str) -> int:
        if axis not in self.sizes:
            raise ValueError(f"the size of axis {axis!r} is not known; absent cells can't be counted")
        return self.sizes[axis]

    def project(self, drop: Iterable[str], how: str = "sum") -> Tensor:
        return self.reduce(drop, how)

    def keep_only(self, keep: Iterable[str], how: str = "sum") -> Tensor:
        keep = self._need(keep)
        return self.reduce([a for a in self.axes if a not in keep], how)

    def trace(self, first: str, second: str) -> Tensor:
        """Sum over the cells where two axes agree."""
        self._need([first, second])
        if first == second:
            raise ValueError("a trace takes two axes")
        rest = [a for a in self.axes if a not in (first, second)]
        return self._like(_grouped(self.df.where(F.col(f"`{first}`") == F.col(f"`{second}`")), rest, F.sum("value")), rest)

    def indicator(self) -> Tensor:
        return self._like(self.coalesce().df.withColumn("value", F.lit(1.0)), self.axes)

    def rollup(self, axis: str, parent: str, mapping: DataFrame | Mapping, how: str = "sum") -> Tensor:
        """Keys of an axis replaced by their parents; cells of one parent gathered. Only cells that are there take part."""
        self._need([axis])
        table = mapping if isinstance(mapping, DataFrame) else self.df.sparkSession.createDataFrame(list(mapping.items()), [axis, parent])
        axes = [parent if a == axis else a for a in self.axes]
        df = self.df.join(table.select(F.col(axis).alias("__child"), F.col(parent).alias(parent)), F.col(f"`{axis}`") == F.col("__child"))
        return self._like(_grouped(df, axes, {"sum": F.sum, "min": F.min, "max": F.max}[how]("value")), axes)

    def count_distinct(self, axis: str, keep: Iterable[str] = ()) -> Tensor:
        """How many keys of an axis have a non-zero cell, for each combination of the kept axes."""
        keep = self._need(keep)
        self._need([axis])
        return self._like(_grouped(self.coalesce().df, keep, F.count_distinct(F.col(f"`{axis}`")).cast("double")), keep)

    def running(self, axis: str, back: int | None = None) -> Tensor:
        """Running sums along an integer axis; ``back``: over so many keys before the current one. Every key up to the size gets a cell."""
        size = self._size(axis)
        rest = [F.col(f"`{a}`") for a in self.axes if a != axis]
        # Each cell once, then zeros at the keys that have none: where a series' cells begin, up to the next ones.
        cells = _grouped(self.df, self.axes, F.sum("value"))
        here = Window.partitionBy(*rest).orderBy(F.col(f"`{axis}`"))
        cells = cells.withColumn("__next", F.lead(F.col(f"`{axis}`")).over(here))
        last = F.least(F.coalesce(F.col("__next"), F.lit(size)) - 1, F.lit(size - 1))
        last = last if back is None else F.least(last, F.col(f"`{axis}`") + F.lit(back))
        span = F.explode(F.sequence(F.col(f"`{axis}`"), last)).alias("__at")
        filled = cells.where(F.col(f"`{axis}`") < size).select(*rest, F.col(f"`{axis}`").alias("__from"), "value", span)
        value = F.when(F.col("__at") == F.col("__from"), F.col("value")).otherwise(0.0)
        window = Window.partitionBy(*rest).orderBy("__at").rangeBetween(Window.unboundedPreceding if back is None else -back, 0)
        df = filled.select(*rest, F.col("__at"), F.sum(value).over(window).alias("value")).withColumnRenamed("__at", axis)
        return self._like(df, self.axes)

    def weighted_window(self, axis: str, weights: DataFrame | Sequence[Sequence[float]]) -> Tensor:
        """New cells as sums of old ones: ``weights`` has columns from, to, weight, or is a matrix [from][to]."""
        self._need([axis])
        if not isinstance(weights, DataFrame):
            rows = [(i, j, float(w)) for i, r in enumerate(weights) for j, w in enumerate(r) if w]
            weights = F.broadcast(self.df.sparkSession.createDataFrame(rows, "from long, to long, weight double"))
        df = self.df.join(weights, F.col(f"`{axis}`") == F.col("from")).withColumn(axis, F.col("to")).withColumn("value", F.col("value") * F.col("weight"))
        return self._like(_grouped(df, self.axes, F.sum("value")), self.axes)

    def aggregate(self, axes: Iterable[str], ring: str | Semiring = "sum-prod") -> Tensor:
        """Axes gathered by a semiring's addition, over the cells that are there."""
        gone, ring = self._need(axes), semiring(ring)
        keep = [a for a in self.axes if a not in gone]
        return self._like(_grouped(self.df, keep, ring.aggregate("value")), keep)

    # two tensors

    def roles(self, other: Tensor, keep: Iterable[str] = ()) -> tuple[list[str], list[str]]:
        """Shared axes that are kept, and shared axes that are summed."""
        shared = [a for a in self.axes if a in other.axes]
        keep = set(keep)
        return [a for a in shared if a in keep], [a for a in shared if a not in keep]

    def product(self, other: Tensor, keep: Iterable[str] = (), ring: str | Semiring = "sum-prod", check: bool = False, max_cells: int | None = None, blocks: bool = False) -> Tensor:
        """Join on shared axes, combine, and gather over those that ``keep`` doesn't name.

        Without shared axes to sum there is nothing to gather, and no aggregation. ``max_cells``: a product whose whole index
        space (by the sizes of all axes) has more cells raises MemoryError before anything runs. ``blocks``: multiply blocks of dense vectors in place of a join
        (``blocks.py``), for operands that are mostly filled and whose result has about as many cells as pairs of free keys; the cells
        are the same. Where blocks can't do it (kept shared axes, no free ones, many summed keys, null values), it is the join.
        """
        ring = semiring(ring)
        if max_cells is not None:
            _check_cells(self.sizes | other.sizes, dict.fromkeys([*self.axes, *other.axes]), max_cells)
        if check and ring.domain is not None:
            for t in (self, other):
                if not t.df.where(~ring.domain(F.col("value"))).isEmpty():
                    raise ValueError(f"{ring.name} is not a semiring on these values")
        lam, mu = self.roles(other, keep)
        shared = [a for a in self.axes if a in other.axes]
        for a in shared:
            if a in self.sizes and a in other.sizes and self.sizes[a] != other.sizes[a]:
                raise ValueError(f"axis {a!r} has sizes {self.sizes[a]} and {other.sizes[a]}")
        axes = [a for a in dict.fromkeys([*self.axes, *other.axes]) if a not in mu]
        if blocks and not lam:
            df = by_blocks(self.df, other.df, [a for a in self.axes if a not in mu], [a for a in other.axes if a not in mu], mu, ring)
            if df is not None:
                return Tensor(df, axes, self.sizes | other.sizes)
        left = self.df.withColumnRenamed("value", "__left")
        right = other.df.withColumnRenamed("value", "__right")
        df = left.join(right, shared) if shared else left.crossJoin(right)
        df = df.withColumn("value", ring.combine(F.col("__left"), F.col("__right")))
        if mu:
            df = _grouped(df, axes, ring.aggregate("value"))
        return Tensor(df, axes, self.sizes | other.sizes)

    def _aligned(self, other: Tensor) -> tuple[DataFrame, list[str]]:
        """Both tensors' cells side by side (``__left``, ``__right``, null where absent), over all axes of either."""
        axes = list(dict.fromkeys([*self.axes, *other.axes]))
        left, right = (t._spread([a for a in axes if a not in t.axes], o) for t, o in ((self, other), (other, self)))
        left, right = left.withColumnRenamed("value", "__left"), right.withColumnRenamed("value", "__right")
        return (left.join(right, axes, "full") if axes else left.crossJoin(right)), axes

    def _spread(self, missing: list[str], other: Tensor) -> DataFrame:
        df = self.df
        if missing:
            _check_cells(self.sizes | other.sizes, [*self.axes, *missing], MOST_CELLS)
        for a in missing:
            df = df.crossJoin(df.sparkSession.range(other._size(a)).withColumnRenamed("id", a))
        return df

    def elementwise(self, other, op: str) -> Tensor:
        """``+ - * /`` with a tensor or a number; what is divided by zero is 0."""
        if op not in ("+", "-", "*", "/"):
            raise ValueError(f"unknown operation {op!r}")
        if not isinstance(other, Tensor):
            v = F.lit(float(other))
            if op in "+-" and float(other):
                df = self._full()
            else:
                df = self.df
            return self._like(df.withColumn("value", _applied(op, F.col("value"), v)), self.axes)
        if op in "*/":
            shared = [a for a in self.axes if a in other.axes]
            if set(shared) in (set(self.axes), set(other.axes)) and op == "*":
                return self.product(other, keep=shared)
        df, axes = self._aligned(other)
        a, b = F.coalesce("__left", F.lit(0.0)), F.coalesce("__right", F.lit(0.0))
        return Tensor(df.withColumn("value", _applied(op, a, b)), axes, self.sizes | other.sizes)

    def _full(self) -> DataFrame:
        """All cells, absent ones as zeros."""
        _check_cells(self.sizes, self.axes, MOST_CELLS)
        grid = self.df.sparkSession.range(1).select()
        for a in self.axes:
            grid = grid.crossJoin(self.df.sparkSession.range(self._size(a)).withColumnRenamed("id", a))
        if not self.axes:
            return self.df
        return grid.join(self.df, list(self.axes), "left").withColumn("value", F.coalesce("value", F.lit(0.0)))

    def __add__(self, other):
        return self.elementwise(other, "+")

    def __sub__(self, other):
        return self.elementwise(other, "-")

    def __mul__(self, other):
        return self.elementwise(other, "*")

    def __truediv__(self, other):
        return self.elementwise(other, "/")

    # graphs

    def walks(self, steps: int) -> DataFrame:
        """Of a matrix of edges: every walk of so many edges, v0 to vk, with the product of its weights. Nothing is summed."""
        if self.rank != 2:
            raise ValueError("walks take a matrix")
        a, b = self.axes
        out = self.df.where("value <> 0").select(F.col(a).alias("v0"), F.col(b).alias("v1"), "value")
        edges = self.df.where("value <> 0").select(F.col(a).alias("__from"), F.col(b).alias("__to"), F.col("value").alias("__w"))
        for k in range(1, steps):
            out = out.join(edges, F.col(f"v{k}") == F.col("__from")).select(*[f"v{i}" for i in range(k + 1)], F.col("__to").alias(f"v{k + 1}"), (F.col("value") * F.col("__w")).alias("value"))
        return out

    def closure(self, ring: str | Semiring, steps: int) -> Tensor:
        """The best of all walks of up to 2 ** steps edges, by repeated squaring (shortest paths under min-plus)."""
        ring = semiring(ring)
        a, b = self.axes
        out = self
        for _ in range(steps):
            squared = out.rename(**{b: "__mid"}).product(out.rename(**{a: "__mid"}), ring=ring)
            both = out.df.unionByName(squared.df)
            out = self._like(_grouped(both, self.axes, ring.aggregate("value")), self.axes)
        return out


def _applied(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        return F.when(b != 0, a / b).otherwise(F.lit(0.0))
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _grouped(df: DataFrame, axes: Sequence[str], value: Column) -> DataFrame:
    if not axes:
        return df.agg(F.coalesce(value, F.lit(0.0)).alias("value"))
    return df.groupBy(*[F.col(f"`{a}`") for a in axes]).agg(value.alias("value"))


def convolve(a: Tensor, b: Tensor, lam: int, mu: int, ring: str | Semiring = "sum-prod", blocks: bool = False) -> Tensor:
    """The (lambda, mu)-product by position: a[L, S, C] and b[S, C, M] give [L, S, M], where S are ``lam`` axes that stay and C ``mu`` axes that are summed."""
    if lam < 0 or mu < 0 or lam + mu > min(a.rank, b.rank):
        raise ValueError(f"a ({lam},{mu})-product of ranks {a.rank} and {b.rank}")
    names = [f"x{i}" for i in range(a.rank)]
    tail = names[a.rank - lam - mu :]
    others = [*tail, *[f"y{i}" for i in range(b.rank - lam - mu)]]
    return a.rename(**dict(zip(a.axes, names))).product(b.rename(**dict(zip(b.axes, others))), keep=tail[:lam], ring=ring, blocks=blocks)


def contract(tensors: Sequence[Tensor], keep: Sequence[str]) -> Tensor:
    """The sum of products of many tensors: an axis is summed as soon as no later tensor and not the result needs it. No limit on the number of axes."""
    out = tensors[0]
    for i, t in enumerate(tensors[1:], 1):
        later = {a for x in tensors[i + 1 :] for a in x.axes} | set(keep)
        own = [a for a in out.axes if a not in t.axes and a not in later]
        out = out.reduce(own) if own else out
        alone = [a for a in t.axes if a not in out.axes and a not in later]
        t = t.reduce(alone) if alone else t
        out = out.product(t, keep=[a for a in out.axes if a in later])
    extra = [a for a in out.axes if a not in keep]
    return (out.reduce(extra) if extra else out).transpose(list(keep))


def build_spec(operands: Sequence[Sequence[str]], result: Sequence[str]) -> str:
    """Axes as letters, as in ``ab,bc->ac``."""
    names = list(dict.fromkeys(a for o in operands for a in o))
    if len(names) > len(string.ascii_letters):
        raise TooManyIndicesError(f"{len(names)} axes, {len(string.ascii_letters)} letters")
    of = dict(zip(names, string.ascii_letters))
    return ",".join("".join(of[a] for a in o) for o in operands) + "->" + "".join(of[a] for a in result)


def build_einsum(rank_a: int, rank_b: int, lam: int, mu: int) -> str:
    """The specification of a (lambda, mu)-product of two ranks."""
    a = [f"x{i}" for i in range(rank_a)]
    tail = a[rank_a - lam - mu :]
    b = [*tail, *[f"y{i}" for i in range(rank_b - lam - mu)]]
    return build_spec([a, b], [x for x in a if x not in tail[lam:]] + b[lam + mu :])


#: The algebra's operations and laws, as data; tests hold each law.
SIGNATURE = {
    "sorts": ["tensor", "axis set"],
    "operations": ["product", "transpose", "project", "slice", "rename", "elementwise", "trace", "rollup", "unit"],
    "outside": ["weighted_window", "count_distinct", "closure"],
    "laws": [
        "product is bilinear", "product is associative for a fixed role of every axis", "unit is neutral", "transposing operands swaps the product's axes",
        "rank = rank + rank - lambda - 2 mu", "sums over axes commute", "a filter is a product with an indicator", "a roll-up is a product with a 0/1 matrix",
        "loading is additive", "slicing commutes with products along kept axes", "semirings distribute on their domain", "renaming is neutral", "trace of a product is symmetric",
    ],
}


def describe_signature() -> str:
    return "\n".join(f"{k}: " + "; ".join(v) for k, v in SIGNATURE.items())


def suppressed(df: DataFrame, value: str, count: str, k: int = 5) -> DataFrame:
    """Values of cells that fewer than ``k`` rows make up become null."""
    return df.withColumn(value, F.when(F.col(count) >= k, F.col(value)))
