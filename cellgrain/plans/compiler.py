"""From a parsed query to one DataFrame.

Aggregates fall apart into terms, terms into groups by the facts they need. Each group of facts is one
*frame*: the facts' scans are reduced to the axes still needed (so that a join of facts never
carries more than their pre-aggregates), joined on what they share, extended by hierarchies and
dimension tables, filtered, and aggregated once for all aggregates that need just these
facts. Facts that a term does not name never multiply it. Groups of a query are those in which the
facts of FROM, joined, have rows; frames of other facts are joined to them by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Cube, dense_ordinals
from ..errors import AccessDenied, BindError
from . import nodes as n
from .terms import Mask, Measure, Term, conditions_of, conjuncts, names_of, normalize

#: Pairs of keys that a comparison of two dimensions may span.
THETA_CELLS = 1 << 26


@dataclass(frozen=True)
class Axis:
    name: str


@dataclass(frozen=True)
class Attribute:
    dimension: str
    name: str


@dataclass(frozen=True)
class Theta:
    """A comparison of two axes of different facts."""

    left: str
    op: str
    right: str


@dataclass
class Operand:
    """For explain: what is multiplied, and along which axes."""

    label: str
    axes: tuple[str, ...]


@dataclass
class Step:
    """For explain: the product behind a frame."""

    title: str
    operands: list[Operand]
    keep: tuple[str, ...]


@dataclass
class Compiled:
    df: DataFrame
    labels: list[str]
    group: list[str]
    steps: list[Step]
    terms: dict[str, list[str]]
    in_order: Callable[[], DataFrame] | None = None


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


class Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, role: str | None = None):
        self.spark, self.catalog = spark, catalog
        self.role = catalog.role(role) if role is not None else None

    # names

    def _bind_sources(self, q: n.Select) -> None:
        self.facts: list[str] = []
        self.tables: list[str] = []
        self.outer = {j.source for j in q.joins if j.outer}
        for s in q.sources:
            if s in self.catalog.cubes:
                if s in self.facts:
                    raise BindError(f"{s!r} stands twice in FROM")
                self.facts.append(s)
            elif s in self.catalog.dimensions:
                self.tables.append(s)
            else:
                raise BindError(f"unknown source {s!r}")
        self.aliases = q.aliases

    def column(self, name: n.Name) -> Axis | Attribute:
        """A dimension, or an attribute that just one dimension has."""
        qualifier = self.aliases.get(name.qualifier, name.qualifier)
        dims = self.catalog.dimensions
        if qualifier in dims and qualifier not in self.catalog.cubes and name.name != qualifier:
            if name.name in dims[qualifier].attributes:
                return Attribute(qualifier, name.name)
            if name.name not in dims:
                raise BindError(f"dimension {qualifier!r} has no attribute {name.name!r}")
        if name.name in dims:
            return Axis(name.name)
        owners = [d.name for d in dims.values() if name.name in d.attributes]
        if len(owners) > 1:
            raise BindError(f"{name.name!r} is an attribute of {', '.join(owners)}; qualify it")
        if not owners:
            holders = self.catalog.measures().get(name.name)
            raise BindError(f"{name.name!r} is a measure; conditions and groups take dimensions and attributes" if holders else f"unknown column {name.name!r}")
        return Attribute(owners[0], name.name)

    def measure(self, name: n.Name) -> Measure:
        qualifier = self.aliases.get(name.qualifier, name.qualifier)
        cubes, dims = self.catalog.cubes, self.catalog.dimensions
        if qualifier in cubes and cubes[qualifier].measure == name.name:
            return Measure(qualifier, name.name)
        if qualifier in dims and name.name in dims[qualifier].measures:
            return Measure(qualifier, name.name, True)
        if name.name in cubes:
            return Measure(name.name, cubes[name.name].measure)
        holder = self.catalog.cube_for_measure(name.name, [*self.facts, *self.tables])
        return Measure(holder, name.name, holder not in cubes)

    def _axis_of(self, name: n.Name) -> str:
        found = self.column(name)
        return found.name if isinstance(found, Axis) else found.dimension

    # conditions

    def _literal(self, value, kind: T.DataType, where: str, strict: bool) -> Column | None:
        """The value as the column's type; None where it can't be one."""
        if isinstance(kind, T.NumericType):
            if isinstance(value, str):
                try:
                    value = float(value)
                except ValueError:
                    if strict:
                        raise BindError(f"{where} is numeric, {value!r} is not") from None
                    return None
            return F.lit(value)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(str(value)).try_cast(kind)
        if strict and not isinstance(value, str) and isinstance(kind, T.StringType):
            raise BindError(f"{where} is text, {value!r} is not")
        return F.lit(str(value)) if isinstance(kind, T.StringType) else F.lit(value)

    def condition(self, c, df: DataFrame) -> Column:
        """A condition over a frame's columns, in three-valued logic."""
        if isinstance(c, n.Both):
            return self.condition(c.left, df) & self.condition(c.right, df)
        if isinstance(c, n.Either):
            return self.condition(c.left, df) | self.condition(c.right, df)
        if isinstance(c, n.Negation):
            return ~self.condition(c.inner, df)
        if not isinstance(c.left, n.Name):
            raise BindError(f"{c}: a condition on rows compares columns, not aggregates")
        found = self.column(c.left)
        internal = found.name if isinstance(found, Axis) else f"{found.dimension}@{found.name}"
        if internal not in df.columns:
            raise BindError(f"{c.left} can't be reached here")
        col, kind = F.col(f"`{internal}`"), df.schema[internal].dataType
        if isinstance(c, n.IsNull):
            return col.isNotNull() if c.negated else col.isNull()
        strict = isinstance(found, Attribute)
        if isinstance(c, n.AmongQuery):
            inner = self._among_query(c, found, df)
            kept = F.when(col.isNotNull(), F.coalesce(inner, F.lit(False)))
            return ~kept if c.negated else kept
        if isinstance(c, n.Among):
            values = [v for v in (self._literal(v.value, kind, str(c.left), strict) for v in c.values) if v is not None]
            inside = col.isin(*values) if values else F.when(col.isNotNull(), F.lit(False))
            return ~inside if c.negated else inside
        ranged = isinstance(c, n.Between) or c.op in ("<", "<=", ">", ">=")
        if ranged and isinstance(found, Axis) and not self.catalog.dimension(found.name).comparable and not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"dimension {found.name!r} has no order; declare it as ordered")
        if isinstance(c, n.Between):
            inside = col.between(self._literal(c.low.value, kind, str(c.left), True), self._literal(c.high.value, kind, str(c.left), True))
            return ~inside if c.negated else inside
        if isinstance(c.right, n.Name):
            other = self.column(c.right)
            if other == found:
                if c.op == "=":
                    return F.lit(True)
                raise BindError(f"{c}: a dimension compared with itself")
            name = other.name if isinstance(other, Axis) else f"{other.dimension}@{other.name}"
            if name not in df.columns:
                raise BindError(f"{c.right} can't be reached here")
            return self._compared(c.op, col, F.col(f"`{name}`"))
        right = self._literal(c.right.value, kind, str(c.left), strict or ranged)
        if right is None:  # no member is such a value
            return F.when(col.isNotNull(), F.lit(c.op == "!="))
        return self._compared(c.op, col, right)

    @staticmethod
    def _compared(op: str, a: Column, b: Column) -> Column:
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def _among_query(self, c: n.AmongQuery, found, df: DataFrame) -> Column:
        q = c.query
        if q.group or q.joins or q.distinct or any(n.aggregates(i.expr) for i in q.items):
            raise BindError("a subquery in IN has neither GROUP BY, aggregates, JOIN nor DISTINCT")
        if len(q.items) != 1 or not isinstance(q.items[0].expr, n.Name):
            raise BindError("a subquery in IN selects one column")
        own = found.name if isinstance(found, Axis) else found.dimension
        for name in [q.items[0].expr, *(names_of(q.where) if q.where is not None else [])]:
            axis = self._axis_of(name)
            if axis != own and self.catalog.path(own, axis) is None:
                raise BindError(f"the subquery restricts {axis!r}, not {own!r}")
        return self.condition(q.where, df) if q.where is not None else F.lit(True)

    # security

    def _secured(self, df: DataFrame, dims: list[str], title: str) -> DataFrame:
        if self.role is None:
            return df
        for d in dims:
            grant = self.role.grants.get(d)
            if grant is None and not self.role.permissive:
                raise AccessDenied(f"role {self.role.name!r} has no grant on {d!r}")
            if grant is not None and not grant.can_project and d not in self.group:
                raise AccessDenied(f"role {self.role.name!r} may not aggregate over {d!r}")
        for axis, grant in self.role.grants.items():
            if grant.allowed is None:
                continue
            for d in dims:
                path = self.catalog.path(d, axis)
                if path is None:
                    continue
                climbed = df
                for step in path:
                    climbed = step.climb(climbed)
                if isinstance(grant.allowed, DataFrame):
                    kept = climbed.join(grant.allowed.select(F.col(axis).alias("__allowed")), climbed[axis] == F.col("__allowed"), "left_semi")
                else:
                    kept = climbed.where(F.col(f"`{axis}`").isin(*grant.allowed) if len(grant.allowed) else F.lit(False))
                df = kept.select(*[F.col(f"`{c}`") for c in df.columns])
                break
        return df

    # frames

    def _reach(self, dims: list[str], axis: str):
        """The way to an axis from one of ``dims``, the shortest one: (dimension, steps), or None."""
        ways = [(len(p), i, d, p) for i, d in enumerate(dims) if (p := self.catalog.path(d, axis)) is not None]
        if not ways:
            return None
        _, _, d, p = min(ways, key=lambda w: w[:2])
        return d, p

    def _extend(self, df: DataFrame, dims: list[str], wanted: list, step: Step | None, what: str) -> DataFrame:
        """Bring axes and attributes into a frame, by hierarchies and dimension tables."""
        for w in wanted:
            axis = w.name if isinstance(w, Axis) else w.dimension
            if axis not in df.columns:
                way = self._reach([d for d in dims if d in df.columns], axis)
                if way is None:
                    raise BindError(f"{axis!r} can't be reached from {what}")
                for h in way[1]:
                    if h.parent not in df.columns:
                        df = h.climb(df)
                        if step:
                            step.operands.append(Operand(f"{h.child}->{h.parent}", (h.child, h.parent)))
            if isinstance(w, Attribute) and f"{w.dimension}@{w.name}" not in df.columns:
                df = self._dimension(df, w.dimension)
        return df

    def _dimension(self, df: DataFrame, name: str) -> DataFrame:
        """Join a dimension's table: attributes as ``dimension@attribute``, measures as ``dimension#measure``."""
        d = self.catalog.dimension(name)
        if d.table is None:
            raise BindError(f"dimension {name!r} has no table")
        table = d.table.select(F.col(f"`{name}`").alias("__key"), *[F.col(f"`{a}`").alias(f"{name}@{a}") for a in d.attributes], *[F.col(f"`{m}`").alias(f"{name}#{m}") for m in d.measures])
        table = F.broadcast(table) if d.small else table
        out = df.join(table, df[name] == F.col("__key"), "left").drop("__key")
        return out.withColumns({f"{name}#{m}": F.coalesce(F.col(f"`{name}#{m}`"), F.lit(0.0)) for m in d.measures}) if d.measures else out

    def _wanted(self, names) -> list:
        return list(dict.fromkeys(self.column(x) for x in names))

    def _scan(self, cube: Cube, powers: set[int], cell_grain: bool) -> DataFrame:
        df = self._secured(cube.scan(cell_grain or any(p > 1 for p in powers)), cube.dims, cube.name)
        values = [F.pow("value", F.lit(p)).alias(f"{cube.name}^{p}") if p > 1 else F.col("value").alias(f"{cube.name}^1") for p in sorted(powers | {1})]
        return df.select(*[F.col(f"`{d}`") for d in cube.dims], *values, F.col("__count").alias(f"{cube.name}#count"), F.col("__rows").alias(f"{cube.name}#rows"))

    def _frame(self, facts: tuple[str, ...], dimensions: set[str], wanted: list, powers: dict[str, set[int]], cell_grain: bool, title: str) -> tuple[DataFrame, Step]:
        """The joined and filtered frame of ``facts`` (or of a dimension's table alone), before its aggregation."""
        step = Step(title, [], tuple(self.group))
        filters = list(self.filters)
        if not facts:
            (name,) = dimensions
            d = self.catalog.dimension(name)
            if d.table is None:
                raise BindError(f"dimension {name!r} has no table")
            df = self._secured(d.table.select(F.col(f"`{name}`")), [name], name)
            step.operands.append(Operand(name, (name,)))
            df = self._dimension(df, name)
            df = self._extend(df, [name], wanted, step, name)
            return self._filtered(df, filters, [name], step, name), step

        cubes = [self.catalog.cube(f) for f in facts]
        thetas = [t for t in self.thetas if any(t.left in c.dims for c in cubes) and any(t.right in c.dims for c in cubes)] if len(cubes) > 1 else []
        every = list(dict.fromkeys(d for c in cubes for d in c.dims))
        parts: list[tuple[Cube, DataFrame]] = []
        late = list(filters)
        for c in cubes:
            df = self._scan(c, powers.get(c.name, set()), cell_grain)
            step.operands.append(Operand(c.name, tuple(c.dims)))
            if len(cubes) > 1 and c.name not in self.outer:
                for f in filters:  # a filter on this fact's own axes goes before its pre-aggregation
                    own = self._wanted(names_of(f))
                    if own and all(self._reach(c.dims, a.name if isinstance(a, Axis) else a.dimension) for a in own):
                        df = self._filtered(df, [f], c.dims, None, c.name)
                        if f in late:
                            late.remove(f)
                            step.operands.append(Operand(f"[{f}]", tuple(dict.fromkeys(a.name if isinstance(a, Axis) else a.dimension for a in own))))
            parts.append((c, df))
        late_wanted = self._wanted(x for f in late for x in names_of(f))
        if len(cubes) > 1:
            parts = [(c, self._reduced(c, df, cubes, wanted + late_wanted, dimensions, thetas)) for c, df in parts]
        df = self._joined(parts, thetas, step)
        for name in sorted(dimensions):
            if name not in df.columns and self._reach([d for d in every if d in df.columns], name) is None:
                table = self.catalog.dimension(name).table
                df = df.crossJoin(F.broadcast(table.select(name)) if self.catalog.dimension(name).small else table.select(name))
            df = self._extend(df, every, [Axis(name)], step, title)
            if not any(c.startswith((f"{name}@", f"{name}#")) for c in df.columns):
                df = self._dimension(df, name)
            step.operands.append(Operand(f"{name} measures", (name,)))
        df = self._extend(df, every, wanted, step, title)
        return self._filtered(df, late, every, step, title), step

    def _filtered(self, df: DataFrame, filters: list, dims: list[str], step: Step | None, what: str) -> DataFrame:
        for f in filters:
            wanted = self._wanted(names_of(f))
            df = self._extend(df, dims, wanted, step, what)
            if step:
                step.operands.append(Operand(f"[{f}]", tuple(dict.fromkeys(w.name if isinstance(w, Axis) else w.dimension for w in wanted))))
            df = df.where(self.condition(f, df))
        return df

    def _reduced(self, cube: Cube, df: DataFrame, cubes: list[Cube], wanted: list, dimensions: set[str], thetas: list[Theta]) -> DataFrame:
        """Sum out the axes of a fact that neither join, group, filter nor measures need."""
        others = [d for c in cubes if c is not cube for d in c.dims]
        need = {d for d in cube.dims if d in others}
        need |= {a for t in thetas for a in (t.left, t.right)}
        for other in others:  # facts at different levels of a hierarchy
            for d in cube.dims:
                if d != other and (self.catalog.path(d, other) is not None or self.catalog.path(other, d) is not None):
                    need.add(d)
        for axis in [w.name if isinstance(w, Axis) else w.dimension for w in wanted] + sorted(dimensions):
            if way := self._reach(cube.dims, axis):
                need.add(way[0])
        keep = [d for d in cube.dims if d in need]
        if len(keep) == len(cube.dims) and cube.scan(False) is cube.cells:
            return df
        sums = [F.sum(F.col(f"`{c}`")).alias(c) for c in df.columns if c.startswith((f"{cube.name}^", f"{cube.name}#"))]
        return df.groupBy(*keep).agg(*sums) if keep else df.agg(*sums)

    def _joined(self, parts: list[tuple[Cube, DataFrame]], thetas: list[Theta], step: Step) -> DataFrame:
        cube, df = parts[0]
        waiting = list(thetas)
        for cube, right in parts[1:]:
            how = "left" if cube.name in self.outer else "inner"
            on = [d for d in right.columns if d in cube.dims and d in df.columns]
            for d in [d for d in cube.dims if d in right.columns and d not in on]:  # the other fact stands at a finer or coarser level
                below = [x for x in df.columns if x in self.catalog.dimensions]
                if way := self._reach(below, d):
                    for h in way[1]:
                        df = h.climb(df)
                    on.append(d)
                else:
                    for x in below:
                        if x not in right.columns and (up := self.catalog.path(d, x)):
                            for h in up:
                                right = h.climb(right)
                            if x not in on:
                                on.append(x)
                            break
            ready = [t for t in waiting if {t.left, t.right} <= {*df.columns, *right.columns} and not {t.left, t.right} <= {*df.columns} and not {t.left, t.right} <= {*right.columns}]
            waiting = [t for t in waiting if t not in ready]
            renamed = right.select(*[F.col(f"`{c}`").alias(f"__on_{c}" if c in on else c) for c in right.columns])
            conditions = [F.col(f"`{c}`") == F.col(f"`__on_{c}`") for c in on]
            for t in ready:
                if t.op != "=" and not on:
                    self._guard(df, right, t)
                step.operands.append(Operand(f"[{t.left} {t.op} {t.right}]", (t.left, t.right)))
                conditions.append(self._compared(t.op, F.col(f"`{t.left}`"), F.col(f"`{t.right}`")))
            if not conditions:
                self._guard_product(df, right, cube.name)
            df = df.join(renamed, _all(conditions), how) if conditions else df.join(renamed, F.lit(True), how) if how == "left" else df.crossJoin(renamed)
            df = df.drop(*[f"__on_{c}" for c in on])
        for t in waiting:
            df = df.where(self._compared(t.op, F.col(f"`{t.left}`"), F.col(f"`{t.right}`")))
        return df

    def _guard_product(self, left: DataFrame, right: DataFrame, what: str) -> None:
        """A product of facts without a common axis; both sides are pre-aggregated."""
        cells = left.count() * right.count()
        if cells > THETA_CELLS:
            raise BindError(f"the product with {what!r} spans {cells} pairs; at most {THETA_CELLS} are made")

    def _guard(self, left: DataFrame, right: DataFrame, t: Theta) -> None:
        """Both sides are pre-aggregated; what they span is counted before it is joined."""
        a, b = (left, right) if t.left in left.columns else (right, left)
        cells = a.select(t.left).distinct().count() * b.select(t.right).distinct().count()
        if cells > THETA_CELLS:
            raise BindError(f"{t.left} {t.op} {t.right} spans {cells} pairs; at most {THETA_CELLS} are compared")
        kinds = [x.schema[c].dataType for x, c in ((a, t.left), (b, t.right))]
        if isinstance(kinds[0], T.StringType) != isinstance(kinds[1], T.StringType):
            raise BindError(f"{t.left} and {t.right} can't be compared")
        if t.op != "!=" and isinstance(kinds[0], T.StringType) and not all(self.catalog.dimension(x).ordered for x in (t.left, t.right)):
            raise BindError(f"{t.left} {t.op} {t.right} compares dimensions without an order")

    # aggregates

    def _mask(self, masks: tuple[Mask, ...], df: DataFrame) -> Column | None:
        out = None
        for m in masks:
            for c, sense in [*((b, False) for b in m.before), *([(m.condition, True)] if m.condition is not None else [])]:
                holds = F.coalesce(self.condition(c, df), F.lit(False))
                holds = holds if sense else ~holds
                out = holds if out is None else out & holds
        return out

    def _term(self, t: Term, df: DataFrame, count: bool) -> Column:
        """A term's value in a frame's row, or the number of rows it stands for."""
        cubes = t.cubes
        factors = [F.col(f"`{c}#count`" if count else f"`{c}^{t.power(c)}`") for c in cubes]
        if not cubes:
            factors += [self._rows(c) for c in df.columns if c.endswith("#rows")]
        if not count:
            factors += [F.col(f"`{m.owner}#{m.name}`") for m in t.measures if m.of_dimension]
        if not factors or not count and t.coef != 1 or not count and not t.measures:
            factors.insert(0, F.lit(1).cast("long") if count else F.lit(t.coef))
        out = reduce(lambda a, b: a * b, factors)
        mask = self._mask(t.masks, df)
        return out if mask is None else F.when(mask, out)

    def _rows(self, column: str) -> Column:
        cube = column.removesuffix("#rows")
        return F.coalesce(F.col(f"`{column}`"), F.lit(1).cast("long")) if cube in self.outer else F.col(f"`{column}`")

    def compile(self, q: n.Select) -> Compiled:
        self._bind_sources(q)
        self.group = []
        for g in q.group:
            found = self.column(g)
            if not isinstance(found, Axis):
                raise BindError(f"{g} is an attribute; groups are dimensions")
            if found.name in self.group:
                raise BindError(f"{g} stands twice in GROUP BY")
            self.group.append(found.name)
        self.filters, self.thetas = conjuncts(q.where), []
        for j in q.joins:
            for c in conjuncts(j.on):
                self._on(c)
        for w in self._wanted(x for f in self.filters for x in names_of(f)):
            pass  # unknown names are told before anything is planned

        having, order = q.having, list(q.order)
        aggregates: list[n.Aggregate] = []
        for e in [i.expr for i in q.items] + ([having] if having is not None else []) + [o.key for o in order]:
            aggregates += [a for a in n.aggregates(e) if a not in aggregates]
        if not aggregates and not self.group:
            raise BindError("a query has aggregates or GROUP BY")
        for i in q.items:
            self._check_item(i.expr)

        if not self.facts and not self.tables:  # without FROM, the measures say what is asked
            for a in aggregates:
                for name in self._plain_names(a.arg):
                    m = self.measure(name)
                    into = self.tables if m.of_dimension else self.facts
                    if m.owner not in into:
                        into.append(m.owner)
        frames: dict[tuple, dict] = {}

        def frame(facts: tuple[str, ...], dimensions=()) -> dict:
            facts = tuple(sorted(facts, key=lambda f: (self.facts.index(f) if f in self.facts else 99, f)))
            key = facts or tuple(f"dimension {d}" for d in dimensions)
            out = frames.setdefault(key, {"facts": facts, "dims": set(), "wanted": [], "powers": {}, "cells": False, "columns": []})
            out["dims"] |= set(dimensions)
            return out

        everything = tuple(self.facts)
        base = frame(everything) if everything else frame((), self.tables[:1]) if self.tables else None
        if base is None:
            raise BindError("no source to count groups of")

        terms_shown: dict[str, list[str]] = {}
        plans: dict[n.Aggregate, dict] = {}
        for k, a in enumerate(aggregates):
            plans[a] = self._plan(a, f"a{k}", frame, base, terms_shown)
        group_wanted = [Axis(g) for g in self.group]
        steps, ready = [], {}
        for key, f in frames.items():
            title = ", ".join(f["facts"]) or key[0]
            df, step = self._frame(f["facts"], f["dims"], list(dict.fromkeys(group_wanted + f["wanted"])), f["powers"], f["cells"], title)
            steps.append(step)
            columns = [make(df).alias(name) for name, make in f["columns"]]
            if f is base:
                rows = F.lit(1).cast("long")
                for c in f["facts"]:
                    rows = rows * self._rows(f"{c}#rows")
                columns.append(F.sum(rows).alias("__present"))
            ready[key] = df.groupBy(*self.group).agg(*columns) if self.group else df.agg(*columns)
        out = self._assembled(frames, ready, base)
        zero = {name: F.coalesce(F.col(name), F.lit(0)) for f in frames.values() for name, _ in f["columns"]}
        out = out.withColumns({name: F.coalesce(F.col(name), F.lit(0).cast(out.schema[name].dataType)) for name in zero}) if zero else out

        out, values = self._windowed(out, plans)
        return self._projected(q, out, values, steps, terms_shown)

    def _on(self, c) -> None:
        if isinstance(c, n.Compare) and isinstance(c.right, n.Name):
            a, b = self.column(c.left), self.column(c.right)
            if not isinstance(a, Axis) or not isinstance(b, Axis):
                raise BindError(f"{c}: joins compare dimensions")
            if a == b:
                if c.op != "=":
                    raise BindError(f"{c}: a dimension is compared with itself")
                return
            self.thetas.append(Theta(a.name, c.op, b.name))
        else:
            self.filters += [c]

    def _plain_names(self, expr) -> list[n.Name]:
        if isinstance(expr, n.Name):
            return [expr]
        if isinstance(expr, n.Arithmetic):
            return self._plain_names(expr.left) + self._plain_names(expr.right)
        if isinstance(expr, n.Case):
            return [x for _, v in expr.branches for x in self._plain_names(v)] + (self._plain_names(expr.otherwise) if expr.otherwise is not None else [])
        return []

    def _check_item(self, expr) -> None:
        if isinstance(expr, n.Name):
            found = self.column(expr)
            if not isinstance(found, Axis) or found.name not in self.group:
                raise BindError(f"{expr} is not in GROUP BY")
        elif isinstance(expr, n.Arithmetic):
            self._check_item(expr.left)
            self._check_item(expr.right)
        elif isinstance(expr, n.Case):
            raise BindError("CASE stands within an aggregate")

    def _plan(self, a: n.Aggregate, name: str, frame, base: dict, shown: dict) -> dict:
        """Columns an aggregate needs from which frames. num and den: lists of column names that are added up."""
        out = {"func": a.func, "num": [], "den": [], "over": a.over}
        masked = self._wanted(x for c in conditions_of(a.arg) for x in names_of(c))
        if a.distinct:
            if a.func != "COUNT" or not isinstance(a.arg, n.Name):
                raise BindError(f"{a}: DISTINCT counts a dimension")
            found = self.column(a.arg)
            if not isinstance(found, Axis):
                raise BindError(f"{a}: {a.arg} is an attribute")
            if found.name in self.group:
                raise BindError(f"{a}: {a.arg} is in GROUP BY")
            if a.over:
                raise BindError(f"{a}: distinct counts don't run")
            fact = next((f for f in self.facts if self._reach(self.catalog.cube(f).dims, found.name)), None)
            if fact is None:
                raise BindError(f"{a}: no source has {found.name!r}")
            f = frame((fact,))
            f["wanted"].append(found)
            f["columns"].append((name, lambda df: F.count_distinct(F.col(f"`{found.name}`"))))
            out["num"].append(name)
            shown[str(a)] = [f"distinct {found.name}"]
            return out
        if a.func in ("MIN", "MAX"):
            if not isinstance(a.arg, n.Name):
                raise BindError(f"{a}: {a.func} takes one measure")
            m = self.measure(a.arg)
            f = frame((), (m.owner,)) if m.of_dimension else frame((m.owner,))
            f["cells"] = True
            column = f"`{m.owner}#{m.name}`" if m.of_dimension else f"`{m.owner}^1`"
            make = F.min if a.func == "MIN" else F.max
            f["columns"].append((name, lambda df: make(F.col(column))))
            out["num"].append(name)
            shown[str(a)] = [str(m)]
            return out
        if a.func == "COUNT":
            if isinstance(a.arg, n.Star):
                terms = [Term(1.0)]
            else:
                if isinstance(a.arg, n.Name):
                    self.measure(a.arg)
                terms = normalize(a.arg, self.measure)
        else:
            terms = normalize(a.arg, self.measure)
        shown[str(a)] = [str(t) for t in terms]

        def needs(t: Term) -> dict:
            if t.cubes:
                f = frame(t.cubes, t.dimensions)
                for c in t.cubes:
                    f["powers"].setdefault(c, set()).add(t.power(c))
            elif t.dimensions:
                if len(t.dimensions) > 1:
                    raise BindError(f"{a}: measures of several dimensions without a fact")
                f = frame((), t.dimensions)
            else:
                f = base
            f["wanted"] += [m for m in masked if m not in f["wanted"]]
            return f

        def add(kind: str, group: list[Term], f: dict, count: bool, suffix: str) -> None:
            def make(df: DataFrame) -> Column:
                parts = [self._term(t, df, count) for t in group]
                return F.sum(reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0).cast("long" if count else "double")) for p in parts]))

            column = f"{name}{suffix}"
            f["columns"].append((column, make))
            out[kind].append(column)

        by_frame: dict[int, tuple[dict, list[Term]]] = {}
        for t in terms:
            f = needs(t)
            by_frame.setdefault(id(f), (f, []))[1].append(t)
        if a.func == "COUNT":
            # rows with an argument: of terms that share masks, the first stands for all
            for i, (f, group) in enumerate(by_frame.values()):
                unique = {t.masks: t for t in reversed(group)}
                add("num", list(unique.values()), f, True, f"_{i}")
            return out
        for i, (f, group) in enumerate(by_frame.values()):
            add("num", group, f, False, f"_{i}")
        if a.func == "AVG":
            f, group = next(iter(by_frame.values()), (base, [Term(1.0)]))
            unique = {t.masks: t for t in reversed(group)}
            zero = self._zero_branches(a.arg)
            unique |= {t.masks: t for t in zero if t.masks not in unique}
            add("den", list(unique.values()), f, True, "_d")
        return out

    def _zero_branches(self, expr) -> list[Term]:
        """CASE branches whose value is 0: no term, but rows with an argument."""
        if not isinstance(expr, n.Case):
            return []
        out, before = [], ()
        for condition, value in expr.branches:
            if isinstance(value, n.Literal) and not value.value:
                out.append(Term(1.0, (), (Mask(condition, before),)))
            before += (condition,)
        if isinstance(expr.otherwise, n.Literal) and not expr.otherwise.value:
            out.append(Term(1.0, (), (Mask(None, before),)))
        return out

    def _assembled(self, frames: dict, ready: dict, base: dict) -> DataFrame:
        """The base frame's groups that have rows, with the other frames' columns."""
        key = next(k for k, f in frames.items() if f is base)
        out = ready[key]
        if self.group:
            out = out.where("__present > 0")
        for k, df in ready.items():
            if k == key:
                continue
            if not self.group:
                out = out.crossJoin(df)  # one row each
                continue
            other = df.select(*[F.col(f"`{g}`").alias(f"__by_{g}") for g in self.group], *[c for c in df.columns if c not in self.group])
            out = out.join(other, _all([F.col(f"`{g}`").eqNullSafe(F.col(f"`__by_{g}`")) for g in self.group]), "left").drop(*[f"__by_{g}" for g in self.group])
        return out

    def _windowed(self, out: DataFrame, plans: dict) -> tuple[DataFrame, dict[n.Aggregate, Column]]:
        """Values of aggregates as columns; running ones over the ordinals of their order."""
        values = {}
        for a, p in plans.items():
            over = p["over"]
            num = [F.col(c) for c in p["num"]]
            den = [F.col(c) for c in p["den"]]
            if over is not None:
                if over.order is None:
                    raise BindError(f"{a}: a window needs ORDER BY")
                axis, partition = self._axis_of(over.order), [self._axis_of(x) for x in over.partition]
                if lost := [x for x in [axis, *partition] if x not in self.group]:
                    raise BindError(f"{a}: {lost[0]!r} is not in GROUP BY")
                if axis in partition:
                    raise BindError(f"{a}: {axis!r} both orders and partitions")
                at = f"__at_{axis}"
                by_key = over.back is None and self._in_key_order(axis)
                if not by_key and at not in out.columns:
                    positions = self._positions(axis).select(F.col(f"`{axis}`").alias("__key"), F.col("ordinal").alias(at))
                    out = out.join(positions, F.col(f"`{axis}`").eqNullSafe(F.col("__key")), "left").drop("__key")
                partition = partition or [g for g in self.group if g != axis]
                by = F.col(f"`{axis}`") if by_key else F.col(at)
                order = by.desc_nulls_first() if over.descending else by.asc_nulls_last()
                window = Window.partitionBy(*[F.col(f"`{x}`") for x in partition]).orderBy(order)
                window = window.rangeBetween(Window.unboundedPreceding if over.back is None else -over.back, 0)
                fold = {"MIN": F.min, "MAX": F.max}.get(p["func"], F.sum)
                num, den = [fold(c).over(window) for c in num], [F.sum(c).over(window) for c in den]
            total = reduce(lambda x, y: x + y, num) if num else F.lit(0.0)
            if den:
                rows = reduce(lambda x, y: x + y, den)
                total = F.when(rows != 0, total / rows).otherwise(F.lit(0.0))
            elif p["func"] == "COUNT":
                total = total.cast("long")
            values[a] = total
        return out, values

    def _in_key_order(self, axis: str) -> bool:
        """Whether the dictionary's order is that of the keys, as after a single load."""
        return len(self.catalog.dimension(axis)._batches) <= 1

    def _below(self, axis: str):
        """The step by which an axis without members of its own is reached."""
        for (_, parent), h in self.catalog.hierarchies.items():
            if parent == axis:
                return h
        raise BindError(f"dimension {axis!r} has no members")

    def _keys(self, axis: str) -> DataFrame:
        batches = self.catalog.dimension(axis)._batches
        if batches:
            return reduce(lambda a, b: a.unionByName(b), batches).distinct()
        h = self._below(axis)
        return h.climb(self._keys(h.child)).select(axis).distinct()

    def _positions(self, axis: str) -> DataFrame:
        d = self.catalog.dimension(axis)
        return d.members() if d._batches else dense_ordinals(self._keys(axis), axis)

    def _value(self, expr, values: dict) -> Column:
        if isinstance(expr, n.Aggregate):
            return values[expr]
        if isinstance(expr, n.Literal):
            return F.lit(expr.value) if isinstance(expr.value, str) else F.lit(float(expr.value))
        if isinstance(expr, n.Name):
            return F.col(f"`{self.column(expr).name}`")
        a, b = self._value(expr.left, values), self._value(expr.right, values)
        if expr.op == "/":
            return F.when(b != 0, a / b).otherwise(F.lit(0.0))
        return {"+": a + b, "-": a - b, "*": a * b}[expr.op]

    def _projected(self, q: n.Select, out: DataFrame, values: dict, steps: list[Step], shown: dict) -> Compiled:
        items: list[tuple[str, Column]] = []
        for i in q.items:
            if isinstance(i.expr, n.Star):
                items += [(g, F.col(f"`{g}`")) for g in self.group]
            else:
                items.append((i.label, self._value(i.expr, values)))
        labels = [x for x, _ in items]
        if len(set(labels)) != len(labels):
            raise BindError(f"two columns are called {next(x for x in labels if labels.count(x) > 1)!r}")
        hidden = {f"__h{k}": v for k, (a, v) in enumerate(values.items())}
        names = {a: f"__h{k}" for k, a in enumerate(values)}
        group = {f"__g_{g}": F.col(f"`{g}`") for g in self.group}
        df = out.select(*[c.alias(x) for x, c in items], *[c.alias(x) for x, c in hidden.items()], *[c.alias(x) for x, c in group.items()])

        def of(key) -> Column:
            if isinstance(key, n.Literal) and isinstance(key.value, int):
                if not 1 <= key.value <= len(labels):
                    raise BindError(f"there is no column {key.value}")
                return F.col(f"`{labels[key.value - 1]}`")
            if isinstance(key, n.Name) and str(key) in labels or isinstance(key, n.Name) and key.name in labels:
                return F.col(f"`{str(key) if str(key) in labels else key.name}`")
            if isinstance(key, n.Aggregate):
                return F.col(names[key])
            if isinstance(key, n.Arithmetic):
                a, b = of(key.left), of(key.right)
                return F.when(b != 0, a / b).otherwise(F.lit(0.0)) if key.op == "/" else {"+": a + b, "-": a - b, "*": a * b}[key.op]
            if isinstance(key, n.Literal):
                return F.lit(key.value)
            if str(key) in labels:
                return F.col(f"`{key}`")
            if isinstance(key, n.Name) and f"__g_{key.name}" in df.columns:
                return F.col(f"`__g_{key.name}`")
            raise BindError(f"no output column {key}")

        def having(c) -> Column:
            if isinstance(c, n.Both):
                return having(c.left) & having(c.right)
            if isinstance(c, n.Either):
                return having(c.left) | having(c.right)
            if isinstance(c, n.Negation):
                return ~having(c.inner)
            if not isinstance(c, n.Compare):
                raise BindError(f"HAVING compares output columns, not {c}")
            return self._compared(c.op, of(c.left), of(c.right) if isinstance(c.right, n.Name) else F.lit(c.right.value))

        if q.having is not None:
            df = df.where(having(q.having))
        chosen = [F.col(f"`{x}`") for x in labels]
        keys = [of(o.key).desc_nulls_last() if o.descending else of(o.key).asc_nulls_first() for o in q.order]
        if keys or q.limit is not None:
            df, by_group = self._by_position(df)  # groups break ties, so that LIMIT is one result
            df = df.orderBy(*keys, *by_group) if keys or by_group else df
            df = df.limit(q.limit) if q.limit is not None else df
            return Compiled(df.select(*chosen), labels, list(self.group), steps, shown)

        def in_order() -> DataFrame:
            placed, by_group = self._by_position(df)
            return (placed.orderBy(*by_group) if by_group else placed).select(*chosen)

        return Compiled(df.select(*chosen), labels, list(self.group), steps, shown, in_order)

    def _by_position(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """The group keys' order: that of their dictionaries, which is the keys' own unless a dimension grew by several loads."""
        order = []
        for g in self.group:
            if self._in_key_order(g):
                order.append(F.col(f"`__g_{g}`").asc_nulls_last())
            else:
                positions = self._positions(g).select(F.col(f"`{g}`").alias("__key"), F.col("ordinal").alias(f"__p_{g}"))
                df = df.join(positions, F.col(f"`__g_{g}`").eqNullSafe(F.col("__key")), "left").drop("__key")
                order.append(F.col(f"`__p_{g}`").asc_nulls_last())
        return df, order
