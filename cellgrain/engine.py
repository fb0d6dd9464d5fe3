"""The facade: load facts and dimensions, ask queries."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import catalog as c
from .plans import explain as x
from .plans.compiler import Compiled, Compiler
from .plans.parser import parse
from .result import ResultSet
from .sources import loaders, store


class Engine:
    """A catalog, a session, and compiled queries.

    ``cache`` keeps cell and dimension tables in executor memory (spilling to disk) once they are first read.
    """

    def __init__(self, spark: SparkSession, catalog: c.Catalog | None = None, cache: bool = False):
        self.spark, self.catalog, self.cache = spark, catalog or c.Catalog(), cache
        self._plans: dict[tuple, Compiled] = {}
        self.hits = self.misses = 0

    # catalog

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        return cls(spark, store.load(spark, path))

    def save(self, path: str, **options) -> None:
        store.save(self.catalog, self.spark, path, **options)

    def load_frame(self, data, dims: Sequence[str], measure: str, name: str | None = None, **options) -> c.Cube:
        self._plans.clear()
        return loaders.load_fact(self.catalog, loaders.to_frame(self.spark, data), dims, measure, name, **{"cache": self.cache} | options)

    def load_csv(self, path: str, dims: Sequence[str], measure: str, name: str | None = None, schema=None, **options) -> c.Cube:
        return self.load_frame(loaders.read_csv(self.spark, path, schema), dims, measure, name, **options)

    def load_sql(self, connection, query, dims: Sequence[str], measure: str, name: str | None = None, **options) -> c.Cube:
        """Rows of a query by a connection or a JDBC url; the two are told apart, so they may come in either order."""
        if isinstance(connection, str) and not (isinstance(query, str) and connection.startswith("jdbc:")):
            connection, query = query, connection
        return self.load_frame(loaders.read_sql(self.spark, query, connection), dims, measure, name, **options)

    def load_dimension(self, data, key: str, name: str | None = None, **options) -> c.Dimension:
        self._plans.clear()
        return loaders.load_dimension(self.catalog, loaders.to_frame(self.spark, data), key, name, **{"cache": self.cache} | options)

    def add_hierarchy(self, child: str, parent: str, mapping, parent_ordered: bool = False) -> c.Hierarchy:
        self._plans.clear()
        return loaders.add_hierarchy(self.catalog, self.spark, child, parent, mapping, parent_ordered)

    def add_cube(self, cube: c.Cube) -> c.Cube:
        self._plans.clear()
        return self.catalog.add_cube(cube)

    def grant(self, role: str, axis: str, allowed=None, can_project: bool = True, permissive: bool = True) -> c.Role:
        self._plans.clear()
        return self.catalog.grant(role, axis, allowed, can_project, permissive)

    def use_engine(self, spark: SparkSession) -> Engine:
        """Go on with another session of the same application; plans are compiled anew."""
        self.spark = spark
        self._plans.clear()
        return self

    @property
    def cubes(self) -> list[str]:
        return list(self.catalog.cubes)

    @property
    def dimensions(self) -> list[str]:
        return list(self.catalog.dimensions)

    def cube(self, name: str) -> c.Cube:
        return self.catalog.cube(name)

    def stats(self, name: str) -> dict:
        return self.catalog.stats(name)

    def summary(self) -> str:
        return self.catalog.summary()

    # queries

    def compile(self, query: str, role: str | None = None) -> Compiled:
        """The query's plan; the same query, however it is spaced and cased, over the same cubes for the same role is compiled once."""
        parsed = parse(query)
        key = (repr(parsed), role, tuple((n, v.version) for n, v in sorted(self.catalog.cubes.items())))
        if key in self._plans:
            self.hits += 1
        else:
            self.misses += 1
            self._plans[key] = Compiler(self.spark, self.catalog, role).compile(parsed)
        return self._plans[key]

    def sql(self, query: str, role: str | None = None) -> ResultSet:
        began = time.perf_counter()
        compiled = self.compile(query, role)
        stats = {"compile_seconds": time.perf_counter() - began, "engine": "spark", "group_shape": compiled.group, "plan_cache": {"hits": self.hits, "misses": self.misses}}
        return ResultSet(compiled.df, compiled.in_order, stats)

    def frame(self, query: str, role: str | None = None) -> DataFrame:
        """The query as a DataFrame, with no order that it doesn't ask for."""
        return self.compile(query, role).df

    def _sizes(self) -> dict[str, int]:
        return {d.name: d.rows for d in self.catalog.dimensions.values() if d.rows is not None}

    def explain(self, query: str, role: str | None = None, physical: bool = False) -> str:
        compiled = self.compile(query, role)
        out = x.describe(compiled, self._sizes())
        if physical:
            out += "\n" + compiled.df._sc._jvm.PythonSQLUtils.explainString(compiled.df._jdf.queryExecution(), "formatted")
        return out

    def decompose(self, query: str, role: str | None = None) -> list[list[dict]]:
        """Each frame as a chain of binary products."""
        return [x.chain(s) for s in self.compile(query, role).steps]

    def term(self, query: str, role: str | None = None) -> list[str]:
        return [x.term(s) for s in self.compile(query, role).steps]

    def einsum_of(self, query: str, role: str | None = None) -> list[str]:
        return [x.spec(s) for s in self.compile(query, role).steps]
