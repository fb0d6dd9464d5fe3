"""Catalogs on disk: a manifest in JSON, and a Parquet table for each cube and dimension."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Cube, Grant, Hierarchy, Role


def save(catalog: Catalog, spark: SparkSession, path: str, compression: str = "zstd", partition_by: Sequence[str] = ()) -> None:
    """Write everything below ``path``, in any file system that Spark writes.

    ``partition_by``: dimensions by whose values cubes that have them are laid out, for pruning.
    A hierarchy given as a function is stored as the table of its members.
    """
    manifest = {"cubes": [], "dimensions": [], "hierarchies": [], "roles": []}
    for i, cube in enumerate(catalog.cubes.values()):
        by = [d for d in partition_by if d in cube.dims]
        cube.cells.write.mode("overwrite").option("compression", compression).partitionBy(*by).parquet(f"{path}/cubes/{i}")
        manifest["cubes"].append({"name": cube.name, "measure": cube.measure, "dims": cube.dims, "agg": cube.agg, "layout": cube.layout, "version": cube.version, "schema": cube.cells.schema.json()})
    for i, d in enumerate(catalog.dimensions.values()):
        entry = {"name": d.name, "ordered": d.ordered, "attributes": d.attributes, "measures": d.measures, "rows": d.rows, "table": d.table is not None, "members": bool(d._batches)}
        if d.table is not None:
            d.table.write.mode("overwrite").option("compression", compression).parquet(f"{path}/dimensions/{i}/table")
        if d._batches:
            d.members().write.mode("overwrite").option("compression", compression).parquet(f"{path}/dimensions/{i}/members")
        manifest["dimensions"].append(entry)
    for i, ((child, parent), h) in enumerate(catalog.hierarchies.items()):
        table = h.table if h.table is not None else h.climb(_members(catalog, child)).select(child, parent).distinct()
        table.write.mode("overwrite").option("compression", compression).parquet(f"{path}/hierarchies/{i}")
        manifest["hierarchies"].append({"child": child, "parent": parent, "rows": h.rows})
    for i, role in enumerate(catalog.roles.values()):
        grants = {}
        for j, (axis, g) in enumerate(role.grants.items()):
            table = f"roles/{i}/{j}" if isinstance(g.allowed, DataFrame) else None
            if table:
                g.allowed.select(axis).write.mode("overwrite").option("compression", compression).parquet(f"{path}/{table}")
            grants[axis] = {"allowed": None if table else g.allowed, "table": table, "can_project": g.can_project}
        manifest["roles"].append({"name": role.name, "permissive": role.permissive, "grants": grants})
    spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _members(catalog: Catalog, name: str) -> DataFrame:
    d = catalog.dimension(name)
    if d._batches:
        return d.members().select(name)
    below = next(h for (_, p), h in catalog.hierarchies.items() if p == name)
    return below.climb(_members(catalog, below.child)).select(name).distinct()


def load(spark: SparkSession, path: str) -> Catalog:
    """A catalog as it was saved. Tables are read lazily, so that filters and columns reach Parquet."""
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    out = Catalog()
    for i, entry in enumerate(manifest["dimensions"]):
        d = out.ensure_dimension(entry["name"], None, entry["ordered"])
        if entry["members"]:
            d._ordinals = spark.read.parquet(f"{path}/dimensions/{i}/members")
            d._batches = [d._ordinals.select(d.name)]
            d.data_type = d._ordinals.schema[d.name].dataType
        if entry["table"]:
            d.set_attributes(spark.read.parquet(f"{path}/dimensions/{i}/table"), entry["attributes"], entry["measures"], entry["rows"])
    for i, entry in enumerate(manifest["cubes"]):
        from pyspark.sql import types as T

        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        cells = spark.read.schema(schema).parquet(f"{path}/cubes/{i}").select(*[F.col(f"`{c}`") for c in schema.names])
        out.cubes[entry["name"]] = Cube(entry["name"], entry["measure"], entry["dims"], cells, None, entry["agg"], entry["layout"], entry["version"])
    for i, entry in enumerate(manifest["hierarchies"]):
        out.add_hierarchy(Hierarchy(entry["child"], entry["parent"], spark.read.parquet(f"{path}/hierarchies/{i}"), rows=entry["rows"]))
    for entry in manifest["roles"]:
        role = out.roles[entry["name"]] = Role(entry["name"], entry["permissive"])
        role.grants = {axis: Grant(spark.read.parquet(f"{path}/{g['table']}") if g["table"] else g["allowed"], g["can_project"]) for axis, g in entry["grants"].items()}
    return out


def read_cube(spark: SparkSession, path: str, condition: str | None = None) -> DataFrame:
    """One stored table, lazily; ``condition`` is pushed to the files."""
    df = spark.read.parquet(path)
    return df.where(condition) if condition else df
