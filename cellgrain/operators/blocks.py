"""Products of two tensors by blocks of dense vectors, for operands with few summed keys that are mostly filled.

A join makes one row for each pair of cells that meet, and shuffles it to be gathered: for full matrices that is the number of
summed keys times the result. Here each operand's cells are gathered once into vectors over the summed keys, vectors into
chunks, and each pair of chunks is multiplied by NumPy in one task; rows of the result are made where they are used, without a
shuffle. A pair of chunks is the unit of work, so tasks grow in number with the result and not in size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semirings import Semiring

#: Summed keys that vectors may have; with more, the join is left to do it.
MOST_KEYS = 4096
#: Vectors of a chunk, numbers of a chunk, and vectors of the left chunk that are multiplied at once (they fit a core's cache).
CHUNK, NUMBERS, ROWS = 1024, 1 << 20, 64
#: Of a semiring: how it gathers, what it takes for "nothing yet", and how it combines. As in Spark, NaN is above all numbers.
KERNELS = {
    "sum-prod": (np.add, 0.0, np.multiply), "bool-or-and": (np.maximum, -np.inf, np.fmin), "max-prod": (np.maximum, -np.inf, np.multiply),
    "min-prod": (np.fmin, np.nan, np.multiply), "max-plus": (np.maximum, -np.inf, np.add), "min-plus": (np.fmin, np.nan, np.add),
}


def product(left: DataFrame, right: DataFrame, rows: Sequence[str], columns: Sequence[str], summed: Sequence[str], ring: Semiring) -> DataFrame | None:
    """``rows``, ``columns`` and ``value`` of the product; None where only a join can do it (many summed keys, null values, another semiring)."""
    if ring.name not in KERNELS or not (rows and columns and summed):
        return None
    spark = left.sparkSession
    names = [f"__c{i}" for i in range(len(summed))]
    counts = [
        df.groupBy(*[F.col(f"`{a}`").alias(c) for a, c in zip(summed, names)]).agg(F.count(F.lit(1)).alias(f"__n{i}"), F.count_if(F.col("value").isNull()).alias(f"__null{i}"))
        for i, df in enumerate((left, right))
    ]
    keys = counts[0].join(counts[1], names).limit(MOST_KEYS + 1).collect()
    if len(keys) > MOST_KEYS or any(k["__null0"] or k["__null1"] for k in keys):
        return None
    schema = T.StructType([*[T.StructField(c, left.schema[a].dataType) for a, c in zip(summed, names)], T.StructField("__c", T.IntegerType())])
    numbered = F.broadcast(spark.createDataFrame([(*[k[c] for c in names], i) for i, k in enumerate(keys)], schema))
    size = max(32, min(CHUNK, NUMBERS // max(1, len(keys))))
    sides = []
    for i, (df, axes, side) in enumerate(((left, rows, "l"), (right, columns, "r"))):
        own = [f"__{side}{j}" for j in range(len(axes))]
        cells = df.select(*[F.col(f"`{a}`").alias(o) for a, o in zip(axes, own)], *[F.col(f"`{a}`").alias(c) for a, c in zip(summed, names)], "value")
        vectors = cells.join(numbered, names).groupBy(*own).agg(F.collect_list("__c").alias("__at"), F.collect_list("value").alias("__values"))
        fields = [T.StructField(o, T.ArrayType(vectors.schema[o].dataType)) for o in own]
        fields += [T.StructField(f"__{side}{x}", T.BinaryType()) for x in ("first", "second", "there")]
        chunks = vectors.mapInArrow(_packer(len(own), [f.name for f in fields], len(keys), size, ring.name), T.StructType(fields))
        # two chunks a partition where all vectors have the commonest key; this is also what keeps chunks from being made anew for each pair
        sides.append(chunks.repartition(max(1, -(-max((k[f"__n{i}"] for k in keys), default=0) // (2 * size)))))
    types = [sides[0].schema[f"__l{j}"].dataType.elementType for j in range(len(rows))]
    fields = [T.StructField(f"__l{j}", t) for j, t in enumerate(types)] + [sides[1].schema[f"__r{j}"] for j in range(len(columns))]
    fields.append(T.StructField("__values", T.ArrayType(T.DoubleType())))
    out = sides[0].crossJoin(sides[1].hint("shuffle_replicate_nl")).mapInArrow(_multiplier(len(rows), len(columns), len(keys), ring.name), T.StructType(fields))
    out = out.select("*", F.posexplode("__values").alias("__pos", "value"))
    return out.select(*[F.col(f"__l{j}").alias(a) for j, a in enumerate(rows)], *[F.get(f"__r{j}", F.col("__pos")).alias(a) for j, a in enumerate(columns)], "value")


def _packer(axes: int, names: list[str], keys: int, size: int, ring: str):
    """Vectors to chunks: their keys, a matrix of values (a second one where cells that come twice have two extremes that matter), and a mask unless all cells are there."""
    gather, nothing, combine = KERNELS[ring]

    def matrix(flat, values, n, how, start):
        out = np.full(n * keys, start)
        how.at(out, flat, values)
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                n, at = part.num_rows, part.column(axes)
                at, lengths = at.flatten().to_numpy(zero_copy_only=False), np.diff(at.offsets.to_numpy())
                values = part.column(axes + 1).flatten().to_numpy(zero_copy_only=False)
                flat = np.repeat(np.arange(n, dtype=np.int64), lengths) * keys + at
                there = np.bincount(flat, minlength=n * keys)
                second = None
                if there.max(initial=0) <= 1:
                    first = np.zeros(n * keys)
                    first[flat] = values
                elif combine is not np.multiply or ring == "sum-prod" or (values >= 0).all():
                    first = matrix(flat, values, n, gather, nothing)  # the semiring distributes here
                else:  # products of negative numbers: the extremes of either cell make those of all pairs
                    first = matrix(flat, values, n, np.maximum, -np.inf) if gather is np.maximum else matrix(flat, values, n, np.fmax, np.nan)
                    second = matrix(flat, values, n, np.fmin, np.nan)
                whole = bool(there.all())
                if not whole:
                    first[there == 0] = 0.0
                    if second is not None:
                        second[there == 0] = 0.0
                columns = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(j)) for j in range(axes)]
                columns += [pa.array([x], pa.binary()) for x in (first.tobytes(), None if second is None else second.tobytes(), None if whole else (there > 0).tobytes())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return pack


def _multiplier(rows: int, columns: int, keys: int, ring: str):
    """Pairs of chunks to rows of the result: a left vector's keys, and lists of the right vectors' keys and of values."""
    gather, nothing, combine = KERNELS[ring]

    def multiplied(a, b, here, there):
        """``a``: layers of some left vectors; ``b``: layers of the right chunk, turned."""
        if ring == "sum-prod" and (here is None and there is None or np.isfinite(a[0]).all() and np.isfinite(b[0]).all()):
            return a[0] @ b[0]
        out = np.full((a[0].shape[0], b[0].shape[1]), nothing)
        one = np.empty_like(out)
        for k in range(keys):
            both = None
            if here is not None or there is not None:
                both = (True if here is None else here[:, k, None]) & (True if there is None else there[k])
            for x in a:
                for y in b:
                    combine(x[:, k, None], y[k], out=one)
                    if both is not None:
                        one[~np.broadcast_to(both, one.shape)] = nothing
                    gather(out, one, out=out)
        return out

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*[f"__l{j}" for j in range(rows)], *[f"__r{j}" for j in range(columns)], "__values"]
        for batch in batches:
            for i in range(batch.num_rows):
                cell = [batch.column(j)[i] for j in range(batch.num_columns)]
                left, right = cell[: rows + 3], cell[rows + 3 :]
                n, m = len(left[0].values), len(right[0].values)

                def read(x, count, kind):
                    return np.frombuffer(x.as_buffer(), kind).reshape(count, keys) if x.is_valid else None

                a = [x for x in (read(left[rows], n, float), read(left[rows + 1], n, float)) if x is not None]
                b = [np.ascontiguousarray(x.T) for x in (read(right[columns], m, float), read(right[columns + 1], m, float)) if x is not None]
                here, there = read(left[rows + 2], n, bool), read(right[columns + 2], m, bool)
                there = None if there is None else np.ascontiguousarray(there.T)
                tiled = [pa.concat_arrays([x.values] * min(ROWS, n)) for x in right[:columns]]
                for begin in range(0, n, ROWS):
                    end = min(n, begin + ROWS)
                    mask = None if here is None else here[begin:end]
                    out = multiplied([x[begin:end] for x in a], b, mask, there).ravel()
                    at, lists = np.arange(end - begin + 1, dtype=np.int32) * m, [x.slice(0, (end - begin) * m) for x in tiled]
                    if here is not None or there is not None:  # pairs without a common key are no rows
                        meet = (np.ones((end - begin, keys), np.float32) if mask is None else mask.astype(np.float32)) @ (np.ones((keys, m), np.float32) if there is None else there.astype(np.float32)) > 0
                        found = np.flatnonzero(meet)
                        at, out = np.concatenate([[0], np.cumsum(meet.sum(axis=1))]).astype(np.int32), out[found]
                        lists = [x.take(pa.array(found)) for x in lists]
                    made = [pa.ListArray.from_arrays(pa.array(at), x) for x in [*lists, pa.array(out)]]
                    yield pa.RecordBatch.from_arrays([*[x.values.slice(begin, end - begin) for x in left[:rows]], *made], names)

    return multiply
