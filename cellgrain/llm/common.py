"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Narrow rows that a checkpoint's file may hold.
ROWS_A_FILE = 250_000


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset
    (tests, notebooks) a folder below the warehouse is used. ``rows``: about how many narrow rows there are, where that is
    known; a few rows then make few files, whatever the number of shuffle partitions (each file costs round trips to the store).
    """
    spark = df.sparkSession
    if rows is not None:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(1, min(most, -(-rows // ROWS_A_FILE))))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)


def apart(*columns: str) -> Column:
    """A key within a struct: it fits no partitioning that there is, so both sides of a join by it are shuffled for this join alone and AQE can split a hot key."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where all characters are ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers idle on beside the tasks that come after."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def regex_spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of struct(start, end, match, group), offsets in code points, end exclusive.

    SQL functions give the matches and, by splitting, the texts between them; offsets are
    running sums of their lengths. Sums are taken by blocks of 128, which keeps a text of
    very many matches from costing the square of their number.
    """
    block = 128

    def over_steps(found: Column, between: Column, group: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))
        zero = F.lit(0)

        def total(part: Column) -> Column:
            return F.aggregate(part, zero, lambda a, x: a + x)

        def with_steps(steps: Column) -> Column:
            n = F.size(steps)
            blocks = F.transform(F.sequence(zero, F.floor((n - 1) / block).cast("int")), lambda b: total(F.slice(steps, b * block + 1, block)))

            def with_blocks(sums: Column) -> Column:
                before = F.transform(sums, lambda s, b: total(F.slice(sums, 1, b)))

                def with_before(before: Column) -> Column:
                    def one(m: Column, i: Column) -> Column:
                        b = F.floor(i / block).cast("int")
                        end = F.get(before, b) + total(F.slice(steps, b * block + 1, i - b * block + 1))
                        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"), F.get(group, i).alias("group"))

                    return F.transform(found, one)

                return let(before, with_before)

            return let(blocks, with_blocks)

        return let(steps, with_steps)

    empty = F.array().cast("array<struct<start:int,end:int,match:string,group:string>>")

    def from_found(found: Column) -> Column:
        group = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)) if groups else found
        some = let(F.struct(F.split(text, pattern, -1).alias("between"), group.alias("group")), lambda x: over_steps(found, x["between"], x["group"]))
        return F.when(F.size(found) == 0, empty).otherwise(some)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_found)
