"""Cubes kept up to date by streams.

Loading is additive, so a stream of facts needs no state beyond the cells: each micro-batch becomes
a small cube, appended under its batch number; reading adds the deltas up. A batch that
is run again after a failure overwrites its own delta, so that every fact counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame, dims: Sequence[str], measure: str) -> DataFrame:
    value = F.col(measure).cast("double")
    return df.groupBy(*dims).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("value"), F.count(value).alias("__count"), F.count(F.lit(1)).alias("__rows"))


def start(stream: DataFrame, dims: Sequence[str], measure: str, path: str, checkpoint: str, trigger: dict | None = None):
    """A running query that writes a delta cube for each micro-batch below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        cells(batch, dims, measure).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark, path: str, dims: Sequence[str]) -> DataFrame:
    """The cube: all deltas added up."""
    parts = spark.read.parquet(path)
    return parts.groupBy(*dims).agg(F.sum("value").alias("value"), F.sum("__count").alias("__count"), F.sum("__rows").alias("__rows"))


def maintain(stream: DataFrame, dims: Sequence[str], measure: str, path: str, checkpoint: str) -> DataFrame:
    """Take in all that the stream's source holds now, then read the cube."""
    start(stream, dims, measure, path, checkpoint).awaitTermination()
    return read(stream.sparkSession, path, dims)


def compact(spark, path: str, dims: Sequence[str], target: str) -> None:
    """The cube in one table, for sources that stand still."""
    read(spark, path, dims).write.mode("overwrite").parquet(target)


def live(stream: DataFrame, dims: Sequence[str], measure: str, event_time: str | None = None, delay: str = "1 hour", window: str | None = None) -> DataFrame:
    """The cube as a streaming aggregation; with ``event_time``, late rows beyond ``delay`` are left out and ``window`` groups by time."""
    if event_time:
        stream = stream.withWatermark(event_time, delay)
    groups = [*dims, *([F.window(event_time, window).alias("window")] if window else [])]
    value = F.col(measure).cast("double")
    return stream.groupBy(*groups).agg(F.sum(value).alias("value"), F.count(value).alias("__count"), F.count(F.lit(1)).alias("__rows"))
