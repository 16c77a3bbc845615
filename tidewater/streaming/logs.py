"""Streams over event logs: idempotent append, and counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats are no later than ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, by: str, value: str) -> DataFrame:
    """An extension: counts and sums by tumbling event-time window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def run_to_end(stream: DataFrame, spark: SparkSession, out: str, mode: str = "append") -> DataFrame:
    """All that the source holds now, written to ``out`` and read again."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
