"""Structured Streaming over event and call files: the extension of the batch operators to unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, lateness: str) -> DataFrame:
    """Counts and sums for each tumbling window; rows later than ``lateness`` are dropped, as a watermark does."""
    w = events.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", "total")


def distinct_events(events: DataFrame, ts: str, key: str, lateness: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def site_rates(calls: DataFrame) -> DataFrame:
    """Running counts of each site over a stream of calls."""
    g = F.col("g")
    return calls.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(g.isNull()).alias("missing"), F.coalesce(F.sum(g), F.lit(0)).alias("dosage"))


def upsert_into(path: str, key: str, version: str):
    """A function for ``foreachBatch`` that keeps the latest row of each key in a table, written to a new folder for each batch."""
    from ..operators.tables import upsert

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/{epoch - 1}") if epoch else batch.limit(0)
        upsert(old, batch, key, version, key).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return write
