"""Incremental ingest: new files of a folder, once each, upserted into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import last_write, with_schema


def ingest(
    spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, key: str, order: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df
) -> None:
    """Reads the Parquet files of folder that no earlier call has read, and writes the latest row of each key as one batch
    folder of table. The checkpoint takes the place of a manifest: a call that fails is repeated, and a batch that was written
    is overwritten by its repetition."""

    def write(batch: DataFrame, number: int) -> None:
        latest = last_write(transform(batch), key, order)
        latest.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, table: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key over all batches, later batches last."""
    rows = spark.read.option("basePath", table).parquet(f"{table}/batch=*")
    return with_schema(last_write(rows, key, [*order, "batch"]), schema)


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window start, by, n) of a stream or a table of events; in a stream, windows close when the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
