"""Screening a stream of shipments, tailing job logs, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def screen_stream(shipments: DataFrame, screen: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Screen each micro-batch of a streaming DataFrame and write it as Parquet.

    ``screen`` is called once a batch, so policies and reference tables that it
    reads are the same for the whole batch.  A batch has its own folder, which
    a repeated batch overwrites, so results are written exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        screen(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = shipments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tail(log: DataFrame, after: int = 0) -> DataFrame:
    """Log rows of a stream beyond an id, in append mode."""
    return log.where(F.col("log_id") > after)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window; those later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a streaming DataFrame over what there is, appending to ``path``."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_new(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The Parquet files of a table as a stream; the schema is the files' own."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
