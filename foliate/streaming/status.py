"""Streaming counters and the status machine; each can run over what is there now and give a batch result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.sources.shared import new_folder


def read_events(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """A stream of event files with a watermark; naive timestamps are read in the session's zone."""
    schema = spark.read.parquet(path).schema
    parent = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", parent[1]).parquet(parent[0])
    return source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def daily_counts(events: DataFrame) -> DataFrame:
    """day, event_type, n, total: a one-day window each."""
    counted = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def latest_status(events: DataFrame, state: Column) -> DataFrame:
    """user_id, status, n: the last state by time and the number of changes; one small row of state a key."""
    return events.withColumn("status", state).groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n"))


def run_now(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for the input that is there now, as a table.

    Each batch's whole result is written by the tasks to the shared folder, the last one is read: no row passes through the driver.
    """
    spark = stream.sparkSession
    folder, last = new_folder(spark, "stream"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        last[:] = [number]

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def run_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    return run_now(daily_counts(read_events(spark, path)), "complete")


def run_latest_status(spark: SparkSession, path: str, state: Column) -> DataFrame:
    return run_now(latest_status(read_events(spark, path), state), "complete")
