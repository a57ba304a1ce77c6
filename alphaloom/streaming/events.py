"""Structured Streaming over event tables: windows, and duplicates within a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType().add("event_id", "long").add("ts", "timestamp_ntz").add("user_id", "long").add("event_type", "string").add("value", "double").add("props", "string")


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a path (a glob); ts becomes a timestamp, as watermarks need."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "60 minutes", step: str = "10 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def without_duplicates(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; later and late ones are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, directory: str, mode: str) -> DataFrame:
    """Runs a stream over all that its source has and returns what it wrote, from Parquet in the directory.

    mode complete: the last result replaces those before; append: all results.
    """
    spark, run = stream.sparkSession, uuid.uuid4().hex
    out, marks = f"{directory.rstrip('/')}/{run}/out", f"{directory.rstrip('/')}/{run}/marks"
    write: Callable[[DataFrame, int], None] = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
