"""Roll-ups of streams: windowed counts with late events, and running tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's parquet files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")


def windowed_counts(events: DataFrame, when: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and key; events later than ``late`` behind the newest are dropped by the watermark."""
    timed = events.withColumn("_t", F.col(when).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def once_each(events: DataFrame, when: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Events without repeats of ``keys`` within the watermark."""
    return events.withColumn("_t", F.col(when).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def run_to_table(stream: DataFrame, table: str, mode: str, checkpoint: str) -> None:
    """Run a stream over what is there into a memory table."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
