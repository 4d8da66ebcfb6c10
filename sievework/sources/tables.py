"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``, one parquet file or folder each."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``table``, dealt out to all cores if its files make fewer read tasks than half of them.

    For work that is heavy per row: a single small file would otherwise be one task.
    Tables of many files are read as they are, without a shuffle.
    """
    df, cores = table(spark, folder, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
