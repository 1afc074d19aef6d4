"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``ts`` as an instant: the files carry a zoneless timestamp."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are cores.

    For work that is heavy per row on a small file, and for scans only: asking a query with a
    shuffle for its partitions would run the shuffle. A large table has more partitions than
    cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
