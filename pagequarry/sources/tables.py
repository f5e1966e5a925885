"""Reading tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and column choice reach the scan as they are."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the scan has fewer splits than the cluster has cores.

    Text work per row is heavy, and a small file is one split. A large table has more splits than
    cores already, and is left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
