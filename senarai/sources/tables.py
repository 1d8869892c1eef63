"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; a file or a directory of part files, columns pruned by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for stages that compute much a row. Tables of many files
    already are; only a small table in fewer pieces than cores is shuffled, round robin."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df._jdf.queryExecution().toRdd().getNumPartitions() < wanted else df
