"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder, columns pruned by whatever is selected from it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work enough tasks when a scan has too few splits (a file with one row group is one task).

    Only for plain scans: the partition count is taken from the plan before any shuffle.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() * 2 > wanted else scan.repartition(wanted)
