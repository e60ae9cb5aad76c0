"""Tables of a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Catalyst prunes columns and pushes filters into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least twice as many partitions as there are cores.

    Work that costs much more than reading, such as tokenizing, must not run in the few tasks that a few small
    files give. A scan that has enough partitions comes back unchanged, so large inputs aren't shuffled.
    """
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
