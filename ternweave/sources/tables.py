"""Reading tables for work that is heavier than the read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table over all cores.

    A Parquet file is read by as many tasks as it has row groups, so a small file is one task, and so is everything up to the next
    exchange.  A table with fewer bytes than the cores' scan tasks would take is dealt out first; a larger one is
    left as it is, for its scan has enough tasks."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df
