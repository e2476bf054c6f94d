"""Scan parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has room for.

    A Parquet file of one row group is one task however many cores wait. Large inputs have more splits than
    that and are returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < 2 * cores else df
