"""Sides of a join whose size is checked before they are sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most so many rows is sent to every executor.
MOST_SENT = 50_000


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows; with more rows Spark shuffles (an equi-join) or tiles (no key) instead."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where the scan of a small table (few files of few row groups) would use fewer; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
