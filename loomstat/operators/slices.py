"""Windows over rows of few keys, cut into slices of time, so that a key's rows are not all in one task.

A slice brings along the rows of its neighbour that its own rows can still see; results are those of the whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts_within(df: DataFrame, keys: list[str], before: int, after: int, ts: str = "ts", slice_hours: int = 6) -> DataFrame:
    """df with k: the rows of the key from `before` microseconds before to `after` microseconds after each row, itself included."""
    length = max(slice_hours * 3_600_000_000, before, after)
    t = F.unix_micros(ts)
    own = F.floor(t / length)
    seen_by = F.array_compact(F.array(own, F.when(F.lit(before > 0) & (F.floor((t + before) / length) > own), own + 1), F.when(F.lit(after > 0) & (F.floor((t - after) / length) < own), own - 1)))
    rows = df.withColumn("slice_own", own).withColumn("slice", F.explode(seen_by))
    w = Window.partitionBy(*keys, "slice").orderBy(t).rangeBetween(-before, after)
    return rows.withColumn("k", F.count(F.lit(1)).over(w)).where("slice = slice_own").drop("slice", "slice_own")


def gaps(df: DataFrame, keys: list[str], ts: str = "ts", slice_hours: int = 6) -> DataFrame:
    """(keys, gap): microseconds between neighbouring rows of each key. Gaps across slices come from the slices' first and last times, one row for each slice."""
    t = F.unix_micros(ts)
    rows = df.where(F.col(ts).isNotNull()).select(*keys, t.alias("t"), F.floor(t / (slice_hours * 3_600_000_000)).alias("slice"))
    inside = rows.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(*keys, "slice").orderBy("t"))).where("gap is not null").select(*keys, "gap")
    ends = rows.groupBy(*keys, "slice").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    across = ends.withColumn("gap", F.col("a") - F.lag("z").over(Window.partitionBy(*keys).orderBy("slice"))).where("gap is not null").select(*keys, "gap")
    return inside.unionByName(across)
