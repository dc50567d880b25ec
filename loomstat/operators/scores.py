"""Diversity, entropy and quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cases, clamp, reasons
from .slices import gaps


def category_counts(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, category, c, n): rows per category, and of the key."""
    got = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("c"))
    return got.withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))


def entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Shannon entropy in bits, normalised entropy (0 for one category), Simpson diversity (0 for one row)."""
    c = category_counts(df, keys, category).withColumn("p", F.col("c") / F.col("n"))
    out = c.groupBy(*keys).agg((0.0 - F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    out = out.withColumn("normalized", F.when(F.col("k") > 1, F.col("h") / F.log2(F.col("k").cast("double"))).otherwise(0.0))
    return out.withColumn("simpson", F.when(F.col("n") > 1, 1 - F.col("pairs") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)).drop("pairs")


def gini(dim: DataFrame, facts: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Gini coefficient of counts over all keys of a dimension, those without rows as zero."""
    got = facts.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("c"))
    every = facts.select(*groups).distinct().join(F.broadcast(dim.select(key)), F.lit(True)) if groups else dim.select(key)
    x = every.join(got, [*groups, key], "left").fillna({"c": 0})
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("c", key)  # as many rows as the dimension has
    x = x.withColumn("i", F.row_number().over(w))
    total, n = F.sum("c"), F.count(F.lit(1))
    return x.groupBy(*groups).agg(F.when(total > 0, 2 * F.sum(F.col("i") * F.col("c")) / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def interarrival(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Variation of positive gaps in hours (sample deviation / mean), squashed to 0..1."""
    g = gaps(df, keys, ts).select(*keys, (F.col("gap") / 3.6e9).alias("gap")).where("gap > 0").groupBy(*keys).agg(F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"))
    cv = F.coalesce(F.col("s") / F.col("m"), F.lit(0.0))
    return g.select(*keys, cv.alias("cv"), (2 / (1 + F.exp(-cv)) - 1).alias("squashed"))


def coherence(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean cosine over all pairs of a group, from the sum of its unit vectors: (|sum|^2 - m) / (n (n - 1)), without any pair; 1 with fewer than two rows."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    u = df.select(*keys, vector, norm.alias("_norm")).select(*keys, "_norm", F.posexplode(vector).alias("pos", "x"))
    u = u.withColumn("x", F.when(F.col("_norm") > 0, F.col("x") / F.col("_norm")).otherwise(0.0))
    s = u.groupBy(*keys, "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_norm") > 0).alias("m"))
    out = s.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"), F.max("m").alias("m"))
    return out.select(*keys, F.when(F.col("n") > 1, (F.col("q") - F.col("m")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("coherence"))


def temporal_quality(span_hours: Column) -> Column:
    """0.5 for a single moment, 0.3 for more than a week, else falling with the distance from 36 hours, 0.2 at least."""
    return cases([(span_hours <= 0, 0.5), (span_hours > 168, 0.3)], F.greatest(F.lit(0.2), 1 - 0.5 * F.abs(span_hours - 36) / 36))


def uncertainty(n: Column, sources: Column, age_hours: Column) -> dict[str, Column]:
    """Confidence, interval, quality word and limitations: every published row carries them."""
    conf = F.least(F.lit(0.9), 0.3 + 0.1 * n + 0.15 * sources) * F.greatest(F.lit(0.5), 1 - age_hours / 168)
    return {
        "confidence": conf,
        "low": clamp(conf - 0.15, 0.0, 1.0),
        "high": clamp(conf + 0.15, 0.0, 1.0),
        "quality": cases([(conf >= 0.7, "high"), (conf >= 0.4, "moderate")], "low"),
        "limitations": reasons([(n < 5, "few records"), (sources < 3, "few sources"), (age_hours > 72, "old data")]),
        "disclaimer": F.lit("Public attention only; not a statement about events or persons."),
    }


COVERAGE = ["STALE", "INCOMPLETE", "SPARSE", "DELAYED", "COMPLETE"]


def coverage(age_hours: Column, share: Column, n: Column) -> Column:
    """STALE from a week, INCOMPLETE below half of the expected sources, SPARSE below two rows, DELAYED from two days, else COMPLETE."""
    return cases([(age_hours >= 168, "STALE"), (share < 0.5, "INCOMPLETE"), (n < 2, "SPARSE"), (age_hours >= 48, "DELAYED")], "COMPLETE")


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over all rows; constant ones become 0.5."""
    ends = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    got = df.join(F.broadcast(ends), F.lit(True))  # one row of statistics
    for c in columns:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        got = got.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)).drop(f"lo_{c}", f"hi_{c}")
    return got
