"""Aggregations over signals and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sizes import sent

FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def bucket_counts(df: DataFrame, unit: str, ts: str = "ts") -> DataFrame:
    """Rows, distinct sources and distinct regions per day, week or month."""
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("region").alias("n_regions"))


def stats(df: DataFrame, field: str, keys: list[str] | None = None) -> DataFrame:
    """count, sum, mean, median, min, max and population deviation, by keys (or of all rows); the median by percentiles(), so no group's values are held. A null key is a group of its own."""
    own = {f"loomstat_key{k}": c for k, c in enumerate(keys or [])} or {"loomstat_key0": None}
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias(k) if c else F.lit("").alias(k) for k, c in own.items()]
    rows = df.select(*(keys or []), F.col(field).alias("loomstat_x"), *named)
    c = F.col("loomstat_x")
    out = rows.groupBy(*own, *(keys or [])).agg(F.count(c).alias("count"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_pop(c).alias("std"))
    return out.join(percentiles(rows, list(own), "loomstat_x", {"median": 0.5}), list(own), "left").select(*(keys or []), "count", "sum", "mean", "median", "min", "max", "std")


def count_by(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(field), F.lit("Unknown")).alias(field)).agg(F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, field: str, n: int) -> DataFrame:
    return count_by(df, field).orderBy(F.desc("n"), field).limit(n)


def group_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Size, volume, distinct sources, first and last time of groups."""
    return df.groupBy(*keys).agg(
        F.any_value("region").alias("region"), F.count(F.lit(1)).alias("size"), F.sum("weight").alias("volume"), F.countDistinct("source").alias("n_sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def with_totals(df: DataFrame, *totals: Column) -> DataFrame:
    """Each row with the totals of all rows: one row of statistics, sent to every task."""
    return df.join(F.broadcast(df.agg(*totals)), F.lit(True))


def anomalies(df: DataFrame, field: str, threshold: float = 2.0) -> DataFrame:
    """Rows whose value is more than so many population deviations from the mean."""
    got = with_totals(df, F.avg(field).alias("mean_"), F.stddev_pop(field).alias("std_"))
    z = F.when(F.col("std_") > 0, (F.col(field) - F.col("mean_")) / F.col("std_")).otherwise(0.0)
    return got.withColumn("z", z).where(F.abs("z") > threshold).drop("mean_", "std_")


def inputs_hash(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A digest of each group's rows that doesn't depend on their order: 60 bits of each half of a row's MD5 (of its canonical JSON), combined by sum and by exclusive or. No group is gathered."""
    row = F.md5(F.to_json(F.struct(*fields)))
    half = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("long")
    rows = df.select(*keys, half(1).alias("a"), half(17).alias("b"))
    text = lambda c: c.cast("string")
    parts = [F.count(F.lit(1)), F.bit_xor("a"), F.bit_xor("b"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))]
    return rows.groupBy(*keys).agg(F.sha2(F.concat_ws("|", *[text(p) for p in parts]), 256).alias("hash"))


def percentiles(df: DataFrame, keys: list[str], field: str, shares: dict[str, float], ranges: int = 4096) -> DataFrame:
    """(keys, one column for each share): exact percentiles, interpolated between neighbours, without holding a group's values.

    Values are counted in equal ranges between a group's least and greatest; then the different values of just those ranges that hold a wanted rank are counted.
    """
    x = F.col(field).cast("double")
    rows = df.where(x.isNotNull()).select(*keys, x.alias("x"))
    ends = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges), F.lit(ranges - 1))).otherwise(0).cast("int")
    dealt = rows.join(sent(ends), keys).withColumn("range", place)
    counts = dealt.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("range")  # at most `ranges` rows for each key
    counts = counts.withColumn("from", F.sum("n").over(before) - F.col("n"))
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), (F.lit(q) * (F.col("total") - 1)).alias("at")) for name, q in shares.items()]
    ranks = ends.select(*keys, F.explode(F.array(*wanted)).alias("w")).select(*keys, "w.name", "w.at", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank"))
    hit = ranks.join(counts, keys).where("rank >= `from` and rank < `from` + n").select(*keys, "name", "at", "rank", "range", "from")
    values = dealt.join(sent(hit.select(*keys, "range").distinct()), [*keys, "range"], "left_semi").groupBy(*keys, "range", "x").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*keys, "range").orderBy("x")
    values = values.withColumn("upto", F.sum("n").over(inside))
    found = hit.join(values, [*keys, "range"]).where("rank - `from` >= upto - n and rank - `from` < upto")
    low, high = F.min_by("x", "rank"), F.max_by("x", "rank")
    got = found.groupBy(*keys, "name").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("v"))
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
