"""Deduplication by keys, and joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by order; the order should end in an id so that the choice is fixed."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_prefix(df: DataFrame, text: str = "text", chars: int = 100) -> DataFrame:
    return keep_first(df, [F.substring(text, 1, chars)], [F.col("ts"), F.col("signal_id")])


def by_id(df: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    return keep_first(df, [F.col(id_col)], order)


def by_title_prefix(df: DataFrame, title: str, chars: int = 50) -> DataFrame:
    return keep_first(df, [F.substring(F.lower(title), 1, chars)], [F.col("ts"), F.col("signal_id")])


def hash_key(text: Column, date: Column) -> Column:
    """A digest of the trimmed lower-case text and the day."""
    return F.sha2(F.concat(F.lower(F.trim(text)), F.date_format(date, "yyyy-MM-dd")), 256)


def by_hash(df: DataFrame) -> DataFrame:
    return keep_first(df, [hash_key(F.col("text"), F.col("ts"))], [F.col("signal_id")])


def keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, of each key the last by batch, then id."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [F.col(k) for k in keys], [F.desc("_batch"), F.desc("signal_id")]).drop("_batch")


def event_id(text: Column, date: Column, region: Column) -> Column:
    """A short content id: 12 characters of the digest of the text's first 100 characters, the day and the region."""
    return F.substring(F.md5(F.concat(F.substring(text, 1, 100), F.date_format(date, "yyyy-MM-dd"), region)), 1, 12)


def not_seen(df: DataFrame, seen: DataFrame, id_col: str) -> DataFrame:
    return df.join(seen.select(id_col), id_col, "left_anti")


def in_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of listed regions; the list has at most the dimension's size, so Spark broadcasts it by its statistics."""
    return df.join(regions.select("region"), "region", "left_semi")


def fill_dimension(dim: DataFrame, facts: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """One row for every key of the dimension, with defaults where there are no facts."""
    return dim.join(facts, key, "left").fillna(defaults)


def calendar(df: DataFrame, ts: str, unit: str, keys: list[str], value: Column, name: str) -> DataFrame:
    """Values per key and hour or day, complete between each key's first and last, zero where there is no row."""
    got = df.groupBy(*keys, F.date_trunc(unit, ts).alias("bucket")).agg(value.alias(name))
    step = F.expr(f"interval 1 {unit}")
    spine = got.groupBy(*keys).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(*keys, F.explode(F.sequence("a", "b", step)).alias("bucket"))
    return spine.join(got, [*keys, "bucket"], "left").fillna({name: 0})
