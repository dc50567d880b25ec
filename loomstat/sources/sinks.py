"""Sinks: tables with append, upsert and replace, exports, retention. Paths are Spark's, so any store works."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import refuse_identity
from ..operators.sizes import sent


def append(df: DataFrame, path: str, defaults: Mapping[str, object] | None = None, partition: Sequence[str] = ()) -> None:
    """Append rows; missing columns get their defaults."""
    for name, value in (defaults or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    refuse_identity(df).write.mode("append").partitionBy(*partition).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    refuse_identity(df).write.mode("overwrite").parquet(path)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key isn't in new, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(df: DataFrame, path: str, keys: Sequence[str], partition: Sequence[str]) -> None:
    """Replace rows of the same keys. Only partitions that df touches are rewritten, so keys must not move between partitions."""
    spark = df.sparkSession
    refuse_identity(df)
    touched = df.select(*partition).distinct()
    try:
        old = spark.read.schema(df.schema).parquet(path)  # else partition codes such as 01582 are read as numbers
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.partitionBy(*partition).parquet(path)
        return
    # The rows to keep are read from the files that are overwritten, so they are cut loose first.
    from ..operators.graph import cut

    out = cut(merged(old.join(sent(touched), list(partition), "left_semi"), df, keys))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def csv_export(df: DataFrame, path: str, columns: Sequence[str], scrub: Mapping[str, Column] | None = None) -> None:
    """Listed columns, scrubbed where given, as CSV; arrays joined by "; "."""
    out = []
    for c in columns:
        x = (scrub or {}).get(c, F.col(c))
        kind = df.schema[c].dataType.typeName()
        out.append((F.array_join(F.transform(x, lambda v: v.cast("string")), "; ") if kind == "array" else x).alias(c))
    refuse_identity(df.select(*columns))
    df.select(*out).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def json_rows(df: DataFrame, path: str) -> None:
    refuse_identity(df).write.mode("overwrite").json(path)


def feature(kind: str, coordinates: Column, properties: Sequence[str]) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def geo_features(df: DataFrame, path: str, kind: str, coordinates: Column, properties: Sequence[str]) -> None:
    """One feature a line."""
    df.select(feature(kind, coordinates, properties).alias("value")).write.mode("overwrite").text(path)


def pruned(df: DataFrame, as_of: Column, days: int = 90, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows at most so old, and the rest; rows without a time are removed."""
    old = F.coalesce(F.col(ts) < as_of - F.make_dt_interval(days=F.lit(days)), F.lit(True))
    return df.where(~old), df.where(old)


def split_archive(df: DataFrame, as_of: Column, current: str, archive: str, days: int = 365, ts: str = "ts") -> None:
    new, old = pruned(df, as_of, days, ts)
    replace(new, current)
    replace(old, archive)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
