"""Sources: files with explicit schemas, malformed rows set aside rather than skipped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

SIGNAL = StructType([StructField(c, StringType()) for c in ("text", "zip", "date", "url")])


def csv_signals(spark: SparkSession, path: str | Sequence[str], source: str | None = None, schema: StructType = SIGNAL) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of CSV files with a header. Rejected: malformed lines, rows without text."""
    full = StructType([*schema.fields, StructField("_bad", StringType())])
    df = spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).option("escape", '"').csv(path if isinstance(path, str) else list(path))
    df = df.withColumn("source", F.lit(source) if source else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1))
    bad = F.col("_bad").isNotNull() | F.col("text").isNull() | (F.trim("text") == "")
    return df.where(~bad).drop("_bad"), df.where(bad)


def families(spark: SparkSession, folder: str, patterns: Mapping[str, str]) -> DataFrame:
    """Rows of several file families (glob -> default source), by name; columns that a family lacks are null."""
    out = None
    for glob, source in patterns.items():
        one, _ = csv_signals(spark, f"{folder}/{glob}", source)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file families")
    return out


def aliased(df: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns by the first of several names that occur, ignoring case; null where none does."""
    there = {c.lower(): c for c in df.columns}
    pick = lambda options: F.coalesce(*[F.col(there[o.lower()]).cast("string") for o in options if o.lower() in there], F.lit(None).cast("string"))
    return df.select(*[pick(options).alias(name) for name, options in names.items()])


def json_objects(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One-object JSON files (or one object a line)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value: StructType) -> DataFrame:
    """{key: {...}} files as rows (key, fields)."""
    text = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", MapType(StringType(), value))
    return text.select(F.explode(m).alias("key", "v")).select("key", "v.*")


def sql_over(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """SQL over named DataFrames."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def with_general(rows: DataFrame, expected: DataFrame, key: str, value: str, general: Sequence[str]) -> DataFrame:
    """Rows with the expected values of their key, else the general list."""
    return rows.join(expected, key, "left").withColumn(value, F.coalesce(value, F.array(*[F.lit(g) for g in general])))
