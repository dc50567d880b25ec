"""Record rules: a table of rules with severities, compiled into one pass over the records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import sent

# What records may hold.
SOURCE_TYPES = ("news", "community", "official", "verified")
TRENDS = ("increasing", "decreasing", "stable")
FIRST_DATE = "2020-01-01"
MOST_INTENSITY, OUTLIER_Z = 10, 3


@dataclass(frozen=True)
class Rule:
    """A record breaks the rule where `bad` is true; null is no breach."""

    category: str
    name: str
    bad: Column
    critical: bool = False

    @property
    def label(self) -> str:
        return f"{self.category}.{self.name}"


def given(c: str) -> Column:
    """Is there a value, and is it not an empty string?"""
    return F.col(c).isNotNull() & (F.col(c) != "")


def record_rules(now: str, mean: float | None, deviation: float | None, regions: int) -> list[Rule]:
    """The rules for records (date, zip: text; lat, lon, intensity: numbers; source_type, trend, source, summary: text) as they stand in judged().

    now: nothing is later; mean and deviation of all intensities; regions: how many different ones there are. known_zip, in_bounds and copies are columns that judged() adds.
    """
    day = F.expr("try_cast(date as date)")
    z = F.abs(F.col("intensity") - F.lit(mean)) / F.lit(deviation)
    return [
        Rule("temporal", "dateExists", F.col("date").isNull(), True),
        Rule("temporal", "dateValid", day.isNull(), True),
        Rule("temporal", "dateNotFuture", day.isNull() | (day > F.lit(now).cast("date"))),
        Rule("temporal", "dateWithinRange", day.isNull() | (day > F.lit(now).cast("date")) | (day < F.lit(FIRST_DATE).cast("date"))),
        Rule("spatial", "zipExists", ~given("zip"), True),
        Rule("spatial", "zipFormat", ~F.coalesce(F.col("zip").rlike("^[0-9]{5}$"), F.lit(False)), True),
        Rule("spatial", "zipInRegion", F.col("known_zip").isNull()),
        Rule("spatial", "coordinatesValid", ~F.col("in_bounds")),
        Rule("logical", "intensityRange", ~F.col("intensity").between(0, MOST_INTENSITY)),
        Rule("logical", "sourceTypeValid", given("source_type") & ~F.lower("source_type").isin(*SOURCE_TYPES)),
        Rule("logical", "trendLogical", given("trend") & ~F.lower("trend").isin(*TRENDS)),
        Rule("statistical", "noOutliers", z >= OUTLIER_Z),
        Rule("statistical", "distributionNormal", F.lit(regions <= 1)),
        Rule("integrity", "hasRequiredFields", ~given("date") | ~given("zip"), True),
        Rule("integrity", "noDuplicates", F.col("copies") > 1),
        Rule("integrity", "sourceExists", ~given("source")),
    ]


def judged(records: DataFrame, places: DataFrame, box: tuple[float, float, float, float], now: str) -> DataFrame:
    """records with errors and warnings (arrays of category.rule, in the rules' order) and valid: no critical rule is broken.

    places: the codes that exist (column zip); box: south, north, west, east of valid coordinates. Statistics of all records are one row; equal records (date, zip, summary, nulls alike) are counted by a hash of
    128 bits and met by it.
    """
    stats = records.agg(F.avg("intensity").alias("m"), F.stddev_pop("intensity").alias("d"), F.min("zip").alias("a"), F.max("zip").alias("b")).first()
    regions = 0 if stats["a"] is None else 1 if stats["a"] == stats["b"] else 2
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("date", "zip", "summary")]
    rows = records.withColumn("same", F.md5(F.concat_ws("\x1f", *text)))
    twice = rows.groupBy("same").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = rows.join(sent(twice), "same", "left").join(F.broadcast(places.select(F.col("zip").alias("known_zip")).distinct()), F.col("zip") == F.col("known_zip"), "left")
    south, north, west, east = box
    there = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0)
    rows = rows.withColumn("in_bounds", ~there | (F.col("lat").between(south, north) & F.col("lon").between(west, east)))
    rules = record_rules(now, stats["m"], stats["d"] or None, regions)
    broken = lambda critical: F.array_compact(F.array(*[F.when(r.bad, F.lit(r.label)) for r in rules if r.critical == critical]))
    out = rows.select(*records.columns, broken(True).alias("errors"), broken(False).alias("warnings"))
    return out.withColumn("valid", F.size("errors") == 0)


def rates(judged_records: DataFrame) -> DataFrame:
    """One row: (total, n_valid, n_errors, n_warnings, error_rate in percent)."""
    n = F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return judged_records.agg(n.alias("total"), F.count_if(F.col("valid")).alias("n_valid"), total("errors").alias("n_errors"), total("warnings").alias("n_warnings"), F.round(100 * total("errors") / F.nullif(n, F.lit(0)), 2).alias("error_rate"))


def cleaned(judged_records: DataFrame) -> DataFrame:
    """Valid records, normalised: date as yyyy-MM-dd, digits of the code (null unless five), intensity rounded and clamped (null: 1), unknown source types and trends replaced by `unknown` and `stable`."""
    digits = F.regexp_replace("zip", "[^0-9]", "")
    kind = lambda c, known, other: F.when(F.lower(F.trim(c)).isin(*known), F.lower(F.trim(c))).otherwise(other)
    made = {
        "date": F.date_format(F.expr("try_cast(date as date)"), "yyyy-MM-dd"),
        "zip": F.when(F.length(digits) == 5, digits),
        "intensity": F.when(F.col("intensity").isNull() | F.isnan("intensity"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_INTENSITY)), F.floor(F.col("intensity") + 0.5).cast("double")))),
        "source_type": kind("source_type", SOURCE_TYPES, "unknown"),
        "trend": kind("trend", TRENDS, "stable"),
    }
    rest = [c for c in judged_records.columns if c not in ("errors", "warnings", "valid")]
    return judged_records.where("valid").select(*[made[c].alias(c) if c in made else F.col(c) for c in rest])
