"""Time series: calendars, rolling values, trends, bursts, baselines, kinematics, weekly alerts.

Raw rows are first aggregated to hours, days or weeks; windows then run over those, partitioned by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.columns import cases
from .scans import decayed_sums

ALPHA = 2 / 29  # of an average with span 28
#: Older days weigh below 1e-12 in it.
EMA_DAYS = 400


def per(keys: list[str], order: str = "bucket") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def series(df: DataFrame, unit: str, keys: list[str], value: Column | None = None) -> DataFrame:
    """(keys, bucket, n): complete between the first and last bucket of all keys, so that silent keys show as zeros."""
    got = df.groupBy(*keys, F.date_trunc(unit, "ts").alias("bucket")).agg((F.count(F.lit(1)) if value is None else value).alias("n"))
    ends = got.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    step = F.expr(f"interval 1 {unit}")
    spine = got.select(*keys).distinct().join(F.broadcast(ends), F.lit(True)).select(*keys, F.explode(F.sequence("a", "b", step)).alias("bucket"))
    return spine.join(got, [*keys, "bucket"], "left").fillna({"n": 0})


def rolling(s: DataFrame, keys: list[str]) -> DataFrame:
    """Trailing 7 and 14 bucket means."""
    w = per(keys)
    return s.withColumn("avg7", F.avg("n").over(w.rowsBetween(-6, 0))).withColumn("avg14", F.avg("n").over(w.rowsBetween(-13, 0)))


def week_trend(s: DataFrame, keys: list[str], change: float = 0.15, volatile: float = 0.5) -> DataFrame:
    """The last day's 7-day mean against that of 7 days earlier; volatile where the 14 last days vary much; insufficient with fewer than 7 days."""
    w = per(keys)
    r = rolling(s, keys)
    last14 = w.rowsBetween(-13, 0)
    r = r.withColumn("before", F.lag("avg7", 7).over(w)).withColumn("days", F.row_number().over(w))
    r = r.withColumn("cv", F.when(F.avg("n").over(last14) > 0, F.stddev_samp("n").over(last14) / F.avg("n").over(last14)))
    last = r.groupBy(*keys).agg(F.max_by(F.struct("avg7", "before", "days", "cv"), "bucket").alias("x")).select(*keys, "x.*")
    moved = F.when(F.col("before") > 0, F.col("avg7") / F.col("before") - 1)
    trend = cases([((F.col("days") < 7) | F.col("before").isNull(), "insufficient"), (F.col("cv") >= volatile, "volatile"), (moved > change, "rising"), (moved < -change, "falling")], "stable")
    return last.withColumn("trend", trend)


def bursts(s: DataFrame, keys: list[str], hours: int = 24, z: float = 2.0) -> DataFrame:
    """z of each hour against the trailing mean and sample deviation (no or zero deviation counts as 1)."""
    w = per(keys).rowsBetween(1 - hours, 0)
    std = F.stddev_samp("n").over(w)
    std = F.when(std.isNull() | (std == 0), 1.0).otherwise(std)
    s = s.withColumn("z", (F.col("n") - F.avg("n").over(w)) / std)
    return s.withColumn("burst", F.col("z") > z)


def ema(s: DataFrame, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """The adjusted exponential average at the last bucket, in closed form: one aggregation instead of a recursion."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bucket"))) - 1
    w = F.pow(F.lit(1 - alpha), F.col("age"))
    return s.withColumn("age", place).where(F.col("age") < EMA_DAYS).groupBy(*keys).agg((F.sum(F.col("n") * w) / F.sum(w)).alias("ema"), F.count(F.lit(1)).alias("days"))


def baseline(s: DataFrame, keys: list[str]) -> DataFrame:
    """Exponential average, deviation of the last 28 days (from 7 days on), and weekend and weekday factors; with fewer than 7 days the defaults 0, 1, 1, 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bucket")))
    weekend = F.dayofweek("bucket").isin(1, 7)
    last = s.withColumn("age", place)
    stats = last.groupBy(*keys).agg(
        F.stddev_samp(F.when(F.col("age") <= 28, F.col("n"))).alias("std"), F.avg("n").alias("mean"), F.avg(F.when(weekend, F.col("n"))).alias("we"), F.avg(F.when(~weekend, F.col("n"))).alias("wd")
    )
    out = ema(s, keys).join(stats, keys)
    few = F.col("days") < 7
    factor = lambda c: F.when(few | (F.col("mean") == 0) | F.col(c).isNull(), 1.0).otherwise(F.col(c) / F.col("mean"))
    return out.select(*keys, "days", F.when(few, 0.0).otherwise(F.col("ema")).alias("ema"), F.when(few, 1.0).otherwise(F.coalesce("std", F.lit(1.0))).alias("std"), factor("we").alias("weekend_factor"), factor("wd").alias("weekday_factor"))


def daily_baselines(s: DataFrame, keys: list[str]) -> DataFrame:
    """The baseline as it stands on each bucket (a day): (keys, bucket, days, ema, std, weekend_factor, weekday_factor).

    The exponential average is a scan of affine maps over slices of time; the deviation is of the 28 last days (from 7 days on, else 1, as is 0), factors are of all days so far.
    With fewer than 7 days the defaults 0, 1, 1, 1.
    """
    rows = s.select(*keys, "bucket", "n", F.datediff("bucket", F.lit("0001-01-01")).cast("long").alias("at"))
    averages = decayed_sums(rows, keys, "at", F.col("n"), 1 - ALPHA)
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    weekend = F.dayofweek("bucket").isin(1, 7)
    rows = rows.withColumn("days", F.count(F.lit(1)).over(so_far)).withColumn("s", F.stddev_samp("n").over(w.rowsBetween(-27, 0))).withColumn("mean", F.avg("n").over(so_far))
    rows = rows.withColumn("we", F.avg(F.when(weekend, F.col("n"))).over(so_far)).withColumn("wd", F.avg(F.when(~weekend, F.col("n"))).over(so_far))
    j = rows.join(averages, [*keys, "at"])
    few = F.col("days") < 7
    factor = lambda c: F.when(few | (F.col("mean") == 0) | ~(F.col(c) > 0) | F.col(c).isNull(), 1.0).otherwise(F.col(c) / F.col("mean"))
    std = F.when(few | F.col("s").isNull() | (F.col("s") == 0), 1.0).otherwise(F.col("s"))
    return j.select(*keys, "bucket", "n", "days", F.when(few, 0.0).otherwise(F.col("total") / F.col("weight")).alias("ema"), std.alias("std"), factor("we").alias("weekend_factor"), factor("wd").alias("weekday_factor"))


def kinematics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and hour: count, velocity and acceleration (differences), distinct sources and regions so far."""
    s = series(df, "hour", keys)
    first = lambda c: df.groupBy(*keys, c).agg(F.min(F.date_trunc("hour", "ts")).alias("bucket")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias(f"new_{c}"))
    s = s.join(first("source"), [*keys, "bucket"], "left").join(first("region"), [*keys, "bucket"], "left").fillna({"new_source": 0, "new_region": 0})
    w = per(keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("sources", F.sum("new_source").over(so_far)).withColumn("regions", F.sum("new_region").over(so_far))
    s = s.withColumn("velocity", F.col("n") - F.lag("n", 1).over(w))
    return s.withColumn("acceleration", F.col("velocity") - F.lag("velocity", 1).over(w)).drop("new_source", "new_region")


def accelerating(k: DataFrame, keys: list[str], places: int = 12, sigma: float = 2.0, least_hours: int = 3) -> DataFrame:
    """(keys, hours, accelerating) from kinematics(): with at least `places` accelerations, whether any is more than sigma deviations above the mean of the trailing ones, itself included (no or zero sample deviation counts
    as 1); with fewer, whether the greatest size is more than sigma population deviations (one value: 1; at least 0.01) above their mean. Never with fewer hours than least_hours."""
    a = F.col("acceleration")
    w = per(keys).rowsBetween(1 - places, 0)
    std = F.stddev_samp(a).over(w)
    z = (a - F.avg(a).over(w)) / F.when(std.isNull() | (std == 0), 1.0).otherwise(std)
    one = k.withColumn("z", F.when(a.isNotNull(), z)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"), F.count(a).alias("n"), F.max("z").alias("z"), F.max(F.abs(a)).alias("top"), F.avg(a).alias("mean"), F.stddev_pop(a).alias("std"),
    )
    single = F.when(F.col("n") > 1, F.greatest(F.col("std"), F.lit(0.01))).otherwise(1.0)
    short = F.col("top") > F.col("mean") + sigma * single
    return one.select(*keys, "hours", ((F.col("hours") >= least_hours) & F.coalesce(F.when(F.col("n") >= places, F.col("z") > sigma).otherwise(short), F.lit(False))).alias("accelerating"))


def regression(s: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and intercept of n over the bucket's number."""
    s = s.withColumn("x", F.row_number().over(per(keys)) - 1)
    return s.groupBy(*keys).agg(F.regr_slope("n", "x").alias("slope"), F.regr_intercept("n", "x").alias("intercept"), F.count(F.lit(1)).alias("points"), F.avg("n").alias("mean"))


def weekly_alerts(s: DataFrame, keys: list[str]) -> DataFrame:
    """Over weekly counts: class A if the last week's z (population deviation of all earlier weeks, 0 counts as 1) is at least 2; B if the last two weeks both exceed the mean of
    the rest by 1.5 deviations; C if the last is below half the mean of the four before and below the previous."""
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bucket")))
    s = s.withColumn("age", age)
    pick = lambda cond, f=F.avg: f(F.when(cond, F.col("n")))
    a = F.col("age")
    one = s.groupBy(*keys).agg(
        F.max(F.when(a == 1, F.col("n"))).alias("last"), F.max(F.when(a == 2, F.col("n"))).alias("previous"),
        pick(a > 1).alias("m1"), pick(a > 1, F.stddev_pop).alias("s1"), pick(a > 2).alias("m2"), pick(a > 2, F.stddev_pop).alias("s2"), pick((a > 1) & (a <= 5)).alias("base"),
    )
    z = (F.col("last") - F.col("m1")) / F.when(F.col("s1") > 0, F.col("s1")).otherwise(1.0)
    limit = F.col("m2") + 1.5 * F.col("s2")
    one = one.withColumn("z", z).withColumn("alert_a", F.col("z") >= 2).withColumn("alert_b", (F.col("last") > limit) & (F.col("previous") > limit))
    return one.withColumn("alert_c", (F.col("last") < 0.5 * F.col("base")) & (F.col("last") < F.col("previous")))
