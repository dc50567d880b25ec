"""Queries on windows, trends and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cases, clamp, cosine
from ..operators import windows as W
from ..sources.adapters import SQL_EV, SQL_GEV, SQL_REGIONS, SQL_VEC, as_of, event_groups, event_signals, regions, vector_groups
from .base import query
from .q_aggregate import _CS, clusters

_NOW = "timestamp '2024-01-31'"


def _series(unit: str, keys: str = "region", src: str = "ev") -> str:
    return f"""got as (select {keys}, date_trunc('{unit}', ts)::timestamp as bucket, count(*) as n from {src} group by all), ends as (select min(bucket) as a, max(bucket) as b from got),
s as (select k.{keys}, x.bucket, coalesce(n, 0) as n from (select distinct {keys} from got) k cross join (select unnest(generate_series(a, b, interval 1 {unit})) as bucket from ends) x left join got on got.{keys} = k.{keys} and got.bucket = x.bucket)"""


_DAY = f"with {SQL_EV}, {_series('day')}"
_HOUR = f"with {SQL_EV}, {_series('hour')}"
_WEEK = f"with {SQL_EV}, {_series('week')}"


def days(spark, sf):
    return W.series(event_signals(spark, sf), "day", ["region"])


def _day(c="bucket"):
    return F.date_format(c, "yyyy-MM-dd").alias("day")


@query(f"{_DAY} select region, strftime(bucket, '%Y-%m-%d') as day, n, round(avg(n) over (w rows between 6 preceding and current row), 6) as avg7, round(avg(n) over (w rows between 13 preceding and current row), 6) as avg14 from s window w as (partition by region order by bucket)")
def rolling_avg_7_14(spark, sf):
    return W.rolling(days(spark, sf), ["region"]).select("region", _day(), "n", F.round("avg7", 6).alias("avg7"), F.round("avg14", 6).alias("avg14"))


@query(f"""{_DAY}, r as (select region, bucket, avg(n) over (w rows between 6 preceding and current row) as avg7, stddev_samp(n) over (w rows between 13 preceding and current row) / avg(n) over (w rows between 13 preceding and current row) as cv, row_number() over w as days from s window w as (partition by region order by bucket)),
q as (select *, lag(avg7, 7) over (partition by region order by bucket) as before from r), l as (select * from q where bucket = (select max(bucket) from q))
select region, round(avg7, 6) as avg7, round(before, 6) as before, case when days < 7 or before is null then 'insufficient' when cv >= 0.5 then 'volatile' when avg7 / before - 1 > 0.15 then 'rising' when avg7 / before - 1 < -0.15 then 'falling' else 'stable' end as trend from l""")
def week_over_week_trend(spark, sf):
    return W.week_trend(days(spark, sf), ["region"]).select("region", F.round("avg7", 6).alias("avg7"), F.round("before", 6).alias("before"), "trend")


@query(f"""{_DAY}, r as (select region, bucket, count(*) over w7 as k, avg(n) over w7 as m, stddev_samp(n) over w7 as sd from s window w7 as (partition by region order by bucket rows between 6 preceding and current row))
select region, strftime(bucket, '%Y-%m-%d') as day, round(m, 6) as mean7, round(case when k >= 3 and m > 0 then sd / m end, 6) as cv7, coalesce(k >= 3 and round(sd / m, 9) >= 0.5, false) as volatile from r""")
def rolling_columns(spark, sf):
    w7 = W.per(["region"]).rowsBetween(-6, 0)
    d = days(spark, sf).withColumn("k", F.count(F.lit(1)).over(w7)).withColumn("m", F.avg("n").over(w7)).withColumn("sd", F.stddev_samp("n").over(w7))
    cv = F.when((F.col("k") >= 3) & (F.col("m") > 0), F.col("sd") / F.col("m"))
    return d.select("region", _day(), F.round("m", 6).alias("mean7"), F.round(cv, 6).alias("cv7"), F.coalesce(F.round(cv, 9) >= 0.5, F.lit(False)).alias("volatile"))


@query(f"with {SQL_EV}, d as (select source, ts::date as d, count(*) as n from ev group by 1, 2) select source, strftime(d, '%Y-%m-%d') as day, round(avg(n) over (partition by source order by d rows between 4 preceding and current row), 6) as ma from d")
def moving_average(spark, sf):
    d = event_signals(spark, sf).groupBy("source", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy("d").rowsBetween(-4, 0)
    return d.select("source", _day("d"), F.round(F.avg("n").over(w), 6).alias("ma"))


@query(f"with {SQL_EV}, t as (select region, count(*) filter (where ts >= {_NOW} - interval 7 day) as last, count(*) filter (where ts >= {_NOW} - interval 14 day and ts < {_NOW} - interval 7 day) as before from ev group by 1) select region, last, before, round(case when before > 0 then 100.0 * (last - before) / before end, 6) as pct from t")
def window_trend(spark, sf):
    e = event_signals(spark, sf)
    a, b = as_of() - F.expr("interval 7 days"), as_of() - F.expr("interval 14 days")
    t = e.groupBy("region").agg(F.count_if(F.col("ts") >= a).alias("last"), F.count_if((F.col("ts") >= b) & (F.col("ts") < a)).alias("before"))
    return t.select("region", "last", "before", F.round(F.when(F.col("before") > 0, 100.0 * (F.col("last") - F.col("before")) / F.col("before")), 6).alias("pct"))


_TREND = "case when abs(slope) < 0.1 then 'stable' when slope > 0 then 'rising' else 'falling' end"


@query(f"{_DAY}, x as (select region, n, row_number() over (partition by region order by bucket) - 1 as x from s), r as (select region, regr_slope(n, x) as slope, count(*) as points from x group by 1) select region, round(slope, 6) as slope, points, {_TREND} as trend from r")
def trend_regression(spark, sf):
    r = W.regression(days(spark, sf), ["region"])
    return r.select("region", F.round("slope", 6).alias("slope"), "points", cases([(F.abs("slope") < 0.1, "stable"), (F.col("slope") > 0, "rising")], "falling").alias("trend"))


@query(f"{_DAY}, x as (select region, n, row_number() over (partition by region order by bucket) - 1 as x from s), r as (select region, regr_slope(n, x) as slope, regr_intercept(n, x) as i, count(*) as points from x group by 1), h as (select *, unnest([0, 1, 2, 3]) as step from r) select region, step::bigint as step, round(greatest(0, i + slope * (points + step)), 6) as expected from h")
def trend_projection(spark, sf):
    r = W.regression(days(spark, sf), ["region"]).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return r.select("region", "step", F.round(F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("points") + F.col("step"))), 6).alias("expected"))


_CW = f"with {SQL_EV}, {SQL_GEV}, {_CS}"


@query(f"{_CW}, r as (select region, avg(volume) filter (where last_ts >= {_NOW} - interval 14 day) as recent, avg(volume) filter (where last_ts < {_NOW} - interval 14 day) as older from cs group by 1) select region, round(recent, 6) as recent, round(older, 6) as older, case when recent > 1.2 * older then 'growing' when recent < 0.8 * older then 'shrinking' else 'steady' end as pattern from r")
def growth_recent_vs_older(spark, sf):
    new = F.col("last_ts") >= as_of() - F.expr("interval 14 days")
    r = clusters(spark, sf).groupBy("region").agg(F.avg(F.when(new, F.col("volume"))).alias("recent"), F.avg(F.when(~new, F.col("volume"))).alias("older"))
    return r.select("region", F.round("recent", 6).alias("recent"), F.round("older", 6).alias("older"), cases([(F.col("recent") > 1.2 * F.col("older"), "growing"), (F.col("recent") < 0.8 * F.col("older"), "shrinking")], "steady").alias("pattern"))


@query(f"{_CW} select region, round(least(100, 40 * least(count(*) / 30.0, 1) + 30 * least(avg(size) / 20, 1) + 30 * least(avg(volume) / 1000, 1)), 6) as activity, case when sum(size) >= 300 then 'high' when sum(size) >= 100 then 'medium' else 'low' end as confidence from cs where last_ts >= {_NOW} - interval 30 day group by 1")
def activity_index(spark, sf):
    one = F.lit(1.0)
    n = F.sum("size")
    c = clusters(spark, sf).where(F.col("last_ts") >= as_of() - F.expr("interval 30 days"))
    score = 40 * F.least(F.count(F.lit(1)) / 30.0, one) + 30 * F.least(F.avg("size") / 20, one) + 30 * F.least(F.avg("volume") / 1000, one)
    return c.groupBy("region").agg(F.round(F.least(F.lit(100.0), score), 6).alias("activity"), cases([(n >= 300, "high"), (n >= 100, "medium")], "low").alias("confidence"))


_BURST = "b as (select region, bucket, n, (n - avg(n) over w) / coalesce(nullif(stddev_samp(n) over w, 0), 1) as z from s window w as (partition by region order by bucket rows between 23 preceding and current row))"


@query(f"{_HOUR}, {_BURST} select region, strftime(bucket, '%Y-%m-%d %H') as hour, n, round(z, 6) as z from b where z > 2")
def burst_hourly(spark, sf):
    b = W.bursts(W.series(event_signals(spark, sf), "hour", ["region"]), ["region"])
    return b.where("burst").select("region", F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "n", F.round("z", 6).alias("z"))


@query(f"{_HOUR}, {_BURST} select region, round(coalesce(sum(n) filter (where z > 2), 0) / sum(n), 6) as burst_score from b group by 1")
def burst_score(spark, sf):
    b = W.bursts(W.series(event_signals(spark, sf), "hour", ["region"]), ["region"])
    return b.groupBy("region").agg(F.round(F.sum(F.when(F.col("burst"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("burst_score"))


_BASE = f"""a as (select *, row_number() over (partition by region order by bucket desc) - 1 as age from s), e as (select region, sum(n * pow(1 - 2.0 / 29, age)) / sum(pow(1 - 2.0 / 29, age)) as ema, stddev_samp(n) filter (where age < 28) as std, count(*) as days, avg(n) as mean, avg(n) filter (where dayofweek(bucket) in (0, 6)) as we, avg(n) filter (where dayofweek(bucket) not in (0, 6)) as wd from a group by 1)"""


_DAILY = """w as (select region, bucket, n, count(*) over f as days, stddev_samp(n) over l as s, avg(n) over f as mean, avg(n) filter (where dayofweek(bucket) in (0, 6)) over f as we, avg(n) filter (where dayofweek(bucket) not in (0, 6)) over f as wd
from s window f as (partition by region order by bucket), l as (partition by region order by bucket rows 27 preceding)),
x as (select a.region, a.bucket, sum(b.n * pow(1 - 2.0 / 29, date_diff('day', b.bucket, a.bucket))) / sum(pow(1 - 2.0 / 29, date_diff('day', b.bucket, a.bucket))) as ema from s a join s b on a.region = b.region and b.bucket <= a.bucket group by 1, 2),
bl as (select region, bucket, n, days, case when days < 7 then 0 else ema end as ema, case when days < 7 or s is null or s = 0 then 1 else s end as std,
case when days < 7 or mean = 0 or not coalesce(we > 0, false) then 1 else we / mean end as weekend_factor, case when days < 7 or mean = 0 or not coalesce(wd > 0, false) then 1 else wd / mean end as weekday_factor from w join x using (region, bucket))"""


@query(f"{_DAY}, {_DAILY} select region, strftime(bucket, '%Y-%m-%d') as day, days, round(ema, 6) as ema, round(std, 6) as std, round(weekend_factor, 6) as weekend_factor, round(weekday_factor, 6) as weekday_factor from bl")
def adaptive_baseline(spark, sf):
    """The baseline of each region as it stands on each day."""
    b = W.daily_baselines(days(spark, sf), ["region"])
    return b.select("region", _day(), "days", *[F.round(c, 6).alias(c) for c in ("ema", "std", "weekend_factor", "weekday_factor")])


@query(f"{_DAY}, {_BASE} select region, days, round(ema, 6) as ema, round(std, 6) as std, round(we / mean, 6) as weekend_factor, round(wd / mean, 6) as weekday_factor from e")
def last_baseline(spark, sf):
    """The baseline of each region at the last day."""
    b = W.baseline(days(spark, sf), ["region"])
    return b.select("region", "days", *[F.round(c, 6).alias(c) for c in ("ema", "std", "weekend_factor", "weekday_factor")])


@query(f"""{_DAY}, {_BASE} select s.region, strftime(bucket, '%Y-%m-%d') as day, round(ema + 2 * std, 6) as high, round(ema + 1.5 * std, 6) as elevated, round((n - ema * case when dayofweek(bucket) in (0, 6) then we else wd end / mean) / std, 6) as z from s join e using (region)""")
def adaptive_threshold(spark, sf):
    d = days(spark, sf)
    j = d.join(W.baseline(d, ["region"]), "region")
    factor = F.when(F.dayofweek("bucket").isin(1, 7), F.col("weekend_factor")).otherwise(F.col("weekday_factor"))
    z = (F.col("n") - F.col("ema") * factor) / F.col("std")
    return j.select("region", _day(), F.round(F.col("ema") + 2 * F.col("std"), 6).alias("high"), F.round(F.col("ema") + 1.5 * F.col("std"), 6).alias("elevated"), F.round(z, 6).alias("z"))


_KIN = f"""with {SQL_EV}, {_series('hour', 'source')}, fr as (select source, b as bucket, count(*) as k from (select source, region, min(date_trunc('hour', ts)::timestamp) as b from ev group by 1, 2) group by 1, 2),
v as (select s.source, s.bucket, n, sum(coalesce(k, 0)) over (partition by s.source order by s.bucket) as regions, n - lag(n) over (partition by s.source order by s.bucket) as velocity from s left join fr on fr.source = s.source and fr.bucket = s.bucket),
kin as (select *, velocity - lag(velocity) over (partition by source order by bucket) as acceleration from v)"""


@query(f"{_KIN} select source, max(n) as peak, max(velocity) as peak_velocity, max(acceleration) as peak_acceleration, round(avg(velocity), 6) as mean_velocity, round(avg(acceleration), 6) as mean_acceleration, max(regions)::bigint as regions from kin group by 1")
def kinematics_hourly(spark, sf):
    return _kin(spark, sf).groupBy("source").agg(F.max("n").alias("peak"), F.max("velocity").alias("peak_velocity"), F.max("acceleration").alias("peak_acceleration"), F.round(F.avg("velocity"), 6).alias("mean_velocity"), F.round(F.avg("acceleration"), 6).alias("mean_acceleration"), F.max("regions").alias("regions"))


def _kin(spark, sf):
    e = event_signals(spark, sf).select("ts", "region", F.col("source").alias("topic"), F.col("signal_id").alias("source"))
    return W.kinematics(e, ["topic"]).drop("sources").withColumnRenamed("topic", "source")


_ACC = f"""{_KIN}, z as (select source, acceleration as a, (acceleration - avg(acceleration) over w) / coalesce(nullif(stddev_samp(acceleration) over w, 0), 1) as z from kin where acceleration is not null window w as (partition by source order by bucket rows between 11 preceding and current row)),
ac as (select source, h.hours, h.hours >= 3 and coalesce(case when n >= 12 then z > 2 else top > mean + 2 * case when n > 1 then greatest(std, 0.01) else 1 end end, false) as accelerating
from (select source, count(*) as hours from kin group by 1) h left join (select source, count(*) as n, max(z) as z, max(abs(a)) as top, avg(a) as mean, stddev_pop(a) as std from z group by 1) using (source))"""


@query(f"{_ACC} select source, hours, accelerating from ac")
def acceleration_flag(spark, sf):
    return W.accelerating(_kin(spark, sf), ["source"])


@query(f"""{_ACC}, bz as (select source, (n - avg(n) over w) / coalesce(nullif(stddev_samp(n) over w, 0), 1) as z from s window w as (partition by source order by bucket rows between 23 preceding and current row)),
br as (select source, count(*) filter (where z > 2) as burst_hours, count(*) filter (where z > 2) / count(*) as ratio from bz group by 1)
select source, burst_hours, round(ratio, 6) as burst_ratio, accelerating, accelerating and ratio < 0.5 as sustained, not accelerating and ratio > 0.3 as spike from ac join br using (source)""")
def sustained_vs_spike(spark, sf):
    """Sustained: accelerating, and less than half of the hours are bursts; a spike: not accelerating, and more than 0.3 are."""
    b = W.bursts(W.series(event_signals(spark, sf), "hour", ["source"]), ["source"]).groupBy("source").agg(F.count_if("burst").alias("burst_hours"), (F.count_if("burst") / F.count(F.lit(1))).alias("ratio"))
    j = b.join(W.accelerating(_kin(spark, sf), ["source"]), "source")
    up, ratio = F.col("accelerating"), F.col("ratio")
    return j.select("source", "burst_hours", F.round(ratio, 6).alias("burst_ratio"), "accelerating", (up & (ratio < 0.5)).alias("sustained"), (~up & (ratio > 0.3)).alias("spike"))


@query(f"""with {SQL_VEC}, u as (select cluster_id, date_trunc('week', ts)::date as d, unnest(embedding) as x, unnest(range(1, 65)) as p from vec), c as (select cluster_id, d, p, avg(x) as x from u group by all),
v as (select cluster_id, d, list(x order by p) as c from c group by all), l as (select cluster_id, d, c, lag(c) over (partition by cluster_id order by d) as before from v)
select cluster_id, strftime(d, '%Y-%m-%d') as week, round(1 - list_cosine_similarity(c, before), 5) as drift, coalesce(1 - list_cosine_similarity(c, before) > 0.25, false) as mutation from l""")
def daily_centroid_drift(spark, sf):
    from ..operators.groups import centroids

    v = vector_groups(spark, sf).withColumn("d", F.to_date(F.date_trunc("week", "ts")))
    c = centroids(v, ["cluster_id", "d"], "embedding")
    w = Window.partitionBy("cluster_id").orderBy("d")
    c = c.withColumn("drift", 1 - cosine(F.col("centroid"), F.lag("centroid").over(w)))
    return c.select("cluster_id", F.date_format("d", "yyyy-MM-dd").alias("week"), F.round("drift", 5).alias("drift"), F.coalesce(F.col("drift") > 0.25, F.lit(False)).alias("mutation"))


_SNAP = f"""with {SQL_EV}, {SQL_REGIONS}, w as (select distinct date_trunc('week', ts)::date as week from ev), c as (select date_trunc('week', ts)::date as week, region, source, count(*) as k, avg(weight) as q from ev group by all),
t as (select week, region, sum(k) as n from c group by 1, 2), h as (select week, region, any_value(n) as n, 0 - sum(k / n * log2(k / n)) as entropy, sum(k * q) / any_value(n) as quality, string_agg(source || '=' || k, ',' order by source) as mix from c join t using (week, region) group by 1, 2),
snap as (select week, regions.region, coalesce(n, 0)::bigint as n, coalesce(entropy, 0) as entropy, coalesce(quality, 0) as quality, coalesce(mix, '') as mix from w cross join regions left join h using (week, region))"""


def snapshot(spark, sf):
    e = event_signals(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    c = e.groupBy("week", "region", "source").agg(F.count(F.lit(1)).alias("k"), F.avg("weight").alias("q"))
    w = Window.partitionBy("week", "region")
    c = c.withColumn("n", F.sum("k").over(w)).withColumn("p", F.col("k") / F.col("n"))
    mix = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "k"))), lambda x: F.concat_ws("=", x["source"], x["k"].cast("string"))), ",")
    h = c.groupBy("week", "region").agg(F.max("n").alias("n"), (0.0 - F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (F.sum(F.col("k") * F.col("q")) / F.max("n")).alias("quality"), mix.alias("mix"))
    every = e.select("week").distinct().join(F.broadcast(regions(spark).select("region")), F.lit(True))
    return every.join(h, ["week", "region"], "left").fillna({"n": 0, "entropy": 0.0, "quality": 0.0, "mix": ""})


@query(f"{_SNAP} select strftime(week, '%Y-%m-%d') as week, region, n, round(entropy, 6) as entropy, round(quality + 1e-9, 5) as quality, mix from snap")
def weekly_snapshot(spark, sf):
    return snapshot(spark, sf).select(F.date_format("week", "yyyy-MM-dd").alias("week"), "region", "n", F.round("entropy", 6).alias("entropy"), F.round(F.col("quality") + 1e-9, 5).alias("quality"), "mix")  # means of halves: a nudge, so that ties go one way


@query(f"{_SNAP} select strftime(week, '%Y-%m-%d') as week, n from snap where region = '01582' and week between date '2024-01-08' and date '2024-01-22'")
def history_range(spark, sf):
    s = snapshot(spark, sf).where("region = '01582' and week between date'2024-01-08' and date'2024-01-22'")
    return s.orderBy("week").select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n")


@query(f"""{_SNAP} select strftime(a.week, '%Y-%m-%d') as week, a.region, coalesce(a.n - b.n, 0) as wow, round(case when b.n > 0 then 100.0 * (a.n - b.n) / b.n end, 6) as wow_pct, b.n is not null as wow_available, y.n is not null as yoy_available
from snap a left join snap b on b.region = a.region and b.week = a.week - 7 left join snap y on y.region = a.region and isoyear(y.week) = isoyear(a.week) - 1 and weekofyear(y.week) = weekofyear(a.week)""")
def period_deltas(spark, sf):
    s = snapshot(spark, sf).select("week", "region", "n")
    iso = lambda c: (F.date_part(F.lit("YEAROFWEEK"), c), F.weekofyear(c))
    a = s.withColumn("y", iso(F.col("week"))[0]).withColumn("w", iso(F.col("week"))[1])
    b = s.select("region", F.date_add("week", 7).alias("week"), F.col("n").alias("b"))
    y = s.select("region", (iso(F.col("week"))[0] + 1).alias("y"), iso(F.col("week"))[1].alias("w"), F.col("n").alias("yn"))
    j = a.join(b, ["region", "week"], "left").join(y, ["region", "y", "w"], "left")
    return j.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "region", F.coalesce(F.col("n") - F.col("b"), F.lit(0)).alias("wow"), F.round(F.when(F.col("b") > 0, 100.0 * (F.col("n") - F.col("b")) / F.col("b")), 6).alias("wow_pct"), F.col("b").isNotNull().alias("wow_available"), F.col("yn").isNotNull().alias("yoy_available"))


@query(f"{_SNAP} select strftime(week, '%Y-%m-%d') as week, sum(n)::bigint as n, round(avg(entropy), 6) as entropy, count(*) filter (where n > 0) as active from snap group by 1")
def memory_timeline(spark, sf):
    return snapshot(spark, sf).groupBy(F.date_format("week", "yyyy-MM-dd").alias("week")).agg(F.sum("n").alias("n"), F.round(F.avg("entropy"), 6).alias("entropy"), F.count_if(F.col("n") > 0).alias("active"))


_AL = f"""{_WEEK}, g as (select *, row_number() over (partition by region order by bucket desc) as age from s), al as (select region, max(n) filter (where age = 1) as last, max(n) filter (where age = 2) as previous, avg(n) filter (where age > 1) as m1, stddev_pop(n) filter (where age > 1) as s1,
avg(n) filter (where age > 2) as m2, stddev_pop(n) filter (where age > 2) as s2, avg(n) filter (where age between 2 and 5) as base from g group by 1), az as (select *, (last - m1) / case when s1 > 0 then s1 else 1 end as z from al)"""


def _alerts(spark, sf):
    return W.weekly_alerts(W.series(event_signals(spark, sf), "week", ["region"]), ["region"])


@query(f"{_AL} select region, round(z, 6) as z, z >= 2 as alert_a from az")
def alert_rate(spark, sf):
    return _alerts(spark, sf).select("region", F.round("z", 6).alias("z"), "alert_a")


@query(f"{_AL} select region, last > m2 + 1.5 * s2 and previous > m2 + 1.5 * s2 as alert_b from az")
def alert_sustained(spark, sf):
    return _alerts(spark, sf).select("region", "alert_b")


@query(f"{_AL} select region, last < 0.5 * base and last < previous as alert_c from az")
def alert_decay(spark, sf):
    return _alerts(spark, sf).select("region", "alert_c")


@query(f"{_AL} select region, round(coalesce(base, 5), 6) as baseline from az")
def alert_baseline(spark, sf):
    return _alerts(spark, sf).select("region", F.round(F.coalesce("base", F.lit(5.0)), 6).alias("baseline"))


@query(f"{_AL} select region, case when z > 2 then 'A' when z > 1.5 then 'B' when z < -0.5 then 'C' else 'none' end as class from az")
def alert_class_z(spark, sf):
    return _alerts(spark, sf).select("region", cases([(F.col("z") > 2, "A"), (F.col("z") > 1.5, "B"), (F.col("z") < -0.5, "C")], "none").alias("class"))


@query(f"""{_AL}, c as (select region, case when z > 2 then 'A' when z > 1.5 then 'B' when z < -0.5 then 'C' else 'none' end as class, z, case when previous > 0 then (last - previous) / previous else 0 end as change from az)
select region, class, round(z, 6) as z, round(change, 6) as change, case when change > 0.15 then 'rising' when change < -0.15 then 'falling' else 'stable' end as trend from c order by case class when 'A' then 0 when 'B' then 1 when 'C' then 2 else 3 end, z desc, region limit 1""")
def weekly_digest(spark, sf):
    """The first notice by class, and its region's change from the week before."""
    c = _alerts(spark, sf).withColumn("class", cases([(F.col("z") > 2, "A"), (F.col("z") > 1.5, "B"), (F.col("z") < -0.5, "C")], "none"))
    rank = cases([(F.col("class") == "A", 0), (F.col("class") == "B", 1), (F.col("class") == "C", 2)], 3)
    change = F.when(F.col("previous") > 0, (F.col("last") - F.col("previous")) / F.col("previous")).otherwise(0.0)
    top = c.withColumn("change", change).orderBy(rank, F.desc("z"), "region").limit(1)
    return top.select("region", "class", F.round("z", 6).alias("z"), F.round("change", 6).alias("change"), cases([(F.col("change") > 0.15, "rising"), (F.col("change") < -0.15, "falling")], "stable").alias("trend"))


_GAUGE = f"""{_AL}, hs as (select region, date_trunc('hour', ts)::timestamp as h, count(*) as n from ev group by 1, 2), hm as (select min(h) as a, max(h) as b from hs),
hf as (select k.region, x.h, coalesce(n, 0) as n from (select distinct region from hs) k cross join (select unnest(generate_series(a, b, interval 1 hour)) as h from hm) x left join hs on hs.region = k.region and hs.h = x.h),
hz as (select region, h, n, (n - avg(n) over w) / coalesce(nullif(stddev_samp(n) over w, 0), 1) as z from hf window w as (partition by region order by h rows between 23 preceding and current row)),
wb as (select region, max(share) as share from (select region, date_trunc('week', h) as wk, coalesce(sum(n) filter (where z > 2), 0) / nullif(sum(n), 0) as share from hz where h >= {_NOW} - interval 28 day group by 1, 2) group by 1),
dg as (select region, ts::date as d, count(*) as n, count(distinct source) as s, max(ts) as t, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 as span from ev group by 1, 2),
gt as (select region, count(*) filter (where t >= {_NOW} - interval 7 day) as recent, avg(greatest(0, 100 - 100 * span / 24)) as velocity from dg where n >= 3 and s >= 2 and t <= {_NOW} - interval 24 hour group by 1),
tw as (select count(*) filter (where ts >= {_NOW} - interval 8 day) as last, count(*) filter (where ts >= {_NOW} - interval 15 day and ts < {_NOW} - interval 8 day) as before from ev where ts <= {_NOW} - interval 24 hour),
tr as (select case when before > 0 then 100.0 * (last - before) / before else 0 end as m from tw)"""


@query(f"""{_GAUGE}, pt as (select region, least(recent / 10 * 40, 40) as volume, case when m > 0 then least(m / 50 * 30, 30) else greatest(m / 50 * 15, -15) end as trend, case when coalesce(share, 0) > 0.5 then 15 else 0 end as burst,
case when z >= 2 then 15 when (last > m2 + 1.5 * s2 and previous > m2 + 1.5 * s2) or (last < 0.5 * base and last < previous) then 10 else 0 end as alert, velocity / 10 as velocity from gt join wb using (region) join az using (region), tr)
select region, round(volume, 6) as volume, round(trend, 6) as trend, burst::int as burst, alert::int as alert, round(velocity, 6) as velocity, round(least(100, greatest(0, volume + trend + burst + alert + velocity)), 6) as gauge from pt""")
def attention_gauge(spark, sf):
    """Five parts by region, from released groups: recent volume (40 points), the trend of all signals (30, or down to -15), bursts of the last four weeks (15), alerts (15 or 10), velocity (10); the sum within 0 and 100."""
    e = event_signals(spark, sf)
    day, hours = F.to_date("ts"), lambda n: as_of() - F.make_dt_interval(hours=F.lit(n))
    groups = e.groupBy("region", day.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s"), F.max("ts").alias("t"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("span"))
    out = groups.where((F.col("n") >= 3) & (F.col("s") >= 2) & (F.col("t") <= hours(24)))
    g = out.groupBy("region").agg(F.count_if(F.col("t") >= hours(7 * 24)).alias("recent"), F.avg(F.greatest(F.lit(0.0), 100 - 100 * F.col("span") / 24)).alias("velocity"))
    b = W.bursts(W.series(e, "hour", ["region"]), ["region"]).where(F.col("bucket") >= hours(28 * 24)).groupBy("region", F.date_trunc("week", "bucket").alias("w"))
    b = b.agg((F.sum(F.when(F.col("burst"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias("share")).groupBy("region").agg(F.max("share").alias("share"))
    t = e.where(F.col("ts") <= hours(24)).agg(F.count_if(F.col("ts") >= hours(8 * 24)).alias("last"), F.count_if((F.col("ts") >= hours(15 * 24)) & (F.col("ts") < hours(8 * 24))).alias("before")).first()
    moved = 100.0 * (t["last"] - t["before"]) / t["before"] if t["before"] else 0.0
    trend = F.lit(min(moved / 50 * 30, 30.0) if moved > 0 else max(moved / 50 * 15, -15.0))
    j = g.join(b, "region").join(_alerts(spark, sf).select("region", "alert_a", "alert_b", "alert_c"), "region")
    volume, velocity = F.least(F.col("recent") / 10 * 40, F.lit(40.0)), F.col("velocity") / 10
    burst = F.when(F.coalesce("share", F.lit(0.0)) > 0.5, 15).otherwise(0)
    alert = F.when(F.col("alert_a"), 15).when(F.col("alert_b") | F.col("alert_c"), 10).otherwise(0)
    six = lambda x, name: F.round(x, 6).alias(name)
    return j.select("region", six(volume, "volume"), six(trend, "trend"), burst.alias("burst"), alert.alias("alert"), six(velocity, "velocity"), six(clamp(volume + trend + burst + alert + velocity, 0.0, 100.0), "gauge"))

