"""Queries on aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cases, clamp, hours_before
from ..operators import aggregate as A
from ..operators import normalize as N
from ..sources.adapters import SQL_DOC, SQL_EV, SQL_GEV, SQL_REGIONS, as_of, event_groups, event_signals, regions, table, text_signals
from .base import query

_CS = "cs as (select cluster_id, any_value(region) as region, count(*) as size, sum(weight) as volume, count(distinct source) as n_sources, min(ts) as first_ts, max(ts) as last_ts from gev group by 1)"
_W = f"with {SQL_EV}, {SQL_GEV}, {_CS}"
_NOW = "timestamp '2024-01-31'"


def clusters(spark, sf):
    return A.group_stats(event_groups(spark, sf), ["cluster_id"])


def _r(name, c=None):
    return F.round(F.col(c or name), 6).alias(name)


def _buckets(unit):
    return f"with {SQL_EV} select strftime(date_trunc('{unit}', ts), '%Y-%m-%d') as bucket, count(*) as n, count(distinct source) as n_sources, count(distinct region) as n_regions from ev group by 1"


@query(_buckets("week"))
def time_bucket_counts(spark, sf):
    return A.bucket_counts(event_signals(spark, sf), "week").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query(f"with {SQL_EV} select 'day' as period, strftime(ts, '%Y-%m-%d') as label, count(*) as n from ev group by 2 union all select 'month', strftime(ts, '%Y-%m'), count(*) from ev group by 2 union all select 'year', strftime(ts, '%Y'), count(*) from ev group by 2")
def time_series_period(spark, sf):
    e = event_signals(spark, sf)
    labels = F.array(*[F.struct(F.lit(k).alias("period"), F.date_format("ts", f).alias("label")) for k, f in A.FORMATS.items()])
    return e.select(F.explode(labels).alias("x")).select("x.*").groupBy("period", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV} select region, count(weight) as count, round(sum(weight), 4) as sum, round(avg(weight), 6) as mean, round(quantile_cont(weight, 0.5), 6) as median, round(min(weight), 6) as min, round(max(weight), 6) as max, round(stddev_pop(weight), 6) as std from ev group by 1")
def basic_stats(spark, sf):
    s = A.stats(event_signals(spark, sf), "weight", ["region"])
    return s.select("region", "count", F.round("sum", 4).alias("sum"), *[_r(c) for c in ("mean", "median", "min", "max", "std")])


@query("select coalesce(source, 'Unknown') as source, count(*) as n from documents group by 1")
def count_by(spark, sf):
    return A.count_by(table(spark, sf, "documents"), "source")


@query("select coalesce(source, 'Unknown') as source, count(*) as n from documents group by 1 order by n desc, source limit 5")
def top_n(spark, sf):
    return A.top_n(table(spark, sf, "documents"), "source", 5)


@query(f"with {SQL_EV} select region, count(*) as n, round(100.0 * count(*) / (select count(*) from ev), 6) as pct from ev group by 1")
def geo_distribution(spark, sf):
    g = event_signals(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return A.with_totals(g, F.sum("n").alias("total")).select("region", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


@query("select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r, count(*) as n from lineitem group by 1")
def correlation(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) as p25, round(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem group by 1")
def percentile(spark, sf):
    p = A.percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p90": 0.9})
    return p.select("l_returnflag", F.round("p25", 4).alias("p25"), F.round("p90", 4).alias("p90"))


@query("with s as (select avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as sd from lineitem) select l_orderkey, l_linenumber, round((l_extendedprice - m) / sd, 6) as z from lineitem, s where abs((l_extendedprice - m) / sd) > 2")
def anomalies_z(spark, sf):
    return A.anomalies(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice").select("l_orderkey", "l_linenumber", _r("z"))


@query(f"{_W} select count(*) as n_groups, sum(size)::bigint as n_signals, round(avg(volume), 6) as mean_volume, round(max(volume), 6) as max_volume, round(min(volume), 6) as min_volume, count(distinct region) as n_regions from cs")
def cluster_summary(spark, sf):
    return clusters(spark, sf).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_signals"), F.round(F.avg("volume"), 6).alias("mean_volume"), F.round(F.max("volume"), 6).alias("max_volume"), F.round(F.min("volume"), 6).alias("min_volume"), F.countDistinct("region").alias("n_regions"))


@query(f"with {SQL_EV}, {SQL_GEV}, s as (select cluster_id, unnest(list(distinct source)) as source from gev group by 1) select source, count(*) as n_groups from s group by 1")
def source_breakdown(spark, sf):
    g = event_groups(spark, sf).groupBy("cluster_id").agg(F.collect_set("source").alias("sources"))
    return g.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n_groups"))


@query(f"{_W} select count(*) filter (where volume / 100 <= 3) as low, count(*) filter (where volume / 100 > 3 and volume / 100 <= 6) as medium, count(*) filter (where volume / 100 > 6) as high from cs")
def strength_histogram(spark, sf):
    s = F.col("volume") / 100
    return clusters(spark, sf).agg(F.count_if(s <= 3).alias("low"), F.count_if((s > 3) & (s <= 6)).alias("medium"), F.count_if(s > 6).alias("high"))


@query(f"""with {SQL_EV}, r as (select region, count(*) as n, row_number() over (order by count(*) desc, region) as k from ev group by 1)
select (select count(*) from ev) as total, (select count(*) from ev where ts >= {_NOW} - interval 7 day) as last_7, (select count(*) from ev where ts >= {_NOW} - interval 14 day and ts < {_NOW} - interval 7 day) as before_7, (select string_agg(region, ',' order by k) from r where k <= 5) as top_regions""")
def dashboard_summary(spark, sf):
    e = event_signals(spark, sf)
    week = as_of() - F.expr("interval 7 days")
    two = as_of() - F.expr("interval 14 days")
    per = e.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= week).alias("last_7"), F.count_if((F.col("ts") >= two) & (F.col("ts") < week)).alias("before_7"))
    # One row per region from here on.
    ranked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "region"))), 1, 5), lambda x: x["region"])
    return per.agg(F.sum("n").alias("total"), F.sum("last_7").alias("last_7"), F.sum("before_7").alias("before_7"), F.array_join(ranked, ",").alias("top_regions"))


@query(f"""{_W} select case when size < 2 then '1' when size < 3 then '2' when size < 5 then '3-4' when size < 10 then '5-9' when size < 20 then '10-19' else '20+' end as bin, count(*) as n from cs group by 1""")
def bin_histogram(spark, sf):
    s = F.col("size")
    b = cases([(s < 2, "1"), (s < 3, "2"), (s < 5, "3-4"), (s < 10, "5-9"), (s < 20, "10-19")], "20+")
    return clusters(spark, sf).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_W} select region, n_groups, n_signals from (select region, count(*) as n_groups from cs group by 1) join (select region, count(*) as n_signals from ev group by 1) using (region)")
def region_totals(spark, sf):
    a = clusters(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n_groups"))
    return a.join(event_signals(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n_signals")), "region")


@query(f"{_W} select round(corr(size, volume), 6) as r, count(*) as n from cs where first_ts >= {_NOW} - interval 30 day")
def size_strength_corr(spark, sf):
    return clusters(spark, sf).where(F.col("first_ts") >= as_of() - F.expr("interval 30 days")).agg(F.round(F.corr("size", "volume"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query(f"{_W} select round(0.4 * least(100, 2 * 100.0 * count(*) / sum(size)) + 0.3 * greatest(0, 100 - date_diff('hour', max(last_ts), {_NOW})) + 0.3 * least(100, sum(size) / 10), 6) as score from cs")
def health_score(spark, sf):
    c = clusters(spark, sf).agg(F.count(F.lit(1)).alias("g"), F.sum("size").alias("n"), F.max("last_ts").alias("t"))
    hours = (F.unix_timestamp(F.date_trunc("hour", as_of())) - F.unix_timestamp(F.date_trunc("hour", F.col("t")))) / 3600
    score = 0.4 * F.least(F.lit(100.0), 200.0 * F.col("g") / F.col("n")) + 0.3 * F.greatest(F.lit(0.0), 100 - hours) + 0.3 * F.least(F.lit(100.0), F.col("n") / 10)
    return c.select(F.round(score, 6).alias("score"))


@query(f"{_W} select region, least(100, round(10 * sum(volume) / 1000))::double as intensity from cs group by 1")
def intensity(spark, sf):
    return clusters(spark, sf).groupBy("region").agg(F.least(F.lit(100.0), F.round(10 * F.sum("volume") / 1000)).alias("intensity"))


@query(f"{_W}, a as (select (epoch_us({_NOW}) - epoch_us(last_ts)) / 3.6e9 as h from cs) select case when h < 48 then 'ACTIVE' when h < 168 then 'RECENT' else 'PAST' end as label, count(*) as n from a where h >= 24 group by 1")
def recency_label(spark, sf):
    h = hours_before(as_of(), F.col("last_ts"))
    g = clusters(spark, sf).withColumn("h", h).where("h >= 24")
    return g.groupBy(cases([(F.col("h") < 48, "ACTIVE"), (F.col("h") < 168, "RECENT")], "PAST").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_W} select coalesce(sum(size) filter (where last_ts >= {_NOW} - interval 3 day), 0)::bigint as last_3d, coalesce(sum(size) filter (where last_ts >= {_NOW} - interval 7 day), 0)::bigint as last_7d, coalesce(sum(size) filter (where last_ts >= {_NOW} - interval 14 day and last_ts < {_NOW} - interval 7 day), 0)::bigint as before_7d from cs")
def period_counts(spark, sf):
    back = lambda n: as_of() - F.expr(f"interval {n} days")
    s = lambda cond: F.sum(F.when(cond, F.col("size")).otherwise(0))
    t = F.col("last_ts")
    return clusters(spark, sf).agg(s(t >= back(3)).alias("last_3d"), s(t >= back(7)).alias("last_7d"), s((t >= back(14)) & (t < back(7))).alias("before_7d"))


@query(f"{_W} select strftime(first_ts, '%Y-%m-%d') as day, count(*) as n_groups, sum(size)::bigint as n_signals, round(avg(volume), 6) as mean_volume from cs group by 1")
def daily_formation(spark, sf):
    return clusters(spark, sf).groupBy(F.date_format("first_ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_signals"), F.round(F.avg("volume"), 6).alias("mean_volume"))


@query(f"with {SQL_EV}, d as (select ts::date as d, count(*) as n from ev group by 1) select sum(n)::bigint as total, round(avg(n), 6) as mean_per_day, max(n) as peak, min(n) as low, date_diff('day', min(d), max(d)) as span_days from d")
def ingest_metrics(spark, sf):
    d = event_signals(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean_per_day"), F.max("n").alias("peak"), F.min("n").alias("low"), F.datediff(F.max("d"), F.min("d")).cast("long").alias("span_days"))


@query(f"{_W} select round(avg(size), 6) as mean_size, round(quantile_cont(size, 0.5), 6) as median_size, max(size) as max_size, round(sum(size) filter (where size >= 3) / sum(size), 6) as grouped_ratio from cs")
def clustering_quality(spark, sf):
    s = F.col("size")
    return clusters(spark, sf).agg(F.round(F.avg(s), 6).alias("mean_size"), F.round(F.percentile(s, 0.5), 6).alias("median_size"), F.max(s).alias("max_size"), F.round(F.sum(F.when(s >= 3, s)) / F.sum(s), 6).alias("grouped_ratio"))


@query(f"with {SQL_EV} select source, count(*) as n, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day, case when count(*) >= 2500 then 'A' when count(*) >= 1500 then 'B' else 'C' end as grade from ev group by 1")
def source_summary(spark, sf):
    n = F.count(F.lit(1))
    return event_signals(spark, sf).groupBy("source").agg(n.alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"), cases([(n >= 2500, "A"), (n >= 1500, "B")], "C").alias("grade"))


@query(f"{_W} select region, count(*) as n_groups, sum(size)::bigint as n_signals, round(avg(volume), 6) as mean_volume from cs group by 1")
def region_summary(spark, sf):
    return clusters(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_signals"), F.round(F.avg("volume"), 6).alias("mean_volume"))


@query(f"with {SQL_DOC} select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(*) as n, count(distinct source) as n_sources, count(distinct region) as n_regions from doc group by 1")
def weekly_unique(spark, sf):
    return A.bucket_counts(text_signals(spark, sf), "week").select(F.date_format("bucket", "yyyy-MM-dd").alias("week"), "n", "n_sources", "n_regions")


_STATE = "case when s * c >= 0.75 then 'HIGH_ATTENTION' when s * c >= 0.5 then 'ELEVATED_ATTENTION' when s * c >= 0.25 then 'MODERATE' else 'QUIET' end"


def state(score, confidence):
    p = score * confidence
    return cases([(p >= 0.75, "HIGH_ATTENTION"), (p >= 0.5, "ELEVATED_ATTENTION"), (p >= 0.25, "MODERATE")], "QUIET")


@query(f"{_W}, r as (select region, least(avg(volume) / 1000, 1) as s, least(sum(size) / 500, 1) as c, count(*) as n_groups from cs group by 1) select region, round(s, 6) as score, round(c, 6) as confidence, n_groups, {_STATE} as state from r")
def attention_by_region(spark, sf):
    r = clusters(spark, sf).groupBy("region").agg(F.least(F.avg("volume") / 1000, F.lit(1.0)).alias("s"), F.least(F.sum("size") / 500, F.lit(1.0)).alias("c"), F.count(F.lit(1)).alias("n_groups"))
    return r.select("region", _r("score", "s"), _r("confidence", "c"), "n_groups", state(F.col("s"), F.col("c")).alias("state"))


@query(f"with {SQL_EV}, a as (select region, count(*) as n, sum(weight * exp(-ln(2) * (epoch_us({_NOW}) - epoch_us(ts)) / 3.6e9 / 168)) as d, count(distinct source) as n_sources from ev group by 1) select region, n, round(d, 4) as decayed, n_sources, round(d / (select max(d) from a), 6) as share from a")
def region_time_decay(spark, sf):
    decay = F.exp(-F.log(F.lit(2.0)) * hours_before(as_of(), F.col("ts")) / 168)
    a = event_signals(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") * decay).alias("d"), F.countDistinct("source").alias("n_sources"))
    return A.with_totals(a, F.max("d").alias("top")).select("region", "n", F.round("d", 4).alias("decayed"), "n_sources", F.round(F.col("d") / F.col("top"), 6).alias("share"))


@query(f"""with {SQL_EV}, m as (select region, strftime(ts, '%Y-%m-%d %H') as hour, md5('{{"signal_id":' || signal_id || ',"source":"' || source || '"}}') as h from ev), p as (select region, hour, ('0x' || substr(h, 1, 15))::bigint as a, ('0x' || substr(h, 17, 15))::bigint as b from m)
select region, hour, sha256(concat_ws('|', count(*)::varchar, bit_xor(a)::varchar, bit_xor(b)::varchar, sum(a::hugeint)::varchar, sum(b::hugeint)::varchar)) as hash from p group by 1, 2""")
def inputs_hash(spark, sf):
    e = event_signals(spark, sf).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return A.inputs_hash(e, ["region", "hour"], ["signal_id", "source"])


@query("select o_orderpriority as step, count(*) as runs, round(avg(case when o_orderstatus <> 'F' then 1.0 else 0 end), 6) as success_rate, round(avg(o_totalprice), 4) as mean_cost, arg_max(o_orderkey, (o_orderdate, o_orderkey)) filter (where o_orderstatus = 'F') as last_failed from orders group by 1")
def step_health(spark, sf):
    failed = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("step")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.when(~failed, 1.0).otherwise(0.0)), 6).alias("success_rate"), F.round(F.avg("o_totalprice"), 4).alias("mean_cost"),
        F.max_by(F.when(failed, F.col("o_orderkey")), F.when(failed, F.struct("o_orderdate", "o_orderkey"))).alias("last_failed"),
    )


@query("select l_returnflag as stage, l_linestatus as step, count(*) as n, count(distinct l_orderkey) as records from lineitem group by 1, 2")
def lineage_summary(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("records"))


@query("""with e as (select o_orderkey as record, 'ordered' as stage, o_orderstatus as step, 0 as line, o_orderdate::timestamp as t from orders union all select l_orderkey, 'shipped', l_returnflag || l_linestatus, l_linenumber, l_shipdate::timestamp from lineitem)
select record, row_number() over w as place, stage, step, line::int as line, strftime(t, '%Y-%m-%d') as day, date_diff('day', lag(t) over w, t) as days from e window w as (partition by record order by t, line, stage, step)""")
def lineage_chain(spark, sf):
    """Every record's events in the order of time: when it was ordered and each of its lines shipped, and the days since the event before."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), F.lit("ordered").alias("stage"), F.col("o_orderstatus").alias("step"), F.lit(0).alias("line"), F.col("o_orderdate").cast("timestamp").alias("at"))
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.lit("shipped").alias("stage"), F.concat("l_returnflag", "l_linestatus").alias("step"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_shipdate").cast("timestamp").alias("at"))
    w = Window.partitionBy("record").orderBy("at", "line", "stage", "step")  # the few events of one record
    e = o.unionByName(i).withColumn("place", F.row_number().over(w)).withColumn("days", F.datediff("at", F.lag("at").over(w)).cast("long"))
    return e.select("record", "place", "stage", "step", "line", F.date_format("at", "yyyy-MM-dd").alias("day"), "days")


@query("select coalesce(source, 'Unknown') as source, case when length(text) < 200 then 'too_short' when length(text) > 20000 then 'too_long' else 'accepted' end as status, count(*) as n from documents group by 1, 2")
def rejects_summary(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("Unknown")).alias("source"), cases([(n < 200, "too_short"), (n > 20000, "too_long")], "accepted").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("select source, count(*) as scraped, count(*) filter (where length(text) >= 200) as valid from documents group by 1")
def source_scrape_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("scraped"), F.count_if(F.length("text") >= 200).alias("valid"))


@query(f"with {SQL_EV} select region, strftime(ts, '%Y-%m-%d') as day, signal_id from ev")
def event_catalog_index(spark, sf):
    """The index as rows sorted by region, day and id, so that no day's ids are gathered in one."""
    e = event_signals(spark, sf)
    return e.select("region", F.date_format("ts", "yyyy-MM-dd").alias("day"), "signal_id").orderBy("region", "day", "signal_id")
