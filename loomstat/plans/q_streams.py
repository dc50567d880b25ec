"""Queries on streams: each reads the table as a stream, over what there is now, into a table that is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hours_before
from ..operators import gates as G
from ..operators import groups
from ..sources import sinks
from ..sources.adapters import SQL_EV, SQL_VEC, as_of, region_code, table, vector_groups
from ..streaming import streams as S
from .base import query
from .q_gates import _MACHINE
from .q_sinks import place
from .q_vectors import _CEN

_END = "(select max(ts) from ev)"


def events(spark, sf):
    raw = S.files(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema)
    e = raw.select(F.col("event_id").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), region_code(F.col("user_id")).alias("region"), F.col("value").alias("weight"))
    return S.vetted(e, now=as_of())


def run(df, spark):
    p = place(spark)
    S.to_table(df, f"{p}/out", f"{p}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{p}/out")


def _t(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(f"with {SQL_EV} select region, count(*) as n from ev group by 1")
def stream_source(spark, sf):
    return run(events(spark, sf), spark).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV} select region, count(*) as n from ev group by 1")
def stream_dedup(spark, sf):
    twice = events(spark, sf).unionByName(events(spark, sf))
    return run(S.dedup(twice, ["signal_id"]), spark).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def _win(hours, delay):
    return f"with {SQL_EV}, w as (select region, date_trunc('hour', ts)::timestamp as start, count(*) as n from ev group by 1, 2) select region, strftime(start, '%Y-%m-%d %H:%M:%S') as start, n from w where start + interval {hours} hour <= {_END} - interval {delay} hour"


@query(_win(1, 24))
def stream_hourly_counts(spark, sf):
    return run(S.windowed(events(spark, sf), ["region"], "1 hour"), spark).select("region", _t("start"), "n")


@query(f"with {SQL_EV}, w as (select region, unnest(generate_series(date_trunc('hour', ts)::timestamp - interval 23 hour, date_trunc('hour', ts)::timestamp, interval 1 hour)) as start from ev) select region, strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from w where start + interval 24 hour <= {_END} - interval 24 hour group by 1, 2")
def stream_rolling_24h(spark, sf):
    return run(S.windowed(events(spark, sf), ["region"], "24 hours", "1 hour"), spark).select("region", _t("start"), "n")


@query(f"""with {SQL_EV}, g as (select region, source, ts, signal_id, coalesce(ts >= lag(ts) over w + interval 6 hour, true) as first from ev window w as (partition by region, source order by ts, signal_id)),
s as (select *, sum(first::int) over (partition by region, source order by ts, signal_id) as k from g), q as (select region, source, min(ts) as start, max(ts) + interval 6 hour as e, count(*) as n from s group by region, source, k)
select region, source, strftime(start, '%Y-%m-%d %H:%M:%S') as start, n from q where e <= {_END} - interval 24 hour""")
def stream_sessions(spark, sf):
    return run(S.sessions(events(spark, sf), ["region", "source"], "6 hours"), spark).select("region", "source", _t("start"), "n")


@query(_win(1, 72))
def stream_delay_release(spark, sf):
    return run(S.windowed(events(spark, sf), ["region"], "1 hour", delay="72 hours"), spark).select("region", _t("start"), "n")


@query(f"with {SQL_EV} select region, count(*) as n from ev where ts < timestamp '2024-01-15' and ts < (select max(ts) from ev where ts >= timestamp '2024-01-15') - interval 24 hour group by 1")
def stream_late_rows(spark, sf):
    p = place(spark)
    e = sinks.read_table(spark, f"{sf}/events.parquet").select(F.col("event_id").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), region_code(F.col("user_id")).alias("region"))
    split = S.late_splitter(p, "ts", 24)
    # New rows arrive before old ones; two runs of one stream.
    for cond in ("ts >= timestamp'2024-01-15 00:00:00'", "ts < timestamp'2024-01-15 00:00:00'"):
        e.where(cond).write.mode("append").parquet(f"{p}/raw")
        S.each_batch(S.files(spark, f"{p}/raw", e.schema), split, f"{p}/checkpoint")
    return spark.read.schema("signal_id long, ts timestamp, region string, batch int").parquet(f"{p}/late").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV}, c as (select signal_id, count(*) over (partition by region order by epoch_us(ts) range between 3600000000 preceding and current row) as n from ev) select signal_id, n, n <= 2 as accepted from c")
def stream_rate_limit(spark, sf):
    """Events arrive in three stretches of time, as files of a folder; state goes on from one to the next."""
    p = place(spark)
    e = table(spark, sf, "events").select(F.col("event_id").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), region_code(F.col("user_id")).alias("region"))
    out = None
    for first, end in (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        e.where((F.col("ts") >= first) & (F.col("ts") < end)).write.mode("append").parquet(f"{p}/raw")
        out = S.rate_limit(S.files(spark, f"{p}/raw", e.schema), "region", "ts", "signal_id", 2)
        with S.keyed_state(spark):
            S.to_table(out, f"{p}/out", f"{p}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{p}/out").withColumnRenamed("id", "signal_id")


@query(f"{_MACHINE} select region, strftime(day, '%Y-%m-%d') as day, wanted, state from m where k > 0")
def stream_area_state(spark, sf):
    p = place(spark)
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), region_code(F.col("user_id")).alias("region"), F.col("value").alias("weight"))
    a = e.groupBy("region", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s"), F.max("ts").alias("t"), (F.avg("weight") / 100).alias("score"))
    wanted = a.select("region", "day", G.area_state(F.col("n"), F.col("s"), hours_before(as_of(), F.col("t")), F.col("score")).alias("wanted"))
    out = None
    for cond in ("day < '2024-01-15'", "day >= '2024-01-15'"):  # two batches
        wanted.where(cond).write.mode("append").parquet(f"{p}/wanted")
        out = S.area_states(S.files(spark, f"{p}/wanted", wanted.schema))
        with S.keyed_state(spark):
            S.to_table(out, f"{p}/out", f"{p}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{p}/out")


@query(f"with {SQL_VEC}, {_CEN}, n as (select signal_id, cen.cluster_id, list_cosine_similarity(embedding, c) as s from vec cross join cen) select signal_id, arg_max(cluster_id, (s, -cluster_id)) as topic from n group by 1")
def stream_topic_assign(spark, sf):
    p = place(spark)
    c = groups.centroids(vector_groups(spark, sf), ["cluster_id"], "embedding").withColumnRenamed("cluster_id", "topic")
    sinks.replace(c, f"{p}/centroids")
    known = spark.read.parquet(f"{p}/centroids")
    v = S.files(spark, f"{sf}/embedding[s].parquet", table(spark, sf, "embeddings").schema).select(F.col("vec_id").alias("signal_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    one = S.assign(v, known, "signal_id", "embedding")
    S.each_batch(v, lambda b, k: one(b, k).write.mode("append").parquet(f"{p}/out"), f"{p}/checkpoint")
    return spark.read.parquet(f"{p}/out")


@query(f"with {SQL_EV} select source, region, count(*) as n from ev group by 1, 2")
def stream_upsert(spark, sf):
    """Counts by source and region, merged batch by batch; events arrive in two stretches."""
    p = place(spark)
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), region_code(F.col("user_id")).alias("region"))
    for cond in ("ts < timestamp'2024-01-16 00:00:00'", "ts >= timestamp'2024-01-16 00:00:00'"):
        e.where(cond).write.mode("append").parquet(f"{p}/raw")
        S.each_batch(S.files(spark, f"{p}/raw", e.schema), S.merged_counts(f"{p}/counts", ["source", "region"]), f"{p}/checkpoint")
    return spark.read.schema("source string, region string, n long").parquet(f"{p}/counts/{S.versions(spark, f'{p}/counts')[-1]}")
