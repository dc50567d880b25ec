"""Queries on deduplication, joins, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import haversine_km
from ..operators import dedup as D
from ..operators.sizes import sent
from ..operators.spatial import near_points
from ..sources.adapters import SQL_DOC, SQL_EV, SQL_GEV, SQL_REGIONS, SQL_SITES, event_groups, event_signals, regions, sites, table, text_signals
from .base import query

_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"with {SQL_DOC} select signal_id from (select signal_id, row_number() over (partition by substr(text, 1, 100) order by ts, signal_id) as n from doc) where n = 1")
def dedup_prefix(spark, sf):
    return D.by_prefix(text_signals(spark, sf)).select("signal_id")


@query("select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations) where n = 1")
def dedup_id(spark, sf):
    return D.by_id(table(spark, sf, "conversations"), "conv_id", [F.col("turn")]).select("conv_id", "turn")


@query(f"with {SQL_DOC} select signal_id from (select signal_id, row_number() over (partition by substr(lower(text), 1, 50) order by ts, signal_id) as n from doc) where n = 1")
def dedup_title_prefix(spark, sf):
    return D.by_title_prefix(text_signals(spark, sf), "text").select("signal_id")


@query(f"with {SQL_DOC} select signal_id, k from (select signal_id, sha256(lower(trim(text)) || strftime(ts, '%Y-%m-%d')) as k, row_number() over (partition by sha256(lower(trim(text)) || strftime(ts, '%Y-%m-%d')) order by signal_id) as n from doc) where n = 1")
def dedup_hash_key(spark, sf):
    return D.by_hash(text_signals(spark, sf)).select("signal_id", D.hash_key(F.col("text"), F.col("ts")).alias("k"))


@query(f"""with {SQL_DOC}, b as (select *, 0 as batch from doc union all select *, 1 as batch from doc where signal_id % 3 = 0)
select signal_id, region from (select *, row_number() over (partition by text, region order by batch desc, signal_id desc) as n from b) where n = 1""")
def dedup_keep_last(spark, sf):
    d = text_signals(spark, sf)
    return D.keep_last(d, d.where("signal_id % 3 = 0"), ["text", "region"]).select("signal_id", "region")


@query(f"with {SQL_DOC} select signal_id, left(md5(substr(text, 1, 100) || strftime(ts, '%Y-%m-%d') || region), 12) as content_id from doc")
def content_event_id(spark, sf):
    return text_signals(spark, sf).select("signal_id", D.event_id(F.col("text"), F.col("ts"), F.col("region")).alias("content_id"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_join_seen(spark, sf):
    return D.not_seen(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query(f"with {SQL_EV}, {SQL_REGIONS} select signal_id from ev where region in (select region from regions where grp = 'europe')")
def semi_join_regions(spark, sf):
    return D.in_regions(event_signals(spark, sf), regions(spark).where("grp = 'europe'")).select("signal_id")


@query("select n_name, customers, suppliers from (select c_nationkey as k, count(*) as customers from customer group by 1) join (select s_nationkey as k, count(*) as suppliers from supplier group by 1) using (k) join nation on n_nationkey = k")
def inner_join_counts(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "k").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("k")).select("n_name", "customers", "suppliers")


@query("select doc_id, coalesce(quality, 1) as quality, coalesce(toxic, 0) as toxic from documents left join labels using (doc_id)")
def left_join_coalesce(spark, sf):
    j = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query(f"with {SQL_EV}, {SQL_REGIONS} select signal_id, coalesce(grp, 'none') as grp from ev left join (select * from regions where grp <> 'europe') using (region)")
def map_lookup_join(spark, sf):
    r = regions(spark).where("grp <> 'europe'").select("region", "grp")
    return event_signals(spark, sf).join(r, "region", "left").select("signal_id", F.coalesce("grp", F.lit("none")).alias("grp"))


@query("select doc_id, label from documents join embeddings on vec_id = doc_id")
def positional_align(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("vec_id") == F.col("doc_id")).select("doc_id", "label")


@query(f"with {SQL_EV}, {SQL_REGIONS} select region, grp, coalesce(n, 0) as n, coalesce(n_sources, 0) as n_sources from regions left join (select region, count(*) as n, count(distinct source) as n_sources from ev where ts >= timestamp '2024-01-30 20:00:00' group by 1) using (region)")
def dimension_left_outer_fill(spark, sf):
    f = event_signals(spark, sf).where("ts >= timestamp'2024-01-30 20:00:00'").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))
    return D.fill_dimension(regions(spark).select("region", "grp"), f, "region", {"n": 0, "n_sources": 0})


@query(f"""with {SQL_EV}, g as (select region, date_trunc('hour', ts) as b, count(*) as n from ev group by 1, 2), s as (select region, unnest(generate_series(min(b), max(b), interval 1 hour)) as b from g group by 1)
select region, strftime(s.b, '%Y-%m-%d %H:%M:%S') as bucket, coalesce(n, 0) as n from s left join g using (region, b)""")
def calendar_gap_fill(spark, sf):
    c = D.calendar(event_signals(spark, sf), "ts", "hour", ["region"], F.count(F.lit(1)), "n")
    return c.select("region", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n")


@query(f"with {SQL_SITES} select a.site as a, b.site as b, round({_KM}, 6) as km from sites a join sites b on a.site <> b.site and b.lat between a.lat - 0.04 and a.lat + 0.04 where {_KM} <= 4.0")
def self_pair_join(spark, sf):
    """Pairs of sites within four kilometres; sites meet those of neighbouring cells only."""
    near = near_points(sites(spark, sf).withColumnRenamed("site", "id"), 4.0)
    return near.select("a", "b", F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


_RING = "case when km < 2 then 0 when km < 5 then 1 when km < 10 then 2 when km < 20 then 3 else 4 end"


@query(f"with {SQL_REGIONS}, {SQL_SITES}, d as (select a.region as centre, {_KM} as km from regions a cross join sites b where a.region in ('01249', '01582')) select centre, {_RING} as ring, count(*) as n from d where km < 50 group by 1, 2")
def range_join_ring(spark, sf):
    """Sites by distance from two centres."""
    a = F.broadcast(regions(spark).where("region in ('01249', '01582')").select(F.col("region").alias("centre"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0")))  # two rows
    d = sites(spark, sf).join(a, F.abs(F.col("lat") - F.col("lat0")) < 1).select("centre", haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")).alias("km"))
    ring = F.when(F.col("km") < 2, 0).when(F.col("km") < 5, 1).when(F.col("km") < 10, 2).when(F.col("km") < 20, 3).otherwise(4)
    return d.where("km < 50").groupBy("centre", ring.alias("ring")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_REGIONS}, {SQL_SITES}, b as (select grp, min(lat) - 0.01 as a1, max(lat) + 0.01 as a2, min(lon) - 0.01 as o1, max(lon) + 0.01 as o2 from regions group by 1) select site, b.grp as box from sites join b on lat between a1 and a2 and lon between o1 and o2")
def point_in_box(spark, sf):
    """Sites in the boxes of region groups."""
    b = regions(spark).groupBy(F.col("grp").alias("box")).agg((F.min("lat") - 0.01).alias("a1"), (F.max("lat") + 0.01).alias("a2"), (F.min("lon") - 0.01).alias("o1"), (F.max("lon") + 0.01).alias("o2"))
    return sites(spark, sf).join(F.broadcast(b), F.col("lat").between(F.col("a1"), F.col("a2")) & F.col("lon").between(F.col("o1"), F.col("o2"))).select("site", "box")  # a box for each group of regions


_G = "g as (select cluster_id, any_value(region) as region, count(*) as n, sum(weight) as volume, max(ts) as last_ts from gev group by 1)"


def _groups(spark, sf):
    return event_groups(spark, sf).groupBy("cluster_id").agg(F.any_value("region").alias("region"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("volume"), F.max("ts").alias("last_ts"))


@query(f"with {SQL_EV}, {SQL_GEV}, {_G} select cluster_id, n, round(volume, 6) as volume from g order by volume desc, cluster_id limit 25")
def order_by_volume(spark, sf):
    return _groups(spark, sf).orderBy(F.desc("volume"), "cluster_id").limit(25).select("cluster_id", "n", F.round("volume", 6).alias("volume"))


@query(f"with {SQL_EV}, {SQL_GEV}, {_G} select cluster_id, round(volume / n, 6) as quality from g order by volume / n desc, cluster_id limit 25")
def order_by_quality(spark, sf):
    return _groups(spark, sf).withColumn("q", F.col("volume") / F.col("n")).orderBy(F.desc("q"), "cluster_id").limit(25).select("cluster_id", F.round("q", 6).alias("quality"))


@query(f"with {SQL_EV}, {SQL_GEV}, {_G} select cluster_id, strftime(last_ts, '%Y-%m-%d %H:%M:%S') as last_ts from g where n >= 3 and last_ts <= timestamp '2024-01-30' order by g.last_ts desc, cluster_id limit 12")
def latest_k(spark, sf):
    g = _groups(spark, sf).where("n >= 3 and last_ts <= timestamp'2024-01-30 00:00:00'")
    return g.orderBy(F.desc("last_ts"), "cluster_id").limit(12).select("cluster_id", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query(f"with {SQL_EV} select signal_id, region from ev where ts >= timestamp '2024-01-31' - interval 48 hour")
def recent_hours(spark, sf):
    return event_signals(spark, sf).where("ts >= timestamp'2024-01-29 00:00:00'").orderBy(F.desc("ts"), "signal_id").select("signal_id", "region")


@query(f"with {SQL_EV}, {SQL_GEV}, {_G} select region, cluster_id, rank from (select region, cluster_id, row_number() over (partition by region order by volume desc, cluster_id) as rank from g) where rank <= 10")
def topk_per_group(spark, sf):
    w = Window.partitionBy("region").orderBy(F.desc("volume"), "cluster_id")
    return _groups(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("region", "cluster_id", "rank")


@query("select c_custkey as id, c_name as name, c_acctbal as balance, null::varchar as url from customer union all by name select page_id as id, url from pages")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


_WORDS = "w as (select distinct lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as t from documents), c as (select lang, count(*) as n from w group by 1), o as (select a.lang as a, b.lang as b, count(*) as n from w a join w b on a.lang < b.lang and a.t = b.t group by 1, 2)"


def _lang_words(spark, sf):
    """Different (lang, term) of whole texts."""
    d = table(spark, sf, "documents")
    return d.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("t")).distinct()


def _shared(w):
    """Terms that two languages share, counted by an equi-join on the term."""
    b = w.select(F.col("lang").alias("b"), "t")
    return w.withColumnRenamed("lang", "a").join(b, "t").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_WORDS} select x.lang as a, y.lang as b, x.n - coalesce(o.n, 0) as n from c x join c y on x.lang < y.lang left join o on o.a = x.lang and o.b = y.lang")
def set_diff_terms(spark, sf):
    w = _lang_words(spark, sf)
    c = w.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    pairs = c.withColumnRenamed("lang", "a").join(sent(c.select(F.col("lang").alias("b"))), F.col("a") < F.col("b"))  # of languages
    return pairs.join(_shared(w), ["a", "b"], "left").select("a", "b", (F.col("size") - F.coalesce("n", F.lit(0))).alias("n"))


@query(f"with {_WORDS} select a, b, n from o")
def set_overlap(spark, sf):
    return _shared(_lang_words(spark, sf))


@query(f"with {SQL_EV}, {SQL_REGIONS} select region from regions where region not in (select region from ev where ts >= timestamp '2024-01-30 22:30:00')")
def inactive_regions(spark, sf):
    active = event_signals(spark, sf).where("ts >= timestamp'2024-01-30 22:30:00'")
    return regions(spark).select("region").join(active.select("region"), "region", "left_anti")
