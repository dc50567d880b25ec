"""Queries on scans and sinks: rows go through a table in the shared folder and are read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators import normalize as N
from ..operators.graph import shared_dir
from ..sources import readers as R
from ..sources import sinks as S
from ..sources.adapters import SQL_EV, SQL_GEV, SQL_REGIONS, SQL_SITES, as_of, event_groups, event_signals, regions, sites, table
from .base import query
from .q_aggregate import _CS, clusters


def place(spark) -> str:
    """A new folder for a table, in the folder that all executors share."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


@query(f"with {SQL_EV} select region, count(*) as n from ev group by 1")
def scan_csv_signals(spark, sf):
    p = place(spark)
    e = event_signals(spark, sf).select(F.concat(F.lit('He said "'), F.col("source"), F.lit('", twice')).alias("text"), F.col("region").alias("zip"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("url"))
    e.write.option("header", True).option("escape", '"').csv(p)
    ok, bad = R.csv_signals(spark, p, "events")
    return ok.groupBy(N.pad_region(F.col("zip")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("select 'documents' as source, count(*) as n from documents union all select 'pages', count(*) from pages")
def scan_multi_glob(spark, sf):
    p = place(spark)
    table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("text"), F.lit("1").alias("zip"), F.lit("2024-01-01").alias("date"), F.lit("u").alias("url")).write.option("header", True).csv(f"{p}/doc_a")
    table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("text"), F.lit("1").alias("zip"), F.lit("2024-01-01").alias("date"), F.lit("u").alias("url")).write.option("header", True).csv(f"{p}/page_a")
    return R.families(spark, p, {"doc_*": "documents", "page_*": "pages"}).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus as text, count(*) as n from orders group by 1")
def scan_column_alias(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "Message")
    return R.aliased(o, {"text": ["text", "content", "MESSAGE"], "date": ["date", "created"]}).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV} select source as category, region as zip, count(*) as n from ev group by 1, 2")
def scan_json_submissions(spark, sf):
    p = place(spark)
    event_signals(spark, sf).select(F.col("source").alias("category"), F.col("region").alias("zip")).write.json(p)
    return spark.read.schema("category string, zip string").json(p).groupBy("category", "zip").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV} select region as key, count(*) as population, round(avg(weight), 6) as income from ev group by 1")
def scan_indicators(spark, sf):
    p = place(spark)
    a = event_signals(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("population"), F.round(F.avg("weight"), 6).alias("income"))
    m = a.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("region", F.struct("population", "income"))))).alias("value"))  # one entry for each region
    m.write.text(p)
    return R.json_map(spark, p, StructType([StructField("population", LongType()), StructField("income", DoubleType())]))


@query(f"with {SQL_EV} select region, count(*) as n from ev where source = 'click' group by 1")
def scan_table_as_df(spark, sf):
    return R.sql_over(spark, {"signals": event_signals(spark, sf)}, "select region, count(*) as n from signals where source = 'click' group by region")


_KNOWN = "k as (select region, list(distinct source) as sources from ev join regions using (region) where grp = 'asia' group by 1), gen as (select list(distinct source) as sources from ev where weight >= 90)"


@query(f"with {SQL_EV}, {SQL_REGIONS}, {_KNOWN} select r.region, coalesce(len(k.sources), (select len(sources) from gen)) as n_expected, (select count(distinct source) from ev where ev.region = r.region) as n_seen from regions r left join k using (region)")
def scan_expected_sources(spark, sf):
    """Sources expected of each region, from a JSON map of those seen in one group of regions, else a general list; and how many were seen."""
    p = place(spark)
    e = event_signals(spark, sf)
    seen = e.groupBy("region").agg(F.collect_set("source").alias("sources"))  # sources are a short fixed list
    asia = regions(spark).where("grp = 'asia'").select("region")
    seen.join(asia, "region", "left_semi").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("region", "sources")))).alias("value")).write.text(p)  # an entry for each region
    known = spark.read.text(p).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("region", "sources"))
    general = sorted(r[0] for r in e.where("weight >= 90").select("source").distinct().collect())
    got = R.with_general(regions(spark).select("region"), known, "region", "sources", general)
    n = e.groupBy("region").agg(F.countDistinct("source").alias("n_seen"))
    return got.join(n, "region", "left").select("region", F.size("sources").cast("long").alias("n_expected"), F.coalesce("n_seen", F.lit(0)).alias("n_seen"))


@query(f"with {SQL_EV} select source, 2 * count(*) as n, 'unknown' as language from ev group by 1")
def sink_table_append(spark, sf):
    p = place(spark)
    for _ in range(2):
        S.append(event_signals(spark, sf), p, {"language": "unknown"})
    return spark.read.parquet(p).groupBy("source", "language").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV}, {SQL_GEV}, {_CS} select region, count(*) as n, sum(size + case when region = '01582' then 1000 else 0 end)::bigint as size from cs group by 1")
def sink_upsert_stats(spark, sf):
    p = place(spark)
    c = clusters(spark, sf).select("cluster_id", "region", "size")
    S.upsert(c, p, ["cluster_id"], ["region"])
    S.upsert(c.where("region = '01582'").withColumn("size", F.col("size") + 1000), p, ["cluster_id"], ["region"])
    return spark.read.schema("cluster_id long, size long, region string").parquet(p).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query(f"with {SQL_EV} select source, strftime(ts, '%Y-%m-%d') as day, case when ts >= timestamp '2024-01-20' then -1 else count(*) end as n from ev group by source, strftime(ts, '%Y-%m-%d'), ts >= timestamp '2024-01-20'")
def sink_upsert_composite(spark, sf):
    p = place(spark)
    d = event_signals(spark, sf).groupBy("source", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    S.upsert(d, p, ["source", "day"], ["source"])
    S.upsert(d.where("day >= '2024-01-20'").withColumn("n", F.lit(-1).cast("long")), p, ["source", "day"], ["source"])
    return spark.read.schema("day string, n long, source string").parquet(p).select("source", "day", "n")


@query("select lang, count(*) as n from documents group by 1")
def sink_full_replace(spark, sf):
    p = place(spark)
    S.replace(table(spark, sf, "pages").select(F.lit("x").alias("lang")), p)
    S.replace(table(spark, sf, "documents").select("lang"), p)
    return spark.read.parquet(p).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV}, {SQL_GEV} select cluster_id, count(*) as n from gev group by 1")
def sink_assignments(spark, sf):
    p = place(spark)
    S.append(event_groups(spark, sf).select("signal_id", "cluster_id"), p, {"assigned_at": "2024-01-31"})
    return spark.read.parquet(p).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def _scrub_sql(col):
    for pat, m in N.SCRUB:
        col = f"regexp_replace({col}, '{pat}', '{m}', 'g')"
    return col


@query(f"select doc_id::varchar as doc_id, sha256(regexp_replace({_scrub_sql('text')}, '[^a-zA-Z]', '', 'g')) as digest from documents")
def sink_csv_export(spark, sf):
    p = place(spark)
    d = table(spark, sf, "documents")
    S.csv_export(d, p, ["doc_id", "text"], {"text": N.scrub(F.col("text"))})
    got = spark.read.schema("doc_id string, text string").option("header", True).option("multiLine", True).option("escape", '"').csv(p)
    # Only letters are compared: CSV trims outer white space.
    return got.select("doc_id", F.sha2(F.regexp_replace("text", "[^a-zA-Z]", ""), 256).alias("digest"))


@query(f"with {SQL_EV}, {SQL_GEV}, {_CS} select cluster_id, region, size from cs where size >= 3 and n_sources >= 2 and last_ts <= timestamp '2024-01-30' and volume >= 1")
def sink_json_rows(spark, sf):
    from .q_gates import _gated

    p = place(spark)
    S.json_rows(_gated(spark, sf).select("cluster_id", F.struct("region", "size").alias("where_")), p)
    return spark.read.schema("cluster_id long, where_ struct<region:string, size:long>").json(p).select("cluster_id", "where_.region", "where_.size")


@query(f"with {SQL_SITES} select site, region, round(lat, 9) as lat, round(lon, 9) as lon from sites")
def sink_geo_features(spark, sf):
    p = place(spark)
    S.geo_features(sites(spark, sf), p, "Point", F.array("lon", "lat"), ["site", "region"])
    j = spark.read.schema("geometry struct<coordinates:array<double>>, properties struct<site:long,region:string>").json(p)
    at = lambda k: F.round(F.col("geometry.coordinates")[k], 9)
    return j.select("properties.site", "properties.region", at(1).alias("lat"), at(0).alias("lon"))


@query(f"with {SQL_EV}, {SQL_GEV} select cluster_id::varchar as cluster_id, string_agg(source, '; ' order by source) as sources from (select distinct cluster_id, source from gev) group by 1")
def sink_array_flatten(spark, sf):
    p = place(spark)
    g = event_groups(spark, sf).groupBy("cluster_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    S.csv_export(g, p, ["cluster_id", "sources"])
    return spark.read.schema("cluster_id string, sources string").option("header", True).csv(p)


@query(f"with {SQL_EV} select count(*) filter (where ts >= timestamp '2024-01-21') as kept, count(*) filter (where ts < timestamp '2024-01-21') as removed from ev")
def retention_prune(spark, sf):
    kept, removed = S.pruned(event_signals(spark, sf), as_of(), 10)
    a = kept.agg(F.count(F.lit(1)).alias("kept"))
    return a.join(F.broadcast(removed.agg(F.count(F.lit(1)).alias("removed"))), F.lit(True))


@query(f"with {SQL_EV} select 'current' as part, count(*) as n from ev where ts >= timestamp '2024-01-16' union all select 'archive', count(*) from ev where ts < timestamp '2024-01-16'")
def archive_split(spark, sf):
    p = place(spark)
    S.split_archive(event_signals(spark, sf), as_of(), f"{p}/current", f"{p}/archive", 15)
    n = lambda part: spark.read.parquet(f"{p}/{part}").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return n("current").unionByName(n("archive"))
