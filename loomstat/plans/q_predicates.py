"""Queries of the predicate engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predicates as P
from ..sources.adapters import AS_OF, SQL_EV, SQL_GEV, SQL_REGIONS, event_groups, event_signals, regions, table
from .base import query

_CASES = [
    ("equals", "o_orderstatus", "F", "o_orderstatus = 'F'"),
    ("not_equals", "o_orderstatus", "F", "o_orderstatus is distinct from 'F'"),
    ("contains", "o_orderpriority", "urg", "contains(lower(o_orderpriority), 'urg')"),
    ("not_contains", "o_orderpriority", "urg", "not contains(lower(o_orderpriority), 'urg')"),
    ("starts_with", "o_orderpriority", "1", "starts_with(lower(o_orderpriority), '1')"),
    ("ends_with", "o_orderpriority", "HIGH", "ends_with(lower(o_orderpriority), 'high')"),
    ("in", "o_orderstatus", ["F", "P"], "o_orderstatus in ('F', 'P')"),
    ("not_in", "o_orderstatus", ["F", "P"], "o_orderstatus not in ('F', 'P')"),
    (">", "o_totalprice", 200000.0, "o_totalprice > 200000"),
    ("<", "o_totalprice", 50000.0, "o_totalprice < 50000"),
    (">=", "o_totalprice", 200000.0, "o_totalprice >= 200000"),
    ("<=", "o_totalprice", 50000.0, "o_totalprice <= 50000"),
    ("between", "o_orderdate", ["1994-01-01", "1994-12-31"], "o_orderdate between timestamp '1994-01-01' and timestamp '1994-12-31'"),
    ("exists", "o_orderdate", None, "o_orderdate is not null"),
    ("not_exists", "o_orderdate", None, "o_orderdate is null"),
]


@query("select " + ", ".join(f"count(*) filter (where {sql}) as op_{k}" for k, (_, _, _, sql) in enumerate(_CASES)) + " from orders")
def filter_op(spark, sf):
    o = table(spark, sf, "orders")
    return o.agg(*[F.count_if(P.condition({"field": f, "operator": op, "value": v})).alias(f"op_{k}") for k, (op, f, v, _) in enumerate(_CASES)])


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 150000")
def filter_conjunction(spark, sf):
    specs = [{"field": "o_orderstatus", "operator": "equals", "value": "F"}, {"field": "o_totalprice", "operator": ">", "value": 150000.0}]
    return table(spark, sf, "orders").where(P.conjunction(specs)).select("o_orderkey")


@query("select o_orderkey from orders where (o_orderstatus = 'F' or o_orderstatus = 'P') and (o_totalprice < 20000 or contains(lower(o_orderpriority), 'high'))")
def filter_tree(spark, sf):
    eq = lambda v: {"field": "o_orderstatus", "operator": "equals", "value": v}
    spec = {
        "logic": "AND",
        "rules": [
            {"logic": "OR", "rules": [eq("F"), eq("P")]},
            {"logic": "OR", "rules": [{"field": "o_totalprice", "operator": "<", "value": 20000.0}, {"field": "o_orderpriority", "operator": "contains", "value": "HIGH"}]},
        ],
    }
    return table(spark, sf, "orders").where(P.tree(spec)).select("o_orderkey")


@query("select event_id from events where (props::json->>'k')::bigint >= 50")
def filter_nested_path(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.where(P.condition({"field": "p.k", "operator": ">=", "value": 50})).select("event_id")


@query("select doc_id from documents where regexp_matches(concat_ws(' ', source, text), '(?i)(license|src3)')")
def filter_keywords(spark, sf):
    return table(spark, sf, "documents").where(P.keywords(["source", "text"], ["license", "src3"])).select("doc_id")


@query(f"with {SQL_EV}, {SQL_REGIONS} select signal_id, region from ev where region in (select region from regions where grp = 'asia')")
def filter_region_group(spark, sf):
    r = regions(spark).where("grp = 'asia'").select("region")
    return event_signals(spark, sf).join(r, "region", "left_semi").select("signal_id", "region")


@query(f"""with {SQL_EV}, {SQL_GEV}, g as (select cluster_id, any_value(region) as region, sum(weight) as strength, min(ts) as ts, list(distinct source) as sources from gev group by 1)
select cluster_id from g where region in ('01101', '01249') and strength >= 100 and ts >= timestamp '2024-01-05' and list_contains(sources, 'click')""")
def filter_named(spark, sf):
    g = event_groups(spark, sf).groupBy("cluster_id").agg(F.any_value("region").alias("region"), F.sum("weight").alias("strength"), F.min("ts").alias("ts"), F.collect_set("source").alias("sources"))
    return g.where(P.named(["01101", "01249"], (100.0, None), ("2024-01-05", None), ["click"])).select("cluster_id")


@query(f"""with {SQL_EV} select count(*) filter (where ts >= timestamp '{AS_OF}' - interval 1 day) as recent_24h, count(*) filter (where ts >= timestamp '{AS_OF}' - interval 7 day) as recent_7d,
count(*) filter (where ts >= timestamp '{AS_OF}' - interval 30 day) as recent_30d, count(*) filter (where weight >= 75) as high_intensity, count(*) filter (where weight < 25) as low_intensity,
count(*) filter (where dayofweek(ts) in (0, 6)) as weekend from ev""")
def filter_presets(spark, sf):
    names = ["recent_24h", "recent_7d", "recent_30d", "high_intensity", "low_intensity", "weekend"]
    return event_signals(spark, sf).agg(*[F.count_if(P.preset(n, AS_OF)).alias(n) for n in names])


@query("select o_orderkey from orders where (o_orderkey % 7) * o_totalprice > 900000")
def filter_custom_udf(spark, sf):
    return table(spark, sf, "orders").where(P.condition(lambda: (F.col("o_orderkey") % 7) * F.col("o_totalprice") > 900000)).select("o_orderkey")


@query("select distinct source from documents where source is not null")
def distinct_values(spark, sf):
    return P.distinct_values(table(spark, sf, "documents"), "source")


@query(f"with {SQL_EV} select coalesce(region, 'Unknown') as key, count(*) as n, max(signal_id) as last_id from ev group by 1")
def group_rows(spark, sf):
    return event_signals(spark, sf).groupBy(F.coalesce("region", F.lit("Unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("signal_id").alias("last_id"))


@query(f"with {SQL_EV}, {SQL_GEV} select cluster_id, count(*) as n from gev group by 1 having min(ts) <= timestamp '2024-01-15'")
def as_of_cut(spark, sf):
    g = event_groups(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"))
    return g.where("start <= timestamp'2024-01-15 00:00:00'").select("cluster_id", "n")


@query(f"""with {SQL_EV}, {SQL_GEV}, g as (select cluster_id, any_value(region) as region, count(*) as n, avg(weight) as q from gev group by 1)
select cluster_id, region, n, case when q >= 70 then 'HIGH' when q >= 50 then 'MEDIUM' else 'LOW' end as band from g where n >= 5 and q >= 50""")
def facet_export_filter(spark, sf):
    g = event_groups(spark, sf).groupBy("cluster_id").agg(F.any_value("region").alias("region"), F.count(F.lit(1)).alias("n"), F.avg("weight").alias("q"))
    band = F.when(F.col("q") >= 70, "HIGH").when(F.col("q") >= 50, "MEDIUM").otherwise("LOW")
    return g.where("n >= 5 and q >= 50").select("cluster_id", "region", "n", band.alias("band"))


@query(f"with {SQL_EV}, {SQL_GEV} select distinct cluster_id, region from gev where cluster_id = 319723")
def lookup_by_tracking_id(spark, sf):
    wanted = F.regexp_extract(F.lit("REG-CLU-319723"), r"CLU-0*([0-9]+)$", 1).cast("long")
    return event_groups(spark, sf).where(F.col("cluster_id") == wanted).select("cluster_id", "region").distinct()


@query(f"with {SQL_REGIONS} select 'document' as kind, doc_id::varchar as id from documents where contains(lower(text), 'token') union all select 'region', region from regions where contains(region, '086')")
def substring_search(spark, sf):
    d = table(spark, sf, "documents").where(F.lower("text").contains("token")).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    return d.unionByName(regions(spark).where(F.col("region").contains("086")).select(F.lit("region").alias("kind"), F.col("region").alias("id")))
