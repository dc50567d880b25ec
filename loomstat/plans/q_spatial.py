"""Queries on region-level spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bearing as bearing_deg
from ..functions.columns import cases, haversine_km
from ..operators import spatial as P
from ..operators.aggregate import with_totals
from ..sources.adapters import SQL_EV, SQL_REGIONS, SQL_SITES, event_signals, regions, sites, table
from .base import query
from .q_joins import _KM

_W = f"with {SQL_EV}, {SQL_REGIONS}"
_BEAR = "atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))"
_DEG = f"(degrees({_BEAR}) + 360 - 360 * floor((degrees({_BEAR}) + 360) / 360))"


def _weights(spark, sf):
    """Regions with the total weight of their signals that are at least a day old."""
    w = event_signals(spark, sf).where("ts <= timestamp'2024-01-30 00:00:00'").groupBy("region").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    return regions(spark).join(w, "region")


_WT = "wt as (select region, lat, lon, grp, w, n from regions join (select region, sum(weight) as w, count(*) as n from ev where ts <= timestamp '2024-01-30' group by 1) using (region))"


_SR = f"with {SQL_SITES}, {SQL_REGIONS}"


def _at_region(spark, sf):
    """Sites with the centroid of their region."""
    r = regions(spark).select("region", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    return sites(spark, sf).join(r, "region")


@query(f"{_SR} select b.site, b.region, round({_KM}, 6) as km from sites b join regions a using (region)")
def haversine(spark, sf):
    km = haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return _at_region(spark, sf).select("site", "region", F.round(km, 6).alias("km"))


@query(f"{_SR} select b.site, b.region, round({_DEG}, 5) as bearing from sites b join regions a using (region)")
def bearing(spark, sf):
    return _at_region(spark, sf).select("site", "region", F.round(bearing_deg(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 5).alias("bearing"))


@query(f"{_W}, {_WT}, p as (select a.region as a, b.region as b, {_KM} as km, {_DEG} as bearing, a.n + b.n as n from wt a join wt b on a.region <> b.region) select a, b, round(km, 6) as km, round(1 / km, 6) as weight, round(bearing, 5) as bearing, n from p where km between 0.01 and 12")
def adjacency_graph(spark, sf):
    """Edges between regions with released signals, and how many these have."""
    w = _weights(spark, sf)
    n = lambda c: w.select(F.col("region").alias(c), F.col("n").alias(f"n_{c}"))
    e = P.adjacency(w, 0.01, 12.0).join(n("a"), "a").join(n("b"), "b")
    return e.select("a", "b", F.round("km", 6).alias("km"), F.round("weight", 6).alias("weight"), F.round("bearing", 5).alias("bearing"), (F.col("n_a") + F.col("n_b")).alias("n"))


@query(f"""with recursive {SQL_SITES}, p as (select a.site as a, b.site as b from sites a join sites b on a.site <> b.site and b.lat between a.lat - 0.03 and a.lat + 0.03 where {_KM} <= 2.6),
core as (select a as site from p group by 1 having count(*) >= 2), r(a, c) as (select site, site from core union select p.a, r.c from p join r on r.a = p.b where p.a in (select site from core)), g as (select a, min(c) as c from r group by 1),
e as (select p.a, min(g.c) as c from p join g on g.a = p.b group by 1) select site, coalesce(g.c, e.c, -1) as grp from sites left join g on g.a = site left join e on e.a = site""")
def spatial_dbscan(spark, sf):
    p = sites(spark, sf).select(F.col("site").alias("id"), "lat", "lon")
    return P.dbscan(p, 2.6, 3).select(F.col("id").alias("site"), F.col("group").alias("grp"))


_GRID = "cells as (select i, j, 9.95 + 0.3 * i / 29 as y, 19.95 + 0.35 * j / 29 as x from (select unnest(range(0, 30)) as i) cross join (select unnest(range(0, 30)) as j))"


@query(f"{_W}, {_WT}, {_GRID}, k as (select i, j, sum(w * exp(-(pow(y - lat, 2) + pow(x - lon, 2)) / (2 * 0.05 * 0.05))) as k from cells cross join wt group by 1, 2) select i::int as i, j::int as j, round(k / (select max(k) from k), 6) as density from k")
def kde_grid(spark, sf):
    p = _weights(spark, sf).select("lat", "lon", F.col("w").alias("weight"))
    return P.kde_grid(p, 30, 0.05, (9.95, 10.25, 19.95, 20.3)).withColumn("density", F.round("density", 6))


@query(f"""with {SQL_SITES}, p as (select lat, lon, s_acctbal as w from sites join supplier on s_suppkey = site where s_acctbal > 0), m as (select sum(w) as sw, sum(w * w) as w2, sum(w * lat) / sum(w) as my, sum(w * lon) / sum(w) as mx, min(lat) as s0, max(lat) as n0, min(lon) as w0, max(lon) as e0 from p),
c as (select sum(w * (lat - my) * (lat - my)) as yy, sum(w * (lat - my) * (lon - mx)) as yx, sum(w * (lon - mx) * (lon - mx)) as xx from p, m), h as (select pow(w2 / (sw * sw), 1.0 / 3) / (sw * (1 - w2 / (sw * sw))) as f from m),
g as (select yy * f as yy, yx * f as yx, xx * f as xx, s0 - 1000 / 110574.0 as s, n0 + 1000 / 110574.0 as n, w0 - 1000 / (111320.0 * cos(radians(my))) as w, e0 + 1000 / (111320.0 * cos(radians(my))) as e from c, h, m),
cells as (select i, j, s + (n - s) * i / 39 as y, w + (e - w) * j / 39 as x from g, (select unnest(range(40)) as i), (select unnest(range(40)) as j)),
k as (select i, j, sum(p.w * exp(-(xx * (y - lat) * (y - lat) - 2 * yx * (y - lat) * (x - lon) + yy * (x - lon) * (x - lon)) / (2 * (yy * xx - yx * yx)))) as k from cells, p, g group by 1, 2),
d as (select i, j, k / (select max(k) from k) as density from k) select i::int as i, j::int as j, round(density, 4) as density,
array_to_string(list_transform([[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]], lambda a: round(w + (j + a[2]) * (e - w) / 40, 4)::decimal(9, 4) || ' ' || round(s + (i + a[1]) * (n - s) / 40, 4)::decimal(9, 4)), ',') as ring from d, g where density >= 0.01 and i < 39 and j < 39""")
def kde_cells(spark, sf):
    """Dense cells of sites weighted by their balance, with closed outlines."""
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("weight"))
    got = P.kde_cells(sites(spark, sf).join(b, "site").select("lat", "lon", "weight"), 40)
    text = lambda v: F.round(v, 4).cast("decimal(9,4)").cast("string")
    ring = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", text(p[0]), text(p[1]))), ",")
    return got.select("i", "j", F.round("density", 4).alias("density"), ring.alias("ring"))


@query(f"""{_W}, {_WT}, nb as (select a.region, sum(b.w) as s, count(*) as k from wt a join wt b on {_KM} <= 10 or a.region = b.region group by 1), st as (select avg(w) as m, stddev_pop(w) as sd, count(*) as n from wt),
z as (select region, (s - m * k) / (sd * sqrt((n * k - k * k) / (n - 1))) as z from nb, st where k < n) select region, round(z, 6) as z from z""")
def getis_ord(spark, sf):
    w = _weights(spark, sf).select(F.col("region").alias("id"), "lat", "lon", "w")
    return P.getis_ord(w, 10.0).select(F.col("id").alias("region"), F.round("z", 6).alias("z"))


@query(f"{_W}, {_WT}, d as (select b.n, {_KM} as km from wt a cross join wt b where a.region = '01582'), r as (select least(floor(km / 5), 5)::int as ring, n from d) select ring, sum(n)::bigint as n, round(sum(n) / (pi() * 25 * ((ring + 1) * (ring + 1) - ring * ring)), 6) as density from r where ring < 5 group by 1")
def ring_density(spark, sf):
    w = _weights(spark, sf)
    c = w.where("region = '01582'").select(F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    d = w.join(F.broadcast(c), F.lit(True)).select("n", F.floor(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")) / 5).cast("int").alias("ring"))
    r = F.col("ring")
    return d.where("ring < 5").groupBy("ring").agg(F.sum("n").alias("n")).select("ring", "n", F.round(F.col("n") / (F.pi() * 25 * ((r + 1) * (r + 1) - r * r)), 6).alias("density"))


@query(f"{_W}, {_WT}, p as (select region, unnest(range(0, 9)) as k, lat, lon, sqrt(n / (select max(n) from wt)) * 2.0 as km from wt) select region, k::int as k, round(lon + km / (111.32 * cos(radians(lat))) * cos(2 * pi() * (k % 8) / 8), 6) as x, round(lat + km / 110.574 * sin(2 * pi() * (k % 8) / 8), 6) as y from p")
def circle_polygon(spark, sf):
    """Circles around regions, of areas in proportion to their signals."""
    w = with_totals(_weights(spark, sf), F.max("n").alias("top"))
    km = F.sqrt(F.col("n") / F.col("top")) * 2.0
    r = w.select("region", F.posexplode(P.circle(F.col("lat"), F.col("lon"), km, 8)).alias("k", "p"))
    return r.select("region", "k", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


_SHIFT = f"""{_W}, d as (select ts::date as d, region, count(*) as n from ev where ts <= timestamp '2024-01-30' group by 1, 2 having count(*) >= 3 and count(distinct source) >= 2), c as (select d, sum(n * lat) / sum(n) as lat, sum(n * lon) / sum(n) as lon, sum(n) as n from d join regions using (region) group by 1),
a as (select d, n, lat, lon, lag(lat) over (order by d) as lat0, lag(lon) over (order by d) as lon0 from c)"""


@query(f"{_SHIFT} select strftime(a.d, '%Y-%m-%d') as day, round({_KM}, 5) as km, case when {_KM} is null or {_KM} < 0.5 then 'stationary' when {_KM} < 2 then 'drifting' else 'moving' end as pattern from a join (select d, lat0 as lat, lon0 as lon from a) b using (d)")
def window_centroid_shift(spark, sf):
    e = event_signals(spark, sf).where("ts <= timestamp'2024-01-30 00:00:00'")
    d = e.groupBy(F.to_date("ts").alias("d"), "region").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s")).where("n >= 3 and s >= 2")
    n = F.col("n")
    c = d.join(regions(spark), "region").groupBy("d").agg((F.sum(n * F.col("lat")) / F.sum(n)).alias("lat"), (F.sum(n * F.col("lon")) / F.sum(n)).alias("lon"))
    w = Window.partitionBy(F.lit(0)).orderBy("d")  # one row per day
    km = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    c = c.withColumn("km", km)
    return c.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.round("km", 5).alias("km"), cases([(F.col("km").isNull() | (F.col("km") < 0.5), "stationary"), (F.col("km") < 2, "drifting")], "moving").alias("pattern"))


_FIRST = f"""{_W}, gate as (select source, region, ts::date as d from ev where ts <= timestamp '2024-01-30' group by all having count(*) >= 3), fa as (select source, region, min(d) as first_day from gate group by 1, 2)"""


def _first(spark, sf):
    e = event_signals(spark, sf).where("ts <= timestamp'2024-01-30 00:00:00'")
    gate = e.groupBy("source", "region", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return gate.groupBy("source", "region").agg(F.min("d").alias("first_day"))


@query(f"{_FIRST} select source, region, strftime(first_day, '%Y-%m-%d') as first_day from fa")
def first_appearance(spark, sf):
    return _first(spark, sf).withColumn("first_day", F.date_format("first_day", "yyyy-MM-dd"))


@query(f"""{_FIRST}, o as (select source, fa.region, first_day, lat, lon, lead(fa.region) over w as to_region, lead(first_day) over w as to_day, lead(lat) over w as lat2, lead(lon) over w as lon2 from fa join regions using (region) window w as (partition by source order by first_day, fa.region)),
v as (select a.source, a.region, a.to_region, date_diff('day', a.first_day, a.to_day) as lag_days, {_KM.replace('b.lat', 'a.lat2').replace('b.lon', 'a.lon2')} as km, {_DEG.replace('b.lat', 'a.lat2').replace('b.lon', 'a.lon2')} as bearing from o a where a.to_day > a.first_day)
select source, region, to_region, lag_days, round(km, 6) as km, round(km / (24 * lag_days), 6) as km_per_hour, round(bearing, 5) as bearing, round(count(*) over (partition by region, to_region) / count(*) over (partition by region), 6) as edge_share from v""")
def spread_vectors(spark, sf):
    """Steps from a topic's region of first appearance to the next one's: distance, days, speed, bearing, and the share of all steps from this region that go there. Topics and regions, not rows."""
    w = Window.partitionBy("source").orderBy("first_day", "region")
    o = _first(spark, sf).join(regions(spark), "region")
    o = o.select("source", "region", "first_day", "lat", "lon", F.lead("region").over(w).alias("to_region"), F.lead("first_day").over(w).alias("to_day"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    c = [F.col(x) for x in ("lat", "lon", "lat2", "lon2")]
    v = o.where("to_day > first_day").withColumn("lag_days", F.datediff("to_day", "first_day").cast("long")).withColumn("km", haversine_km(*c)).withColumn("bearing", bearing_deg(*c))
    n = F.count(F.lit(1))
    share = n.over(Window.partitionBy("region", "to_region")) / n.over(Window.partitionBy("region"))
    return v.select("source", "region", "to_region", "lag_days", F.round("km", 6).alias("km"), F.round(F.col("km") / (24 * F.col("lag_days")), 6).alias("km_per_hour"), F.round("bearing", 5).alias("bearing"), F.round(share, 6).alias("edge_share"))


@query(f"""{_W}, p as (select source, region, lat, lon, count(*) as n from ev join regions using (region) group by all), c as (select source, sum(n * lat) / sum(n) as lat, sum(n * lon) / sum(n) as lon from p group by 1), d as (select a.source, {_KM} as km from p a join c b using (source))
select source, round(avg(km), 5) as mean_km, round(max(km), 5) as max_km, case when avg(km) < 3 then 'concentrated' when avg(km) < 7 then 'moderate' else 'dispersed' end as spread from d group by 1""")
def spread_metrics(spark, sf):
    p = event_signals(spark, sf).groupBy("source", "region").agg(F.count(F.lit(1)).alias("n")).join(regions(spark), "region")
    n = F.col("n")
    c = p.groupBy("source").agg((F.sum(n * F.col("lat")) / F.sum(n)).alias("lat1"), (F.sum(n * F.col("lon")) / F.sum(n)).alias("lon1"))
    d = p.join(c, "source").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")))
    m = F.avg("km")
    return d.groupBy("source").agg(F.round(m, 5).alias("mean_km"), F.round(F.max("km"), 5).alias("max_km"), cases([(m < 3, "concentrated"), (m < 7, "moderate")], "dispersed").alias("spread"))


@query(f"{_W}, {_WT}, s as (select region, lat, lon, 100 * (w - min(w) over ()) / (max(w) over () - min(w) over ()) as v from wt) select region, round(v, 6) as index, round(lon + 1.5 / (111.32 * cos(radians(lat))), 6) as east, round(lat + 1.5 / 110.574, 6) as north from s")
def vulnerability_layer(spark, sf):
    from ..operators.scores import min_max

    v = min_max(_weights(spark, sf).select("region", "lat", "lon", "w"), ["w"])
    ring = P.circle(F.col("lat"), F.col("lon"), 1.5, 4)
    v = v.select("region", (100 * F.col("w")).alias("v"), ring.alias("ring"))
    return v.select("region", F.round("v", 6).alias("index"), F.round(F.col("ring")[0][0], 6).alias("east"), F.round(F.col("ring")[1][1], 6).alias("north"))
