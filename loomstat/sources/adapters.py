"""The driver's tables as signals, groups, vectors and votes.

A region code is derived from a key modulo 17; no person key is ever projected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The region dimension, made by rule: 17 codes of five digits on a lattice some 5 km wide, in five groups named after the driver's regions.
GROUPS = ("africa", "america", "asia", "europe", "middle_east")
REGIONS = [(f"{1101 + 37 * k:05d}", round(10.0 + 0.045 * (k % 4) + 0.003 * k, 4), round(20.0 + 0.05 * (k // 4) + 0.002 * k, 4), GROUPS[k * 5 // 17]) for k in range(17)]
AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, lat double, lon double, grp string")


def region_code(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r[0]) for r in REGIONS]), (F.pmod(key, F.lit(17)) + 1).cast("int"))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, ts, source, region, weight) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), region_code(F.col("user_id")).alias("region"), F.col("value").alias("weight")
    )


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, text, source, language, ts, region) from documents."""
    d = table(spark, sf_dir, "documents")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.pmod("doc_id", F.lit(720)) * 3600)
    return d.select(F.col("doc_id").alias("signal_id"), "text", "source", F.col("lang").alias("language"), ts.alias("ts"), region_code(F.col("doc_id")).alias("region"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, region, lat, lon): suppliers as points, spread by their key over the area of the regions; their region by nation."""
    k = F.col("s_suppkey")
    lat = 9.98 + 0.24 * F.pmod(k * 7919, F.lit(10007)) / 10007
    lon = 19.98 + 0.26 * F.pmod(k * 104729, F.lit(10009)) / 10009
    return table(spark, sf_dir, "supplier").select(k.alias("site"), region_code(F.col("s_nationkey")).alias("region"), lat.alias("lat"), lon.alias("lon"))


#: Where the regions' coordinates lie: south, north, west, east.
BOX = (9.9, 10.3, 19.9, 20.4)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, date, zip, lat, lon, intensity, source_type, trend, source, summary) from events, with faults in some fields by rules on the event's id."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), region_code(F.col("user_id")).alias("region"), F.col("value").alias("value"))
    e = e.join(F.broadcast(regions(spark).select("region", "lat", "lon")), "region", "left")
    every = lambda n: F.col("record_id") % n == 0
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        "record_id",
        F.when(every(97), None).when(every(89), "no date").when(every(83), "2031-01-01").when(every(79), "2019-05-05").otherwise(day).alias("date"),
        F.when(every(71), None).when(every(67), "12").when(every(61), "99999").otherwise(F.col("region")).alias("zip"),
        F.when(every(59), F.col("lat") + 30).when(every(57), None).otherwise(F.col("lat")).alias("lat"), "lon",
        F.when(every(53), None).otherwise(F.col("value") / 10).alias("intensity"),
        pick(("news", "Community", "official", "verified", "rumour", None), F.col("record_id")).alias("source_type"),
        pick(("increasing", "stable", "Decreasing", None, "sideways"), F.col("record_id")).alias("trend"),
        F.when(every(47), "").otherwise(F.col("source")).alias("source"),
        F.concat_ws(" ", "source", F.date_format("ts", "HH")).alias("summary"),
    )


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, entity, kind) from the tables: regions and nations, aliases of nations (region's name and nation's number), and products."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda df, name, entity, kind: df.select(name.alias("name"), F.col(entity).alias("entity"), F.lit(kind).alias("kind"))
    out = one(r, F.col("r_name"), "r_name", "PLACE").unionByName(one(n, F.col("n_name"), "n_name", "PLACE"))
    out = out.unionByName(one(nations, F.concat_ws(" ", "r_name", "n_nationkey"), "n_name", "PLACE"))
    return out.unionByName(one(table(spark, sf_dir, "part").select("p_name").distinct(), F.col("p_name"), "p_name", "PRODUCT"))


def place_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, text): all documents, and a note for each order: its customer's nation (every third one by its alias), region and product, as far as they are known."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    o = o.join(table(spark, sf_dir, "part"), F.col("o_custkey") == F.col("p_partkey"), "left")
    place = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(" ", "r_name", "n_nationkey")).otherwise(F.concat_ws(", ", "n_name", "r_name"))
    note = F.concat(F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" from "), place, F.lit(": "), F.coalesce("p_name", F.lit("nothing")), F.lit("."))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    return d.unionByName(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("text_id"), note.alias("text")))


def group_id(region: Column, ts: Column) -> Column:
    """The group of a region's day, as a number: region's place times 100000 plus days since 1970."""
    place = F.array_position(F.array(*[F.lit(r[0]) for r in REGIONS]), region) - 1
    return (place * 100_000 + F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01")))).cast("long")


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with the group of their region and day."""
    return event_signals(spark, sf_dir).withColumn("cluster_id", group_id(F.col("region"), F.col("ts")))


def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, cluster_id, embedding, ts, region): vectors with their label as group and the text signal's time."""
    v = table(spark, sf_dir, "embeddings")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.pmod("vec_id", F.lit(720)) * 3600)
    return v.select(F.col("vec_id").alias("signal_id"), F.col("label").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("embedding"), ts.alias("ts"), region_code(F.col("vec_id")).alias("region"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, statement, vote, seq): synthetic votes from conversations."""
    c = table(spark, sf_dir, "conversations")
    vote = F.element_at(F.array(F.lit("agree"), F.lit("disagree"), F.lit("pass")), (F.pmod(F.length("text"), F.lit(3)) + 1).cast("int"))
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("statement"), vote.alias("vote"), F.length("text").alias("seq"))


# The same adapters in DuckDB's SQL, as common table expressions.
_CODES = "[" + ", ".join(f"'{r[0]}'" for r in REGIONS) + "]"
SQL_REGIONS = "regions as (select * from (values " + ", ".join(f"('{r}', {a}::double, {b}::double, '{g}')" for r, a, b, g in REGIONS) + ") as t(region, lat, lon, grp))"
SQL_EV = f"ev as (select event_id as signal_id, ts::timestamp as ts, event_type as source, ({_CODES})[(user_id % 17 + 1)::int] as region, value as weight from events)"
SQL_GEV = f"gev as (select *, (list_position({_CODES}, region) - 1) * 100000 + date_diff('day', date '1970-01-01', ts::date) as cluster_id from ev)"
SQL_DOC = f"doc as (select doc_id as signal_id, text, source, lang as language, timestamp '2024-01-01' + to_hours((doc_id % 720)::int) as ts, ({_CODES})[(doc_id % 17 + 1)::int] as region from documents)"
SQL_VEC = f"vec as (select vec_id as signal_id, label as cluster_id, embedding::double[] as embedding, timestamp '2024-01-01' + to_hours((vec_id % 720)::int) as ts, ({_CODES})[(vec_id % 17 + 1)::int] as region from embeddings)"
SQL_SITES = f"sites as (select s_suppkey as site, ({_CODES})[(s_nationkey % 17 + 1)::int] as region, 9.98 + 0.24 * (s_suppkey * 7919 % 10007) / 10007.0 as lat, 19.98 + 0.26 * (s_suppkey * 104729 % 10009) / 10009.0 as lon from supplier)"
SQL_RECORDS = f"""{SQL_REGIONS}, {SQL_EV}, rec as (select signal_id as record_id, case when signal_id % 97 = 0 then null when signal_id % 89 = 0 then 'no date' when signal_id % 83 = 0 then '2031-01-01' when signal_id % 79 = 0 then '2019-05-05' else strftime(ts, '%Y-%m-%d') end as date,
case when signal_id % 71 = 0 then null when signal_id % 67 = 0 then '12' when signal_id % 61 = 0 then '99999' else region end as zip, case when signal_id % 59 = 0 then lat + 30 when signal_id % 57 = 0 then null else lat end as lat, lon,
case when signal_id % 53 = 0 then null else weight / 10 end as intensity, (['news', 'Community', 'official', 'verified', 'rumour', null])[(signal_id % 6 + 1)::int] as source_type, (['increasing', 'stable', 'Decreasing', null, 'sideways'])[(signal_id % 5 + 1)::int] as trend,
case when signal_id % 47 = 0 then '' else source end as source, source || ' ' || strftime(ts, '%H') as summary from ev left join regions using (region)),
jr as (select *, try_cast(date as date) as day, count(*) over (partition by date, zip, summary) as copies, avg(intensity) over () as m, stddev_pop(intensity) over () as sd, (select count(distinct zip) from rec) as nz from rec),
jd as (select *, concat_ws(',', case when date is null then 'temporal.dateExists' end, case when day is null then 'temporal.dateValid' end, case when zip is null or zip = '' then 'spatial.zipExists' end,
 case when not coalesce(regexp_full_match(zip, '[0-9]{{5}}'), false) then 'spatial.zipFormat' end, case when coalesce(date, '') = '' or coalesce(zip, '') = '' then 'integrity.hasRequiredFields' end) as errors,
 concat_ws(',', case when day is null or day > date '2024-01-31' then 'temporal.dateNotFuture' end, case when day is null or day > date '2024-01-31' or day < date '2020-01-01' then 'temporal.dateWithinRange' end,
 case when zip is null or zip not in (select region from regions) then 'spatial.zipInRegion' end, case when coalesce(lat, 0) <> 0 and coalesce(lon, 0) <> 0 and not (lat between {BOX[0]} and {BOX[1]} and lon between {BOX[2]} and {BOX[3]}) then 'spatial.coordinatesValid' end,
 case when intensity not between 0 and 10 then 'logical.intensityRange' end, case when source_type <> '' and lower(source_type) not in ('news', 'community', 'official', 'verified') then 'logical.sourceTypeValid' end,
 case when trend <> '' and lower(trend) not in ('increasing', 'decreasing', 'stable') then 'logical.trendLogical' end, case when abs(intensity - m) / sd >= 3 then 'statistical.noOutliers' end, case when nz <= 1 then 'statistical.distributionNormal' end,
 case when copies > 1 then 'integrity.noDuplicates' end, case when source is null or source = '' then 'integrity.sourceExists' end) as warnings from jr)"""
SQL_NAMES = """names as (select r_name as name, r_name as entity, 'PLACE' as kind from region union all select n_name, n_name, 'PLACE' from nation
union all select r_name || ' ' || n_nationkey, n_name, 'PLACE' from nation join region on n_regionkey = r_regionkey union all select distinct p_name, p_name, 'PRODUCT' from part),
notes as (select 'd' || doc_id as text_id, text from documents union all select 'o' || o_orderkey, 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ' from ' || case when o_orderkey % 3 = 0 then r_name || ' ' || n_nationkey else n_name || ', ' || r_name end || ': ' || coalesce(p_name, 'nothing') || '.'
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join part on o_custkey = p_partkey)"""
# All names of the texts, one after the other: of those that begin after the last one, the first, and of these the longest.
SQL_MATCHES = rf"""{SQL_NAMES}, nw as (select w, min((entity, kind)) as e from (select regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}]+') as w, entity, kind from names) where len(w) between 1 and 8 group by w),
tw as (select text_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as t from notes), tp as (select text_id, t, unnest(range(len(t))) as s from tw),
cand as materialized (select text_id, s, len(w) as n, e[1] as entity, e[2] as kind from tp join nw on t[s + 1] = w[1] and t[s + 1:s + len(w)] = w),
hit(text_id, s, n, entity, kind) as (select * from (select * from cand qualify row_number() over (partition by text_id order by s, n desc) = 1)
 union all select * from (select c.* from cand c join hit h on c.text_id = h.text_id and c.s >= h.s + h.n qualify row_number() over (partition by c.text_id order by c.s, c.n desc) = 1))"""
SQL_VOTES = "votes as (select conv_id as session, turn as statement, (['agree', 'disagree', 'pass'])[(length(text) % 3 + 1)::int] as vote, length(text) as seq from conversations)"


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("loomstat_rank", F.row_number().over(w)).where("loomstat_rank = 1").drop("loomstat_rank")
