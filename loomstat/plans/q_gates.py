"""Queries on gates, tiers and governance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cases, hours_before
from ..operators import gates as G
from ..operators import normalize as N
from ..operators import scores as S
from ..operators import windows as W
from ..operators.limits import PROHIBITED, TIERS, Limits
from ..sources.adapters import SQL_DOC, SQL_EV, SQL_GEV, SQL_REGIONS, as_of, event_groups, event_signals, regions, table, text_signals
from .base import query
from .q_aggregate import _CS, clusters, state

_NOW = "timestamp '2024-01-31'"
_W = f"with {SQL_EV}, {SQL_GEV}, {_CS}"


def _pass(hours=24, size=3):
    return f"size >= {size} and n_sources >= 2 and last_ts <= {_NOW} - interval {hours} hour and volume >= 1"


def _gated(spark, sf, tier=1):
    return G.release(clusters(spark, sf), TIERS[tier], as_of())


@query(f"{_W}, r as (select region, least(avg(volume) / 1000, 1) as s, least(sum(size) / 500, 1) as c, count(*) as n_groups, max((epoch_us({_NOW}) - epoch_us(last_ts)) / 3.6e9) as age from cs where {_pass()} group by 1) select region, n_groups, round(s, 4) as score, round(c, 4) as confidence, case when s * c >= 0.75 then 'HIGH_ATTENTION' when s * c >= 0.5 then 'ELEVATED_ATTENTION' when s * c >= 0.25 then 'MODERATE' else 'QUIET' end as state, 'Public attention only; not a statement about events or persons.' as disclaimer from r")
def gated_attention(spark, sf):
    r = _gated(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n_groups"), F.least(F.avg("volume") / 1000, F.lit(1.0)).alias("s"), F.least(F.sum("size") / 500, F.lit(1.0)).alias("c"))
    return r.select("region", "n_groups", F.round("s", 4).alias("score"), F.round("c", 4).alias("confidence"), state(F.col("s"), F.col("c")).alias("state"), F.lit("Public attention only; not a statement about events or persons.").alias("disclaimer"))


@query(f"{_W} select cluster_id, region, size, n_sources from cs where {_pass()}")
def release_gate(spark, sf):
    return _gated(spark, sf).select("cluster_id", "region", "size", "n_sources")


@query(f"{_W} select count(*) as n_in, count(*) filter (where {_pass()}) as n_out, count(*) filter (where size >= 3) as pass_size, count(*) filter (where n_sources >= 2) as pass_sources, count(*) filter (where last_ts <= {_NOW} - interval 24 hour) as pass_delay, count(*) filter (where volume >= 1) as pass_volume, 3 as min_size, 2 as min_sources, 24 as delay_hours from cs")
def gate_audit(spark, sf):
    return G.audit(clusters(spark, sf), TIERS[1], as_of())


@query(f"""{_W}, f as (select cluster_id, concat_ws(',', case when not size >= 3 then 'size' end, case when not n_sources >= 2 then 'sources' end, case when not last_ts <= {_NOW} - interval 24 hour then 'delay' end, case when not volume >= 1 then 'volume' end) as failed from cs where not ({_pass()}))
select cluster_id, failed, sha256(cluster_id || '|' || failed) as hash from f""")
def gate_reasons(spark, sf):
    """The gates that each group fails, and a hash of that."""
    r = clusters(spark, sf).select("cluster_id", F.array_join(G.failed(TIERS[1], as_of()), ",").alias("failed"))
    return r.where("failed <> ''").withColumn("hash", F.sha2(F.concat_ws("|", F.col("cluster_id").cast("string"), "failed"), 256))


@query("select 'customer' as t, 0 as n, count(*) as n_rows from customer union all select 'documents', 0, count(*) from documents union all select 'events', 1, count(*) from events union all select 'pages', 0, count(*) from pages")
def schema_identity_gate(spark, sf):
    """Prohibited columns of raw tables (events has a user key, which no adapter projects), and how many rows the gate covers; a row for each table, empty or not."""
    out = None
    for t in ("customer", "documents", "events", "pages"):
        df = table(spark, sf, t)
        one = df.agg(F.lit(t).alias("t"), F.lit(len(G.identity_fields(df.schema))).alias("n"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query(r"select doc_id from documents where regexp_matches(text, '[0-9]{2}\.[0-9]{4,},[ ]?-?[0-9]{2}\.[0-9]{4,}') or regexp_matches(text, '(?i)[0-9]{1,5} [a-z]+ (street|avenue|road|lane|drive)\b')")
def precision_gate(spark, sf):
    return table(spark, sf, "documents").where(G.precise(F.col("text"))).select("doc_id")


@query(f"with {SQL_EV} select 0 as tier, count(*) as n from ev where ts <= {_NOW} - interval 72 hour union all select 1, count(*) from ev where ts <= {_NOW} - interval 24 hour")
def delay_filter(spark, sf):
    e = event_signals(spark, sf)
    parts = [G.delayed(e, as_of(), TIERS[t].delay_hours).agg(F.lit(t).alias("tier"), F.count(F.lit(1)).alias("n")) for t in (0, 1)]
    return parts[0].unionByName(parts[1])


@query(f"{_W} select region, count(*) as n_groups, case when count(*) >= 10 then 'high' when count(*) >= 5 then 'medium' else 'low' end as level from cs where {_pass(72, 5)} group by 1")
def tier0_public(spark, sf):
    n = F.count(F.lit(1))
    return _gated(spark, sf, 0).groupBy("region").agg(n.alias("n_groups"), cases([(n >= 10, "high"), (n >= 5, "medium")], "low").alias("level"))


@query(f"{_W} select cluster_id, region, case when volume >= 500 then 'high' when volume >= 250 then 'medium' else 'low' end as level from cs where {_pass()}")
def tier1_contributor(spark, sf):
    return _gated(spark, sf).select("cluster_id", "region", cases([(F.col("volume") >= 500, "high"), (F.col("volume") >= 250, "medium")], "low").alias("level"))


def _scrub_sql(col):
    for p, m in N.SCRUB:
        col = f"regexp_replace({col}, '{p}', '{m}', 'g')"
    return col


@query(f"with {SQL_DOC} select signal_id, source, left({_scrub_sql('text')}, 200) as excerpt from doc order by ts desc, signal_id limit 100")
def tier2_moderation(spark, sf):
    d = text_signals(spark, sf).orderBy(F.desc("ts"), "signal_id").limit(100)
    return d.select("signal_id", "source", F.substring(N.scrub(F.col("text")), 1, 200).alias("excerpt"))


@query(f"{_W} select cluster_id, region, case when n_sources >= 3 then size else 0 end as size, case when n_sources >= 4 then n_sources else 0 end as n_sources from cs where {_pass()}")
def progressive_view(spark, sf):
    """Columns are shown from an engagement level on; here the level is the number of sources."""
    level = F.col("n_sources")
    return _gated(spark, sf).select("cluster_id", "region", F.when(level >= 3, F.col("size")).otherwise(0).alias("size"), F.when(level >= 4, F.col("n_sources")).otherwise(0).alias("n_sources"))


@query(f"with {SQL_EV}, {SQL_GEV}, {_CS}, d as (select cluster_id, size, ('0x' || substr(md5(concat_ws('|', '7', strftime(last_ts, '%Y-%m-%d'), region)), 1, 8))::bigint % 5 as pick from cs), t as (select cluster_id, size, greatest(3 + case when pick = 0 then -1 when pick = 4 then 1 else 0 end, 3)::int as threshold from d) select cluster_id, threshold, size >= threshold as passes from t")
def dynamic_threshold(spark, sf):
    c = clusters(spark, sf)
    t = G.dynamic_threshold(F.lit(3), 7, F.col("region"), F.to_date("last_ts"))
    return c.select("cluster_id", t.alias("threshold"), (F.col("size") >= t).alias("passes"))


_REG = f"""with {SQL_EV}, {SQL_GEV}, gp as (select cluster_id, source, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by cluster_id order by ts, signal_id)) / 6e7 as gap from gev), gs as (select cluster_id, count(*) as n, var_pop(gap) as v, avg(gap) as m from gp group by 1),
sh as (select cluster_id, max(c) / sum(c) as top from (select cluster_id, source, count(*) as c from gev group by 1, 2) group by 1), fl as (select cluster_id, n, top, n >= 5 and coalesce(v < 25 and m < 30, false) as regular, n >= 5 and top > 0.6 as one_source from gs join sh using (cluster_id))"""


@query(f"{_REG} select cluster_id, n, round(top, 6) as top_share, regular, one_source from fl")
def coordination_flags(spark, sf):
    r = G.regularity(event_groups(spark, sf), ["cluster_id"])
    return r.select("cluster_id", "n", F.round("top_share", 6).alias("top_share"), "regular", "one_source")


@query(f"with {SQL_EV}, {SQL_GEV}, k as (select cluster_id, count(*) over (partition by cluster_id order by epoch_us(ts) range between current row and 7199999999 following) as k from gev) select cluster_id, round(max(k) / count(*), 6) as share, max(k) / count(*) > 0.5 as concentrated from k group by 1")
def burst_concentration(spark, sf):
    c = G.concentration(event_groups(spark, sf), ["cluster_id"])
    return c.select("cluster_id", F.round("share", 6).alias("share"), (F.col("share") > 0.5).alias("concentrated"))


@query(f"with {SQL_EV}, {SQL_GEV} select cluster_id, round(max(c) / sum(c), 6) as top_share, max(c) / sum(c) > 0.7 as dominated from (select cluster_id, source, count(*) as c from gev group by 1, 2) group by 1")
def source_dominance(spark, sf):
    c = event_groups(spark, sf).groupBy("cluster_id", "source").agg(F.count(F.lit(1)).alias("c"))
    s = F.max("c") / F.sum("c")
    return c.groupBy("cluster_id").agg(F.round(s, 6).alias("top_share"), (s > 0.7).alias("dominated"))


@query(f"with {SQL_EV}, {SQL_REGIONS}, n as (select region, count(*) as n from ev where ts between timestamp '2024-01-29 22:00:00' and timestamp '2024-01-30' group by 1) select region, coalesce(n, 0) as n, case when n is null then 'no public attention recorded; silence is not safety or danger' else 'active' end as context from regions left join n using (region)")
def silence_context(spark, sf):
    n = event_signals(spark, sf).where("ts between timestamp'2024-01-29 22:00:00' and timestamp'2024-01-30 00:00:00'").groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    j = regions(spark).select("region").join(n, "region", "left")
    return j.select("region", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "no public attention recorded; silence is not safety or danger").otherwise("active").alias("context"))


_AREA = f"""ar as (select region, count(ev.signal_id) as n, count(distinct source) as s, (epoch_us({_NOW}) - epoch_us(max(ts))) / 3.6e9 as age, coalesce(avg(weight), 0) / 100 as score from regions left join (select * from ev where ts >= {_NOW} - interval 30 hour) ev using (region) group by 1)"""


@query(f"with {SQL_EV}, {SQL_REGIONS}, {_AREA} select region, n, case when n = 0 then 'silent' when n < 3 or s < 2 then 'insufficient' when age < 24 then 'delayed' when score < 0.25 then 'quiet' when score < 0.6 then 'active' else 'elevated' end as state from ar")
def area_state(spark, sf):
    e = event_signals(spark, sf).where(F.col("ts") >= as_of() - F.expr("interval 30 hours"))
    a = e.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s"), F.max("ts").alias("t"), (F.avg("weight") / 100).alias("score"))
    j = regions(spark).select("region").join(a, "region", "left")
    return j.select("region", F.coalesce("n", F.lit(0)).alias("n"), G.area_state(F.col("n"), F.col("s"), hours_before(as_of(), F.col("t")), F.col("score")).alias("state"))


def _states(spark, sf):
    e = event_signals(spark, sf).withColumn("day", F.to_date("ts"))
    a = e.groupBy("region", "day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s"), F.max("ts").alias("t"), (F.avg("weight") / 100).alias("score"))
    wanted = G.area_state(F.col("n"), F.col("s"), hours_before(as_of(), F.col("t")), F.col("score"))
    return G.state_machine(a.select("region", F.date_format("day", "yyyy-MM-dd").alias("day"), wanted.alias("wanted")))


_KEEPS = "[" + ", ".join(f"('{s}', '{w}')" for s in G.STATES for w in G.STATES if G.advance(s, w) != w) + "]"
_MACHINE = f"""with recursive {SQL_EV}, da as (select region, ts::date as day, count(*) as n, count(distinct source) as s, (epoch_us({_NOW}) - epoch_us(max(ts))) / 3.6e9 as age, avg(weight) / 100 as score from ev group by 1, 2),
wa as (select region, day, row_number() over (partition by region order by day) as k, case when n = 0 then 'silent' when n < 3 or s < 2 then 'insufficient' when age < 24 then 'delayed' when score < 0.25 then 'quiet' when score < 0.6 then 'active' else 'elevated' end as wanted from da),
m(region, k, day, wanted, before, state) as (select region, 0::bigint, null::date, null::varchar, null::varchar, 'silent' from (select distinct region from wa)
 union all select m.region, wa.k, wa.day, wa.wanted, m.state, case when list_contains({_KEEPS}, (m.state, wa.wanted)) then m.state else wa.wanted end from m join wa on wa.region = m.region and wa.k = m.k + 1)"""


@query(f"{_MACHINE} select region, strftime(day, '%Y-%m-%d') as day, wanted, state from m where k > 0")
def area_state_machine(spark, sf):
    """The state of each region on each day."""
    return _states(spark, sf).select("region", "day", "wanted", "state")


@query(f"{_MACHINE} select region, strftime(day, '%Y-%m-%d') as day, before as previous, state, wanted from m where k > 0 and before <> state")
def area_transition_log(spark, sf):
    """Every change of a region's state."""
    return G.transitions(_states(spark, sf))


@query(f"{_W} select cluster_id, round((least(size / 10, 1) + least(n_sources / 5, 1)) / 2, 6) as confidence from cs")
def state_confidence(spark, sf):
    one = F.lit(1.0)
    return clusters(spark, sf).select("cluster_id", F.round((F.least(F.col("size") / 10, one) + F.least(F.col("n_sources") / 5, one)) / 2, 6).alias("confidence"))


@query(f"{_REG} select count(*) filter (where regular) as regular, count(*) filter (where one_source) as one_source, count(*) as n from fl")
def governance_counts(spark, sf):
    return G.regularity(event_groups(spark, sf), ["cluster_id"]).agg(F.count_if("regular").alias("regular"), F.count_if("one_source").alias("one_source"), F.count(F.lit(1)).alias("n"))


@query(f"""{_W}, g as (select * from cs where {_pass()}) select 'fresh' as check, count(*) as n, count(*) filter (where last_ts > {_NOW} - interval 24 hour) as n_bad, count(*) filter (where last_ts > {_NOW} - interval 24 hour) = 0 as passed from g
union all select 'size', count(*), count(*) filter (where size < 3), count(*) filter (where size < 3) = 0 from g union all select 'sources', count(*), count(*) filter (where n_sources < 2), count(*) filter (where n_sources < 2) = 0 from g
union all select 'text', count(*), count(*) filter (where contains(text, '@')), count(*) filter (where contains(text, '@')) = 0 from documents""")
def output_checks(spark, sf):
    g = _gated(spark, sf)
    return G.checks([("fresh", g, F.col("last_ts") > as_of() - F.expr("interval 24 hours")), ("size", g, F.col("size") < 3), ("sources", g, F.col("n_sources") < 2), ("text", table(spark, sf, "documents"), F.col("text").contains("@"))])


_LEAST = f"count(*) as n_released, min(size) as least_size, min(n_sources) as least_sources, round(min((epoch_us({_NOW}) - epoch_us(last_ts)) / 3.6e9), 6) as least_age"


@query(f"{_W}, l as (select 0 as tier, {_LEAST} from cs where {_pass(72, 5)} union all select 1, {_LEAST} from cs where {_pass()}) select *, coalesce(least_size >= 3 and least_sources >= 2 and least_age >= 24, true) as complies from l")
def compliance_checks(spark, sf):
    """What each tier releases, its smallest, least attested and newest group, and whether these keep the limits; for signals that hold no identity column."""
    G.refuse_identity(event_signals(spark, sf))
    out = None
    for t, limits in TIERS.items():
        age = F.min(hours_before(as_of(), F.col("last_ts")))
        one = G.release(clusters(spark, sf), limits, as_of()).agg(F.lit(t).alias("tier"), F.count(F.lit(1)).alias("n_released"), F.min("size").alias("least_size"), F.min("n_sources").alias("least_sources"), F.round(age, 6).alias("least_age"))
        out = one if out is None else out.unionByName(one)
    kept = (F.col("least_size") >= 3) & (F.col("least_sources") >= 2) & (F.col("least_age") >= 24)
    return out.withColumn("complies", F.coalesce(kept, F.lit(True)))


@query(f"""{_W}, g as (select * from cs where {_pass()} and first_ts >= {_NOW} - interval 8 day), {SQL_REGIONS}, r as (select region, count(cluster_id) as n_groups, coalesce(sum(size), 0)::bigint as n_signals, round(coalesce(avg(volume), 0), 6) as mean_volume from regions left join g using (region) group by 1)
select *, sha256(concat_ws('|', '2024-01-31', region, n_groups, n_signals)) as hash from r""")
def weekly_brief(spark, sf):
    """The last week's released groups by region, with a hash of the day and the counts."""
    g = _gated(spark, sf).where(F.col("first_ts") >= as_of() - F.expr("interval 8 days")).groupBy("region").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_signals"), F.round(F.avg("volume"), 6).alias("mean_volume"))
    r = regions(spark).select("region").join(g, "region", "left").fillna({"n_groups": 0, "n_signals": 0, "mean_volume": 0.0})
    return r.withColumn("hash", F.sha2(F.concat_ws("|", F.date_format(as_of(), "yyyy-MM-dd"), "region", F.col("n_groups").cast("string"), F.col("n_signals").cast("string")), 256))


@query(f"with {SQL_EV}, w as (select region, date_trunc('week', ts) as b, count(*) as n from ev where ts <= {_NOW} - interval 24 hour group by 1, 2), x as (select *, row_number() over (partition by region order by b) - 1 as x from w) select region, count(*) as weeks, round(regr_slope(n, x), 6) as slope from x group by 1")
def trend_report(spark, sf):
    w = G.delayed(event_signals(spark, sf), as_of(), 24).groupBy("region", F.date_trunc("week", "ts").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    r = W.regression(w, ["region"])
    return r.select("region", F.col("points").alias("weeks"), F.round("slope", 6).alias("slope"))


@query("select count(*) as n, count(distinct source) as n_sources, count(*) filter (where contains(text, '@')) as with_at, count(*) filter (where regexp_matches(text, '[0-9]{16}')) as with_number from documents")
def audit_report(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.count_if(F.col("text").contains("@")).alias("with_at"), F.count_if(F.col("text").rlike("[0-9]{16}")).alias("with_number"))


@query(f"{_W} select cluster_id, region, size, n_sources, round(volume, 6) as volume from cs where {_pass()} and region = '01249' and last_ts >= timestamp '2024-01-20'")
def group_report(spark, sf):
    return _gated(spark, sf).where("region = '01249' and last_ts >= timestamp'2024-01-20 00:00:00'").select("cluster_id", "region", "size", "n_sources", F.round("volume", 6).alias("volume"))


@query(f"{_W} select cluster_id, region, left('Attention in ' || region || ': ' || size || ' records from ' || n_sources || ' sources', 200) as notice from cs where {_pass()} and volume >= 400")
def gated_group_notices(spark, sf):
    text = F.concat(F.lit("Attention in "), F.col("region"), F.lit(": "), F.col("size").cast("string"), F.lit(" records from "), F.col("n_sources").cast("string"), F.lit(" sources"))
    return _gated(spark, sf).where("volume >= 400").select("cluster_id", "region", F.substring(N.scrub(text), 1, 200).alias("notice"))
