"""Queries on diversity, entropy and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cases, hours_before, ratio
from ..operators import normalize as N
from ..operators import scores as S
from ..sources.adapters import SQL_DOC, SQL_EV, SQL_GEV, SQL_REGIONS, SQL_VEC, as_of, event_groups, event_signals, regions, table, text_signals, vector_groups
from .base import query
from .q_aggregate import _CS, clusters
from .q_rows import _rules_sql

_NOW = "timestamp '2024-01-31'"
_W = f"with {SQL_EV}, {SQL_GEV}, {_CS}"


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _ent(src, key, cat):
    return f"""ec as (select {key}, {cat}, count(*) as c from {src} group by 1, 2), en as (select {key}, sum(c) as n from ec group by 1),
eh as (select {key}, 0 - sum(c / n * log2(c / n)) as h, count(*) as k, any_value(n) as n, 1 - sum(c * (c - 1)) / any_value(n * (n - 1)) as simpson from ec join en using ({key}) group by 1)"""


@query(f"with {SQL_EV}, {_ent('ev', 'region', 'source')} select region, round(h, 6) as h from eh")
def shannon_entropy(spark, sf):
    return S.entropy(event_signals(spark, sf), ["region"], "source").select("region", *_r("h"))


@query(f"with {SQL_EV}, {_ent('ev', 'region', 'source')} select region, round(case when k > 1 then h / log2(k) else 0 end, 6) as normalized from eh")
def normalized_entropy(spark, sf):
    return S.entropy(event_signals(spark, sf), ["region"], "source").select("region", *_r("normalized"))


@query(f"with {SQL_DOC}, {_ent('doc', 'region', 'source')} select region, round(h, 6) as h, k from eh")
def source_entropy(spark, sf):
    return S.entropy(text_signals(spark, sf), ["region"], "source").select("region", *_r("h"), "k")


@query(f"with {SQL_DOC}, {_ent('doc', 'region', 'language')} select region, round(h, 6) as h, k from eh")
def topic_entropy(spark, sf):
    return S.entropy(text_signals(spark, sf), ["region"], "language").select("region", *_r("h"), "k")


_GINI = f"""gx as (select s.source, r.region, count(ev.signal_id) as c from (select distinct source from ev) s cross join regions r left join ev on ev.source = s.source and ev.region = r.region group by 1, 2),
gi as (select *, row_number() over (partition by source order by c, region) as i from gx), gini as (select source, 2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*) as gini from gi group by 1)"""


@query(f"with {SQL_EV}, {SQL_REGIONS}, {_GINI} select source, round(gini, 6) as gini from gini")
def gini(spark, sf):
    return S.gini(regions(spark), event_signals(spark, sf), "region", ["source"]).select("source", *_r("gini"))


_IA = "ia0 as (select region, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by region order by ts, signal_id)) / 3.6e9 as gap from ev), ia as (select region, coalesce(stddev_samp(gap) / avg(gap), 0) as cv from ia0 where gap > 0 group by 1)"


@query(f"with {SQL_EV}, {_IA} select region, round(cv, 5) as cv, round(2 / (1 + exp(-cv)) - 1, 5) as squashed from ia")
def interarrival_cv(spark, sf):
    return S.interarrival(event_signals(spark, sf), ["region"]).select("region", F.round("cv", 5).alias("cv"), F.round("squashed", 5).alias("squashed"))


@query(f"with {SQL_EV.replace('ev as (', 'ev0 as (', 1)}, ev as (select * from ev0 union all select signal_id, ts, source, 'all' as region, weight from ev0), {_ent('ev', 'region', 'source')}, {_IA}, d as (select region, ts::date as d, count(*) as c from ev group by 1, 2), dh as (select region, -sum(c / n * log2(c / n)) / log2(count(*)) as dh from d join en using (region) group by 1) select region, round(100 * (h / log2(k) + dh + 2 / (1 + exp(-cv)) - 1 + simpson) / 4, 4) as cei from eh join ia using (region) join dh using (region)")
def composite_entropy_index(spark, sf):
    """By region, and of all regions together."""
    e = event_signals(spark, sf)
    e = e.unionByName(e.withColumn("region", F.lit("all")))
    a = S.entropy(e, ["region"], "source").select("region", F.col("normalized").alias("a"), "simpson")
    d = S.entropy(e.withColumn("d", F.to_date("ts")), ["region"], "d").select("region", F.col("normalized").alias("d"))
    i = S.interarrival(e, ["region"]).select("region", "squashed")
    return a.join(d, "region").join(i, "region").select("region", F.round(100 * (F.col("a") + F.col("d") + F.col("squashed") + F.col("simpson")) / 4, 4).alias("cei"))


@query(f"with {SQL_EV}, {_ent('ev', 'region', 'source')} select region, round(simpson, 6) as simpson from eh")
def simpson_diversity(spark, sf):
    return S.entropy(event_signals(spark, sf), ["region"], "source").select("region", *_r("simpson"))


@query(f"""with {SQL_EV}, {SQL_GEV}, {_ent('gev', 'cluster_id', 'source')}, rel as (select cluster_id, avg({_rules_sql('source', 'weight')}) as reliability from ec group by 1)
select cluster_id, round(coalesce(simpson, 0), 6) as simpson, round(h, 6) as h, round(reliability, 6) as reliability, round(0.4 * case when n > 1 then simpson else 0 end + 0.3 * case when k > 1 then h / log2(k) else 0 end + 0.3 * reliability, 6) as composite from eh join rel using (cluster_id) where n > 1""")
def cluster_diversity(spark, sf):
    g = event_groups(spark, sf)
    e = S.entropy(g, ["cluster_id"], "source")
    w = N.source_weight(F.col("source"), {}, N.SOURCE_RULES, N.CLASS_WEIGHT)
    rel = g.select("cluster_id", "source").distinct().groupBy("cluster_id").agg(F.avg(w).alias("reliability"))
    e = e.where("n > 1").join(rel, "cluster_id").withColumn("composite", 0.4 * F.col("simpson") + 0.3 * F.col("normalized") + 0.3 * F.col("reliability"))
    return e.select("cluster_id", *_r("simpson", "h", "reliability", "composite"))


@query(f"with {SQL_DOC} select region, round(count(distinct left(source, 4)) / count(distinct source), 6) as ratio from doc group by 1")
def source_type_ratio(spark, sf):
    return text_signals(spark, sf).groupBy("region").agg(F.round(F.countDistinct(F.substring("source", 1, 4)) / F.countDistinct("source"), 6).alias("ratio"))


_Q = f"""q as (select cluster_id, size, n_sources, (epoch_us(last_ts) - epoch_us(first_ts)) / 3.6e9 as span from cs), rel as (select cluster_id, avg({_rules_sql('source', 'weight')}) as reliability from (select distinct cluster_id, source from gev) group by 1),
qq as (select *, least(n_sources / size, 1) as corroboration, case when span <= 0 then 0.5 when span > 168 then 0.3 else greatest(0.2, 1 - 0.5 * abs(span - 36) / 36) end as temporal from q join rel using (cluster_id))"""


def _quality(spark, sf):
    g = event_groups(spark, sf)
    w = N.source_weight(F.col("source"), {}, N.SOURCE_RULES, N.CLASS_WEIGHT)
    rel = g.select("cluster_id", "source").distinct().groupBy("cluster_id").agg(F.avg(w).alias("reliability"))
    c = clusters(spark, sf).join(rel, "cluster_id").withColumn("span", (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 3.6e9)
    return c.withColumn("corroboration", F.least(F.col("n_sources") / F.col("size"), F.lit(1.0))).withColumn("temporal", S.temporal_quality(F.col("span")))


_SIX = f"""with {SQL_DOC}, {SQL_VEC}, s as (select v.cluster_id, v.embedding, d.signal_id, d.source, d.ts, d.region, d.text from vec v join doc d on d.signal_id = v.signal_id where v.embedding is not null),
b as (select cluster_id, count(*) as size, count(distinct source) as k, count(distinct region) as r, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 as span, coalesce(sum(len(regexp_extract_all(text, '[A-Z][a-z]+'))), 0) as ents from s group by 1),
rel as (select cluster_id, avg({_rules_sql('source', 'weight')}) as reliability from (select distinct cluster_id, source from s) group by 1),
co as (select a.cluster_id, avg(list_cosine_similarity(a.embedding, b.embedding)) as coherence from s a join s b on a.cluster_id = b.cluster_id and a.signal_id <> b.signal_id group by 1),
six as (select cluster_id, reliability, least(k / size, 1) as corroboration, coalesce(coherence, 1) as coherence, 1 / (1 + 0.5 * (r - 1)) as geo, case when span <= 0 then 0.5 when span > 168 then 0.3 else greatest(0.2, 1 - 0.5 * abs(span - 36) / 36) end as temporal, least(ents / (5 * size), 1) as entities from b join rel using (cluster_id) left join co using (cluster_id))"""


@query(f"{_SIX} select cluster_id, round(0.25 * reliability + 0.2 * corroboration + 0.15 * coherence + 0.1 * geo + 0.15 * temporal + 0.15 * entities, 5) as quality from six")
def signal_quality(spark, sf):
    """The six components of groups of texts: each from the groups' own rows."""
    d = text_signals(spark, sf).select("signal_id", "source", "ts", "region", F.regexp_count("text", F.lit("[A-Z][a-z]+")).alias("entities"))
    s = vector_groups(spark, sf).where("embedding is not null").select("signal_id", "cluster_id", "embedding").join(d, "signal_id")
    w = N.source_weight(F.col("source"), {}, N.SOURCE_RULES, N.CLASS_WEIGHT)
    rel = s.select("cluster_id", "source").distinct().groupBy("cluster_id").agg(F.avg(w).alias("reliability"))
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9
    n = F.count(F.lit(1))
    b = s.groupBy("cluster_id").agg(
        F.least(F.countDistinct("source") / n, F.lit(1.0)).alias("corroboration"), (1 / (1 + 0.5 * (F.countDistinct("region") - 1))).alias("geo"),
        S.temporal_quality(span).alias("temporal"), F.least(F.coalesce(F.sum("entities"), F.lit(0)) / (5 * n), F.lit(1.0)).alias("entities"),
    )
    six = b.join(rel, "cluster_id").join(S.coherence(s, ["cluster_id"], "embedding"), "cluster_id")
    q = sum(F.col(c) * share for c, share in (("reliability", 0.25), ("corroboration", 0.2), ("coherence", 0.15), ("geo", 0.1), ("temporal", 0.15), ("entities", 0.15)))
    return six.select("cluster_id", F.round(q, 5).alias("quality"))


@query(f"{_W}, {_Q} select cluster_id, round(reliability, 6) as reliability from qq")
def q_reliability(spark, sf):
    return _quality(spark, sf).select("cluster_id", *_r("reliability"))


@query(f"{_W}, {_Q} select cluster_id, round(corroboration, 6) as corroboration from qq")
def q_corroboration(spark, sf):
    return _quality(spark, sf).select("cluster_id", *_r("corroboration"))


@query(f"with {SQL_VEC}, p as (select a.cluster_id, list_cosine_similarity(a.embedding, b.embedding) as c from vec a join vec b on a.cluster_id = b.cluster_id and a.signal_id <> b.signal_id) select cluster_id, round(avg(c), 5) as coherence from p group by 1")
def q_coherence(spark, sf):
    return S.coherence(vector_groups(spark, sf), ["cluster_id"], "embedding").select("cluster_id", F.round("coherence", 5).alias("coherence"))


@query(f"with {SQL_VEC} select cluster_id, round(1 / (1 + 0.5 * (count(distinct region) - 1)), 6) as precision from vec group by 1")
def q_geo_precision(spark, sf):
    return vector_groups(spark, sf).groupBy("cluster_id").agg(F.round(1 / (1 + 0.5 * (F.countDistinct("region") - 1)), 6).alias("precision"))


@query(f"{_W}, {_Q} select cluster_id, round(temporal, 6) as temporal from qq")
def q_temporal(spark, sf):
    return _quality(spark, sf).select("cluster_id", *_r("temporal"))


@query("select source, round(least(sum(len(regexp_extract_all(text, '[A-Z][a-z]+'))) / (5 * count(*)), 1), 6) as density from documents group by 1")
def q_entity_density(spark, sf):
    n = F.regexp_count("text", F.lit("[A-Z][a-z]+"))
    return table(spark, sf, "documents").groupBy("source").agg(F.round(F.least(F.sum(n) / (5 * F.count(F.lit(1))), F.lit(1.0)), 6).alias("density"))


_PTS = "(30 * least(size / 10, 1) + 30 * least(n_sources / 3, 1) + 20 * volume / (select max(volume) from cs) + 20 * coalesce(linked, 0) / size)"


@query(f"{_W}, ur as (select cluster_id, count(*) as linked from gev join pages on page_id = signal_id where url like 'http://%' or url like 'https://%' group by 1), p as (select cluster_id, {_PTS} as pts from cs left join ur using (cluster_id)) select cluster_id, round(pts, 6) as points, case when pts >= 70 then 'HIGH' when pts >= 50 then 'MEDIUM' else 'LOW' end as band from p")
def group_quality_points(spark, sf):
    """Size, sources, share of the highest volume, and the share of signals that have a page with a web address."""
    pages = table(spark, sf, "pages").where(F.col("url").startswith("http://") | F.col("url").startswith("https://")).select(F.col("page_id").alias("signal_id"))
    linked = event_groups(spark, sf).join(pages, "signal_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("linked"))
    c = clusters(spark, sf).join(linked, "cluster_id", "left")
    c = c.join(F.broadcast(c.agg(F.max("volume").alias("top"))), F.lit(True))
    one = F.lit(1.0)
    pts = 30 * F.least(F.col("size") / 10, one) + 30 * F.least(F.col("n_sources") / 3, one) + 20 * F.col("volume") / F.col("top") + 20 * F.coalesce("linked", F.lit(0)) / F.col("size")
    return c.select("cluster_id", F.round(pts, 6).alias("points"), cases([(pts >= 70, "HIGH"), (pts >= 50, "MEDIUM")], "LOW").alias("band"))


_CONF = f"(0.35 * least(size / 10, 1) + 0.25 * least(n_sources / 3, 1) + 0.2 * least((epoch_us(last_ts) - epoch_us(first_ts)) / 3.6e9 / 168, 1) + 0.2 * greatest(0, 1 - (epoch_us({_NOW}) - epoch_us(last_ts)) / 3.6e9 / 720))"


@query(f"{_W} select region, round(avg({_CONF}), 6) as mean, round(quantile_cont({_CONF}, 0.5), 6) as median from cs group by 1")
def cluster_confidence(spark, sf):
    one = F.lit(1.0)
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 3.6e9
    conf = 0.35 * F.least(F.col("size") / 10, one) + 0.25 * F.least(F.col("n_sources") / 3, one) + 0.2 * F.least(span / 168, one) + 0.2 * F.greatest(F.lit(0.0), 1 - hours_before(as_of(), F.col("last_ts")) / 720)
    return clusters(spark, sf).groupBy("region").agg(F.round(F.avg(conf), 6).alias("mean"), F.round(F.percentile(conf, 0.5), 6).alias("median"))


@query(f"""{_W}, a as (select cluster_id, size, n_sources, (epoch_us({_NOW}) - epoch_us(last_ts)) / 3.6e9 as age from cs), u as (select *, least(0.9, 0.3 + 0.1 * size + 0.15 * n_sources) * greatest(0.5, 1 - age / 168) as c from a)
select cluster_id, round(c, 6) as confidence, round(greatest(0, c - 0.15), 6) as low, round(least(1, c + 0.15), 6) as high, case when c >= 0.7 then 'high' when c >= 0.4 then 'moderate' else 'low' end as quality,
concat_ws(';', case when size < 5 then 'few records' end, case when n_sources < 3 then 'few sources' end, case when age > 72 then 'old data' end) as limitations from u""")
def uncertainty_columns(spark, sf):
    u = S.uncertainty(F.col("size"), F.col("n_sources"), hours_before(as_of(), F.col("last_ts")))
    return clusters(spark, sf).select("cluster_id", *[F.round(u[k], 6).alias(k) for k in ("confidence", "low", "high")], u["quality"].alias("quality"), F.array_join(u["limitations"], ";").alias("limitations"))


@query(f"""{_W}, a as (select cluster_id, size, n_sources, (epoch_us({_NOW}) - epoch_us(last_ts)) / 3.6e9 as age from cs), d as (select cluster_id, case when age < 48 then 0.1 when age < 168 then 0.3 else 0.6 end as temporal, case when size >= 10 then 0.1 when size >= 5 then 0.3 else 0.5 end as spatial, case when n_sources >= 4 then 0.1 when n_sources >= 2 then 0.3 else 0.7 end as source from a)
select cluster_id, temporal::double as temporal, spatial::double as spatial, source::double as source, round((temporal + spatial + source) / 3, 6)::double as mean from d""")
def uncertainty_dimensions(spark, sf):
    age = hours_before(as_of(), F.col("last_ts"))
    c = clusters(spark, sf).select("cluster_id", cases([(age < 48, 0.1), (age < 168, 0.3)], 0.6).alias("temporal"), cases([(F.col("size") >= 10, 0.1), (F.col("size") >= 5, 0.3)], 0.5).alias("spatial"), cases([(F.col("n_sources") >= 4, 0.1), (F.col("n_sources") >= 2, 0.3)], 0.7).alias("source"))
    return c.withColumn("mean", F.round((F.col("temporal") + F.col("spatial") + F.col("source")) / 3, 6))


_COV = f"""cov as (select cluster_id, case when (epoch_us({_NOW}) - epoch_us(last_ts)) / 3.6e9 >= 168 then 'STALE' when n_sources / 5 < 0.5 then 'INCOMPLETE' when size < 2 then 'SPARSE' when (epoch_us({_NOW}) - epoch_us(last_ts)) / 3.6e9 >= 48 then 'DELAYED' else 'COMPLETE' end as flag from cs)"""


def _coverage(spark, sf):
    return clusters(spark, sf).select("cluster_id", S.coverage(hours_before(as_of(), F.col("last_ts")), F.col("n_sources") / 5, F.col("size")).alias("flag"))


@query(f"{_W}, {_COV} select cluster_id, flag from cov")
def coverage_quality_flag(spark, sf):
    return _coverage(spark, sf)


@query(f"{_W}, {_COV}, f as (select * from (values ('STALE'), ('INCOMPLETE'), ('SPARSE'), ('DELAYED'), ('COMPLETE')) as t(flag)) select f.flag, count(cluster_id) as n, round(100.0 * count(cluster_id) / (select count(*) from cov), 6) as pct from f left join cov using (flag) group by 1")
def coverage_quality_report(spark, sf):
    got = _coverage(spark, sf).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    got = got.join(F.broadcast(got.agg(F.sum("n").alias("total"))), F.lit(True))
    flags = spark.createDataFrame([(f,) for f in S.COVERAGE], "flag string")
    return flags.join(got, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("n"), F.round(100.0 * F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)), 6).alias("pct"))


@query(f"{_W}, s as (select region, cluster_id, 0.5 * least(n_sources / 5, 1) + 0.3 * least(size / 20, 1) + 0.2 * least(volume / 1000, 1) as score from cs) select region, cluster_id, round(score, 6) as score, rank from (select *, row_number() over (partition by region order by score desc, cluster_id) as rank from s) where rank <= 10")
def geo_accuracy_rank(spark, sf):
    one = F.lit(1.0)
    s = clusters(spark, sf).withColumn("score", 0.5 * F.least(F.col("n_sources") / 5, one) + 0.3 * F.least(F.col("size") / 20, one) + 0.2 * F.least(F.col("volume") / 1000, one))
    w = Window.partitionBy("region").orderBy(F.desc("score"), "cluster_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("region", "cluster_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {SQL_EV} select case when weight / 100 < 0.3 then 'minimal' when weight / 100 < 0.5 then 'low' when weight / 100 < 0.7 then 'moderate' when weight / 100 < 0.85 then 'high' else 'severe' end as band, count(*) as n from ev group by 1")
def severity_band(spark, sf):
    x = F.col("weight") / 100
    return event_signals(spark, sf).groupBy(cases([(x < 0.3, "minimal"), (x < 0.5, "low"), (x < 0.7, "moderate"), (x < 0.85, "high")], "severe").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_W}, r as (select cluster_id, least(volume / 1000, 1) as s, least(size / 20, 1) as c from cs) select cluster_id, case when s * c >= 0.75 then 'HIGH_ATTENTION' when s * c >= 0.5 then 'ELEVATED_ATTENTION' when s * c >= 0.25 then 'MODERATE' else 'QUIET' end as state from r")
def attention_state(spark, sf):
    from .q_aggregate import state

    return clusters(spark, sf).select("cluster_id", state(F.least(F.col("volume") / 1000, F.lit(1.0)), F.least(F.col("size") / 20, F.lit(1.0))).alias("state"))


@query(f"{_W} select cluster_id, concat_ws(';', case when size >= 10 then 'many records' end, case when n_sources >= 3 then 'several sources' end, case when volume >= 500 then 'high volume' end, 'not a statement about events or persons') as explanation from cs")
def attention_explanation(spark, sf):
    parts = N.reasons([(F.col("size") >= 10, "many records"), (F.col("n_sources") >= 3, "several sources"), (F.col("volume") >= 500, "high volume"), (F.lit(True), "not a statement about events or persons")])
    return clusters(spark, sf).select("cluster_id", F.array_join(parts, ";").alias("explanation"))


@query("""with i as (select c_nationkey as k, avg(c_acctbal) as a, count(*) as b, count(*) filter (where c_mktsegment = 'BUILDING') as c from customer group by 1),
m as (select k, (a - min(a) over ()) / (max(a) over () - min(a) over ()) as a, (b - min(b) over ()) / (max(b) over () - min(b) over ()) as b, (c - min(c) over ()) / (max(c) over () - min(c) over ()) as c from i),
w as (select k, 0.5 * (1 - a) + 0.3 * b + 0.2 * c as x from m), f as (select k, 100 * (x - min(x) over ()) / (max(x) over () - min(x) over ()) as v from w)
select k, round(v, 6) as index, case when v < 20 then 'very low' when v < 40 then 'low' when v < 60 then 'moderate' when v < 80 then 'high' else 'very high' end as band from f""")
def vulnerability_index(spark, sf):
    c = table(spark, sf, "customer")
    i = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).alias("b"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("c"))
    m = S.min_max(i, ["a", "b", "c"]).select("k", (0.5 * (1 - F.col("a")) + 0.3 * F.col("b") + 0.2 * F.col("c")).alias("x"))
    v = S.min_max(m, ["x"]).withColumn("v", 100 * F.col("x"))
    return v.select("k", F.round("v", 6).alias("index"), cases([(F.col("v") < 20, "very low"), (F.col("v") < 40, "low"), (F.col("v") < 60, "moderate"), (F.col("v") < 80, "high")], "very high").alias("band"))


@query("select c_nationkey as k, round(100.0 * count(*) filter (where c_mktsegment = 'BUILDING') / count(*), 6) as pct_building, round(100.0 * count(*) filter (where c_acctbal < 0) / count(*), 6) as pct_negative from customer group by 1")
def derived_percentages(spark, sf):
    pct = lambda cond: F.round(100.0 * ratio(F.count_if(cond), F.count(F.lit(1))), 6)
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(pct(F.col("c_mktsegment") == "BUILDING").alias("pct_building"), pct(F.col("c_acctbal") < 0).alias("pct_negative"))
