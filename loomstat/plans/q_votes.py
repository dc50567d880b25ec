"""Queries on votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cases
from ..operators import dedup as D
from ..operators import opinions as V
from ..operators.graph import connected_components, cut
from ..operators.groups import seed_groups
from ..sources.adapters import SQL_EV, SQL_GEV, SQL_VOTES, table, votes
from .base import query
from .q_aggregate import _CS, clusters

_LV = f"with {SQL_VOTES}, lv as (select session, statement, vote from (select *, row_number() over (partition by session, statement order by seq desc, vote) as k from votes) where k = 1)"


def latest(spark, sf):
    return D.keep_first(votes(spark, sf), [F.col("session"), F.col("statement")], [F.desc("seq"), F.col("vote")])


@query(f"{_LV} select session, statement, vote from lv")
def latest_vote(spark, sf):
    return latest(spark, sf).select("session", "statement", "vote")


@query(f"{_LV} select statement, count(*) filter (where vote = 'agree') as agree, count(*) filter (where vote = 'disagree') as disagree, count(*) filter (where vote = 'pass') as pass from lv group by 1")
def vote_counts(spark, sf):
    return latest(spark, sf).groupBy("statement").agg(*[F.count_if(F.col("vote") == v).alias(v) for v in ("agree", "disagree", "pass")])


_V = "case vote when 'agree' then 1 when 'disagree' then -1 else 0 end"


@query(f"{_LV} select session, statement, ({_V})::int as v from lv")
def vote_matrix(spark, sf):
    """The session x statement matrix in sparse form: one row for each vote, for any number of statements; what isn't there is 0."""
    return V.matrix(latest(spark, sf))


def _groups(spark, sf):
    m = cut(V.matrix(latest(spark, sf)))
    return m, cut(V.opinion_groups(m))


@query()
def opinion_groups(spark, sf):
    """Groups of sessions by principal components (10 at most) and k-means, k from 2 to 8 of the best silhouette; groups below 5 sessions are hidden."""
    return _groups(spark, sf)[1].where("group >= 0").groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query()
def group_representatives(spark, sf):
    """The five strongest statements of each group of opinion."""
    r = V.representatives(V.by_group(*_groups(spark, sf)))
    return r.select("group", "statement", F.round("mean", 6).alias("mean"), "rank")


@query()
def consensus(spark, sf):
    """Statements that at least 70 % agree with in every group of opinion."""
    m, g = _groups(spark, sf)
    n = g.where("group >= 0").select("group").distinct().count()
    return V.consensus(V.by_group(m, g), n).select("statement", F.round("lowest", 6).alias("lowest"), "consensus")


@query()
def divisive(spark, sf):
    """How far groups of opinion are apart on each statement, and whether by 0.30 or more."""
    return V.divisive(V.by_group(*_groups(spark, sf)), 0.0).select("statement", F.round("spread", 6).alias("spread"), (F.col("spread") >= 0.3).alias("divisive"))


_GR = f"{_LV}, gv as (select (session % 3)::int as \"group\", statement, avg(case vote when 'agree' then 1.0 when 'disagree' then -1.0 else 0 end) as mean, count(*) filter (where vote = 'agree') / count(*) as ratio, count(*) as n from lv group by 1, 2)"


def _cohorts(spark, sf):
    """The same measures for three given cohorts, for which SQL can say what is right."""
    m = V.matrix(latest(spark, sf))
    return V.by_group(m, m.select("session", (F.col("session") % 3).cast("int").alias("group")).distinct())


@query(f"{_GR} select \"group\", statement, round(mean, 6) as mean, rank from (select *, row_number() over (partition by \"group\" order by round(abs(mean), 9) desc, statement) as rank from gv) where rank <= 5")
def cohort_representatives(spark, sf):
    return V.representatives(_cohorts(spark, sf)).select("group", "statement", F.round("mean", 6).alias("mean"), "rank")


@query(f"{_GR} select statement, round(min(ratio), 6) as lowest, min(ratio) >= 0.7 and count(*) = 3 as consensus from gv group by 1")
def cohort_consensus(spark, sf):
    return V.consensus(_cohorts(spark, sf), 3).select("statement", F.round("lowest", 6).alias("lowest"), "consensus")


@query(f"{_GR} select statement, round(max(ratio) - min(ratio), 6) as spread, max(ratio) - min(ratio) >= 0.3 as divisive from gv group by 1")
def cohort_divisive(spark, sf):
    return V.divisive(_cohorts(spark, sf), 0.0).select("statement", F.round("spread", 6).alias("spread"), (F.col("spread") >= 0.3).alias("divisive"))


@query(f"""{_LV}, st as (select statement, count(*) as n, count(*) filter (where vote = 'agree') / count(*) as ratio from lv group by 1)
select count(*) as n_votes, count(distinct session) as n_sessions, count(distinct statement) as n_statements, round(count(*) filter (where vote = 'agree') / count(*), 6) as agree_ratio,
(select string_agg(statement::varchar, ',' order by ratio desc, statement) from (select * from st order by ratio desc, statement limit 5)) as top_agreed, (select string_agg(statement::varchar, ',' order by n desc, statement) from (select * from st order by n desc, statement limit 5)) as most_voted from lv""")
def opinion_summary(spark, sf):
    """Totals, and the five statements of the highest agreement and of the most votes; no session is named."""
    lv = latest(spark, sf)
    n = F.count(F.lit(1))
    st = lv.groupBy("statement").agg(n.alias("n"), (F.count_if(F.col("vote") == "agree") / n).alias("ratio"))
    five = lambda order: F.lit(",".join(str(r["statement"]) for r in st.orderBy(F.desc(order), "statement").limit(5).collect()))
    totals = lv.agg(n.alias("n_votes"), F.countDistinct("session").alias("n_sessions"), F.countDistinct("statement").alias("n_statements"), F.round(F.count_if(F.col("vote") == "agree") / F.nullif(n, F.lit(0)), 6).alias("agree_ratio"))
    return totals.select("*", five("ratio").alias("top_agreed"), five("n").alias("most_voted"))


_BP = f"""with recursive {SQL_EV}, {SQL_GEV}, {_CS}, bp as (select cluster_id, region, least(100, 5.0 * size) as density, least(100, 20.0 * n_sources) as breadth, least(100, volume / 10) as strength, least(100, (epoch_us(last_ts) - epoch_us(first_ts)) / 3.6e9 / 24 * 100) as span from cs where size >= 3 and n_sources >= 2 and last_ts <= timestamp '2024-01-30')"""


def profile(spark, sf):
    top = F.lit(100.0)
    c = clusters(spark, sf).where("size >= 3 and n_sources >= 2 and last_ts <= timestamp'2024-01-30 00:00:00'")
    return c.select("cluster_id", "region", F.least(top, 5.0 * F.col("size")).alias("density"), F.least(top, 20.0 * F.col("n_sources")).alias("breadth"), F.least(top, F.col("volume") / 10).alias("strength"), F.least(top, (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 3.6e9 / 24 * 100).alias("span"))


@query(f"{_BP} select cluster_id, round(density, 6) as density, round(breadth, 6) as breadth, round(strength, 6) as strength, round(span, 6) as span, case when span < 50 then 'fast' when density >= 75 then 'dense' else 'sparse' end as label from bp")
def behaviour_profile(spark, sf):
    p = profile(spark, sf)
    return p.select("cluster_id", *[F.round(c, 6).alias(c) for c in ("density", "breadth", "strength", "span")], cases([(F.col("span") < 50, "fast"), (F.col("density") >= 75, "dense")], "sparse").alias("label"))


@query(f"""{_BP}, m as (select region, avg(density) as d, avg(breadth) as b, avg(strength) as s, avg(span) as p from bp group by 1), e as (select x.region as a, y.region as b from m x join m y on x.region <> y.region and sqrt(pow(x.d - y.d, 2) + pow(x.b - y.b, 2) + pow(x.s - y.s, 2) + pow(x.p - y.p, 2)) <= 25),
r(a, c) as (select region, region from m union select e.a, r.c from e join r on r.a = e.b) select a as region, min(c) as component from r group by 1""")
def behaviour_links(spark, sf):
    """Regions whose mean profiles are linked by distances below 25; neutral labels."""
    m = profile(spark, sf).groupBy("region").agg(*[F.avg(c).alias(c) for c in ("density", "breadth", "strength", "span")])
    a, b = m.alias("a"), m.alias("b")
    d = sum(F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in ("density", "breadth", "strength", "span"))
    near = a.join(b, F.col("a.region") < F.col("b.region")).where(F.sqrt(d) <= 25).select(F.col("a.region").alias("a"), F.col("b.region").alias("b"))  # regions, not rows
    return connected_components(m.select(F.col("region").alias("id")), near).withColumnRenamed("id", "region")


@query()
def behaviour_regions(spark, sf):
    """Groups around seeds of like profiles, with the seed's group, its size, mean measures and a neutral label by rules."""
    metrics = ["density", "breadth", "strength", "span"]
    p = cut(profile(spark, sf).select("cluster_id", *metrics))
    near = seed_groups(p, "cluster_id", metrics, 25.0)
    g = p.join(near, "cluster_id").groupBy("seed").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in metrics])
    rules = [((F.col("span") < 40) & (F.col("density") > 60), "fast and dense"), ((F.col("breadth") > 60) & (F.col("strength") > 60), "broad and strong"), ((F.col("span") > 60) & (F.col("density") < 40), "slow and sparse")]
    return g.select("seed", "n", *[F.round(c, 6).alias(c) for c in metrics], cases(rules, "mixed").alias("label"))
