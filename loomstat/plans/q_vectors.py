"""Queries on groups of vectors and topics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cases, cosine, hours_before
from ..operators import density as D
from ..operators import groups as G
from ..operators.sizes import sent
from ..sources.adapters import SQL_DOC, SQL_EV, SQL_GEV, SQL_VEC, as_of, event_groups, table, text_signals, vector_groups
from .base import query
from .q_aggregate import _CS, clusters
from .q_text import _IN, STOP

_CEN = "cu as (select cluster_id, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as p from vec), cp as (select cluster_id, p, avg(x) as x from cu group by all), cen as (select cluster_id, list(x order by p) as c from cp group by 1)"
_TOK = "tok as (select signal_id, language as topic, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as term from doc)"
_TF = f"""with {SQL_DOC}, {_TOK}, tf as (select topic, term, count(*) as tf from tok group by all), ff as (select term, sum(tf) as f from tf group by 1), sc as (select topic, term, tf, tf * ln(1 + (select sum(tf) / count(distinct topic) from tf) / f) as score from tf join ff using (term)),
rk as (select *, row_number() over (partition by topic order by score desc, term) as rank from sc)"""


def tokens(spark, sf):
    d = text_signals(spark, sf)
    return d.select("signal_id", F.col("language").alias("topic"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))


@query()
def embed(spark, sf):
    """Hashed term-frequency vectors with inverse document frequencies, from Spark ML."""
    from pyspark.ml.feature import IDF, HashingTF

    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)).alias("terms"))
    tf = HashingTF(inputCol="terms", outputCol="tf", numFeatures=256).transform(d)
    out = IDF(inputCol="tf", outputCol="v").fit(tf).transform(tf)
    from pyspark.ml.functions import vector_to_array

    return out.select("doc_id", F.transform(vector_to_array("v"), lambda x: F.round(x, 6)).alias("embedding"))


@query(f"""with recursive {SQL_VEC}, p as (select a.signal_id as a, b.signal_id as b from vec a join vec b on a.signal_id <> b.signal_id and list_distance(a.embedding, b.embedding) <= 0.5),
r(a, c) as (select signal_id, signal_id from vec where embedding is not null union select p.a, r.c from p join r on r.a = p.b), m as (select a, min(c) as c from r group by 1), z as (select c, count(*) as size from m group by 1)
select signal_id, case when size >= 2 then c else -1 end as "group", coalesce(size, 1) as size, 0.5::double as eps from vec left join m on a = signal_id left join z using (c)""")
def eps_groups(spark, sf):
    """Vectors linked within a distance, and their components."""
    return G.density_groups(vector_groups(spark, sf), "signal_id", "embedding", eps=0.5, min_size=2)


@query(f"""with recursive {SQL_VEC}, pt as (select embedding as x, min(signal_id) as id, count(*) as n from vec where embedding is not null group by 1),
e as materialized (select a.id, b.id as other, struct_pack(d := list_distance(a.x, b.x), lo := least(a.id, b.id), hi := greatest(a.id, b.id)) as e from pt a join pt b on a.id <> b.id),
nn as (select e.id, arg_min(other, e) as other, min(e) as joined from e join pt using (id) where n = 1 group by e.id),
l as (select id, other from nn union select other, id from nn), r(id, c) as (select id, id from pt union select l.id, r.c from l join r on r.id = l.other), ba as (select id, min(c) as c from r group by 1),
sp as (select x.c, min(e) as split from e join ba x on x.id = e.id join ba y on y.id = e.other where x.c <> y.c group by 1),
i as (select pt.id, pt.x, n, c from pt join ba using (id) join sp using (c) left join nn using (id) where joined is null or joined < split),
g as (select c, min(id) as "group", sum(n)::bigint as size from i group by 1)
select signal_id, coalesce("group", -1) as "group", coalesce(size, 1) as size from vec left join i on i.x = vec.embedding left join g using (c)""")
def density_cluster(spark, sf):
    """The leaves of the density hierarchy; no distance is given."""
    return D.leaf_groups(vector_groups(spark, sf), "signal_id", "embedding")


@query()
def kmeans_cluster(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vector_groups(spark, sf).where("embedding is not null").select("signal_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=10, seed=42, maxIter=15).fit(v).transform(v).select("signal_id", F.col("prediction").alias("group"))


@query(f"with {SQL_VEC}, {_CEN} select cluster_id, array_to_string(list_transform(c[1:8], lambda x: round(x, 5)::decimal(12, 5)), ',') as head from cen")
def cluster_centroid(spark, sf):
    c = G.centroids(vector_groups(spark, sf), ["cluster_id"], "embedding")
    return c.select("cluster_id", F.array_join(F.transform(F.slice("centroid", 1, 8), lambda x: F.round(x, 5).cast("decimal(12,5)").cast("string")), ",").alias("head"))


@query(f"""with {SQL_VEC}, {_CEN}, d as (select cluster_id, signal_id, list_distance(embedding, c) as d from vec join cen using (cluster_id)), r as (select cluster_id, arg_min(signal_id, (d, signal_id)) as representative, round(min(d), 5) as distance from d group by 1)
select cluster_id, representative, distance, substr(text, 1, 200) as text from r left join documents on doc_id = representative""")
def cluster_representative(spark, sf):
    """The member nearest to each centroid, with the first 200 characters of its text."""
    v = vector_groups(spark, sf)
    r = G.representatives(v, G.centroids(v, ["cluster_id"], "embedding"), "cluster_id", "signal_id", "embedding").withColumn("distance", F.round("distance", 5))
    text = table(spark, sf, "documents").select(F.col("doc_id").alias("representative"), F.substring("text", 1, 200).alias("text"))
    return r.join(text, "representative", "left").select("cluster_id", "representative", "distance", "text")


@query(f"with {SQL_EV}, {SQL_GEV} select cluster_id, round(sum(exp(-ln(2) * (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3.6e9 / 72)), 6) as volume from gev group by 1")
def cluster_volume_decay(spark, sf):
    return event_groups(spark, sf).groupBy("cluster_id").agg(F.round(F.sum(F.exp(-F.log(F.lit(2.0)) * hours_before(as_of(), F.col("ts")) / 72)), 6).alias("volume"))


@query(f"""with {SQL_VEC}, m as (select cluster_id, region, count(*) as c, row_number() over (partition by cluster_id order by count(*) desc, region) as k from vec group by 1, 2)
select cluster_id, count(*) as size, round(sum(exp(-ln(2) * (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3.6e9 / 72)), 6) as volume, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day, any_value(m.region) as region, count(distinct source) as n_sources
from vec join (select cluster_id, region from m where k = 1) m using (cluster_id) left join documents on doc_id = signal_id group by 1""")
def cluster_stats(spark, sf):
    """Size, decayed volume, days, most frequent region and number of sources of each group; the largest volume first."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("signal_id"), "source")
    v = vector_groups(spark, sf).select("signal_id", "cluster_id", "region", "ts").join(d, "signal_id", "left")
    w = Window.partitionBy("cluster_id").orderBy(F.desc("c"), "region")
    mode = v.groupBy("cluster_id", "region").agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.row_number().over(w)).where("k = 1").select("cluster_id", "region")
    day = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    volume = F.round(F.sum(F.exp(-F.log(F.lit(2.0)) * hours_before(as_of(), F.col("ts")) / 72)), 6)
    s = v.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), volume.alias("volume"), day(F.min("ts"), "first_day"), day(F.max("ts"), "last_day"), F.countDistinct("source").alias("n_sources"))
    return s.join(mode, "cluster_id").orderBy(F.desc("volume"), "cluster_id")


@query(f"with {SQL_VEC}, {_CEN} select a.cluster_id, round(1 - max(list_cosine_similarity(a.c, b.c)), 5) as novelty from cen a join cen b on b.cluster_id < 5 where a.cluster_id >= 5 group by 1")
def cluster_novelty(spark, sf):
    c = G.centroids(vector_groups(spark, sf), ["cluster_id"], "embedding")
    return G.novelty(c.where("cluster_id >= 5"), c.where("cluster_id < 5"), "cluster_id").withColumn("novelty", F.round("novelty", 5))


@query(f"with {SQL_EV}, {SQL_GEV}, {_CS} select count(*) filter (where size >= 20) as n_groups, sum(size) filter (where size >= 20)::bigint as n_grouped, sum(size) filter (where size < 20)::bigint as n_noise from cs")
def cluster_noise_stats(spark, sf):
    big = F.col("size") >= 20
    return clusters(spark, sf).agg(F.count_if(big).alias("n_groups"), F.sum(F.when(big, F.col("size"))).alias("n_grouped"), F.sum(F.when(~big, F.col("size"))).alias("n_noise"))


_NG = f"""with {SQL_VEC}, tw as (select cluster_id as topic, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: w not in {_IN(STOP)}) as w from documents join vec on signal_id = doc_id where cluster_id is not null and text is not null),
ng as (select topic, unnest(flatten([case when len(w) >= n then list_transform(range(1, len(w) + 2 - n), lambda i: array_to_string(w[i:i + n - 1], ' ')) else [] end for n in [1, 2, 3]])) as term from tw),
tf as (select topic, term, count(*) as tf from ng group by all), ff as (select term, sum(tf) as f from tf group by 1), sc as (select topic, term, tf, tf * ln(1 + (select sum(tf) / count(distinct topic) from tf) / f) as score from tf join ff using (term) where f >= 2),
rk as (select *, row_number() over (partition by topic order by score desc, term) as rank from sc)"""


@query(f"{_NG} select topic, term, tf, round(score, 4) as score, rank from rk where rank <= 10")
def topic_model(spark, sf):
    """Topics are groups of vectors; the ten strongest words and groups of words of each, from its texts."""
    v = vector_groups(spark, sf).where("cluster_id is not null").select(F.col("signal_id").alias("doc_id"), F.col("cluster_id").alias("topic"))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text").join(sent(v, 1_000_000), "doc_id")  # two numbers a row; else all texts would be shuffled
    return G.topic_words(d, "topic", "text", STOP).select("topic", "term", "tf", F.round("score", 4).alias("score"), "rank")


@query()
def topic_lda(spark, sf):
    """Topic of each document, with the topic's ten strongest words or word groups: LDA over counted 1- to 3-grams without stop words, the 2,000 most frequent ones."""
    d = table(spark, sf, "documents").where("text is not null")
    return G.topics(d, "doc_id", "text", k=4, vocabulary=2000, stop=STOP)


@query(f"{_TF} select topic, term, tf, round(score, 4) as score, rank from rk where rank <= 10")
def topic_ctfidf(spark, sf):
    return G.top_terms(G.ctfidf(tokens(spark, sf), "topic", "term"), "topic", "term", 10).select("topic", "term", "tf", F.round("score", 4).alias("score"), "rank")


@query(f"{_TF} select topic, string_agg(term, '_' order by rank) as label from rk where rank <= 5 group by 1")
def topic_label(spark, sf):
    t = G.top_terms(G.ctfidf(tokens(spark, sf), "topic", "term"), "topic", "term", 5)
    return t.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "_").alias("label"))


@query(f"with {SQL_DOC} select language as topic, least(10, floor(date_diff('second', timestamp '2024-01-01', ts) / 259200.0) + 1)::int as bin, count(*) as n from doc group by 1, 2")
def topic_evolution(spark, sf):
    b = F.least(F.lit(10), F.floor((F.unix_timestamp("ts") - 1704067200) / 259200) + 1).cast("int")
    return text_signals(spark, sf).groupBy(F.col("language").alias("topic"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_VT = f"with recursive {SQL_DOC}, tv as (select region as topic, term, count(*) as n from (select region, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as term from doc) where term not in ({', '.join(repr(x) for x in STOP)}) group by 1, 2), tl as (select topic, sqrt(sum(n * n)) as l from tv group by 1)"


@query(f"""{_VT}, p as (select a.topic as a, b.topic as b from tv a join tv b on a.term = b.term and a.topic <> b.topic join tl x on x.topic = a.topic join tl y on y.topic = b.topic group by 1, 2 having sum(a.n * b.n) / any_value(x.l * y.l) >= 0.7),
r(a, c) as (select topic, topic from tl union select p.a, r.c from p join r on r.a = p.b) select a as id, min(c) as component from r group by 1""")
def topic_merge(spark, sf):
    """Topics (here: texts by region) whose term vectors have a cosine of 0.7 or more become one."""
    d = text_signals(spark, sf)
    t = d.select(F.col("region").alias("topic"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term")).where(~F.col("term").isin(*STOP))
    return G.merged_topics(t.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n")), 0.7)


@query(f"with {SQL_VEC}, {_CEN}, n as (select signal_id, cen.cluster_id, list_cosine_similarity(embedding, c) as s from vec cross join cen) select signal_id, arg_max(cluster_id, (s, -cluster_id)) as topic from n group by 1")
def topic_assign_new(spark, sf):
    v = vector_groups(spark, sf)
    c = G.centroids(v, ["cluster_id"], "embedding").withColumnRenamed("cluster_id", "topic")
    n = v.join(sent(c), F.lit(True)).withColumn("s", cosine(F.col("embedding"), F.col("centroid")))  # topics are few
    return n.groupBy("signal_id").agg(F.max_by("topic", F.struct("s", -F.col("topic"))).alias("topic"))


@query(f"""{_TF}, h as (select language as topic, count(*) filter (where ts < timestamp '2024-01-16') as a, count(*) filter (where ts >= timestamp '2024-01-16') as b from doc group by 1), kw as (select topic, string_agg(term, ',' order by rank) as keywords from rk where rank <= 10 group by 1),
st as (select topic, term, score from rk where rank <= 10), ds as (select t.topic, t.signal_id, sum(score) as s from (select distinct signal_id, topic, term from tok) t join st using (topic, term) group by 1, 2), dr as (select topic, string_agg(signal_id::varchar, ',' order by k) as docs from (select *, row_number() over (partition by topic order by round(s, 6) desc, signal_id) as k from ds) where k <= 3 group by 1)
select topic, case when b > 1.1 * a then 'rising' when b < 0.9 * a then 'falling' else 'stable' end as trend, keywords, docs from h left join kw using (topic) left join dr using (topic)""")
def topic_narratives(spark, sf):
    """Each topic's ten keywords, up to three documents that hold most of them (by the keywords' scores), and the trend between the halves of the month."""
    mid = F.to_timestamp(F.lit("2024-01-16 00:00:00"))
    h = text_signals(spark, sf).groupBy(F.col("language").alias("topic")).agg(F.count_if(F.col("ts") < mid).alias("a"), F.count_if(F.col("ts") >= mid).alias("b"))
    t = tokens(spark, sf)
    top = G.top_terms(G.ctfidf(t, "topic", "term"), "topic", "term", 10)
    listed = lambda xs: F.array_join(F.transform(F.array_sort(F.collect_list(xs)), lambda x: x["v"]), ",")
    words = top.groupBy("topic").agg(listed(F.struct("rank", F.col("term").alias("v"))).alias("keywords"))
    # Ten rows for each topic; documents meet them by term, and are counted where they are before anything is shuffled.
    held = t.join(sent(top.select("topic", "term", "score")), ["topic", "term"]).select("topic", "signal_id", "term", "score").distinct().groupBy("topic", "signal_id").agg(F.sum("score").alias("s"))
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("s", 6)), "signal_id")
    three = held.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("topic").agg(listed(F.struct("k", F.col("signal_id").cast("string").alias("v"))).alias("docs"))
    trend = cases([(F.col("b") > 1.1 * F.col("a"), "rising"), (F.col("b") < 0.9 * F.col("a"), "falling")], "stable")
    return h.join(words, "topic", "left").join(three, "topic", "left").select("topic", trend.alias("trend"), "keywords", "docs")
