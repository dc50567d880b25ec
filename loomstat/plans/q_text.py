"""Queries on text analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cases, hours_before
from ..operators import textstats as T
from ..operators.graph import cut, expand
from ..operators.normalize import name_matches
from ..sources.adapters import SQL_DOC, SQL_MATCHES, as_of, place_names, place_texts, table, text_signals
from .base import query

STOP = ["the", "and", "der", "die", "und", "les", "des", "una", "que", "for", "was", "con"]
BOOST = ["license", "token", "password", "rights"]
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_TERMS = "tt as (select doc_id, lang, unnest(list_zip(regexp_extract_all(lower(text), '[a-z]{3,}'), range(0, len(regexp_extract_all(lower(text), '[a-z]{3,}'))))) as z from documents), t as (select doc_id, lang, z[1] as term, z[2] as pos from tt)"
_KW = f"with {_TERMS}, kc as (select doc_id, term, count(*) as c, min(pos) as pos, count(*) * case when term in {_IN(BOOST)} then 3 else 1 end as score from t where term not in {_IN(STOP)} group by 1, 2), kr as (select *, row_number() over (partition by doc_id order by score desc, pos) as rank from kc)"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _keywords(spark, sf, n=10):
    return T.keywords(_docs(spark, sf), "doc_id", "text", STOP, BOOST, n)


@query(f"{_KW} select doc_id, term, score, rank from kr where rank <= 10")
def keyword_extract(spark, sf):
    return _keywords(spark, sf).select("doc_id", "term", "score", "rank")


CATEGORIES = [("legal", ["license", "rights"]), ("security", ["token", "password"]), ("contact", ["@"])]
_CAT = "concat_ws(',', " + ", ".join(f"case when {' or '.join(f'''contains(lower(text), '{w}')''' for w in ws)} then '{c}' end" for c, ws in CATEGORIES) + ")"


def _categories():
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = lambda ws: low.rlike("|".join(ws))
    return F.array_compact(F.array(*[F.when(hit(ws), F.lit(c)) for c, ws in CATEGORIES]))


@query(f"select doc_id, coalesce(nullif({_CAT}, ''), 'general') as categories from documents")
def categorize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.coalesce(F.nullif(F.array_join(_categories(), ","), F.lit("")), F.lit("general")).alias("categories"))


_KC = f"""{_KW}, {SQL_DOC}, j as (select term, d.region, d.source, d.ts from kr join doc d on d.signal_id = kr.doc_id where rank <= 10),
ks as (select term, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, (epoch_us(timestamp '2024-01-31') - epoch_us(max(ts))) / 3.6e9 as recency from j group by 1),
tr as (select term, string_agg(region, ',' order by k) as top_regions from (select term, region, row_number() over (partition by term order by count(*) desc, region) as k from j group by term, region) where k <= 3 group by 1),
ts as (select term, source as top_source from (select term, source, row_number() over (partition by term order by count(*) desc, source) as k from j where source is not null group by term, source) where k = 1)"""


def _context(spark, sf):
    """(term, n, first_ts, last_ts, recency) of the ten strongest keywords of each text, and the rows that they come from."""
    d = text_signals(spark, sf).select(F.col("signal_id").alias("doc_id"), "region", "source", "ts")
    j = cut(_keywords(spark, sf).select("doc_id", "term").join(d, "doc_id"))
    return j.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), hours_before(as_of(), F.max("ts")).alias("recency")), j


@query(f"""{_KC} select term, n, strftime(first_ts, '%Y-%m-%d %H') as first_ts, strftime(last_ts, '%Y-%m-%d %H') as last_ts, round(recency, 4) as recency_hours, top_regions, top_source from ks join tr using (term) left join ts using (term) order by n desc, term limit 30""")
def keyword_context(spark, sf):
    """The 30 most frequent keywords: count, first and last time, hours since, three top regions, top source."""
    s, j = _context(spark, sf)
    top = s.orderBy(F.desc("n"), "term").limit(30)  # the report's length
    mine = cut(j.join(F.broadcast(top.select("term")), "term"))

    def strongest(c, n):
        w = Window.partitionBy("term").orderBy(F.desc("c"), c)
        k = mine.where(F.col(c).isNotNull()).groupBy("term", c).agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
        return k.groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]), ",").alias(f"top_{c}"))

    got = top.join(strongest("region", 3), "term").join(strongest("source", 1), "term", "left")
    hour = lambda c: F.date_format(c, "yyyy-MM-dd HH").alias(c)
    return got.select("term", "n", hour("first_ts"), hour("last_ts"), F.round("recency", 4).alias("recency_hours"), F.col("top_region").alias("top_regions"), "top_source")


@query(f"""{_KC} select term, n, floor(recency / 24)::bigint as days, row_number() over (order by floor(recency / 24), n desc, term) as rank, case when n >= 0.7 * (select max(n) from ks) then 'large' when n >= 0.4 * (select max(n) from ks) then 'medium' else 'small' end as size from ks""")
def keyword_display_rank(spark, sf):
    """All keywords in the order of display: the more recent day first, then the more frequent; and their size class. Terms are sorted by all tasks; ranks follow from the sizes of days and the places within."""
    s, _ = _context(spark, sf)
    s = cut(s.withColumn("days", F.floor(F.col("recency") / 24)))
    top = s.agg(F.max("n")).first()[0] or 0
    per = s.groupBy("days", "n").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.sum("m").over(Window.orderBy("days", F.desc("n"))) - F.col("m"))  # a row for each day and count
    place = F.row_number().over(Window.partitionBy("days", "n").orderBy("term"))
    got = s.withColumn("place", place).join(per, ["days", "n"])
    return got.select("term", "n", "days", (F.col("before") + F.col("place")).alias("rank"), cases([(F.col("n") >= 0.7 * top, "large"), (F.col("n") >= 0.4 * top, "medium")], "small").alias("size"))


@query(f"{_KW} select term, sum(c)::bigint as n from kc group by 1 order by n desc, term limit 20")
def top_keywords(spark, sf):
    t = T.terms(_docs(spark, sf), ["doc_id"], "text").where(~F.col("term").isin(*STOP))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(20)


@query(f"with c as (select unnest(string_split(coalesce(nullif({_CAT}, ''), 'general'), ',')) as category from documents) select category, count(*) as n from c group by 1")
def category_distribution(spark, sf):
    c = F.when(F.size(_categories()) > 0, _categories()).otherwise(F.array(F.lit("general")))
    return _docs(spark, sf).select(F.explode(c).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_CO = f"""with {_TERMS}, f as (select doc_id, term, row_number() over (partition by doc_id order by pos) as pos from t where term not in {_IN(STOP)}), l as (select term as x, unnest([lead(term, 1) over w, lead(term, 2) over w, lead(term, 3) over w, lead(term, 4) over w]) as y from f window w as (partition by doc_id order by pos)),
co as (select least(x, y) as a, greatest(x, y) as b, count(*) as weight from l where x <> y group by 1, 2)"""


def _edges(spark, sf):
    return T.cooccurrence(_docs(spark, sf), "text", 5, STOP)


@query(f"{_CO} select a, b, weight from co")
def cooccurrence_edges(spark, sf):
    return _edges(spark, sf)


@query(f"{_CO}, e as (select a, b from co where weight >= 5 union select b, a from co where weight >= 5), h1 as (select distinct b as node from e where a = 'license'), h2 as (select distinct e.b as node from e join h1 on e.a = h1.node) select node, min(hops) as hops from (select 'license' as node, 0 as hops union all select node, 1 from h1 union all select node, 2 from h2) group by 1")
def graph_expand(spark, sf):
    return expand(spark.createDataFrame([("license",)], "node string"), _edges(spark, sf), 2, 5)


_EM = f"""with {_TERMS}, {SQL_DOC}, w as (select date_trunc('week', ts)::date as week, term, count(*) as n from t join doc on signal_id = doc_id where term not in {_IN(STOP)} group by 1, 2), k as (select week, term from (select *, row_number() over (partition by week order by n desc, term) as r from w) where r <= 20)"""


@query(f"""{_EM}, wk as (select distinct week from k), n as (select a.week, a.term from k a left join k b on b.week = a.week - 7 and b.term = a.term where b.term is null),
g as (select wk.week, b.term from wk join k b on b.week = wk.week - 7 left join k a on a.week = wk.week and a.term = b.term where a.term is null),
f as (select week, count(*) as c, string_agg(term, ',' order by term) filter (where r <= 10) as l from (select *, row_number() over (partition by week order by term) as r from n) group by 1),
h as (select week, count(*) as c, string_agg(term, ',' order by term) filter (where r <= 10) as l from (select *, row_number() over (partition by week order by term) as r from g) group by 1)
select strftime(wk.week, '%Y-%m-%d') as week, coalesce(f.c, 0) as n_new, coalesce(f.l, '') as new_terms, coalesce(h.c, 0) as n_lost, coalesce(h.l, '') as lost_terms from wk left join f using (week) left join h using (week)""")
def term_emergence(spark, sf):
    """Of the 20 most frequent terms of each week: those that the week before didn't have, and those that it had; the first ten of each."""
    d = text_signals(spark, sf).select(F.col("signal_id").alias("doc_id"), "text", F.to_date(F.date_trunc("week", "ts")).alias("week"))
    c = T.terms(d, ["week"], "text").where(~F.col("term").isin(*STOP)).groupBy("week", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("week").orderBy(F.desc("n"), "term")
    top = c.withColumn("r", F.row_number().over(w)).where("r <= 20").groupBy("week").agg(F.collect_set("term").alias("terms"))
    before = top.select(F.date_add("week", 7).alias("week"), F.col("terms").alias("old"))
    none = F.array().cast("array<string>")
    j = top.join(before, "week", "left").withColumn("old", F.coalesce("old", none))
    new, lost = F.sort_array(F.array_except("terms", "old")), F.sort_array(F.array_except("old", "terms"))
    first = lambda x, name: F.array_join(F.slice(x, 1, 10), ",").alias(name)
    n = lambda x, name: F.size(x).cast("long").alias(name)
    return j.select(F.date_format("week", "yyyy-MM-dd").alias("week"), n(new, "n_new"), first(new, "new_terms"), n(lost, "n_lost"), first(lost, "lost_terms"))


# Rules of typed entities. A person type is never produced.
ORG = r"[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)* (?:License|Foundation|Institute|University|Council|Inc|Ltd|Corp|GmbH)"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}|(?:19|20)[0-9]{2}"


@query(f"""with recursive {SQL_MATCHES}, m as (select text_id, 'ORG' as kind, unnest(regexp_extract_all(text, '{ORG}')) as entity from notes union all select text_id, 'DATE', unnest(regexp_extract_all(text, '{DATE}')) from notes
union all select text_id, kind, entity from hit) select text_id, kind, entity, count(*) as n from m group by all""")
def entity_extract(spark, sf):
    """Typed entities of each text, with counts: organisations and dates by rules, places and products by a trie of names from the tables."""
    return T.entities(place_texts(spark, sf), "text_id", "text", {"ORG": ORG, "DATE": DATE}, place_names(spark, sf))


_PL = "('the', 'der', 'les', 'del', 'und')"


@query(f"with recursive {SQL_MATCHES} select entity as place, count(distinct text_id) as n_texts from hit where kind = 'PLACE' group by 1")
def location_entities(spark, sf):
    """In how many texts each place is named."""
    got = name_matches(place_texts(spark, sf), place_names(spark, sf), "text", "text_id").where("kind = 'PLACE'").select("text_id", "entity").distinct()
    return got.groupBy(F.col("entity").alias("place")).agg(F.count(F.lit(1)).alias("n_texts"))


TRIGGERS = [("the", "report"), ("and", "meeting"), ("der", "protest"), ("les", "notice"), ("que", "filing")]
_TR = "(values " + ", ".join(f"('{t}', '{k}')" for t, k in TRIGGERS) + ") as g(term, kind)"


def _triggers(spark, sf):
    g = spark.createDataFrame(TRIGGERS, "term string, kind string")
    return T.terms(_docs(spark, sf), ["doc_id"], "text").join(F.broadcast(g), "term")


@query(f"with {_TERMS}, h as (select doc_id, kind, count(*) as n from t join {_TR} using (term) group by 1, 2) select d.doc_id, coalesce(k, 'other') as kind from documents d left join (select doc_id, arg_max(kind, (n, kind)) as k from h group by 1) using (doc_id)")
def event_type_classify(spark, sf):
    h = _triggers(spark, sf).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max_by("kind", F.struct("n", "kind")).alias("k"))
    return _docs(spark, sf).select("doc_id").join(h, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit("other")).alias("kind"))


EVENT_TERMS = [("order", "filing"), ("license", "notice"), ("rights", "notice"), ("token", "report"), ("widget", "delivery"), ("ring", "delivery"), ("gear", "delivery")]
_SENT = SQL_MATCHES.replace("notes as (", "whole as (", 1).replace("nw as (", """sn as materialized (select text_id || '#' || (k - 1) as sid, text_id as id, k - 1 as pos, trim(sentence) as sentence from (select text_id, unnest(sp) as sentence, unnest(range(1, len(sp) + 1)) as k from (select text_id, regexp_split_to_array(text, '[.!?]+[ \n]+') as sp from whole)) where length(trim(sentence)) > 0),
notes as (select sid as text_id, sentence as text from sn), nw as (""", 1)
_EVENTS = f"""with recursive {_SENT}, kd as (select sid, arg_min(kind, (-n, kind)) as event_type from (select sid, kind, count(*) as n from (select distinct sid, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+')) as term from sn) join (values {', '.join(f"('{t}', '{k}')" for t, k in EVENT_TERMS)}) as g(term, kind) using (term) group by 1, 2) group by 1),
pl as (select text_id as sid, arg_min(entity, s) as place from hit where kind = 'PLACE' group by 1), dt as (select sn.*, nullif(regexp_extract(sentence, '{DATE}'), '') as date, place from sn left join pl using (sid)),
fi as (select id, arg_min(date, pos) filter (where date is not null) as any_date, arg_min(place, pos) filter (where place is not null) as any_place from dt group by 1),
ev as (select id as text_id, pos::int as pos, event_type, coalesce(date, any_date) as date, coalesce(place, any_place) as place, substr(sentence, 1, 300) as text from dt join kd using (sid) join fi using (id))"""


def _events(spark, sf):
    t = spark.createDataFrame(EVENT_TERMS, "term string, kind string")
    return T.events(place_texts(spark, sf), "text_id", "text", t, place_names(spark, sf), DATE)


@query(f"{_EVENTS} select text_id, pos, event_type, date, place, text from ev")
def event_extract(spark, sf):
    """Events: sentences with a trigger, their type, date and place."""
    return _events(spark, sf)


@query(f"{_EVENTS} select text_id, pos, event_type, place, strftime(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%d %B %Y'), try_strptime(date, '%Y')), '%Y-%m-%d') as at from ev")
def event_timeline(spark, sf):
    """Events by their dates, those without one at the end."""
    at = F.coalesce(*[F.to_date(F.try_to_timestamp("date", F.lit(f))) for f in ("yyyy-MM-dd", "d MMMM yyyy", "yyyy")])
    return _events(spark, sf).withColumn("at", at).orderBy(F.asc_nulls_last("at"), "text_id", "pos").select("text_id", "pos", "event_type", "place", F.date_format("at", "yyyy-MM-dd").alias("at"))


@query(f"with {_TERMS}, h as (select doc_id, count(*) as words, count(*) filter (where term in {_IN(BOOST)}) as hits, count(*) filter (where term in {_PL}) as ents, count(*) filter (where term in {_IN([t for t, _ in TRIGGERS])}) as trig from t group by 1) select doc_id, round(least(5.0 * hits / words, 0.5) + least(10.0 * ents / words, 0.25) + least(trig / 10, 0.25), 6) as relevance from h")
def civic_relevance(spark, sf):
    places = ["the", "der", "les", "del", "und"]
    t = T.terms(_docs(spark, sf), ["doc_id"], "text")
    n = lambda xs: F.count_if(F.col("term").isin(*xs))
    h = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), n(BOOST).alias("hits"), n(places).alias("ents"), n([x for x, _ in TRIGGERS]).alias("trig"))
    score = F.least(5.0 * F.col("hits") / F.col("words"), F.lit(0.5)) + F.least(10.0 * F.col("ents") / F.col("words"), F.lit(0.25)) + F.least(F.col("trig") / 10, F.lit(0.25))
    return h.select("doc_id", F.round(score, 6).alias("relevance"))


@query(f"with {_TERMS}, c as (select lang, term, count(*) as n from t group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, term) as k from c) select lang, string_agg(term || '=' || n, ',' order by k) as top from r where k <= 5 group by 1")
def entity_summary(spark, sf):
    c = T.terms(_docs(spark, sf), ["lang"], "text").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    r = c.withColumn("k", F.row_number().over(w)).where("k <= 5")
    return r.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term", "n"))), lambda x: F.concat_ws("=", x["term"], x["n"].cast("string"))), ",").alias("top"))
