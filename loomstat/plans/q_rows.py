"""Queries on row normalisation, projection and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import normalize as N
from ..operators import rules as R
from ..operators.slices import counts_within
from ..sources.adapters import AS_OF, BOX, SQL_DOC, SQL_EV, SQL_MATCHES, SQL_RECORDS, SQL_REGIONS, as_of, event_signals, place_names, place_texts, records, regions, table, text_signals
from .base import query

TARGETS = ["01101", "01249", "01582", "01138"]
_T = "('01101', '01249', '01582', '01138')"


def _rules_sql(col: str, what: str) -> str:
    out = "case"
    for p, c in N.SOURCE_RULES:
        out += f" when contains(lower({col}), '{p}') then " + (f"'{c}'" if what == "class" else str(N.CLASS_WEIGHT[c]))
    return out + (" else 'other' end" if what == "class" else " else 0.3 end")


@query(f"""with {SQL_EV} select signal_id, region, source, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(weight, 6) as weight,
{_rules_sql('source', 'class')} as source_class, {_rules_sql('source', 'weight')}::double as source_weight from ev""")
def normalize_signal(spark, sf):
    e = event_signals(spark, sf)
    cls = N.classify(F.col("source"), N.SOURCE_RULES)
    w = N.source_weight(F.col("source"), {}, N.SOURCE_RULES, N.CLASS_WEIGHT)
    return e.select("signal_id", N.pad_region(F.col("region")).alias("region"), "source", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("weight", 6).alias("weight"), cls.alias("source_class"), w.alias("source_weight"))


@query(f"with {SQL_EV} select region in {_T} as accepted, count(*) as n from ev group by 1")
def valid_region_filter(spark, sf):
    e = event_signals(spark, sf)
    return e.groupBy(N.pad_region(F.col("region")).isin(*TARGETS).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV} select source, {_rules_sql('source', 'weight')}::double as weight, count(*) as n from ev group by 1, 2")
def source_weight_lookup(spark, sf):
    e = event_signals(spark, sf)
    return e.groupBy("source", N.source_weight(F.col("source"), {}, N.SOURCE_RULES, N.CLASS_WEIGHT).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SQL_EV} select {_rules_sql('source', 'class')} as source_class, count(*) as n from ev group by 1")
def source_class_regex(spark, sf):
    return event_signals(spark, sf).groupBy(N.classify(F.col("source"), N.SOURCE_RULES).alias("source_class")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when contains(lower(source), 'src1') then 'official' when contains(lower(source), 'src2') then 'news' else 'other' end as source_class, count(*) as n from documents group by 1")
def source_class_substring(spark, sf):
    rules = [("src1", "official"), ("src2", "news")]
    return table(spark, sf, "documents").groupBy(N.classify(F.coalesce("source", F.lit("")), rules, regex=False).alias("source_class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {SQL_EV} select region, count(*) filter (where c = 'news') as news, count(*) filter (where c = 'community') as community,
count(*) filter (where c = 'advocacy') as advocacy, count(*) filter (where c = 'official') as official, count(*) filter (where c not in ('news', 'community', 'advocacy', 'official')) as other
from (select region, {_rules_sql('source', 'class')} as c from ev) group by region""")
def source_bucket(spark, sf):
    e = event_signals(spark, sf).withColumn("c", N.classify(F.col("source"), N.SOURCE_RULES))
    named = ["news", "community", "advocacy", "official"]
    return e.groupBy("region").agg(*[F.count_if(F.col("c") == k).alias(k) for k in named], F.count_if(~F.col("c").isin(*named)).alias("other"))


@query(f"with {SQL_EV} select {_rules_sql('source', 'class')} || ' source' as display, count(*) as n from ev group by 1")
def source_display_category(spark, sf):
    return event_signals(spark, sf).groupBy(F.concat(N.classify(F.col("source"), N.SOURCE_RULES), F.lit(" source")).alias("display")).agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, source, case when contains(lower(text), 'license') then 'legal' when contains(lower(text), '@') then 'contact'
when contains(lower(text), ' the ') then 'english' else 'other' end as source_category from documents""")
def source_category_from_text(spark, sf):
    rules = [("license", "legal"), ("@", "contact"), (" the ", "english")]
    return table(spark, sf, "documents").select("doc_id", "source", N.classify(F.col("text"), rules, regex=False).alias("source_category"))


@query("""with d as (select o_orderkey, o_orderdate::date as d, o_orderkey % 4 as k from orders)
select o_orderkey, strftime(d, '%Y-%m-%d') as parsed from d""")
def date_parse_multi(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 4).alias("k"))
    text = F.when(F.col("k") == 0, F.date_format("d", "yyyy-MM-dd")).when(F.col("k") == 1, F.date_format("d", "MM/dd/yyyy")).when(F.col("k") == 2, F.date_format("d", "yyyyMMdd")).otherwise(F.date_format("d", "MMMM d, yyyy"))
    return o.select("o_orderkey", F.date_format(N.parse_date(text), "yyyy-MM-dd").alias("parsed"))


@query("""select o_orderkey, strftime(o_orderdate::date, '%Y-%m-%d') as found from orders""")
def date_from_text(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("Minutes of the meeting held on "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd")).otherwise(F.date_format(F.to_date("o_orderdate"), "MM/dd/yyyy")), F.lit(", room 4"))
    return o.select("o_orderkey", F.date_format(N.date_in_text(text), "yyyy-MM-dd").alias("found"))


@query(f"with {SQL_EV} select region, count(*) as n from ev where ts >= timestamp '2024-01-24 00:00:00' group by 1")
def lookback_filter(spark, sf):
    e = event_signals(spark, sf)
    return e.where(F.col("ts") >= as_of() - F.expr("interval 7 days")).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with a as (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as t from pages),
b as (select page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as t from a)
select page_id, trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')) as text from b""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.html_to_text(F.col("html")).alias("text"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r]+', '', 'g'), '[ \t\n\r]+', ' ', 'g')) as cleaned from documents""")
def text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.clean_text(F.col("text")).alias("cleaned"))


@query("select doc_id, substr(concat_ws('. ', nullif(source, ''), nullif(text, '')), 1, 500) as body from documents")
def title_body_concat(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.title_body(F.col("source"), F.col("text")).alias("body"))


@query(r"select doc_id from documents where regexp_matches(text, '(?i)(license|token|rights)')")
def keyword_relevance_filter(spark, sf):
    return table(spark, sf, "documents").where(N.has_term(F.col("text"), ["license", "token", "rights"], whole=False)).select("doc_id")


@query("select doc_id from documents where lang <> 'en' or contains(lower(text), 'the')")
def conditional_relevance_filter(spark, sf):
    return table(spark, sf, "documents").where((F.col("lang") != "en") | F.lower("text").contains("the")).select("doc_id")


@query(r"""select doc_id, coalesce(nullif(regexp_extract(t, '\b([0-9]{5})\b', 1), ''), '01582') as region from (select doc_id, case when doc_id % 3 = 0 then '01249 ' || text else text end as t from documents)""")
def region_from_text(spark, sf):
    d = table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("01249 "), F.col("text"))).otherwise(F.col("text"))
    return d.select("doc_id", N.region_in_text(t, "01582").alias("region"))


_PLACES = [("the", "01101"), ("der", "01249"), ("les", "01582"), ("del", "01138"), ("und", "01286")]
_PLACES_SQL = "(values " + ", ".join(f"('{p}', '{r}')" for p, r in _PLACES) + ") as g(place, region)"


@query(f"with recursive {SQL_MATCHES} select text_id, count(*) as n_places, string_agg(distinct entity, ',' order by entity) as places from hit where kind = 'PLACE' group by 1")
def gazetteer_match_all(spark, sf):
    """Places that each text names, by names of several words and aliases; the longest name counts."""
    got = N.name_matches(place_texts(spark, sf), place_names(spark, sf), "text", "text_id").where("kind = 'PLACE'")
    return got.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_places"), F.array_join(F.sort_array(F.collect_set("entity")), ",").alias("places"))


@query(f"""with w as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) as place from documents),
p as (select doc_id, min(region) as by_place from w join {_PLACES_SQL} using (place) group by doc_id),
c as (select doc_id, nullif(regexp_extract(text, '\\b([0-9]{{5}})\\b', 1), '') as by_code from documents)
select doc_id, coalesce(by_code, by_place) as region, case when by_code is not null then 0.5 else 0.3 end::double as confidence from c left join p using (doc_id) where coalesce(by_code, by_place) is not null""")
def location_confidence(spark, sf):
    d = table(spark, sf, "documents")
    g = spark.createDataFrame(_PLACES, "place string, region string")
    place = N.gazetteer_matches(d, g, "text", "doc_id").groupBy("doc_id").agg(F.min("region").alias("by_place"))
    code = F.nullif(F.regexp_extract("text", r"\b([0-9]{5})\b", 1), F.lit(""))
    got = d.select("doc_id", code.alias("by_code")).join(place, "doc_id", "left")
    best = F.array_max(F.array_compact(F.array(F.when(F.col("by_code").isNotNull(), F.struct(F.lit(0.5).alias("c"), F.col("by_code").alias("r"))), F.when(F.col("by_place").isNotNull(), F.struct(F.lit(0.3).alias("c"), F.col("by_place").alias("r"))))))
    return got.withColumn("best", best).where("best is not null").select("doc_id", F.col("best.r").alias("region"), F.col("best.c").alias("confidence"))


@query(f"""with w as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) as place from documents),
p as (select doc_id, list(distinct region) as found from w join {_PLACES_SQL} using (place) group by doc_id),
j as (select d.doc_id, found, case d.lang when 'en' then ['01101'] when 'de' then ['01249', '01286'] when 'fr' then ['01582'] else ['01138'] end as expected from documents d left join p using (doc_id)),
s as (select doc_id, case when found is null then 0.4 when len(list_intersect(found, expected)) = len(found) then 0.85 when len(list_intersect(found, expected)) > 0 then 0.65 else 0.0 end::double as confidence from j)
select doc_id, confidence, case when confidence >= 0.65 then 'accept' when confidence >= 0.4 then 'review' else 'reject' end as status from s""")
def geo_validate(spark, sf):
    d = table(spark, sf, "documents")
    g = spark.createDataFrame(_PLACES, "place string, region string")
    found = N.gazetteer_matches(d, g, "text", "doc_id").groupBy("doc_id").agg(F.collect_set("region").alias("found"))
    expected = F.when(F.col("lang") == "en", F.array(F.lit("01101"))).when(F.col("lang") == "de", F.array(F.lit("01249"), F.lit("01286"))).when(F.col("lang") == "fr", F.array(F.lit("01582"))).otherwise(F.array(F.lit("01138")))
    both = F.size(F.array_intersect("found", "expected"))
    conf = F.when(F.col("found").isNull(), 0.4).when(both == F.size("found"), 0.85).when(both > 0, 0.65).otherwise(0.0)
    got = d.select("doc_id", expected.alias("expected")).join(found, "doc_id", "left").select("doc_id", conf.alias("confidence"))
    return got.withColumn("status", F.when(F.col("confidence") >= 0.65, "accept").when(F.col("confidence") >= 0.4, "review").otherwise("reject"))


@query(f"with {SQL_REGIONS}, s as (select distinct source from documents where source is not null) select source, count(region) as n_regions from s join regions on contains(source, substr(region, 5, 1)) or not exists (select 1 from regions r where contains(source, substr(r.region, 5, 1))) group by source")
def infer_source_regions(spark, sf):
    s = table(spark, sf, "documents").select("source").where("source is not null").distinct()
    r = regions(spark).select("region")
    # The region dimension is small and fixed, so it is an array in each row rather than a join.
    codes = F.array(*[F.lit(x["region"]) for x in r.collect()])
    hit = F.filter(codes, lambda c: F.col("source").contains(F.substring(c, 5, 1)))
    return s.select("source", F.size(F.when(F.size(hit) > 0, hit).otherwise(codes)).cast("long").alias("n_regions"))


def _scrub_sql(col: str) -> str:
    for p, m in N.SCRUB:
        col = f"regexp_replace({col}, '{p}', '{m}', 'g')"
    return col


@query(f"select doc_id, {_scrub_sql('text')} as scrubbed from documents")
def pii_scrub(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.scrub(F.col("text")).alias("scrubbed"))


_COUNTS = ", ".join(f"len(regexp_extract_all(s, '\\[{m}\\]')) as n_{m.lower()}" for m in N.MARKER_TYPES)


@query(f"with a as (select doc_id, {_scrub_sql('text')} as s, text from documents) select doc_id, {_COUNTS}, s = text as is_clean from a")
def pii_detect_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *N.scrub_counts(F.col("text")), (N.scrub(F.col("text")) == F.col("text")).alias("is_clean"))


@query(f"with a as (select doc_id, {_scrub_sql('text')} as s, text from documents) select doc_id, sha256(text) as original_sha256, concat_ws(',', " + ", ".join(f"case when contains(s, '[{m}]') then '{m}' end" for m in N.MARKER_TYPES) + ") as types from a where s <> text")
def pii_audit_row(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", N.scrub(F.col("text")).alias("s")).where("s <> text")
    kinds = F.concat_ws(",", *[F.when(F.col("s").contains(f"[{m}]"), F.lit(m)) for m in N.MARKER_TYPES])
    return d.select("doc_id", F.sha2("text", 256).alias("original_sha256"), kinds.alias("types"))


@query(r"select doc_id, regexp_replace(text, '(?i)\b(license|password|token)\b', '[redacted]', 'g') as redacted from documents")
def forbidden_term_redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.redact_terms(F.col("text"), ["license", "password", "token"]).alias("redacted"))


@query(r"select doc_id from documents where not regexp_matches(text, '(?i)\b(license|password|token)\b')")
def forbidden_term_filter(spark, sf):
    return table(spark, sf, "documents").where(~N.has_term(F.col("text"), ["license", "password", "token"])).select("doc_id")


@query(f"""with {SQL_DOC} select signal_id, concat_ws(',', case when length(trim(text)) < 10 then 'text_too_short' end, case when length(text) > 2000 then 'text_too_long' end,
case when language not in ('en', 'de') then 'bad_category' end, case when ts > timestamp '2024-01-20' then 'future_date' end) as errors from doc""")
def submission_validate(spark, sf):
    d = text_signals(spark, sf)
    errors = N.submission_errors(F.col("text"), F.col("region"), F.col("language"), F.col("ts"), F.to_timestamp(F.lit("2024-01-20 00:00:00")), ["en", "de"])
    return d.select("signal_id", F.array_join(errors, ",").alias("errors"))


@query(f"""with {SQL_EV}, c as (select signal_id, count(*) over (partition by region, source order by epoch_us(ts) range between 3600000000 preceding and current row) as n from ev)
select signal_id, n, n <= 2 as accepted from c""")
def trailing_rate_limit(spark, sf):
    c = counts_within(event_signals(spark, sf), ["region", "source"], 3_600_000_000, 0)
    return c.select("signal_id", F.col("k").alias("n"), (F.col("k") <= 2).alias("accepted"))


@query("select left(url, 8) as scheme, count(*) as n from pages where starts_with(url, 'http://') or starts_with(url, 'https://') group by 1")
def url_validate(spark, sf):
    p = table(spark, sf, "pages")
    urls = F.slice(F.filter(F.array("url"), lambda u: u.startswith("http://") | u.startswith("https://")), 1, 5)
    return p.select(F.explode(urls).alias("url")).groupBy(F.substring("url", 1, 8).alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when contains(lower(text), 'token') then 'security' when contains(lower(text), 'license') then 'legal' when contains(lower(text), ' and ') then 'prose' else 'general' end as theme from documents")
def theme_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.classify(F.col("text"), [("token", "security"), ("license", "legal"), (" and ", "prose")], "general", regex=False).alias("theme"))


@query(r"""with m as (select conv_id, turn, case when turn % 2 = 0 then '01582 ' || text else text end as t from conversations)
select conv_id, turn, nullif(regexp_extract(t, '\b([0-9]{5})\b', 1), '') as region, trim(regexp_replace(t, '\b[0-9]{5}\b', '')) as body, case when contains(lower(t), '?') then 'question' else 'report' end as category from m""")
def message_parse(spark, sf):
    c = table(spark, sf, "conversations")
    c = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("01582 "), F.col("text"))).otherwise(F.col("text")).alias("t"))
    code = F.nullif(F.regexp_extract("t", r"\b([0-9]{5})\b", 1), F.lit(""))
    body = F.trim(F.concat(F.regexp_replace("t", r"(?s)^(.*?)\b[0-9]{5}\b.*$", "$1"), F.regexp_replace("t", r"(?s)^.*?\b[0-9]{5}\b(.*)$", "$1")))
    return c.select("conv_id", "turn", code.alias("region"), F.when(code.isNull(), F.trim("t")).otherwise(body).alias("body"), F.when(F.col("t").contains("?"), "question").otherwise("report").alias("category"))


def _judged(spark, sf):
    return R.judged(records(spark, sf), regions(spark).select(F.col("region").alias("zip")), BOX, AS_OF[:10])


@query(f"with {SQL_RECORDS} select record_id, errors, warnings, errors = '' as valid from jd")
def record_rules(spark, sf):
    """Broken rules of each record, of 16 in five groups, by severity."""
    return _judged(spark, sf).select("record_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid")


_N = "sum(case when {0} = '' then 0 else len(string_split({0}, ',')) end)::bigint"


@query(f"with {SQL_RECORDS} select count(*) as total, count(*) filter (where errors = '') as n_valid, {_N.format('errors')} as n_errors, {_N.format('warnings')} as n_warnings, round(100 * {_N.format('errors')} / count(*), 2) as error_rate from jd")
def record_error_rate(spark, sf):
    return R.rates(_judged(spark, sf))


@query(f"""with {SQL_RECORDS} select record_id, strftime(day, '%Y-%m-%d') as date, case when length(regexp_replace(zip, '[^0-9]', '', 'g')) = 5 then regexp_replace(zip, '[^0-9]', '', 'g') end as zip,
case when intensity is null then 1 else greatest(0, least(10, floor(intensity + 0.5))) end::double as intensity, case when lower(trim(source_type)) in ('news', 'community', 'official', 'verified') then lower(trim(source_type)) else 'unknown' end as source_type,
case when lower(trim(trend)) in ('increasing', 'decreasing', 'stable') then lower(trim(trend)) else 'stable' end as trend from jd where errors = ''""")
def record_clean(spark, sf):
    """Records without a critical fault, normalised."""
    return R.cleaned(_judged(spark, sf)).select("record_id", "date", "zip", "intensity", "source_type", "trend")


@query("select count(*) filter (where text is null) as missing_text, count(*) filter (where source is null) as missing_source, count(*) filter (where length(text) < 50) as short_text, count(*) as n from documents")
def expected_fields_check(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count_if(F.col("text").isNull()).alias("missing_text"), F.count_if(F.col("source").isNull()).alias("missing_source"), F.count_if(F.length("text") < 50).alias("short_text"), F.count(F.lit(1)).alias("n"))
