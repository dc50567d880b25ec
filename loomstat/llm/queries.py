"""Registered queries of the text-corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fst_tokens, langid, multiindex, ngram_join, packing, pfair, pii, quality, ranked_search, resample, token_files, topk, url_filter
from .common import table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, RULES))


OP1_SQL = """
with a as (select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
r as (select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')) as r(verdict, h, p)),
u as (select distinct host, path from c),
best as (select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
         from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from c left join best using (host, path)
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with recursive d as (select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text <> ''),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                               when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 5 * i >= 4 * (x.n + y.n - i)
      union select x.doc_id, y.doc_id from d x join d y on x.text = y.text and x.doc_id <> y.doc_id),
r(a, c) as (select doc_id, doc_id from documents union select l.a, r.c from l join r on l.b = r.a),
m as (select a as doc_id, min(c) as component_id from r group by a),
k as (select a as doc_id, count(*) as n_links from l group by a)
select o.doc_id, case when text <> '' then min(o.doc_id) over (partition by text) else o.doc_id end as class_id,
       coalesce(n_links, 0) as n_links, component_id, o.doc_id = component_id as kept
from documents o join m using (doc_id) left join k using (doc_id)
"""


def op3_segmented_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), vocabulary)
    out = langid.predict(docs, model, vocabulary)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with recursive v as (select vec_id, embedding::double[] as x from embeddings where embedding is not null),
u as (select vec_id, list_transform(x, lambda a: a / sqrt(list_sum(list_transform(x, lambda b: b * b)))) as x from v
      where len(list_filter(x, lambda a: a is null or isnan(a) or isinf(a))) = 0 and list_sum(list_transform(x, lambda b: b * b)) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.x, b.x) >= 0.9),
r(a, c) as (select vec_id, vec_id from embeddings union select l.a, r.c from l join r on l.b = r.a),
m as (select a as vec_id, min(c) as component_id from r group by a),
k as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join m using (vec_id) left join k using (vec_id)
"""


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(table(spark, sf_dir, "documents"))


def op6_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda a: floor(256 * a::double)::bigint) as x from embeddings
           where embedding is not null and len(list_filter(embedding, lambda a: a is null or isnan(a) or isinf(a))) = 0),
p as (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda t: t[1] * t[2]))::bigint as score
      from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii.find(docs)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("found").alias("spans"))


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op9_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = quality.held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs.where(~held), table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRCs are affine in a text's bytes: each byte gives a value that depends on it and its distance from the end, and the length gives one more.
OP11_SQL = r"""
with recursive bits(k, b, x) as (select 0, b, b from range(256) t(b)
                       union all select k + 1, b, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from bits where k < 8),
one as (select b, x from bits where k = 8),
t as (select 0 as doc, doc_id, text from documents union all select 1, item_id, text from benchmark),
w as (select doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t),
f as materialized (select doc, doc_id, unnest(flatten([list_transform(range(1, len(w) + 2 - n), lambda i: array_to_string(w[i:i + n - 1], ' ')) for n in [1, 2, 3]])) as f from w where len(w) > 0),
d as materialized (select f, octet_length(encode(f)) as n, hex(encode(f)) as h from (select distinct f from f)),
far(d, b, x) as (select 0, b, x from one union all select d + 1, far.b, xor(far.x >> 8, one.x) from far join one on one.b = far.x & 255 where d < (select max(n) from d)),
bare(n, x) as (select 0, 4294967295 union all select n + 1, xor(bare.x >> 8, one.x) from bare join one on one.b = bare.x & 255 where n < (select max(n) from d)),
bb as (select f, n, unnest(range(n)) as d, unnest(list_transform(range(n), lambda i: ('0x' || substr(h, 2 * (n - i)::int - 1, 2))::bigint)) as b from d),
c as (select f, xor(xor(bit_xor(far.x::bigint), any_value(bare.x)::bigint), 4294967295) % 10000 as bucket
      from bb join far using (d, b) join bare on bare.n = bb.n group by f),
g as materialized (select doc, doc_id, bucket from f join c using (f)),
n as (select b as bucket, count(*) filter (doc = 0) as s, count(*) filter (doc = 1) as t from range(10000) r(b) left join g on g.bucket = b group by b),
a as (select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from n) + 10000)::double / ((s + 1)::double * ((select sum(t) from n) + 10000)::double)))::bigint as gain from n),
m as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from g join a using (bucket) where doc = 0 group by doc_id),
k as (select doc_id, coalesce(len(w), 0) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
      from w left join m using (doc_id) where doc = 0),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from k where words >= 20)
select doc_id, n_features, weight, score, case when rank <= (select 5 * count(*) // 100 from k where words >= 20) then rank end as rank from k left join r using (doc_id)
"""


def op12_k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with t as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as materialized (select doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from t),
q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
qt as (select item_id, term, count(*) as repeats from q group by all),
n as (select doc_id, count(*) as n from w group by 1),
s as (select count(*)::bigint as docs, sum(n)::bigint as terms from n),
p as (select doc_id, term, count(*) as tf from w where term in (select term from q) group by all),
df as (select term, count(*) as df from p group by 1),
wt as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, s),
im as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) as x from p join wt using (term) join n using (doc_id), s),
sc as (select item_id, doc_id, sum(repeats * x)::bigint as score from qt join im using (term) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from sc where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
"""


def op13_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.documents(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filter,
        op2_ngram_jaccard_join,
        op3_segmented_unigram_langid,
        op4_inverted_multi_index,
        op5_pfair_mix,
        op6_threshold_top_k,
        op7_weak_supervision_pii,
        op8_power_of_two_packing,
        op9_naive_bayes_svm,
        op10_token_counts,
        op11_importance_resampling,
        op12_k2_treap_search,
        op13_arrow_token_files,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op4_inverted_multi_index": OP4_SQL, "op6_threshold_top_k": OP6_SQL,
        "op11_importance_resampling": OP11_SQL, "op12_k2_treap_search": OP12_SQL,
    }
