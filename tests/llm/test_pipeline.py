"""The corpus pipeline: stages' columns, effects and hard rows."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from loomstat.llm import common, packing

HARD = [(900001, None, None, None, None), (900002, "", "en", "a", 0), (900003, "same text here for two rows " * 30, "en", "a", 5), (900003, "same text here for two rows " * 30, "en", "a", 5), (None, "id is null but the text is fine, really", "en", "b", 1), (900006, "a long text that goes on and on, with words such as " + " ".join(f"w{k} and more of it." for k in range(30_000)), "en", None, 1)]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(HARD, docs.schema)).withColumn("extra", F.lit(1))
    names = list(corpus_pipeline.COLUMNS)
    now, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == names, name
            now = corpus_pipeline.cut(now)
        kept[name] = now.count()
    first = docs.count()
    assert first > kept["quality_classifier"] > kept["ngram_jaccard_join"] == kept["pii"] == kept["source_mix"]
    assert now.where("length > 4096 or offset <> 0").count() == 0


def test_run_leaves_only_what_it_returns(spark, sf):
    """Tables that stages wrote for themselves go; the result can still be read."""
    before = set(common.MADE)
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    assert len(set(common.MADE) - before) <= 2


def test_filters_keep_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, sf).select("doc_id").withColumn("kept", F.lit(1))
    j = labels.join(docs.select("doc_id"), "doc_id").join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share"))
    share = {r["quality"]: r["share"] for r in j.collect()}
    assert share[1] > 0.97 and share[0] < 0.2


def test_packed_holds_all_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.packed(spark, docs, sf)
    t = packing.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.hf.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert got.agg(F.sum("length")).first()[0] == want


def test_sequences_follow_the_mix(spark, tmp_path):
    """On several files, of which later ones are larger, sequence_id follows the schedule, and its prefixes keep the target weights."""
    sizes = {"a": 3200, "b": 800, "c": 200}
    rows = [(k, "en", s) for k, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string")
    place = {r["doc_id"]: r["position"] for r in corpus_pipeline.pfair.mix(docs).collect()}
    # Texts grow along the mix, so a scan by file size would start with the last file.
    texts = spark.createDataFrame([(k, " ".join(f"w{k}" for _ in range(1 + p // 40))) for k, p in place.items()], "doc_id long, text string")
    docs = docs.join(texts, "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(*corpus_pipeline.COLUMNS)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 300)
    try:
        mixed = corpus_pipeline.cut(corpus_pipeline.source_mix(spark, docs, ""))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(mixed.inputFiles()) > 5
    got = corpus_pipeline.packed(spark, mixed, "").select("sequence_id", "doc_id", "start", "position").toPandas().sort_values("sequence_id")
    assert got["sequence_id"].is_unique and got["position"].is_monotonic_increasing and (got.groupby("doc_id")["start"].diff().dropna() > 0).all()
    order = got["doc_id"].drop_duplicates().tolist()
    assert order == sorted(place, key=place.get)
    weight = {s: n**0.5 for s, n in sizes.items()}
    source = {k: s for k, _, s in rows}
    for n in (128, 512, 1000):  # until c runs out
        for s, w in weight.items():
            assert abs(sum(source[k] == s for k in order[:n]) - n * w / sum(weight.values())) <= 128


def test_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
