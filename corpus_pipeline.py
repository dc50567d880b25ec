"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import ngram_join, packing, pfair, pii, quality
from loomstat.llm.common import MADE, cut, drop, numbered, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; the others go. It learns from all labelled documents among those that it then filters; null and empty texts, repeated rows, null ids and texts of any length are scored like any other, whole."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model, keep=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; null and empty texts all stay; of rows that repeat id and text one stays; texts of any length are compared whole."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind in brackets; n_chars follows the new text, null for a null text; repeated rows stay repeated, each with its own result; texts of any length are searched whole."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the Pfair mix of the sources (weights: square roots of their sizes): files and rows in files hold the order. Null is a source of its own; null and empty texts, repeated and null ids keep their rows; an empty table gives none."""
    return pfair.in_order(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length with their ids, one for each piece of a document; sequence_id follows the mix, position is the document's place in it. A null or empty text is one piece, the end id; repeated rows stay apart."""
    rows = numbered(docs.select("doc_id", "text"), "position")
    return packing.pack(rows, public_tokenizers.path("word_bpe_49k.json"), order_col="position")


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("pii", pii_redaction),
    ("source_mix", source_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table. What a stage wrote for itself, and its input, go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    mark = len(MADE)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            drop(spark, MADE[mark:-1])
    return docs


#: No SQL: the classifier, the mix's schedule and the tokenizer can't be expressed in it.
ORACLE_SQL = None
