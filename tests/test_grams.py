"""Runs of words: counted level by level, against plain counting of all runs."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstat.operators import grams as R
from loomstat.operators import groups as G

STOP = ["the", "and"]


def texts(n: int, seed: int = 1) -> list[tuple[int, int, str | None]]:
    """(id, topic, text): frequent words that often follow one another, rare words, stop words, texts without words."""
    rng = random.Random(seed)
    common, rare = ["alpha", "beta", "gamma", "delta", "the", "and", "Omega"], [a + b + c for a in "abcdef" for b in "ghij" for c in "klmnopq"]
    out: list[tuple[int, int, str | None]] = [(0, 0, None), (1, 1, ""), (2, 0, "a 12"), (3, 1, "single")]
    for k in range(4, n):
        words = []
        while len(words) < rng.randint(1, 40):
            words += ["alpha", "beta", "gamma"] if rng.random() < 0.2 else [rng.choice(common if rng.random() < 0.6 else rare)]
        out.append((k, k % 3, " ".join(words)))
    return out


def runs_of(text: str | None) -> list[str]:
    w = [x for x in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() if len(x) >= 3 and x not in STOP]
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected_words(rows, words: int = 10, least: int = 2) -> set[tuple]:
    tf = Counter((t, r) for _, t, x in rows for r in runs_of(x))
    f = Counter(r for _, t, x in rows for r in runs_of(x))
    mean = sum(tf.values()) / len({t for t, _ in tf})
    out = set()
    for topic in {t for t, _ in tf}:
        scored = sorted((-n * math.log(1 + mean / f[r]), r, n) for (t, r), n in tf.items() if t == topic and f[r] >= least)
        out |= {(topic, r, n, round(-s, 6), k) for k, (s, r, n) in enumerate(scored[:words], 1)}
    return out


def words_of(spark, rows) -> set[tuple]:
    d = spark.createDataFrame(rows, "id int, topic int, text string")
    return {(r["topic"], r["term"], r["tf"], round(r["score"], 6), r["rank"]) for r in G.topic_words(d, "topic", "text", STOP).collect()}


def test_the_most_frequent_runs_are_found_without_counting_all(spark, monkeypatch):
    """ties go to the smaller run, and no run is counted as a string."""
    from pyspark.ml.feature import CountVectorizer

    rows = texts(150)
    d = spark.createDataFrame(rows, "id int, topic int, text string").repartition(3)
    n, docs = Counter(r for *_, x in rows for r in runs_of(x)), Counter(r for *_, x in rows for r in set(runs_of(x)))
    for size in (5, 12, 40, 200, 100_000):
        want = sorted((r for r in n if docs[r] >= 2), key=lambda r: (-n[r], r))[:size]
        held, found = R.most_frequent(d.select("id", R.found("text", STOP).alias("w")), size)
        assert held == want
        got = {r["id"]: Counter(r["terms"]) for r in found.collect()}
        assert got == {k: Counter(r for r in runs_of(x) if r in set(want)) for k, _, x in rows}

    def refused(*_):
        raise AssertionError("all runs are counted as strings")

    monkeypatch.setattr(CountVectorizer, "fit", refused)
    got = {r["id"]: (r["topic"], r["words"]) for r in G.topics(d, "id", "text", k=2, vocabulary=20, stop=STOP).collect()}
    assert sorted(got) == [k for k, *_ in rows]
    assert all((got[k] == (-1, None)) == (not runs_of(x)) for k, _, x in rows)
    assert "alpha beta" in set(",".join(w for _, w in got.values() if w).split(","))


def test_topics_without_a_vocabulary_and_with_too_many_ties(spark, monkeypatch):
    lone = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, None)], "id int, text string")
    assert {tuple(r) for r in G.topics(lone, "id", "text", k=2, vocabulary=20, stop=STOP).collect()} == {(1, -1, None), (2, -1, None), (3, -1, None)}
    rows = [r for r in texts(60) if r[2] is not None]
    monkeypatch.setattr(R, "MOST_RUNS", 3)
    got = G.topics(spark.createDataFrame(rows, "id int, topic int, text string"), "id", "text", k=2, vocabulary=20, stop=STOP).collect()
    assert all((r["topic"] == -1) == (not runs_of(x)) for r in got for k, _, x in rows if k == r["id"]) and len(got) == len(rows)


@pytest.mark.parametrize("n", [12, 60, 300])
def test_topic_words_equal_plain_counting(spark, monkeypatch, n):
    """the same terms without counting all runs as strings; where too many words could matter, by counting them all."""
    rows = texts(n, seed=n)
    want = expected_words(rows)
    if n == 300:
        monkeypatch.setattr(R, "MOST_RUNS", 3)
        assert words_of(spark, rows) == want
        monkeypatch.undo()
    monkeypatch.setattr(G, "ngrams", None)
    assert words_of(spark, rows) == want


def test_texts_are_dealt_in_slices(spark, monkeypatch):
    """what one task reads depends on the characters of its texts, not on how many texts the table or its first file has."""
    monkeypatch.setattr(R, "SLICE", 1000)
    d = spark.createDataFrame([(1, "word " * 20)] * 400, "topic int, text string").coalesce(1)
    read = [r["n"] for r in R.dealt(d, "text").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(read) == 40 and max(read) <= 30


def test_rows_are_cut_between_texts(monkeypatch):
    monkeypatch.setattr(R, "TOKENS", 3)
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, None, 1]), pa.array([["a", "b"], None, ["c"] * 5, ["d"]])], ["g", "w"])
    got = [(g.to_pylist(), w.to_pylist(), row.tolist()) for g, w, row in R.pieces(iter([b]))]
    assert got == [([1, 2], ["a", "b"], [0, 0]), ([None], ["c"] * 5, [0] * 5), ([1], ["d"], [0])]
    *_, (key, fine) = R.runs(np.array([0, 1, 2, 0, 1, -1]), np.array([0, 0, 0, 1, 1, 1]), 3, [None])
    assert key[fine].tolist() == [1, 5, 1]
