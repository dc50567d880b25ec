"""LDA whose rounds read all texts, against plain sums."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import grams as R
from loomstat.operators import groups as G
from loomstat.operators import lda as L

ONE, TWO = "budget vote council meeting chamber".split(), "river flood water bridge rain".split()


def texts(n: int) -> list[tuple[int, str]]:
    """(id, text): odd ones of one theme, even ones of another."""
    return [(k, " ".join(random.Random(k).choices(ONE if k % 2 else TWO, k=30))) for k in range(n)]


def test_a_handful_of_texts_is_enough(spark):
    """the model came from five samples of a twentieth of the texts, which hold none of six texts as a rule: its topics were those of the random start."""
    for seed in (1, 2, 42):
        got = {r["id"]: (r["topic"], r["words"]) for r in G.topics(spark.createDataFrame(texts(6), "id int, text string"), "id", "text", 2, 10, [], words=5, seed=seed).collect()}
        assert set(got) == set(range(6))
        for theme, mine in ((ONE, (1, 3, 5)), (TWO, (0, 2, 4))):
            assert len({got[k] for k in mine}) == 1
            assert {w for term in got[mine[0]][1].split(",") for w in term.split()} <= set(theme)


def test_every_word_of_every_text_counts_once(spark, monkeypatch):
    """over all topics, a term's weights are its prior and how often all texts have it."""
    monkeypatch.setattr(L, "AT_ONCE", 16)
    rows = [(k, x.split() if x else None) for k, x in [*texts(50), (90, ""), (91, None)]]
    held = [*ONE, *TWO[:3], "never"]
    v = L.counted(spark.createDataFrame(rows, "id int, terms array<string>").repartition(3), held)
    assert {r["id"]: dict(zip(r["at"], r["n"])) for r in v.collect()} == {k: dict(Counter(held.index(w) for w in x or [] if w in held)) for k, x in rows}
    total = Counter(w for _, x in rows for w in x or [])
    for rounds in (1, 4):
        monkeypatch.setattr(L, "ROUNDS", rounds)
        assert L.fit(v, 3, len(held), 42).sum(axis=0) == pytest.approx([1 + total[w] for w in held], abs=1e-3)


def test_runs_are_counted_where_they_are_found(spark, monkeypatch):
    """the lists of places and counts stand for the same runs as the list of all their occurrences."""
    monkeypatch.setattr(R, "TOKENS", 50)
    d = spark.createDataFrame([*texts(30), (90, ""), (91, None)], "id int, text string").repartition(3).select("id", R.found("text", ["river"]).alias("w"))
    held, listed = R.most_frequent(d, 25)
    again, counts = R.most_frequent(d, 25, counts=True)
    assert again == held and len(held) == 25
    want = {r["id"]: Counter(r["terms"]) for r in listed.collect()}
    assert {r["id"]: {held[p]: n for p, n in zip(r["at"], r["n"])} for r in counts.collect()} == want and len(want) == 32


def test_topics_depend_on_neither_order_nor_tasks(spark):
    d = spark.createDataFrame(texts(60), "id int, text string")
    got = [{tuple(r) for r in G.topics(x, "id", "text", 3, 40, []).collect()} for x in (d.coalesce(1), d.repartition(7), d.orderBy(F.desc("id")))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 60


def test_mixtures_equal_plain_steps():
    rng = np.random.default_rng(7)
    weights, prior = rng.random((3, 9)), 1 / 3
    size = np.array([4, 0, 9, 1, 0])
    at = np.concatenate([np.sort(rng.choice(9, s, replace=False)) for s in size])
    n = rng.integers(1, 6, len(at)).astype(float)
    slope = lambda x: (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5
    assert L.digamma(np.array([0.01, 0.3, 1.0, 7.5, 4e4])) == pytest.approx([slope(x) for x in (0.01, 0.3, 1.0, 7.5, 4e4)], rel=1e-4)
    got = L.mixtures(at, n, size, weights, prior, 1e-9, False, 1000)
    for row, (lo, s) in enumerate(zip(np.cumsum(size) - size, size)):
        mine = [prior + n[lo : lo + s].sum() / 3] * 3 if s else [prior] * 3
        for _ in range(1000 if s else 0):
            theta = [math.exp(slope(x) - slope(sum(mine))) for x in mine]
            parts = [[theta[t] * weights[t, w] for t in range(3)] for w in at[lo : lo + s]]
            mine = [prior + sum(c * p[t] / sum(p) for c, p in zip(n[lo : lo + s], parts)) for t in range(3)]
        assert got[row] == pytest.approx(mine, rel=1e-3)
