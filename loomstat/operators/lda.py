"""Topics as weights of terms (LDA by variational Bayes): every round of a fit reads the counts of all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from . import grams as R
from .grams import Batches

#: Terms, or counts times topics, that are worked on at once in a task.
AT_ONCE = 1 << 19
#: A fit ends after a round that moves less than this share of all words, or after so many rounds.
SETTLED, ROUNDS = 1e-3, 100
#: Expected counts are rounded to such parts of a word: sums of whole numbers don't depend on the order of texts or on how they are dealt to tasks.
PARTS = 1 << 20


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma, for positive numbers: its series at x + 6, and back."""
    back = sum(1 / (x + i) for i in range(6))
    x = x + 6
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - back


def expected(a: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet distributions, one in each row."""
    return np.exp(digamma(a) - digamma(a.sum(axis=1))[:, None])


def counted(df: DataFrame, held: list[str]) -> DataFrame:
    """df with the places in `held` of each row's different terms and how often it has them (lists at, n) instead of its list `terms`; other terms are left out."""
    kept = [c for c in df.columns if c != "terms"]

    def count(batches: Batches) -> Batches:
        known = pa.array(held, pa.string())
        for b in batches:
            for lo, hi, size in R.portions(R.sizes(b.column("terms")), AT_ONCE):
                place = pc.fill_null(pc.index_in(b.column("terms").slice(lo, hi - lo).flatten(), value_set=known), -1).to_numpy().astype(np.int64)
                lists = R.row_counts(np.repeat(np.arange(hi - lo), size)[place >= 0], place[place >= 0], hi - lo, len(held))
                yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, hi - lo) for c in kept] + lists, [*kept, "at", "n"])

    return df.mapInArrow(count, StructType([df.schema[c] for c in kept]).add("at", ArrayType(IntegerType())).add("n", ArrayType(IntegerType())))


def pieces(b: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, counts and list lengths of so many rows (at, n) at once that they have about `most` counts."""
    for lo, hi, size in R.portions(R.sizes(b.column("at")), most):
        at, n = (b.column(c).slice(lo, hi - lo).flatten().to_numpy() for c in ("at", "n"))
        yield at, n.astype(np.float64), size


def mixtures(at: np.ndarray, n: np.ndarray, size: np.ndarray, weights: np.ndarray, prior: float, near: float, share: bool, steps: int) -> np.ndarray:
    """The topics' words in each text, plus the prior. A text's steps end when one moves no more than `near` words (share: of its words) of a topic in the mean, or after so many."""
    k, out = len(weights), np.full((len(size), len(weights)), prior)
    live = np.flatnonzero(size)
    size, w = size[live], weights[:, at]
    if not len(live):
        return out
    start = np.cumsum(size) - size
    words = np.add.reduceat(n, start)
    got = np.repeat(prior + words[:, None] / k, k, axis=1)
    for _ in range(steps):
        theta = expected(got)
        new = prior + theta * np.add.reduceat(w * (n / ((np.repeat(theta.T, size, axis=1) * w).sum(axis=0) + 1e-100)), start, axis=1).T
        go = np.abs(new - got).mean(axis=1) > near * (np.maximum(words, 1) if share else 1)
        out[live] = got = new
        if not go.any():
            break
        if go.mean() < 0.8:  # the others only
            some = np.repeat(go, size)
            w, n, size, words, live, got = w[:, some], n[some], size[go], words[go], live[go], got[go]
            start = np.cumsum(size) - size
    return out


def word_shares(v: DataFrame, weights: np.ndarray, prior: float) -> DataFrame:
    """(place, n): how many words of all texts (at, n) each topic has of each term, in PARTS of a word; place: the topic times the number of terms, plus the term."""
    k, n_terms = weights.shape

    def share(batches: Batches) -> Batches:
        total = np.zeros((k, n_terms), dtype=np.int64)
        for b in batches:
            for at, n, size in pieces(b, AT_ONCE // k):
                theta = np.repeat(expected(mixtures(at, n, size, weights, prior, 1e-3, True, 20)).T, size, axis=1) * weights[:, at]
                theta *= n / (theta.sum(axis=0) + 1e-100)
                total += np.stack([np.bincount(at, np.rint(x * PARTS), n_terms) for x in theta]).astype(np.int64)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "n"])

    return v.select("at", "n").mapInArrow(share, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def fit(v: DataFrame, k: int, n_terms: int, seed: int) -> np.ndarray:
    """Weights of terms in each of k topics, from the counts (at, n) of all texts: 1 / k plus the words that the topic has of the term. Each round reads all texts, each with the same weight; rounds go on until they move hardly any words.

    Prior weights of topics in a text and of terms in a topic are 1 / k. The result depends on neither the order of texts nor their tasks.
    """
    got = np.random.default_rng(seed).gamma(100, 0.01, (k, n_terms))
    for _ in range(ROUNDS):
        new = np.full(k * n_terms, 1 / k)
        for r in word_shares(v, expected(got), 1 / k).collect():  # k times n_terms at most
            new[r["place"]] += r["n"] / PARTS
        new = new.reshape(k, n_terms)
        moved, got = np.abs(new - got).sum() / new.sum(), new
        if moved < SETTLED:
            break
    return got


def assigned(v: DataFrame, id_col: str, got: np.ndarray) -> DataFrame:
    """(id, some, topic): the topic that has most of each text's words (ties: the first), by the weights that fit() gives."""
    weights, prior = expected(got), 1 / len(got)

    def assign(batches: Batches) -> Batches:
        for b in batches:
            topic = [np.zeros(0, dtype=np.int64)] + [mixtures(at, n, size, weights, prior, 1e-3, False, 1000).argmax(axis=1) for at, n, size in pieces(b, AT_ONCE // len(weights))]
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("some"), pa.array(np.concatenate(topic).astype(np.int32))], [id_col, "some", "topic"])

    return v.select(id_col, "some", "at", "n").mapInArrow(assign, StructType([v.schema[id_col], v.schema["some"]]).add("topic", IntegerType()))
