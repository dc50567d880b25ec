"""Votes as a matrix, and groups of opinion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cases
from .graph import cut


def matrix(votes: DataFrame) -> DataFrame:
    """(session, statement, v) from one vote for each session and statement: 1, -1 or 0."""
    return votes.select("session", "statement", cases([(F.col("vote") == "agree", 1), (F.col("vote") == "disagree", -1)], 0).cast("int").alias("v"))


def principal_scores(m: DataFrame, dims: int = 10, extra: int = 8, rounds: int = 2, seed: int = 42) -> DataFrame:
    """(session, p0, p1, ...): each session's place along the principal components of a sparse matrix (session, statement, v) with columns centred, by randomised subspace iteration. Written.

    A session starts as the sum of its statements' random signs (bits of a hash, so nothing is stored for a statement). Each round takes statements' sums over sessions and sessions' sums
    over statements; only products of a few columns come to the driver. No row is ever as long as the number of statements. Components of no variance are 0.
    """
    width = dims + extra
    y = [f"y{j}" for j in range(width)]
    m = cut(m.select("session", "statement", F.col("v").cast("double").alias("v")))
    kind = {c: m.schema[c].dataType.simpleString() for c in ("session", "statement")}

    def sums(df: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
        """Number of rows, sums and sums of products of the columns; one array leaves each task."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width + 1, width + 1))
            for b in batches:
                x = np.column_stack((np.ones(len(b)), b[y].to_numpy()))
                total += x.T @ x
            yield pd.DataFrame({"k": range(total.size), "x": total.ravel()})

        got = df.select(*y).mapInPandas(part, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # (width + 1) squared rows
        all_sums = np.zeros((width + 1) ** 2)
        for r in got:
            all_sums[r["k"]] = r["x"]
        t = all_sums.reshape(width + 1, width + 1)
        return t[0, 0], t[0, 1:], t[1:, 1:]

    def times(df: DataFrame, key: str, shift: np.ndarray, t: np.ndarray) -> DataFrame:
        """(columns - shift) times a matrix."""

        def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = pd.DataFrame((b[y].to_numpy() - shift) @ t, columns=y)
                out.insert(0, key, b[key].to_numpy())
                yield out

        return df.mapInPandas(product, f"{key} {kind[key]}, " + ", ".join(f"{c} double" for c in y))

    def orthonormal(df: DataFrame, key: str, centred: bool) -> DataFrame:
        """Columns of df, less their means if asked for, made orthonormal; those without a part of their own become 0."""
        n, total, products = sums(df)
        shift = total / max(n, 1) if centred else np.zeros(width)
        values, vectors = np.linalg.eigh(products - n * np.outer(shift, shift))
        on = values > max(values.max(), 0) * 1e-12
        return times(df, key, shift, np.where(on, vectors / np.sqrt(np.where(on, values, 1.0)), 0.0))

    def across(df: DataFrame, key: str, to: str) -> DataFrame:
        """Sums over the matrix's entries: of what the rows of one side have, for each row of the other."""
        return cut(m.join(df, key).groupBy(to).agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in y]))

    signs = F.xxhash64("statement", F.lit(seed))
    start = m.select("session", *[(F.col("v") * F.when(F.shiftrightunsigned(signs, j).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)).alias(c) for j, c in enumerate(y)])
    rows = cut(start.groupBy("session").agg(*[F.sum(c).alias(c) for c in y]))
    for _ in range(rounds):
        back = across(orthonormal(rows, "session", True), "session", "statement")
        rows = across(orthonormal(back, "statement", False), "statement", "session")
    q = cut(orthonormal(rows, "session", True))
    values, vectors = np.linalg.eigh(sums(across(q, "session", "statement"))[2])
    order = np.argsort(values)[::-1]
    out = times(q, "session", np.zeros(width), vectors[:, order] * np.sqrt(np.maximum(values[order], 0.0)))
    return cut(out.select("session", *[F.col(c).alias(f"p{j}") for j, c in enumerate(y[:dims])]))


def opinion_groups(m: DataFrame, most: int = 10, ks: range = range(2, 9), least: int = 5, seed: int = 42) -> DataFrame:
    """(session, group): sessions of a sparse matrix (session, statement, v) grouped by k-means over at most `most` principal components; k by the best silhouette. Groups of fewer than `least` sessions are hidden: -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    scores = principal_scores(m, most, seed=seed)
    x = cut(scores.select("session", array_to_vector(F.array(*[f"p{j}" for j in range(most)])).alias("features")))
    best, score, n = None, -2.0, x.count()
    for k in [k for k in ks if k < n]:
        got = KMeans(k=k, seed=seed).fit(x).transform(x)
        if got.select("prediction").distinct().count() < 2:
            continue
        s = ClusteringEvaluator().evaluate(got)
        if s > score:
            best, score = got, s
    best = x.withColumn("prediction", F.lit(0)) if best is None else best
    grouped = cut(best.select("session", F.col("prediction").alias("group")))
    shown = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)  # as many as there are ks at most
    return grouped.join(F.broadcast(shown.select(F.col("group").alias("shown"))), F.col("group") == F.col("shown"), "left").select("session", F.coalesce("shown", F.lit(-1)).alias("group"))


def by_group(m: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, statement, mean, ratio, n): mean vote, share of agreement and number of votes of each shown group (session, group; hidden ones are -1)."""
    n = F.count(F.lit(1))
    shown = m.join(groups.where(F.col("group") >= 0), "session")
    return shown.groupBy("group", "statement").agg(F.avg("v").alias("mean"), (F.count_if(F.col("v") == 1) / n).alias("ratio"), n.alias("n"))


def representatives(grouped: DataFrame, n: int = 5) -> DataFrame:
    """(group, statement, mean, rank): the n statements of each group with the strongest mean vote; ties to the smaller statement."""
    w = Window.partitionBy("group").orderBy(F.desc(F.round(F.abs("mean"), 9)), "statement")
    return grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("group", "statement", "mean", "rank")


def consensus(grouped: DataFrame, groups: int, least: float = 0.7) -> DataFrame:
    """(statement, lowest, consensus): the lowest share of agreement, and whether it is at least so high in every one of so many groups."""
    return grouped.groupBy("statement").agg(F.min("ratio").alias("lowest"), ((F.min("ratio") >= least) & (F.count(F.lit(1)) == groups)).alias("consensus"))


def divisive(grouped: DataFrame, least: float = 0.3) -> DataFrame:
    """(statement, spread): statements whose shares of agreement differ by at least so much between groups."""
    return grouped.groupBy("statement").agg((F.max("ratio") - F.min("ratio")).alias("spread")).where(F.col("spread") >= least)
