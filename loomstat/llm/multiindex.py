"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells. A vector is filed in the cell of its nearest
codewords, and as a query it visits cells by the multi-sequence order (rising sum of squared distances to the two codewords) up to an
excess over its own cell that reaches the target recall for pairs of just the wanted similarity; all pairs of visitors and
residents are then verified in double precision. Only counts and one edge for each vector and task leave a task, never the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hot_join

#: Rows of a cell that are filed together in a block, and visitors that meet a block in one task.
RESIDENTS, VISITORS = 512, 1024
#: Lengths of at most so many different vectors have no index: all their pairs are compared in one task.
FEW = 512
#: Visits of a batch of rows that leave a task together, about.
VISITS = 1 << 20


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k codewords of the sample by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(nearest, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def excess(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance to each codeword beyond that to the nearest."""
    d = (c**2).sum(1)[None, :] - 2 * x @ c.T
    return d - d.min(axis=1, keepdims=True)


def multi_sequence(e1: np.ndarray, e2: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) of one vector in the order of e1[i] + e2[j], up to most."""
    o1, o2 = e1.argsort(kind="stable"), e2.argsort(kind="stable")
    heap, put = [(e1[o1[0]] + e2[o2[0]], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, a, b = heapq.heappop(heap)
        yield int(o1[a]), int(o2[b])
        for p in ((a + 1, b), (a, b + 1)):
            if p[0] < len(o1) and p[1] < len(o2) and p not in put:
                put.add(p)
                heapq.heappush(heap, (e1[o1[p[0]]] + e2[o2[p[1]]], *p))


def reach(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, similarity: float, target: float, seed: int) -> float:
    """The excess up to which visits (from either side) find so much of the pairs of just this similarity: measured on the sample, with partners in random directions."""
    rng = np.random.default_rng(seed)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(off, axis=1)
    y = similarity * x + sqrt(1 - similarity**2) * off / np.where(norm > 0, norm, 1)[:, None]
    h = x.shape[1] // 2
    ex, ey = (excess(x[:, :h], c1), excess(x[:, h:], c2)), (excess(y[:, :h], c1), excess(y[:, h:], c2))
    n = np.arange(len(x))
    there = sum(a[n, b.argmin(1)] for a, b in zip(ex, ey, strict=True))
    back = sum(b[n, a.argmin(1)] for a, b in zip(ex, ey, strict=True))
    return float(np.quantile(np.minimum(there, back), target)) + 1e-9


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.9, target: float = 0.99, sample: int = 8192, per_cell: int = 200, most_codewords: int = 1024, seed: int = 7
) -> DataFrame:
    """Every vector with its near-duplicate links: (id, n_links, component_id, kept).

    Vectors link if their cosine in double precision is at least `similarity`; none below it. n_links: other rows linked directly;
    component_id: smallest id reachable by links; kept: id = component_id. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing. Vectors of different lengths don't link; each length has an index of its own (a length of few vectors none:
    they are compared as they are; of length 1, those of one sign are equal). Equal vectors are one entry of the index, so a group of copies costs one. Repeated
    ids are rows of their own; other columns are not looked at.

    The codebooks and the reach of visits are fitted on the `sample` rows of the smallest hash; every row is filed and visits. The
    number of codewords grows with the rows so that a cell holds about `per_cell`, up to `most_codewords` for each half.
    """
    x = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        x = x.cast("array<double>")
    top = F.array_max(F.transform(x, F.abs))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0) & (top > 0)
    x = F.when(F.size(x) == 1, F.transform(x, F.signum).cast(x_type(vectors, vector_col))).otherwise(x)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, x).alias("x"))
    classes = rows.where("x is not null").groupBy("x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    # One index for each length of many vectors.
    lengths = {r["d"]: r["n"] for r in classes.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).where((F.col("d") > 1) & (F.col("n") > FEW)).collect()}
    few = classes.where((F.size("x") > 1) & ~F.size("x").isin([*lengths]))
    found = [compare_few(few.withColumn("d", F.size("x")), similarity)]
    for d, n in sorted(lengths.items()):
        found.append(visit(classes.where(F.size("x") == d), n, similarity, target, sample, per_cell, most_codewords, seed))
    found = cut(reduce(DataFrame.unionByName, found))
    links = found.groupBy("c").agg(F.sum("n").alias("n"))
    group = components(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("c"), "component")
    whole = classes.join(links, "c", "left").join(group, "c", "left").withColumn("component", F.coalesce("component", "c"))
    whole = cut(whole)
    first = whole.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    size = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    whole = hot_join(whole, first, "component", "members", size[0]).select("x", "copies", "n", "component_id")
    out = hot_join(rows.where("x is not null"), whole, "x", "copies", size[1], small=0).select("id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    lone = rows.where("x is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(lone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)


def x_type(vectors: DataFrame, vector_col: str) -> str:
    """Vectors stay floats where they are: half the bytes to send. Cosines are computed in doubles all the same."""
    return "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in doubles, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(names: np.ndarray, i: np.ndarray, j: np.ndarray, count: np.ndarray) -> list[tuple[int, int, int]]:
    """(vector, smallest vector that links lead to, count) of the vectors with links (i, j)."""
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            break
        low = new
    on = np.flatnonzero((low != np.arange(len(names))) | (count > 0))
    return list(zip(names[on].tolist(), names[low[on]].tolist(), count[on].tolist(), strict=True))


def compare_few(few: DataFrame, similarity: float) -> DataFrame:
    """(c, root, n) of vectors compared with all of their length, of which there are at most FEW."""

    def every(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("c")
        x = unit(np.array(b["x"].tolist()))
        i, j = np.nonzero(x @ x.T >= similarity - 1e-9)
        near = (i != j) & ((x[i] * x[j]).sum(1) >= similarity)
        i, j = i[near], j[near]
        n = np.bincount(i, b["copies"].to_numpy()[j], len(b)).astype(np.int64)
        return pd.DataFrame(linked(b["c"].to_numpy(), i, j, n), columns=["c", "root", "n"]).astype("int64")

    return few.select("d", "c", "copies", "x").groupBy("d").applyInPandas(every, "c long, root long, n long")


def visit(indexed: DataFrame, n: int, similarity: float, target: float, sample: int, per_cell: int, most_codewords: int, seed: int) -> DataFrame:
    """(c, root, n): links of a vector found in one task, and the smallest vector linked there."""
    fit = indexed.orderBy(F.xxhash64("x"), "c").limit(sample).select("x").toPandas()
    s = unit(np.array(fit["x"].tolist()))
    half = s.shape[1] // 2
    k = min(most_codewords, max(2, ceil(sqrt(n / per_cell))), len(s))
    c1, c2 = codebook(s[:, :half], k, seed), codebook(s[:, half:], k, seed + 1)
    far = reach(s, c1, c2, similarity, target, seed + 2)
    wide = len(c2)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                cells: list[np.ndarray] = []
                b = whole.slice(at, 1024)
                x = unit(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1))
                e1, e2 = excess(x[:, :half], c1), excess(x[:, half:], c2)
                n = 0
                for a, z in zip(e1, e2, strict=True):
                    cells.append(np.array([i * wide + j for i, j in multi_sequence(a, z, far)], dtype=np.int32))
                    n += len(cells[-1])
                    if n > VISITS:
                        break
                k = len(cells)
                home = [int(c[0]) for c in cells]  # the nearest cell comes first
                yield pa.RecordBatch.from_arrays([*(v.slice(0, k) for v in (b.column("c"), b.column("copies"), b.column("x"))), pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names)
                at += k

    names = ["c", "copies", "x", "home", "cells"]
    element = "float" if "float" in indexed.schema["x"].dataType.simpleString() else "double"
    filed = cut(indexed.select("c", "copies", "x").mapInArrow(file, f"c bigint, copies bigint, x array<{element}>, home int, cells array<int>"))
    cells = filed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("residents"))
    visits = filed.select("c", F.explode("cells").alias("cell"))
    crowd = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("visitors"))
    # As many rows as there are cells at most, so bounded by most_codewords squared. A cell whose only visitor lives there itself has no pairs.
    plan = F.broadcast(
        cells.join(crowd, "cell").where("visitors > 1").select("cell", F.ceil(F.col("residents") / RESIDENTS).cast("int").alias("rb"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("vb"))
    )
    part = lambda m: F.pmod(F.xxhash64("c"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    # Residents bring along which cells they visit themselves; visitors, where they live.
    at_home = filed.withColumn("cell", F.col("home")).join(plan, "cell").select("cell", part("rb").alias("r"), every("vb").alias("q"), "c", "copies", "x", F.lit(None).cast("int").alias("home"), "cells")
    guests = filed.select("c", "copies", "x", "home", F.explode("cells").alias("cell")).join(plan, "cell")
    guests = guests.select("cell", every("rb").alias("r"), part("vb").alias("q"), "c", "copies", "x", "home", F.lit(None).cast("array<int>").alias("cells"))

    def verify(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        guest = b["cells"].isna().to_numpy()
        a, z = b[guest], b[~guest]
        if len(a) and len(z):
            xa, xz = unit(np.stack(a["x"].to_list())), unit(np.stack(z["x"].to_list()))
            na, nz = a["c"].to_numpy(), z["c"].to_numpy()
            i, j = np.nonzero(xa @ xz.T >= similarity - 1e-9)
            # The same vectors in the same order in every task, so that both sides of a pair agree about it.
            flip = na[i] > nz[j]
            left, right = np.where(flip[:, None], xz[j], xa[i]), np.where(flip[:, None], xa[i], xz[j])
            near = ((left * right).sum(1) >= similarity) & (na[i] != nz[j])
            i, j = i[near], j[near]
            if len(i):
                # The pair counts for its visitor; for its resident only where that doesn't visit the other's cell itself.
                lists = z["cells"].to_list()
                own = np.sort(np.concatenate([np.asarray(c, dtype=np.int64) + k * cell_count for k, c in enumerate(lists)]))
                asked = a["home"].to_numpy().astype(np.int64)[i] + j * cell_count
                alone = own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] != asked
                names, where = np.unique(np.concatenate((na[i], nz[j])), return_inverse=True)
                ii, jj = where[: len(i)], where[len(i) :]
                ca, cz = a["copies"].to_numpy(), z["copies"].to_numpy()
                n = np.zeros(len(names), dtype=np.int64)
                np.add.at(n, ii, cz[j])
                np.add.at(n, jj[alone], ca[i[alone]])
                out = linked(names, ii, jj, n)
        return pd.DataFrame(out, columns=["c", "root", "n"]).astype("int64")

    cell_count = len(c1) * wide
    return at_home.unionByName(guests).groupBy("cell", "r", "q").applyInPandas(verify, "c long, root long, n long")
