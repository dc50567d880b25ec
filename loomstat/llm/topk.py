"""Exact top-k inner-product search by the threshold algorithm.

Vectors are dealt to blocks of like directions. A block keeps one list for each dimension, sorted by value. A query walks all lists downwards at the same
pace (upwards where its own component is negative), scores each vector when it is first met, and stops when the bound, the
score of a vector that has in each dimension the value now reached, is below its k-th best score.

The same bound works between blocks: a query walks the lists of one block first, and then those of all blocks whose
extremes in each dimension could still beat its k-th best score so far. The k best of all these are the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Vectors of a block, queries that meet a block in one task, and directions that vectors are dealt by.
BLOCK, QUERIES, DIRECTIONS = 8192, 2048, 256


def best(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int, step: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block for a query: ties to the smaller id, the query's own row left out. order: rows by falling value, for each dimension."""
    n = len(ids)
    seen = ids == own
    left = n - int(seen.sum())
    scores, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    dims = np.flatnonzero(query)
    if not len(dims):
        dims = np.arange(min(1, len(query)))
    up = query[dims] < 0
    at = 0
    while left and at < n:
        to = min(n, at + step)
        rows = np.where(up[:, None], order[dims, n - to : n - at][:, ::-1], order[dims, at:to])
        new = np.zeros(n, dtype=bool)
        new[rows.ravel()] = True
        new &= ~seen
        seen |= new
        new = np.flatnonzero(new)
        left -= len(new)
        scores = np.concatenate((scores, vectors[new] @ query))
        found = np.concatenate((found, ids[new]))
        if len(found) > k:
            keep = np.lexsort((found, -scores))[:k]
            scores, found = scores[keep], found[keep]
        if len(found) >= k:
            bound = int((vectors[rows[:, -1], dims] * query[dims]).sum())
            if int(scores[-1] if len(scores) == k else scores.min()) > bound:
                break
        at = to
        step *= 2
    keep = np.lexsort((found, -scores))[:k]
    return [(int(scores[i]), int(found[i])) for i in keep]


def extremes(x: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, and the smallest and greatest value in each dimension of the rows of each."""
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return keys, np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, step: int = 64) -> DataFrame:
    """The k rows of `vectors` with the highest inner product, for each row of `queries`: (query_id, rank, vec_id, score).

    Components become floor(scale * x) first, so scores are whole numbers and exact (as 64-bit integers). A row of the same id is
    not its own result. Ties go to the smaller id; all rows if there are fewer than k. Vectors that are null or hold null or
    non-finite components take no part, empty ones neither. A query's candidates are the vectors of its own length, whatever that is. Ids are whole numbers; null ids
    take no part; a repeated id is one candidate for each of its rows, and a query for each. Other columns are not looked at.
    """

    def clean(df: DataFrame) -> DataFrame:
        x = F.col(vector_col).cast("array<double>")
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0)
        return df.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("x"))

    rows, asked = clean(vectors), clean(queries)
    # Directions: vectors of the smallest hash for each frequent length; more for more rows, DIRECTIONS at most.
    lengths = {r["d"]: r["n"] for r in rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).collect()}
    pivots = {}
    for d, n in sorted(lengths.items()):
        some = np.array([r["x"] for r in rows.where(F.size("x") == d).orderBy(F.xxhash64("x"), "id").limit(min(DIRECTIONS, -(-n // BLOCK))).select("x").collect()], dtype=np.float64)
        pivots[d] = some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-9)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            size, values, at = np.diff(x.offsets.to_numpy()), x.values.to_numpy(), x.offsets.to_numpy()
            near = np.zeros(b.num_rows, dtype=np.int32)
            for d, p in pivots.items():
                on = np.flatnonzero(size == d)
                if len(on):
                    near[on] = (values[at[on][:, None] + np.arange(d)] @ p.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), x, pa.array(size.astype(np.int32)), pa.array(near)], ["id", "x", "d", "p"])

    schema = "id long, x array<long>, d int, p int"
    dealt = cut(rows.select("id", "x").mapInArrow(deal, schema))
    # One row for each direction of each length.
    sizes = dealt.groupBy("d", "p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    number = cut(sizes.select("d", "p", "parts", (F.sum("parts").over(Window.partitionBy("d").orderBy("p")) - F.col("parts")).cast("int").alias("before")))
    place = lambda df: df.join(number, ["d", "p"]).withColumn("b", F.col("before") + F.pmod(F.xxhash64("id", "x", F.lit(1)), "parts").cast("int")).drop("p", "parts", "before")
    blocks = cut(place(dealt))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, x = b.column("d").to_numpy(), b.column("x")
            values, at = x.values.to_numpy(), x.offsets.to_numpy()
            for size in np.unique(d):
                on = np.flatnonzero(d == size)
                keys, low, high = extremes(values[at[on][:, None] + np.arange(size)], b.column("b").to_numpy()[on])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, dtype=np.int32)), pa.array(keys), pa.array(list(low), pa.list_(pa.int64())), pa.array(list(high), pa.list_(pa.int64()))], ["d", "b", "low", "high"])

    def widest(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": b["d"].iloc[:1], "b": b["b"].iloc[:1], "low": [np.stack(b["low"].to_list()).min(axis=0)], "high": [np.stack(b["high"].to_list()).max(axis=0)]})

    fields = "d int, b int, low array<long>, high array<long>"
    # One row for each BLOCK rows or direction.
    edges = blocks.select("d", "b", "x").mapInArrow(ends, fields).groupBy("d", "b").applyInPandas(widest, fields).toPandas()
    bounds = {int(d): (g["b"].to_numpy(), np.stack(g["low"].to_list()), np.stack(g["high"].to_list())) for d, g in edges.groupby("d")}
    sent = rows.sparkSession.sparkContext.broadcast(bounds)

    # Rows of one query id are told apart by their number.
    asked = cut(place(asked.select("id", "x").mapInArrow(deal, schema).withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("x")))))

    def search(v: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(v) and len(qs):
            ids, x = v["id"].to_numpy(), np.array(v["x"].tolist(), dtype=np.int64)
            y = np.array(qs["x"].tolist(), dtype=np.int64)
            most = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1]
            order = np.argsort(-x, axis=0, kind="stable").T.copy()
            if most < 2**53:  # doubles hold such scores exactly, and multiply faster
                x, y = x.astype(np.float64), y.astype(np.float64)
            for own, copy, one in zip(qs["id"].tolist(), qs["copy"].tolist(), y, strict=True):
                out += [(own, copy, i, s) for s, i in best(one, own, ids, x, order, k, step)]
        return pd.DataFrame(out, columns=["query_id", "copy", "vec_id", "score"]).astype("int64")

    def meet(visits: DataFrame) -> DataFrame:
        """The k best of each visited block; a block with many visitors is met by QUERIES of them at a time."""
        crowd = visits.groupBy("d", "b").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("asks"))
        v = blocks.join(crowd, ["d", "b"]).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("asks")
        q = visits.join(crowd, ["d", "b"]).withColumn("a", F.pmod(F.xxhash64("id", "copy"), "asks").cast("int")).drop("asks")
        return v.groupBy("d", "b", "a").cogroup(q.groupBy("d", "b", "a")).applyInPandas(search, "query_id long, copy long, vec_id long, score long")

    first = cut(meet(asked))
    kth = first.groupBy("query_id", "copy").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    hopes = asked.join(kth.withColumnRenamed("query_id", "id"), ["id", "copy"], "left").select("id", "x", "d", "b", "copy", "kth")

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            values, at, d, own, kth = x.values.to_numpy(), x.offsets.to_numpy(), b.column("d").to_numpy(), b.column("b").to_numpy(), b.column("kth").to_pylist()
            for i in range(b.num_rows):
                names, low, high = sent.value[int(d[i])]
                q = values[at[i] : at[i + 1]]
                top = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
                to = names[(names != own[i]) & ((top >= kth[i]) if kth[i] is not None else True)]
                if len(to):
                    same = pa.array(np.full(len(to), i))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(same), x.take(same), b.column("d").take(same), pa.array(to.astype(np.int32)), b.column("copy").take(same)], ["id", "x", "d", "b", "copy"])

    more = meet(cut(hopes.mapInArrow(promising, "id long, x array<long>, d int, b int, copy int")))
    rank = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(more).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
