"""Hierarchical density groups of vectors: the leaves of the condensed single-linkage tree.

With a smallest group of two and distances to one neighbour, density-connected distance is plain distance, and the leaves of the tree follow from two
rounds of the minimum spanning tree's construction (each row takes its nearest other row; each of the groups so made its nearest row outside), without the rest of the tree:

* Rows that are single join the group of their nearest row at just that distance. Following nearest rows ends at a pair that are nearest to each other, or at a vector
  of several rows. So those that end at one place are a basin, and a basin has grown from one pair, row by row: nothing in it has split.
* At the smallest distance from a basin to a row outside, both sides have two rows at least: there the tree splits, and what the basin holds by then is a leaf. Rows that
  join later are members of no leaf: noise.

Equal distances are told apart by the two rows' ids, so the result doesn't depend on the order of rows. Nearest rows are found exactly: rows are dealt to cells of pivots, and cells to few blocks. Rows meet their own block first
and then only those blocks that can hold a nearer row, once each; what leaves a block is one row for each visitor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .graph import connected_components, cut
from .sizes import sent

#: Rows of a block of cells, and visitors, that meet in one task.
BLOCK = 32_768
#: Pivots at most, vectors that they are chosen from, and rows of a cell, about.
MOST_CELLS, SAMPLE, CELL = 1024, 8192, 256


def pivots(v: DataFrame, seed: int = 42) -> dict[int, np.ndarray]:
    """Pivots by length of vectors (id, x): means of a bounded sample, which comes to the driver."""
    k = max(1, min(MOST_CELLS, v.count() // CELL))
    some = [r["x"] for r in v.orderBy(F.xxhash64("x"), "id").limit(min(SAMPLE, 8 * k)).select("x").collect()]
    rng = np.random.default_rng(seed)
    out = {}
    for size in {len(x) for x in some}:
        rows = np.array([x for x in some if len(x) == size])
        c = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(5):
            near = ((c**2).sum(1)[None] - 2 * rows @ c.T).argmin(1)
            c = np.array([rows[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        out[size] = c
    return out


def nearest_in(b: pd.DataFrame, pivots: np.ndarray | None, radius: np.ndarray) -> pd.DataFrame:
    """For each visitor of a block its nearest resident of another label, if it is no farther than the visitor's bound `most`: (id, block, d, lo, hi); equal distances by ids.

    Tiles of residents whose cells hold nothing nearer than what a visitor has are left out.
    """
    a, z = b[b["guest"]], b[~b["guest"]]
    none = pd.DataFrame({"id": a["id"].iloc[:0], "block": a["block"].iloc[:0], "d": np.zeros(0), "lo": a["id"].iloc[:0], "hi": a["id"].iloc[:0]})
    if not len(a) or not len(z):
        return none
    xa, xz = np.array(a["x"].tolist()), np.array(z["x"].tolist())
    la, lz, na, nz = a["label"].to_numpy(), z["label"].to_numpy(), a["id"].to_numpy(), z["id"].to_numpy()
    a2, z2, best, found = (xa**2).sum(1), (xz**2).sum(1), a["most"].to_numpy().copy(), [none]
    there, own = list(B.tiles(z["cell"].to_numpy())), a["cell"].to_numpy()
    for mine, _ in B.tiles(own):
        least = np.zeros((len(mine), 1)) if pivots is None else bounds(xa[mine], own[mine], pivots, radius)
        near = [least[:, cells].min(axis=1) for _, cells in there]
        for t in sorted(range(len(there)), key=lambda t: near[t].sum()):
            theirs, g = there[t][0], mine[near[t] <= best[mine]]
            if not len(g):
                continue
            square = np.maximum(a2[g][:, None] + z2[theirs][None] - 2 * xa[g] @ xz[theirs].T, 0)
            square[la[g][:, None] == lz[theirs][None]] = np.inf
            lowest = square.min(axis=1)
            # The product is only near the distance: what could be nearest is compared exactly.
            slack = 1e-9 * (1 + a2[g] + z2[theirs].max())
            some = np.flatnonzero(np.isfinite(lowest) & (lowest <= best[g] ** 2 + slack))
            i, j = np.nonzero(square[some] <= (lowest + slack)[some][:, None])
            i, j = g[some][i], theirs[j]
            d = np.sqrt(((xa[i] - xz[j]) ** 2).sum(axis=1))
            np.minimum.at(best, i, d)
            new = pd.DataFrame({"id": na[i], "block": a["block"].iloc[0], "d": d, "lo": np.minimum(na[i], nz[j]), "hi": np.maximum(na[i], nz[j])})[d <= best[i]]
            found.append(new.sort_values(["id", "d", "lo", "hi"]).drop_duplicates("id"))
    return pd.concat(found).sort_values(["id", "d", "lo", "hi"]).drop_duplicates("id")


def bounds(x: np.ndarray, own: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For rows x of cells own, how near a row of each cell can be: it is nearer to that cell's pivot than to the row's own one, and not beyond that cell's radius."""
    d = B.distances(x, pivots)
    least = np.maximum((d - d[np.arange(len(x)), own][:, None]) / 2, d - radius[None]) - B.slack(x, pivots)
    least[:, radius < 0] = np.inf
    least[np.arange(len(x)), own] = 0
    return np.maximum(least, 0)


def nearest_other(v: DataFrame, by_size: dict[int, np.ndarray], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, e): for each row (id, x, label) its nearest row of another label, as e: (d, lo, hi); rows without one are left out. And (id, block, e): the nearest in each block that the row visited. Both are written.

    known: the second result for the same rows when each had a label of its own. Then only the nearest one of each label matters, and rows that can't be its end are left out: the nearest row of a block tells the
    same for other labels if it has one, and a bound if not, so a row visits few blocks again. Vectors of different lengths don't meet.
    """
    kind, label = v.schema["id"].dataType.simpleString(), v.schema["label"].dataType.simpleString()

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [np.linalg.norm(by_size[len(x)] - x, axis=1) if len(x) in by_size else np.zeros(1) for x in b["x"]]
            yield b.assign(size=b["x"].map(len), cell=[int(x.argmin()) for x in d], r=[float(x.min()) for x in d])

    dealt = cut(v.select("id", "x", "label").mapInPandas(home, f"id {kind}, x array<double>, label {label}, size int, cell int, r double"))
    cells = dealt.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius")).collect()  # at most MOST_CELLS for each length
    radius = {k: np.full(len(by_size.get(k, [0])), -np.inf) for k in {c["size"] for c in cells}}
    held: dict[int, dict[int, int]] = {}
    for c in cells:
        radius[c["size"]][c["cell"]] = c["radius"]
        held.setdefault(c["size"], {})[c["cell"]] = c["n"]
    block = {k: B.blocks_of(c, BLOCK) for k, c in held.items()}
    place = {k: np.array([b.get(j, -1) for j in range(len(radius[k]))]) for k, b in block.items()}
    dealt = dealt.join(F.broadcast(dealt.sparkSession.createDataFrame([(k, j, p) for k, b in block.items() for j, p in b.items()], "size int, cell int, home int")), ["size", "cell"])
    residents = dealt.groupBy("size", F.col("home").alias("block")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rb"))

    def met(guests: DataFrame) -> DataFrame:
        """(id, block, e): the nearest rows of guests (id, x, label, size, cell, most, block) in these blocks."""
        plan = sent(residents.join(guests.groupBy("size", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vb")), ["size", "block"]))
        part = lambda m: F.pmod(F.xxhash64("id", "x"), F.col(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        here = dealt.withColumn("block", F.col("home")).join(plan, ["size", "block"]).select("size", "block", part("rb").alias("r"), every("vb").alias("q"), "id", "x", "label", "cell", F.lit(0.0).alias("most"), F.lit(False).alias("guest"))
        there = guests.join(plan, ["size", "block"]).select("size", "block", every("rb").alias("r"), part("vb").alias("q"), "id", "x", "label", "cell", "most", F.lit(True).alias("guest"))

        def compare(b: pd.DataFrame) -> pd.DataFrame:
            size = int(b["size"].iloc[0])
            return nearest_in(b, by_size.get(size), radius[size])

        found = here.unionByName(there).groupBy("size", "block", "r", "q").applyInPandas(compare, f"id {kind}, block int, d double, lo {kind}, hi {kind}")
        return found.groupBy("id", "block").agg(F.min(F.struct("d", "lo", "hi")).alias("e"))

    far = F.lit(float("inf"))
    first = cut(met(dealt.withColumn("block", F.col("home")).withColumn("most", far)))
    if known is None:
        bound = dealt.join(first.select("id", F.col("e.d").alias("most")), "id", "left").fillna({"most": float("inf")}).withColumn("done", F.array().cast("array<int>"))
    else:
        of = v.select(F.col("id").alias("other"), F.col("label").alias("others"))
        seen = known.withColumn("other", F.when(F.col("e.lo") == F.col("id"), F.col("e.hi")).otherwise(F.col("e.lo"))).join(of, "other").join(v.select("id", "label"), "id").withColumn("settled", F.col("others") != F.col("label"))
        seen = cut(seen.select("id", "label", "block", "e", "settled"))
        first = cut(first.unionByName(seen.where("settled").select("id", "block", "e")))
        least = first.join(v.select("id", "label"), "id").groupBy("label").agg(F.min("e.d").alias("most"))
        done = seen.join(least, "label", "left").where(F.col("settled") | (F.col("e.d") > F.coalesce("most", far))).groupBy("id").agg(F.collect_set("block").alias("done"))  # at most all blocks
        bound = dealt.join(least, "label", "left").join(done, "id", "left").withColumn("most", F.coalesce("most", far)).withColumn("done", F.coalesce("done", F.array().cast("array<int>")))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, rows in b.groupby("size"):
                if size not in by_size:
                    yield rows.assign(visits=[[] for _ in range(len(rows))])[["id", "x", "label", "size", "cell", "most", "visits"]]
                    continue
                least = bounds(np.array(rows["x"].tolist()), rows["cell"].to_numpy(), by_size[size], radius[size])
                can = [np.unique(place[size][(x <= most) & (place[size] >= 0)]) for x, most in zip(least, rows["most"], strict=True)]
                to = [[int(p) for p in ps if p != own and p not in done] for ps, own, done in zip(can, rows["home"], map(set, rows["done"]), strict=True)]
                yield rows.assign(visits=to)[["id", "x", "label", "size", "cell", "most", "visits"]]

    further = cut(bound.select("id", "x", "label", "size", "cell", "home", "most", "done").mapInPandas(visits, f"id {kind}, x array<double>, label {label}, size int, cell int, most double, visits array<int>"))
    # The nearest row of each visited block is wanted if it may tell something the next time, else only what is within the bound.
    blocks = cut(first.unionByName(met(further.select("id", "x", "label", "size", "cell", (far if known is None else F.col("most")).alias("most"), F.explode("visits").alias("block")))))
    return cut(blocks.groupBy("id").agg(F.min("e").alias("e"))), blocks


def leaf_groups(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, group, size): the leaves of the density hierarchy, named by their smallest id; noise is -1 with size 1.

    Smallest group 2. Rows of equal vectors are always together. If the tree never splits there is no leaf, and all rows are noise. Vectors of null, empty or non-finite content are
    noise, as are rows without an id; vectors of different lengths are never together (a tree for each length). Ids are whole numbers; an id that repeats names all its rows.
    """
    fine = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(vector) > 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(vector, lambda v: v.cast("double") + 0.0)).alias("x"))
    points = cut(rows.where("x is not null").groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    by_size = pivots(points)
    one, known = nearest_other(points.select("id", "x", F.col("id").alias("label")), by_size)
    single = one.join(points.where("n = 1").select("id"), "id", "left_semi")
    other = F.when(F.col("e.lo") == F.col("id"), F.col("e.hi")).otherwise(F.col("e.lo"))
    basin = cut(connected_components(points.select("id"), single.select(F.col("id").alias("a"), other.alias("b"))))
    labelled = points.join(basin, "id")
    out, _ = nearest_other(labelled.select("id", "x", F.col("component").alias("label")), by_size, known)
    splits = out.join(basin, "id").groupBy("component").agg(F.min("e").alias("split"))
    placed = labelled.join(splits, "component").join(single.select("id", F.col("e").alias("joined")), "id", "left")
    inside = cut(placed.where(F.col("joined").isNull() | (F.col("joined") < F.col("split"))).select("x", "id", "n", "component"))
    named = inside.groupBy("component").agg(F.min("id").alias("group"), F.sum("n").alias("size"))
    members = inside.join(named, "component").select(F.col("x").alias("y"), "group", "size")
    found = rows.join(members, F.col("x") == F.col("y"), "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("group", F.lit(-1)).alias("group"), F.coalesce("size", F.lit(1)).alias("size"))
