"""Groups of vectors: centroids, density groups, novelty, topics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cosine
from . import blocks as B
from . import grams as R
from . import lda as L
from .graph import connected_components, cut
from .sizes import sent, spread


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, centroid): the mean vector of each group; sums by position are combined before the shuffle."""
    x = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("centroid"))


#: Rows of a block of cells, and visitors, that meet in one task.
BLOCK = 32_768


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each of them is linked with by the pairs (i, j), over any number of links."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_edges(v: DataFrame, eps: float, per_cell: int = 256, most_cells: int = 1024, sample: int = 4096, seed: int = 42) -> DataFrame:
    """Edges (a, b) that connect just the rows (id, x) of distance at most eps: one for each row and task at most, never all pairs.

    Rows are dealt to cells by their nearest pivot. Two rows within eps have distances to any pivot that differ by eps at most, so a row whose nearest pivot is at
    distance d meets all its neighbours in cells of pivots within d + 2 eps: none is missed. Pivots come from a bounded sample. Cells lie in few blocks, and a row is sent once to each block that holds a cell
    of its neighbours; there it is compared with the tiles of rows that can be near.
    """
    n = v.count()
    k = max(1, min(most_cells, n // per_cell))
    some = [r["x"] for r in v.orderBy(F.xxhash64("x"), "id").limit(min(sample, 8 * k)).select("x").collect()]
    rng = np.random.default_rng(seed)
    by_size: dict[int, np.ndarray] = {}
    for size in {len(x) for x in some}:
        rows = np.array([x for x in some if len(x) == size])
        c = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(5):
            near = ((c**2).sum(1)[None] - 2 * rows @ c.T).argmin(1)
            c = np.array([rows[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        by_size[size] = c

    def reach(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each of these rows of one length, and in which cells its neighbours can be: of two rows the one of the lower cell visits the other's, which is enough for the pair."""
        c = by_size.get(x.shape[1])
        if c is None:
            return np.zeros(len(x), dtype=np.int64), np.ones((len(x), 1), dtype=bool)
        d = np.stack([np.linalg.norm(c - row, axis=1) for row in x])
        home = d.argmin(1)
        return home, (d <= d.min(1)[:, None] + 2 * eps + 1e-9) & (np.arange(len(c))[None] >= home[:, None])

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["x"].map(len)
            for d, rows in b.groupby(size):
                yield rows.assign(d=d, cell=reach(np.array(rows["x"].tolist(), dtype=np.float64))[0])

    kind = v.schema["id"].dataType.simpleString()
    dealt = cut(v.select("id", "x").mapInPandas(homes, f"id {kind}, x array<double>, d int, cell int"))
    cells: dict[int, dict[int, int]] = {}
    for r in dealt.groupBy("d", "cell").count().collect():  # at most most_cells for each length
        cells.setdefault(r["d"], {})[r["cell"]] = r["count"]
    block = {d: B.blocks_of(c, BLOCK) for d, c in cells.items()}

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, rows in b.groupby("d"):
                place = np.array([block[d].get(j, -1) for j in range(len(by_size.get(d, [0])))])
                met = [[int(p) for p in np.unique(place[row]) if p >= 0] for row in reach(np.array(rows["x"].tolist(), dtype=np.float64))[1]]
                yield rows.assign(home=rows["cell"].map(block[d]), blocks=met)

    sent_to = cut(dealt.mapInPandas(visits, f"id {kind}, x array<double>, d int, cell int, home int, blocks array<int>"))
    residents = sent_to.groupBy("d", F.col("home").alias("block")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rb"))
    visitors = sent_to.select("d", F.explode("blocks").alias("block")).groupBy("d", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vb"))
    plan = sent(residents.join(visitors, ["d", "block"]))
    part = lambda m: F.pmod(F.xxhash64("id", "x"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    here = sent_to.withColumn("block", F.col("home")).join(plan, ["d", "block"]).select("d", "block", part("rb").alias("r"), every("vb").alias("q"), "id", "x", "cell", F.lit(False).alias("guest"))
    guests = sent_to.withColumn("block", F.explode("blocks")).join(plan, ["d", "block"]).select("d", "block", every("rb").alias("r"), part("vb").alias("q"), "id", "x", "cell", F.lit(True).alias("guest"))

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        a, z = b[b["guest"]], b[~b["guest"]]
        if not len(a) or not len(z):
            return pd.DataFrame({"a": a["id"].iloc[:0], "b": a["id"].iloc[:0]})
        xa, xz = np.array(a["x"].tolist()), np.array(z["x"].tolist())
        names, at = np.unique(np.concatenate((a["id"].to_numpy(), z["id"].to_numpy())), return_inverse=True)
        ia, iz = at[: len(a)], at[len(a) :]
        a2, z2, links = (xa**2).sum(1), (xz**2).sum(1), [np.zeros((2, 0), dtype=np.int64)]
        there = list(B.tiles(z["cell"].to_numpy()))
        for mine, _ in B.tiles(a["cell"].to_numpy()):
            can = reach(xa[mine])[1]
            for theirs, near_cells in there:
                g = mine[can[:, near_cells].any(axis=1)]
                if not len(g):
                    continue
                i, j = np.nonzero(a2[g][:, None] + z2[theirs][None] - 2 * xa[g] @ xz[theirs].T <= eps * eps + 1e-6)
                i, j = g[i], theirs[j]
                near = np.concatenate([np.linalg.norm(xa[i[t : t + 65536]] - xz[j[t : t + 65536]], axis=1) <= eps for t in range(0, len(i), 65536)] or [np.zeros(0, dtype=bool)])
                on, where = np.unique(np.concatenate((ia[i[near]], iz[j[near]])), return_inverse=True)
                low = forest(where[: len(where) // 2], where[len(where) // 2 :], len(on))
                links.append(np.stack((on, on[low]))[:, low != np.arange(len(on))])
        low = forest(*np.concatenate(links, axis=1), len(names))
        on = np.flatnonzero(low != np.arange(len(names)))
        return pd.DataFrame({"a": names[on], "b": names[low[on]]})

    return here.unionByName(guests).groupBy("d", "block", "r", "q").applyInPandas(compare, f"a {kind}, b {kind}")


def density_groups(df: DataFrame, id_col: str, vector: str, eps: float, min_size: int = 3) -> DataFrame:
    """(id, group, size, eps): vectors linked within eps and their connected components; smaller groups are -1.

    Vectors of null, empty or non-finite content are noise; vectors of different lengths are never linked.
    """
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(vector) > 0)
    v = cut(df.where(fine).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x")))
    labels = connected_components(v.select("id"), near_edges(v, eps))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    small = F.coalesce(F.col("size"), F.lit(0)) < min_size
    out = df.select(F.col(id_col).alias("id")).join(labels.join(sizes, "component"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.when(small | F.col("component").isNull(), -1).otherwise(F.col("component")).alias("group"), F.coalesce("size", F.lit(1)).alias("size"), F.lit(eps).alias("eps"))


def representatives(df: DataFrame, centroid: DataFrame, key: str, id_col: str, vector: str) -> DataFrame:
    """The member nearest to its group's centroid; ties to the smaller id."""
    d = F.sqrt(F.aggregate(F.zip_with(vector, "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    j = df.join(centroid, key).withColumn("distance", d)
    return j.groupBy(key).agg(F.min_by(id_col, F.struct("distance", id_col)).alias("representative"), F.min("distance").alias("distance"))


def novelty(new: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """1 - the highest cosine to any earlier centroid; 1 if there is none. The history is of groups, not rows."""
    h = history.select(F.col("centroid").alias("old"))
    j = new.join(sent(h), F.lit(True), "left").withColumn("c", cosine(F.col("centroid"), F.col("old")))
    return j.groupBy(key).agg((1 - F.coalesce(F.max("c"), F.lit(0.0))).alias("novelty"))


def ctfidf(tokens: DataFrame, topic: str, term: str) -> DataFrame:
    """(topic, term, tf, score): term frequency in the topic times log(1 + mean topic length / total frequency of the term)."""
    tf = tokens.groupBy(topic, term).agg(F.count(F.lit(1)).alias("tf"))
    total = tf.groupBy(term).agg(F.sum("tf").alias("f"))
    mean = tf.agg((F.sum("tf") / F.countDistinct(topic)).alias("mean"))
    return tf.join(total, term).join(F.broadcast(mean), F.lit(True)).select(topic, term, "tf", (F.col("tf") * F.log(1 + F.col("mean") / F.col("f"))).alias("score"))


def ngrams(df: DataFrame, topic: str, text: str, stop: list[str], most: int = 3) -> DataFrame:
    """(topic, term, tf): how often each run of one to `most` words of three letters or more (stop words left out before) occurs in a topic's texts. Counted where the texts are, slice by slice, before anything is shuffled; no vocabulary is held anywhere."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.when(F.size("w") >= i + (n - 1), F.array_join(F.slice("w", i, n), " ")))
    terms = R.dealt(df.select(topic, text), text, R.SLICE // 4).select(topic, R.found(text, stop).alias("w")).select(topic, F.explode(F.concat(*[runs(n) for n in range(1, most + 1)])).alias("term"))
    return terms.groupBy(topic, "term").agg(F.count(F.lit(1)).alias("tf")).where("term is not null")


def topic_words(df: DataFrame, topic: str, text: str, stop: list[str], words: int = 10, least: int = 2, most: int = 3) -> DataFrame:
    """(topic, term, tf, score, rank): the strongest runs of one to `most` words of each topic by class-based term weights, of all that occur at least `least` times.

    A term that occurs tf times in a topic weighs tf * log(1 + mean / tf) there at most, which grows with tf, and a run occurs no more often than the shorter runs in it. So with the weights of the topics' words known,
    longer runs are counted only if all shorter runs in them could still be among a topic's strongest; those have exact counts, and no other run could have been chosen. Where too many words could be, all runs are counted.
    """
    d = cut(R.dealt(df.select(F.col(topic).alias("g"), text), text).select("g", R.found(text, stop).alias("w")))
    n_runs = sum((F.greatest(F.size("w") - m, F.lit(0)).cast("long") for m in range(1, most)), F.size("w").cast("long"))
    mean = d.where(F.size("w") > 0).agg((F.sum(n_runs) / F.countDistinct("g")).alias("mean")).first()["mean"] or 0.0
    weight = lambda f: F.col("tf") * F.log(1 + F.lit(mean) / F.col(f))
    often = lambda c: c.groupBy("term").agg(F.sum("tf").alias("f")).where(F.col("f") >= least)

    counts, got, chosen, known = cut(R.word_counts(d)), None, [None], []
    for length in range(1, most + 1):
        counts = counts.select("g", F.col("key").alias("term"), F.col("n").alias("tf"))
        scored = counts.join(often(counts), "term").select("g", "term", "tf", weight("f").alias("score"))
        all_scores = scored.select("g", "score") if got is None else scored.select("g", "score").unionByName(got.select("g", "score"))
        last = all_scores.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score")))).where(F.col("k") == words).select("g", (F.col("score") * (1 - 1e-9)).alias("last"))
        can = cut(scored.join(sent(last), "g", "left").where(F.col("last").isNull() | (weight("tf") >= F.col("last"))).select("g", F.col("term").alias("key"), "tf", "score"))
        if length == 1:
            known = [r["key"] for r in can.select("key").distinct().limit(R.MOST_RUNS + 1).collect()]
            if len(known) > R.MOST_RUNS:
                counts = cut(ngrams(df.select(F.col(topic).alias("g"), text), "g", text, stop, most))
                got = counts.join(often(counts), "term").select("g", "term", "tf", weight("f").alias("score"))
                break
            got = can.withColumnRenamed("key", "term")
            d = cut(R.coded(d, known)) if known else d
        else:
            got = got.unionByName(R.terms(can, known, length).withColumnRenamed("key", "term"))
            chosen.append(R.keys(can))
        if length == most or not known:
            break
        counts = cut(R.run_counts(d, len(known), chosen))
    return top_terms(got.withColumnRenamed("g", topic).select(topic, "term", "tf", "score"), topic, "term", words)


def top_terms(scored: DataFrame, topic: str, term: str, n: int) -> DataFrame:
    w = Window.partitionBy(topic).orderBy(F.desc("score"), term)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merged_topics(counts: DataFrame, least: float) -> DataFrame:
    """(id, component): topics linked by term vectors (topic, term, n) of at least this cosine; they meet by terms, so topics without a common term never do."""
    length = counts.groupBy("topic").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    side = lambda t, n: counts.select(F.col("topic").alias(t), "term", F.col("n").alias(n))
    both = side("a", "na").join(side("b", "nb"), "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    of = lambda t: length.select(F.col("topic").alias(t), F.col("l").alias(f"l_{t}"))
    near = both.join(of("a"), "a").join(of("b"), "b").where(F.col("s") / (F.col("l_a") * F.col("l_b")) >= least)
    return connected_components(length.select(F.col("topic").alias("id")), near.select("a", "b"))


def topics(df: DataFrame, id_col: str, text: str, k: int, vocabulary: int, stop: list[str], words: int = 10, seed: int = 42) -> DataFrame:
    """(id, topic, words): LDA over counts of 1- to 3-grams without stop words, fitted on all texts; words: the topic's strongest, comma-joined. Texts without terms have topic -1 and null words.

    vocabulary: the most frequent n-grams (of those in two texts at least, ties to the smaller) that count for the model, which the driver holds (times k numbers); topic_words() has no such bound.
    """
    from pyspark.ml.feature import CountVectorizer, NGram

    d = df.select(F.col(id_col), R.found(text, stop).alias("w"))
    known = R.most_frequent(d, vocabulary, counts=True)
    if known:
        held, d = known
        if not held:  # no term occurs in two texts
            return df.select(id_col, F.lit(-1).alias("topic"), F.lit(None).cast("string").alias("words"))
    else:
        for n in (2, 3):
            d = NGram(n=n, inputCol="w", outputCol=f"g{n}").transform(d)
        d = cut(d.select(id_col, "w", F.concat("w", "g2", "g3").alias("terms")))
        held = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=vocabulary, minDF=2.0).fit(d).vocabulary
        d = L.counted(d, held)
    v = cut(spread(d.select(id_col, (F.size("w") > 0).alias("some"), "at", "n")))  # the model reads them in each of its rounds
    weights = L.fit(v, k, len(held), seed)
    best = [(t, ",".join(held[i] for i in np.argsort(-w, kind="stable")[:words])) for t, w in enumerate(weights)]
    got = L.assigned(v, id_col, weights).select(id_col, F.when(F.col("some"), F.col("topic")).otherwise(-1).alias("topic"))
    return got.join(F.broadcast(df.sparkSession.createDataFrame(best, "topic int, words string")), "topic", "left").select(id_col, "topic", "words")  # k rows


def seed_groups(df: DataFrame, key: str, metrics: list[str], radius: float) -> DataFrame:
    """(key, seed, distance): rows grouped around seeds that are at least `radius` apart, each row with its nearest seed, which is nearer than that (ties to the smaller seed).

    metrics: numbers between 0 and 100, so there can only be so many seeds. Rows are dealt to cells whose rows are all nearer than the radius. In each round the row of the smallest hash stands for its cell,
    and one whose hash is the smallest among those that are near it becomes a seed; rows near a seed are settled. So seeds don't depend on the order of rows. What is compared pair by pair
    are cells and seeds, whose number the space bounds, not rows. Rows with a null metric have no seed; equal keys are one row.
    """
    side = 0.999 * radius / len(metrics) ** 0.5
    cell = [F.floor(F.col(c) / side).alias(f"c{k}") for k, c in enumerate(metrics)]
    known = cut(df.where(" and ".join(f"{c} is not null" for c in metrics)).select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metrics)], *cell, F.md5(F.col(key).cast("string")).alias("h")).dropDuplicates(["id"]))
    names = [f"m{k}" for k in range(len(metrics))]
    far = lambda a, b: F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2) for c in names), F.lit(0.0)))
    left, seeds = known, known.where("1 = 0").select("id", "h", *names)
    while not left.isEmpty():
        first = left.groupBy(*[f"c{k}" for k in range(len(metrics))]).agg(F.min(F.struct("h", "id", *names)).alias("x")).select("x.*")
        first = cut(first)
        beaten = first.alias("a").join(F.broadcast(first).alias("b"), (F.col("a.h") > F.col("b.h")) & (far("a", "b") < radius), "left_semi")
        new = cut(first.join(beaten.select("id"), "id", "left_anti").select("id", "h", *names))
        left = cut(left.alias("a").join(F.broadcast(new).alias("b"), far("a", "b") < radius, "left_anti"))
        seeds = seeds.unionByName(new)
    seeds = cut(seeds)
    met = known.alias("a").join(F.broadcast(seeds).alias("b"), far("a", "b") < radius)
    best = met.groupBy("a.id").agg(F.min(F.struct(far("a", "b").alias("distance"), F.col("b.id").alias("seed"))).alias("x"))
    return best.select(F.col("id").alias(key), "x.seed", "x.distance")


def embed_with(df: DataFrame, id_col: str, text: str, load: Callable[[], Callable[[list[str]], Iterable[Iterable[float]]]]) -> DataFrame:
    """(id, embedding) by a model of the user's own: load() is called once in each Python worker and gives a function from a list of texts to their vectors. Null texts have no vector."""
    rows = df.select(F.col(id_col), F.col(text).cast("string").alias("text"))

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            some = b["text"].notna()
            out = pd.Series([None] * len(b), index=b.index, dtype=object)
            if some.any():
                out[some] = pd.Series([[float(x) for x in v] for v in model(b.loc[some, "text"].tolist())], index=b.index[some])
            yield pd.DataFrame({id_col: b[id_col], "embedding": out})

    return rows.mapInPandas(embed, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, embedding array<double>")
