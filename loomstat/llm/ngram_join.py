"""N-gram Jaccard join: near-duplicate texts by a MinHash LSH forest, then exact verification.

A text is its set of five-word shingles. Each tree of the forest labels a text with a sequence of MinHash values of one byte each; a tree's labels in
sorted order are its prefix trie (the texts below a node are neighbours that agree in a prefix). Matches are taken at the whole label first. Below each
node, signatures (all labels of a text) are compared; from the similarities found, each weighted by the inverse of its chance to be found, follows how
many links there must be in all, hence the recall. Matched prefixes are shortened until that recall reaches the target.

Texts that look similar below a common node are gathered into units. In these, shingle sets are compared exactly, in
blocks of bounded bytes; only counts and one edge for each text and block leave a task, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import components, cut, drop_cut, hot_join, small_batches

#: A list of at most so many rows of fixed width (below 100 bytes) is sent to every executor; a longer one is joined by a shuffle.
MOST_SENT = 200_000
#: Texts of a block of a unit at most, about, and bytes of their shingle sets.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: Texts of a trie node, or of a block of a larger one, at most, about.
NODE_ROWS = 256
#: Values of a label, one byte each: a label is one whole number, whose order is the order of the trie.
LABEL = 8
BINS = 64


def chance(similarity: float, depth: int, trees: int) -> float:
    """The probability that a pair of this similarity shares a prefix of this depth in one of the trees."""
    return 1 - (1 - (similarity + (1 - similarity) / 256) ** depth) ** trees


def shortest(threshold: float, trees: int, target: float) -> int:
    """The depth at which even pairs of just this similarity are found with the target probability: prefixes need not be shorter."""
    return next((d for d in range(LABEL, 1, -1) if chance(threshold, d, trees) >= target), 1)


def recalls(found: dict[int, int], depth: int, threshold: float, trees: int) -> dict[int, float]:
    """The estimated recall at this depth and all shorter ones, from the links found at this depth by similarity bin.

    One more link at just the threshold is supposed, found with its chance, so that few links prove little.
    """
    at = {max(threshold, min(1.0, b / BINS)): n for b, n in found.items()}
    there = [(s, n / chance(s, depth, trees)) for s, n in at.items()] + [(threshold, 1.0)]
    total = sum(n for _, n in there)
    return {d: sum(n * chance(s, d, trees) for s, n in there) / total for d in range(depth, 0, -1)}


def sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def signatures(texts: list[str], width: int, trees: int) -> tuple[list[np.ndarray | None], list[int]]:
    """For each text its labels, one for each tree (None for a text without words), and how many shingles it has."""
    rng = np.random.default_rng(20240601)
    seed = rng.integers(0, 2**32, size=(trees, LABEL), dtype=np.uint32)
    odd = rng.integers(0, 2**32, size=(trees, LABEL), dtype=np.uint32) | np.uint32(1)
    out: list[np.ndarray | None] = []
    sizes: list[int] = []
    for i, j in textvec.batches(texts):
        h, bounds = textvec.shingles(*textvec.words(texts[i:j]), width)
        n = np.diff(bounds)
        has = np.flatnonzero(n)
        labels = np.zeros((len(has), trees), dtype=np.uint64)
        if len(has):
            x, first = (h >> np.uint64(32)).astype(np.uint32), bounds[:-1][has]
            y = np.empty_like(x)
            for t in range(trees):
                for d in range(LABEL):
                    np.bitwise_xor(x, seed[t, d], out=y)
                    np.multiply(y, odd[t, d], out=y)
                    least = textvec.mix(np.minimum.reduceat(y, first).astype(np.uint64))
                    labels[:, t] = (labels[:, t] << np.uint64(8)) | (least >> np.uint64(56))
        rows = dict(zip(has.tolist(), labels.view(np.int64), strict=True))
        out += [rows.get(k) for k in range(j - i)]
        sizes += n.tolist()
    return out, sizes


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two arrays of labels have in common."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    return sum(((x >> np.uint64(64 - 8 * d)) == 0).astype(np.int8) for d in range(1, LABEL + 1))


def walk(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, label, c) of sorted tries with depth, the longest prefix shared with a neighbour, where that is `least` or more.

    Rows at the ends of a task may have a neighbour in the next one: they count as matched to their end.
    """
    rest = None
    first = True

    def result(t: np.ndarray, x: np.ndarray, c: np.ndarray, depth: np.ndarray) -> pa.RecordBatch:
        on = depth >= least
        return pa.RecordBatch.from_arrays([pa.array(v[on]) for v in (t, x, c, depth.astype(np.int32))], ["tree", "label", "c", "depth"])

    for b in batches:
        if not b.num_rows:
            continue
        t, x, c = (b.column(k).to_numpy() for k in range(3))
        if rest is not None:
            t, x, c = (np.concatenate((a, z)) for a, z in zip(rest[:3], (t, x, c), strict=True))
        near = np.where(t[1:] == t[:-1], agreeing(x[1:], x[:-1]), 0).astype(np.int8)
        before = np.concatenate((rest[3] if rest is not None else [LABEL if first else 0], near)).astype(np.int8)
        first = False
        after = np.concatenate((near, [0])).astype(np.int8)
        rest = (t[-1:], x[-1:], c[-1:], before[-1:])  # the last row waits for its neighbour
        yield result(t[:-1], x[:-1], c[:-1], np.maximum(before, after)[:-1])
    if rest is not None:
        yield result(*rest[:3], np.full(1, LABEL, dtype=np.int8))


def alike(batches: Iterator[pa.RecordBatch], depth: int, threshold: float, trees: int) -> Iterator[pa.RecordBatch]:
    """Texts of a trie node compared by their signatures: edges (a, b, null), one for each text and node at most, and counts (bin, null, n) of links by similarity.

    Rows (tree, prefix, lo, hi, side, c, labels) are sorted by the first four; lo < hi: two blocks of a large node, of which only pairs across sides are
    compared. A pair is counted in the first tree that it shares a node of. Pairs are compared for one distance in the order of rows at a time.
    """
    slack = 8 * (threshold * (1 - threshold) / (LABEL * trees)) ** 0.5
    step = np.uint64(64 - 8 * depth)

    def compare(key: np.ndarray, tree: np.ndarray, across: np.ndarray, side: np.ndarray, c: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        raw = labels.view(np.uint8).reshape(len(labels), -1)
        names, low = np.unique(c, return_inverse=True)
        links, count = [], np.zeros(BINS + 1, dtype=np.int64)
        ends = np.concatenate((np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        size = np.diff(np.concatenate(([0], ends)))
        left = np.repeat(ends, size) - np.arange(len(key)) - 1  # rows of the group that follow
        for d in range(1, int(size.max())):
            rows = np.flatnonzero(left >= d)
            rows = rows[~across[rows] | (side[rows] != side[rows + d])]
            for k in range(0, len(rows), 16_384):
                i = rows[k : k + 16_384]
                j = i + d
                same = ((raw[i] == raw[j]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                on = same >= threshold - slack
                i, j, same = i[on], j[on], same[on]
                links.append((low[i], low[j]))
                shared = ((labels[i] ^ labels[j]) >> step) == 0
                once = (same >= threshold) & (shared.argmax(axis=1) == tree[i])
                count += np.bincount(np.floor(same[once] * BINS).astype(np.int64), minlength=BINS + 1)
        i, j = (np.concatenate([p[k] for p in links]) if links else np.zeros(0, dtype=np.int64) for k in (0, 1))
        root = np.arange(len(names))
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        on = np.flatnonzero(root != np.arange(len(names)))
        bins = np.flatnonzero(count)
        a, b = np.concatenate((names[on], bins)), np.concatenate((names[root[on]], bins))
        edge = np.arange(len(a)) < len(on)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=~edge), pa.array(np.concatenate((on, count[bins])), pa.int64(), mask=edge)], ["a", "b", "n"])

    kept: list[tuple[np.ndarray, ...]] = []
    number = waiting = 0
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        tree, prefix, lo, hi, side, c = (b.column(k).to_numpy() for k in range(6))
        labels = b.column(6).flatten().to_numpy().reshape(-1, trees).view(np.uint64)
        new = np.ones(len(c), dtype=bool)
        new[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        now = (tree[0], prefix[0], lo[0], hi[0])
        new[0] = now != last
        last = (tree[-1], prefix[-1], lo[-1], hi[-1])
        key = number + np.cumsum(new)
        number = int(key[-1])
        kept.append((key, tree, lo < hi, side, c, labels))
        waiting += len(c)
        if waiting >= 8192:  # the last group may go on
            whole = [np.concatenate([p[k] for p in kept]) for k in range(6)]
            end = int(np.searchsorted(whole[0], number))
            if end:
                yield compare(*[w[:end] for w in whole])
            kept = [tuple(w[end:] for w in whole)]
            waiting = len(kept[0][0])
    if waiting:
        yield compare(*[np.concatenate([p[k] for p in kept]) for k in range(6)])


def plausible(classes: DataFrame, forest: DataFrame, depth: int, threshold: float, trees: int) -> DataFrame:
    """What alike() finds below the nodes of this depth. Nodes with the same texts are one, that of the first tree; large ones are compared in blocks."""
    crowded = forest.where(F.col("depth") >= depth).groupBy("c").agg(F.collect_set("tree").alias("in"))  # as many as there are trees, at most
    rows = classes.select("c", "labels").join(crowded, "c").select("c", "labels", F.explode("in").alias("tree"))
    rows = cut(rows.select("tree", F.shiftrightunsigned(F.element_at("labels", F.col("tree") + 1), 64 - 8 * depth).alias("prefix"), "c", "labels"))
    nodes = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
    large = nodes.where(F.col("n") > NODE_ROWS).select(F.struct("tree", "prefix").alias("node"), "n", F.ceil(F.col("n") / NODE_ROWS).cast("int").alias("blocks"))
    small = nodes.where((F.col("n") > 1) & (F.col("n") <= NODE_ROWS)).groupBy("n", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("node")).select("node.tree", "node.prefix")
    met = hot_join(rows.withColumn("node", F.struct("tree", "prefix")), large, "node", "n", rows.count(), "left", MOST_SENT * NODE_ROWS)  # there are less than rows / NODE_ROWS large ones
    few = met.where("blocks is null").join(small, ["tree", "prefix"]).select("tree", "prefix", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"), "c", "labels")
    many = met.where("blocks is not null").withColumn("own", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("tree", "prefix", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "c", "labels")
    order = ("tree", "prefix", "lo", "hi")
    both = few.unionByName(many).repartition(*order).sortWithinPartitions(*order)
    out = cut(both.mapInArrow(lambda batches: alike(batches, depth, threshold, trees), "a bigint, b bigint, n bigint"))
    drop_cut(rows)
    return out


def shingle_sets(texts: list[str], width: int) -> list[bytes]:
    """The sorted different shingle hashes of each text."""
    out = []
    for i, j in textvec.batches(texts):
        h, bounds = textvec.shingles(*textvec.words(texts[i:j]), width)
        out += [np.unique(h[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    uniq, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = (count > 1)[inverse]
    rows, cols = rows[shared], column[inverse[shared]]
    out = np.zeros((n, n))
    step = max(1, 8_000_000 // n)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for a in range(0, int(column[-1]) + 1, step):
        lo, hi = np.searchsorted(cols, [a, a + step])
        m = np.zeros((n, min(step, int(column[-1]) + 1 - a)), dtype=np.float32)
        m[rows[lo:hi], cols[lo:hi] - a] = 1
        out += m @ m.T
    return out


def compare(block: list[tuple[int, int, bytes, int]], own: bool, ratio: Fraction) -> list[tuple[int, int, int]]:
    """(text, smallest text linked in this block, linked rows) of a block's (text, rows, set, side); own: all pairs, else those across sides."""
    sets = [np.frombuffer(s, dtype=np.uint64) for _, _, s, _ in block]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    side = np.array([x[3] for x in block])
    inter = np.rint(overlaps(sets)).astype(np.int64)
    ok = inter * (ratio.numerator + ratio.denominator) >= ratio.numerator * (size[:, None] + size[None, :])
    ok &= ~np.eye(len(block), dtype=bool) if own else side[:, None] != side[None, :]
    links = ok @ np.array([x[1] for x in block], dtype=np.int64)
    names = np.array([x[0] for x in block], dtype=np.int64)
    root = names.copy()
    while True:
        low = np.minimum(root, np.where(ok, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == root).all():
            break
        root = low
    return [(int(a), int(r), int(k)) for a, r, k in zip(names, root, links, strict=True) if k]


def text_classes(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, trees: int, target: float) -> DataFrame:
    """One row per different non-empty text: (key, rep = smallest id, copies, n_links of each of its rows, component_id)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''").withColumn("key", F.unhex(F.md5("text")))
    id_type = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in textvec.parts(batch):
                labels, n = signatures(texts, width, trees)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(labels, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["id", "key", "labels", "shingles"])

    signed = rows.mapInArrow(sign, f"id {id_type}, key binary, labels array<bigint>, shingles bigint")
    classes = signed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels"), F.first("shingles").alias("shingles"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    least = shortest(threshold, trees, target)
    tries = classes.select(F.posexplode("labels").alias("tree", "label"), "c").select("tree", "label", "c").repartitionByRange("tree", "label", "c").sortWithinPartitions("tree", "label", "c")
    forest = cut(tries.mapInArrow(lambda batches: walk(batches, least), "tree int, label bigint, c bigint, depth int"))
    depth = LABEL
    while True:
        edges = plausible(classes, forest, depth, threshold, trees)
        found = {r["a"]: r["n"] for r in edges.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).collect()}  # at most BINS + 1 rows
        expected = recalls(found, depth, threshold, trees)
        if depth <= least or expected[depth] >= target:
            break
        drop_cut(edges)
        depth = next((d for d in range(depth - 1, least, -1) if expected[d] >= target), least)
    unit = components(edges.where("b is not null").select("a", "b"))
    drop_cut(edges)
    drop_cut(forest)

    members = cut(unit.select(F.col("id").alias("c"), F.col("component").alias("unit")).join(classes.select("c", "key", "rep", "copies", "shingles"), "c"))
    sizes = members.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("s"))
    large = sizes.select(F.col("unit").alias("u"), F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("s") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")).where("blocks > 1")
    members = members.join(sent(large, large.count()), F.col("unit") == F.col("u"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("u", "shingles")
    members = members.withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in textvec.parts(batch):
                sets = pa.array(shingle_sets(texts, width), pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("unit", "blocks", "block", "c", "copies")), sets], ["unit", "blocks", "block", "c", "copies", "shingles"])

    own_texts = rows.join(sent(members.withColumnRenamed("key", "k"), members.count()), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("rep")))
    own_texts = own_texts.select("unit", "blocks", "block", "c", "copies", "text")
    sets = own_texts.mapInArrow(to_sets, "unit bigint, blocks int, block int, c bigint, copies bigint, shingles binary")
    spread = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("unit", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "c", "copies", "shingles", F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), (F.col("blocks") > 1).alias("more"))

    ratio = Fraction(threshold).limit_denominator(10_000)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(found: list) -> pa.RecordBatch:
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([f[3] for f in found], pa.bool_())], ["c", "root", "n", "more"])

        def linked() -> list:
            return [(*x, now[3]) for x in compare(list(block.values()), now[1] == now[2], ratio)] if len(block) > 1 else []

        now, block = None, {}
        for b in batches:
            found = []
            for u, lo, hi, c, copies, s, side, more in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if (u, lo, hi, more) != now:
                    found += linked()
                    now, block = (u, lo, hi, more), {}
                block[c] = (c, copies, s, side)  # a repeated row of a representative is one text
            yield result(found)
        yield result(linked())

    found = spread.repartition("unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi").mapInArrow(verify, "c bigint, root bigint, n bigint, more boolean")
    found = cut(found)
    # A unit of one block is settled by its task; only what larger ones found in different blocks has to be brought together.
    links = found.groupBy("c").agg(F.sum("n").alias("n"), F.min("root").alias("root"))
    parted = found.where("more and c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))
    whole = classes.select("c", "key", "rep", "copies").join(links, "c", "left").withColumn("component", F.coalesce("root", "c")).drop("root")
    if not parted.isEmpty():
        group = components(parted).withColumnRenamed("component", "joint")
        whole = whole.join(group.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("joint", "component")).drop("joint")
    whole = cut(whole)
    drop_cut(found)
    first = whole.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m"))
    whole = hot_join(whole, first, "component", "m", whole.count())
    return whole.select("key", "rep", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, trees: int = 32, target: float = 0.99999
) -> DataFrame:
    """Every row with its near-duplicate links: (id, class_id, n_links, component_id, kept).

    Rows link if their texts are equal, or if the Jaccard similarity of their sets of `width`-word shingles (words: runs of letters
    and digits, lower-cased; a shorter text is one shingle) is at least `threshold`. class_id: smallest id with just this text; n_links: other rows
    linked directly, copies included; component_id: smallest id reachable by links; kept: id = component_id, so one
    id of each group stays. Null and empty texts link with nothing; texts without words link with equal texts only. Repeated rows
    count as copies of each other and get the same result; other columns are not looked at. Prefixes are shortened until all
    links but a share of 1 - target, as estimated from those found, are found; never beyond the depth at which a pair of just the threshold is missed with a
    probability of 1 - target.
    """
    return of_rows(docs, cut(text_classes(docs, id_col, text_col, width, threshold, trees, target)), id_col, text_col)


def of_rows(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The result of near_duplicates() from that of text_classes()."""
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.nullif(F.col(text_col).cast("string"), F.lit("")))).alias("key"))
    out = hot_join(rows.where("key is not null"), classes, "key", "copies", classes.agg(F.sum("copies")).first()[0] or 0)
    none = [F.lit(None).cast(classes.schema[c].dataType).alias(c) for c in classes.columns if c != "key"]
    out = out.unionByName(rows.where("key is null").select("id", "key", *none))
    out = out.select(
        F.col("id").alias(id_col),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("rep")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The input rows without those that near_duplicates() doesn't keep: one document of each group stays, the one of the smallest id.

    Of rows with equal id and text one stays. Null and empty texts all stay. Columns are those of the input.
    """
    classes = cut(text_classes(docs, id_col, text_col, **({"width": 5, "threshold": 0.8, "trees": 32, "target": 0.99999} | parameters)))
    gone = of_rows(docs, classes, id_col, text_col)
    counts = cut(gone.groupBy(F.col(id_col).alias("loomstat_gone"), "kept").agg(F.count(F.lit(1)).alias("n")))
    lost = counts.where("not kept")
    # An id may stand for several texts, so the key is part of the test only where ids repeat.
    if counts.where("n > 1").limit(1).count() or counts.groupBy("loomstat_gone").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        key = F.unhex(F.md5(F.nullif(F.col(text_col).cast("string"), F.lit(""))))
        stay = classes.where(F.col("rep").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("stay_key"), F.col("rep").alias("stay_id"))
        keyed = docs.withColumn("loomstat_key", key)
        empty = keyed.where("loomstat_key is null").drop("loomstat_key")
        full = keyed.join(stay, (F.col("loomstat_key") == F.col("stay_key")) & F.col(id_col).eqNullSafe(F.col("stay_id")), "left_semi")
        return full.dropDuplicates([id_col, "loomstat_key"]).drop("loomstat_key").unionByName(empty)
    return docs.join(sent(lost.select("loomstat_gone"), lost.count()), F.col(id_col).eqNullSafe(F.col("loomstat_gone")), "left_anti")
