"""Ranked lexical search by a K2-treap over the grid of terms and documents.

Documents are dealt to blocks. A block's grid has a row for each term that is asked for and a column for each of its documents; a cell holds the term's impact
in the document (the part of the score that depends on both, without the term's weight). The treap is the grid's quadtree, level by level, empty
quadrants left out: a node is a mask of its four children, the number of its first child, and by how much the greatest impact below it falls short of its parent's.

An item's terms each follow their row's path down the tree, all over the same range of documents: the sum of their nodes' maxima, times weights, bounds the score of
every document in the range. Ranges are taken best first, a bundle at a time, and halved; those whose bound can't beat the item's k-th best
document are never opened. A task carries the best documents from block to block, so later blocks start with a high bar, and what leaves it are k rows for each item.

Texts are read once for each bundle of items: a narrow table (document, its length, asked terms with their counts) is written, from which also the statistics come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from itertools import chain, islice, repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec
from .common import cut, small_batches

#: Terms in UTF-8, after A-Z are lower-cased: digits, a-z, and whatever isn't ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Terms of a text that are held at once.
TERMS_AT_ONCE = 1 << 18
#: Items of a bundle at most, and bytes of their different terms and of their lists (one item may have more): what is sent to every task.
MOST_ITEMS, MOST_BYTES = 2048, 8 << 20
#: Documents and filled cells of a block at most, about.
BLOCK_DOCS, BLOCK_CELLS = 1 << 14, 1 << 20
#: Ranges opened at a time.
BUNDLE = 256
#: Documents without an id come after all others.
NO_ID = np.iinfo(np.int64).max
CHILDREN = np.array([bin(m).count("1") for m in range(16)], dtype=np.int64)


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, some at a time."""
    raw = text.encode().lower()
    if len(raw) <= 8 * TERMS_AT_ONCE:
        yield TERM.findall(raw)
        return
    found = TERM.finditer(raw)
    while some := [m.group() for m in islice(found, TERMS_AT_ONCE)]:
        yield some


class Treap:
    """The K2-treap of one block: rows are terms, columns documents."""

    def __init__(self, row: np.ndarray, col: np.ndarray, impact: np.ndarray):
        """Filled cells, each once."""
        top = max(int(row.max()), int(col.max()), 1)
        self.height = top.bit_length()
        z = np.zeros(len(row), dtype=np.int64)
        for b in range(self.height):
            z |= ((row >> b) & 1) << (2 * b + 1) | ((col >> b) & 1) << (2 * b)
        order = np.argsort(z)
        z, most = z[order], impact[order]
        levels = [(z, most, np.zeros(len(z), dtype=np.uint8), np.zeros(len(z), dtype=np.int64))]
        for _ in range(self.height):
            up = z >> 2
            first = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
            mask = np.bitwise_or.reduceat(np.left_shift(1, z & 3), first).astype(np.uint8)
            z, most = up[first], np.maximum.reduceat(most, first)
            levels.append((z, most, mask, first))
        levels.reverse()
        # One numbering for all nodes, the root first; a node's children follow each other.
        sizes = [len(x[0]) for x in levels]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        self.mask = np.concatenate([x[2] for x in levels])
        self.first = np.concatenate([x[3] + begins[k + 1] for k, x in enumerate(levels)]).astype(np.int32)
        parents = [np.repeat(x[1], CHILDREN[x[2]]) for x in levels[:-1]]
        self.root = int(levels[0][1][0])
        short = np.concatenate([[0], *[p - x[1] for p, x in zip(parents, levels[1:], strict=True)]])
        self.short = short.astype(np.min_scalar_type(int(short.max())))

    def below(self, node: np.ndarray, most: np.ndarray, quadrant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The child of each node in this quadrant and its maximum; -1 and 0 where there is none (or no node)."""
        mask = self.mask[node]
        has = (node >= 0) & ((mask >> quadrant) & 1 > 0)
        child = np.where(has, self.first[node] + CHILDREN[mask & ((1 << quadrant) - 1)], -1)
        return child, np.where(has, most - self.short[child], 0)


class Best:
    """The k best documents of an item so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    def open(self, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Could a document of at most this score and at least this id be among the best?"""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (first_id < self.id[-1]))


def descend(treap: Treap, ids: np.ndarray, rows: np.ndarray, weight: np.ndarray, best: Best, bundle: int = BUNDLE) -> int:
    """Add the block's best documents for an item (its terms' rows, and weights times repeats) to best; returns how many ranges were opened.

    ids: of the columns, in ascending order; columns beyond them don't exist, so nothing is found there.
    """
    inside = rows >> treap.height == 0  # a term of a row beyond the block's grid isn't in the block
    rows, weight = rows[inside], weight[inside]
    n = len(rows)
    at = np.full(1, treap.height, dtype=np.int64)
    first = np.zeros(1, dtype=np.int64)
    node = np.zeros((1, n), dtype=np.int64)
    most = np.full((1, n), treap.root, dtype=np.int64)
    bound = most @ weight
    opened = 0
    while len(bound):
        if len(bound) > bundle:
            take = np.argpartition(-bound, bundle)[:bundle]
            left = np.ones(len(bound), dtype=bool)
            left[take] = False
        else:
            take, left = np.arange(len(bound)), np.zeros(len(bound), dtype=bool)
        opened += len(take)
        level = at[take] - 1
        bit = (rows[None, :] >> level[:, None]) & 1
        halves = [treap.below(node[take], most[take], 2 * bit + h) for h in (0, 1)]
        new_node, new_most = (np.concatenate([x[k] for x in halves]) for k in (0, 1))
        new_first = np.concatenate((first[take], first[take] + (1 << level)))
        level = np.concatenate((level, level))
        new_bound = new_most @ weight
        there = new_bound > 0
        single = there & (level == 0)
        if single.any():
            best.add(new_bound[single], ids[new_first[single]])
        more = there & (level > 0)
        more[more] = best.open(new_bound[more], ids[new_first[more]])
        left[left] = best.open(bound[left], ids[first[left]])
        at, first, node, most, bound = (np.concatenate((old[left], new[more])) for old, new in ((at, level), (first, new_first), (node, new_node), (most, new_most), (bound, new_bound)))
    return opened


def blocks(batches: Iterator[pa.RecordBatch], most_docs: int, most_cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of documents (id, n, terms, counts): ids in ascending order, lengths; columns, terms and counts of the filled cells."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = cells = 0

    def block() -> tuple[np.ndarray, ...]:
        ids, n, size = (np.concatenate([h[k] for h in held]) for k in range(3))
        term, count = (np.concatenate([h[k] for h in held]) for k in (3, 4))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        return ids[order], n[order], np.repeat(place, size), term, count

    for b in batches:
        ids = b.column("id").fill_null(NO_ID).to_numpy()
        lists = b.column("terms"), b.column("counts")
        size = np.diff(lists[0].offsets.to_numpy())
        term, count = (x.flatten().to_numpy() for x in lists)
        ends = np.cumsum(size)
        a = 0
        while a < len(ids):
            room = max(1, most_cells - cells)
            z = min(len(ids), a + most_docs - docs, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + room, "right"))))
            lo, hi = (int(ends[a - 1]) if a else 0), int(ends[z - 1])
            held.append((ids[a:z], b.column("n").to_numpy()[a:z], size[a:z], term[lo:hi], count[lo:hi]))
            docs, cells, a = docs + z - a, cells + hi - lo, z
            if docs >= most_docs or cells >= most_cells:
                yield block()
                held, docs, cells = [], 0, 0
    if docs:
        yield block()


def postings(docs: DataFrame, number: Mapping[bytes, int]) -> DataFrame:
    """(id, n, terms, counts) of each document (id, text), written: how many terms it has, and which of the asked ones how often."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in textvec.parts(batch, chars=1 << 20):
                n, sizes, terms, counts = [], [], [], []
                for text in texts:
                    total, parts = 0, []
                    for some in terms_of(text):
                        total += len(some)
                        found = np.fromiter(map(number.get, some, repeat(-1)), dtype=np.int64, count=len(some))
                        parts.append(found[found >= 0])
                    uniq, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), return_counts=True)
                    n.append(total)
                    sizes.append(len(uniq))
                    terms.append(uniq)
                    counts.append(count)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return cut(docs.mapInArrow(read, "id bigint, n bigint, terms array<bigint>, counts array<bigint>"))


def search_bundle(docs: DataFrame, items: list[list[bytes]], k: int) -> DataFrame:
    """(item: its place in the list, id, score) of the best documents, written: at least the k best of each item, but k of each task at most."""
    names = sorted({t for terms in items for t in terms})
    number = {t: r for r, t in enumerate(names)}
    found = postings(docs, number)
    whole = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = whole["docs"], whole["terms"]
    df = {r["term"]: r["df"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    # Rows by weight, so that neighbours are alike and rare terms leave whole quadrants empty; a term that no document holds has no row.
    held = sorted(df, key=lambda t: (-df[t], t))
    row = np.full(len(names), -1, dtype=np.int64)
    row[held] = np.arange(len(held))
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in held], dtype=np.int64)
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    for terms in items:
        rows, repeats = np.unique(row[[number[t] for t in terms]] if terms else row[:0], return_counts=True)
        on = rows >= 0
        on[on] = weight[rows[on]] > 0
        asked.append((rows[on], weight[rows[on]] * repeats[on]))
    most_docs, most_cells, bundle = BLOCK_DOCS, BLOCK_CELLS, BUNDLE

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for ids, n, col, term, count in blocks(batches, most_docs, most_cells):
            if not len(col):
                continue
            m = 75 + (25 * n * n_docs) // n_terms
            treap = Treap(row[term], col, (1_000_000_000 * count) // (1000 * count + 12 * m[col]))
            padded = np.full(max(1 << treap.height, len(ids)), NO_ID, dtype=np.int64)
            padded[: len(ids)] = ids
            for (rows, w), b in zip(asked, best, strict=True):
                if len(rows):
                    descend(treap, padded, rows, w, b, bundle)
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        ids, score = (np.concatenate([getattr(b, x) for b in best]) for x in ("id", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["item", "id", "score"])

    return cut(found.where(F.size("terms") > 0).mapInArrow(rank, "item bigint, id bigint, score bigint"))


def bundles(items: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Item ids and their terms, as many at a time as may be sent to every task; items without terms are left out."""
    ids, lists, used = [], [], 0
    for r in items.toLocalIterator():
        terms = list(chain.from_iterable(terms_of(r["text"])))
        if not terms:
            continue
        more = sum(map(len, terms)) + 8 * len(terms)
        if ids and (len(ids) >= MOST_ITEMS or used + more > MOST_BYTES):
            yield ids, lists
            ids, lists, used = [], [], 0
        ids.append(r["id"])
        lists.append(terms)
        used += more
    if ids:
        yield ids, lists


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The k best documents of each item: (item, rank from 1, id, score), scores above 0 only, equal scores by ascending id.

    Terms: runs of digits, a-z and all that isn't ASCII, only A-Z lower-cased, of whole texts. N documents hold a term, L terms in all. A term of df documents weighs
    floor(1000 * ln((2N + 2) / (2df + 1))); in a document of n terms that holds it tf times it counts 10^9 * tf div (1000 * tf + 12 * m), m = 75 + 25 * n * N div L. Scores
    add up over an item's terms, repeats included.

    Ids of documents are whole numbers; null ids come last among equal scores; rows that repeat an id or a text are documents of their own. Null and empty texts have no terms: such
    documents don't count, such items get no rows. Items that repeat an id are items of their own (ranks then repeat); item ids may be null or of any type. Texts may be of
    any length; other columns are not looked at. Items go through the driver in bundles of bounded bytes, and each bundle reads the documents once; everything else stays on Spark.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = items.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    id_type = asked.schema["id"].dataType.simpleString()
    out = None
    for number, (ids, lists) in enumerate(bundles(asked)):
        found = search_bundle(rows, lists, k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {id_type}")
        found = found.join(F.broadcast(names), "item").select(F.lit(number).alias("bundle"), "item", "item_id", "id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"bundle int, item bigint, item_id {id_type}, id bigint, score bigint")
    by_score = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = out.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
