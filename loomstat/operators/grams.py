"""Runs of words (n-grams) counted as numbers, level by level: a run is counted only if the shorter runs in it can matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from .graph import cut

#: Words that get numbers, and runs by which longer ones are chosen. With more words, callers count all runs as strings; with more runs, longer ones are chosen by their words alone.
MOST_RUNS = 1 << 17
#: Words that are counted at once in a task, and characters of a slice of texts.
TOKENS, SLICE = 1 << 19, 1 << 23

Batches = Iterator[pa.RecordBatch]


def with_kind(schema: StructType, name: str, kind: DataType) -> StructType:
    """The schema with another type of one column."""
    return StructType([StructField(name, kind) if f.name == name else f for f in schema])


def found(text: str, stop: list[str]):
    """The words of three letters or more of a text, in lower case, stop words left out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*stop))


def dealt(df: DataFrame, text: str, slice_chars: int | None = None) -> DataFrame:
    """df in slices of about SLICE characters of text, as many as there are cores at least: what a task holds doesn't grow with the table, and no task has most of the texts."""
    chars = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-chars // (slice_chars or SLICE))))


def sizes(lists: pa.Array) -> np.ndarray:
    """Lengths of lists; 0 for null."""
    return np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def portions(size: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, end and list lengths of so many rows at once that their lists hold about `most` values."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to, size[at:to]
        at = to


def pieces(batches: Batches) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Groups, words of all lists, and the row of each word: of so many rows (g, w) at once that their lists hold about TOKENS words."""
    for b in batches:
        for at, to, size in portions(sizes(b.column("w")), TOKENS):
            yield b.column("g").slice(at, to - at), b.column("w").slice(at, to - at).flatten(), np.repeat(np.arange(to - at), size)


def ends(size: np.ndarray) -> pa.Array:
    """Offsets of lists of these lengths."""
    return pa.array(np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(size, dtype=np.int32))))


def row_counts(row: np.ndarray, place: np.ndarray, n_rows: int, n_places: int) -> list[pa.Array]:
    """For each row the different places that it has, and how often."""
    key, n = np.unique(row * n_places + place, return_counts=True)
    row, at = np.divmod(key, n_places)
    return [pa.ListArray.from_arrays(ends(np.bincount(row, minlength=n_rows)), pa.array(x.astype(np.int32))) for x in (at, n)]


def tally(groups: pa.Array, key: np.ndarray, row: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, n, docs) of each different pair of them: how often it occurs, and in how many rows. Rows ascend."""
    coded = groups.dictionary_encode(null_encoding="encode")
    group = coded.indices.to_numpy()[row]
    order = np.lexsort((key, group))
    group, key, row = group[order], key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    other = new.copy()
    other[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    docs = np.add.reduceat(other, first, dtype=np.int64) if len(first) else first
    return coded.dictionary.take(pa.array(group[first])), key[first], np.diff(first, append=len(key)), docs


def summed(df: DataFrame, count: Callable[[Batches], Batches], key: str) -> DataFrame:
    """(g, key, n, docs): the counts that tasks made of their rows, summed."""
    kind = StructType([df.schema["g"]]).add("key", key).add("n", "long").add("docs", "long")
    return df.mapInArrow(count, kind).groupBy("g", "key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def word_counts(df: DataFrame) -> DataFrame:
    """(g, key, n, docs): how often each word occurs in a group's lists (g, w), and in how many of them."""

    def count(batches: Batches) -> Batches:
        for groups, words, row in pieces(batches):
            coded = words.dictionary_encode()
            g, k, n, docs = tally(groups, coded.indices.to_numpy().astype(np.int64), row)
            yield pa.RecordBatch.from_arrays([g, coded.dictionary.take(pa.array(k)), pa.array(n), pa.array(docs)], ["g", "key", "n", "docs"])

    return summed(df.select("g", "w"), count, "string")


def coded(df: DataFrame, words: list[str]) -> DataFrame:
    """df with the places in `words` instead of the words of its lists w; -1 for other words."""

    def code(batches: Batches) -> Batches:
        known = pa.array(words, pa.string())
        for b in batches:
            at = b.schema.get_field_index("w")
            codes = pc.fill_null(pc.index_in(b.column("w").flatten(), value_set=known), -1)
            yield b.set_column(at, "w", pa.ListArray.from_arrays(ends(sizes(b.column("w"))), codes))

    return df.mapInArrow(code, with_kind(df.schema, "w", ArrayType(IntegerType())))


def member(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the numbers are among the ascending ones."""
    if not len(some):
        return np.zeros(len(key), dtype=bool)
    return some[np.minimum(np.searchsorted(some, key), len(some) - 1)] == key


def runs(code: np.ndarray, row: np.ndarray, n_words: int, chosen: list[np.ndarray | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1, 2 and so on to one more than `chosen` has: the number of the run that begins at each place, and whether it lies in one row and all shorter runs in it are known words and chosen (None: all are)."""
    key, fine = code, code >= 0
    yield key, fine
    for m, some in enumerate(chosen):
        if some is not None:
            fine = fine & member(key, some)
        fine = fine[:-1] & fine[1:] & (row[: len(fine) - 1] == row[m + 1 :])
        key = key[:-1] * n_words + code[m + 1 :]
        yield key, fine


def run_counts(df: DataFrame, n_words: int, chosen: list[np.ndarray | None]) -> DataFrame:
    """(g, key, n, docs): counts of runs one longer than `chosen` has, in lists (g, w) of numbers of words. key: the words' numbers as digits to the base n_words."""

    def count(batches: Batches) -> Batches:
        for groups, codes, row in pieces(batches):
            *_, (key, fine) = runs(codes.to_numpy().astype(np.int64), row, n_words, chosen)
            g, k, n, docs = tally(groups, key[fine], row[: len(fine)][fine])
            yield pa.RecordBatch.from_arrays([g, pa.array(k), pa.array(n), pa.array(docs)], ["g", "key", "n", "docs"])

    return summed(df.select("g", "w"), count, "long")


def spelled(key: np.ndarray, words: pa.Array, length: int) -> pa.Array:
    """The runs of these numbers, words joined by blanks."""
    parts = []
    for _ in range(length):
        key, last = np.divmod(key, len(words))
        parts.insert(0, words.take(pa.array(last)))
    return pc.binary_join_element_wise(*parts, " ")


def terms(df: DataFrame, words: list[str], length: int) -> DataFrame:
    """df with the runs that the numbers in its column key stand for."""

    def spell(batches: Batches) -> Batches:
        known = pa.array(words, pa.string())
        for b in batches:
            at = b.schema.get_field_index("key")
            yield b.set_column(at, "key", spelled(b.column("key").to_numpy().astype(np.int64), known, length))

    return df.mapInArrow(spell, with_kind(df.schema, "key", StringType()))


def keys(df: DataFrame) -> np.ndarray | None:
    """The different numbers in its column key, ascending; None if they are more than MOST_RUNS."""
    some = [r["key"] for r in df.select("key").distinct().limit(MOST_RUNS + 1).collect()]
    return np.sort(np.array(some, dtype=np.int64)) if len(some) <= MOST_RUNS else None


def most_frequent(df: DataFrame, vocabulary: int, longest: int = 3, counts: bool = False) -> tuple[list[str], DataFrame] | None:
    """The `vocabulary` most frequent runs of one to `longest` words of those in two rows of df at least (ties to the smaller), and df with numbers instead of the words in its lists w and a list `terms` of all occurrences of those runs
    (counts: lists `at` and `n` instead, of each row's different runs by their places in the first, and how often it has them). None if words or runs that tie are too many to hold.

    A run is as rare as its rarest word, at least. So the vocabulary-th of the words bounds how often words of longer runs must occur, and then the vocabulary-th of words and pairs how often pairs in runs of three must.
    """
    d = df.withColumn("g", F.lit(0))

    def best(counts: DataFrame, least: int) -> list[tuple[int, object]] | None:
        counts = counts.where((F.col("docs") >= 2) & (F.col("n") >= least)).select("n", "key")
        nth = [r["n"] for r in counts.orderBy(F.desc("n")).limit(vocabulary).collect()]
        some = counts.where(F.col("n") >= min(nth)).limit(MOST_RUNS + 1).collect() if len(nth) == vocabulary else counts.limit(MOST_RUNS + 1).collect()
        return [(r["n"], r["key"]) for r in some] if len(some) <= MOST_RUNS else None

    counted = best(cut(word_counts(d)), 1)
    if counted is None:
        return None
    words = sorted(w for _, w in counted)
    known = pa.array(words, pa.string())
    number = {w: k for k, w in enumerate(words)}
    got = [(-n, w, 1, number[w]) for n, w in counted]
    d = cut(coded(d, words)) if words else d
    chosen: list[np.ndarray | None] = [None]
    for length in range(2, longest + 1):
        least = -sorted(got)[vocabulary - 1][0] if len(got) >= vocabulary else 1
        counted = best(cut(run_counts(d, len(words), chosen)), least) if words else []
        if counted is None:
            return None
        key = np.array([k for _, k in counted], dtype=np.int64)
        got += [(-n, w, length, k) for (n, _), w, k in zip(counted, spelled(key, known, length).to_pylist() if len(key) else [], key.tolist())]
        chosen.append(np.sort(key))
    taken = sorted(got)[:vocabulary]
    wanted = []
    for length in range(1, longest + 1):
        mine = sorted((k, w) for _, w, m, k in taken if m == length)
        wanted.append((np.array([k for k, _ in mine], dtype=np.int64), [w for _, w in mine]))
    names = [w for _, mine in wanted for w in mine]
    held = [w for _, w, *_ in taken]
    place = {w: k for k, w in enumerate(held)}
    places = np.array([place[w] for w in names], dtype=np.int64)

    def listed(batches: Batches) -> Batches:
        named = pa.array(names, pa.string())
        for b in batches:
            for lo, hi, size in portions(sizes(b.column("w")), TOKENS):
                row, before, which, where = np.repeat(np.arange(hi - lo), size), 0, [], []
                for (key, fine), (mine, _) in zip(runs(b.column("w").slice(lo, hi - lo).flatten().to_numpy().astype(np.int64), row, len(words), [None] * (longest - 1)), wanted):
                    fine = fine & member(key, mine)
                    which.append(before + np.searchsorted(mine, key[fine]))
                    where.append(row[: len(fine)][fine])
                    before += len(mine)
                which, where = np.concatenate(which), np.concatenate(where)
                if counts:
                    lists = row_counts(where, places[which], hi - lo, len(held))
                else:
                    lists = [pa.ListArray.from_arrays(ends(np.bincount(where, minlength=hi - lo)), named.take(pa.array(which[np.argsort(where, kind="stable")])))]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *lists], kind.names)

    d = d.drop("g")
    more = [StructField("at", ArrayType(IntegerType())), StructField("n", ArrayType(IntegerType()))] if counts else [StructField("terms", ArrayType(StringType()))]
    kind = StructType([*d.schema, *more])
    return held, d.mapInArrow(listed, kind)
