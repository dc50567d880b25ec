"""Text analytics: terms, categories, co-occurrence, events, relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .normalize import MOST_FIRSTS, name_matches
from .sizes import sent, spread


def terms(df: DataFrame, key: list[str], text: str, pattern: str = "[a-z]{3,}") -> DataFrame:
    """(key, pos, term): lower-case terms of the whole text, in order."""
    return df.select(*key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("pos", "term"))


def keywords(df: DataFrame, key: str, text: str, stop: list[str], boost: list[str], n: int) -> DataFrame:
    """The n strongest terms of each text: counts, three times for boosted terms; ties to the earlier one. Stop words are a short fixed list.

    A text's terms are together in its row, so they are sorted and counted there; nothing is shuffled.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    placed = F.filter(F.transform(found, lambda x, i: F.struct(x.alias("term"), i.alias("pos"))), lambda x: ~x["term"].isin(*stop))
    df = spread(df.select(key, text)).select(key, F.sort_array(placed).alias("s"))
    at = lambda i: F.get("s", i)
    # A text without terms has no first place and so no row: a filter here would be pushed below, and find and sort all terms twice.
    places = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)))
    df = df.withColumn("first", F.filter(places, lambda i: (i < F.size("s")) & ((i == 0) | (at(i)["term"] != at(i - 1)["term"]))))
    ends = F.concat(F.slice("first", 2, F.greatest(F.size("first"), F.lit(1))), F.when(F.size("first") > 0, F.array(F.size("s"))).otherwise(F.array().cast("array<int>")))

    def run(a, b):
        c = (b - a).cast("long")
        score = c * F.when(at(a)["term"].isin(*boost), 3).otherwise(1)
        return F.struct((-score).alias("order"), at(a)["pos"].alias("pos"), at(a)["term"].alias("term"), c.alias("c"), score.alias("score"))

    top = F.slice(F.sort_array(F.zip_with("first", ends, run)), 1, n)
    got = df.select(key, F.posexplode(top).alias("k", "x"))
    return got.select(key, "x.term", "x.c", "x.pos", "x.score", (F.col("k") + 1).alias("rank"))


#: Tokens that are paired at once, and pairs that a task holds before it counts them and hands on their counts.
TOKENS, MOST_PAIRS = 1 << 19, 1 << 24


def pair_counts(batches: Iterator[pa.RecordBatch], window: int, stop: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts (a, b, n) of unordered pairs of different terms in lists t of terms; the same pair comes again only after MOST_PAIRS others."""
    number: dict[str, int] = {}
    held: list[np.ndarray] = []

    def rows() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.zeros(0, dtype=np.int64), *held])
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts, keys = np.diff(first, append=len(keys)), keys[first]
        words = pa.array(list(number), pa.string())
        place = np.empty(len(number), dtype=np.int64)
        place[np.argsort(np.array(list(number)), kind="stable")] = np.arange(len(number))
        for k in range(0, len(keys), 1 << 16):
            lo, hi = keys[k : k + (1 << 16)] >> 32, keys[k : k + (1 << 16)] & 0xFFFFFFFF
            less = place[lo] < place[hi]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(np.where(less, lo, hi))), words.take(pa.array(np.where(less, hi, lo))), pa.array(counts[k : k + (1 << 16)])], ["a", "b", "n"])

    for b in batches:
        lists = b.column(0)
        size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
            tokens = lists.slice(at, to - at).flatten().dictionary_encode()
            local = np.array([-1 if w in stop else number.setdefault(w, len(number)) for w in tokens.dictionary.to_pylist()], dtype=np.int64)
            code, text = local[tokens.indices.to_numpy()] if len(tokens) else np.zeros(0, dtype=np.int64), np.repeat(np.arange(at, to), size[at:to])
            code, text = code[code >= 0], text[code >= 0]
            for k in range(1, window):
                x, y = code[:-k], code[k:]
                pair = (text[:-k] == text[k:]) & (x != y)
                held.append((np.minimum(x, y)[pair] << 32) | np.maximum(x, y)[pair])
            at = to
            if sum(map(len, held)) > MOST_PAIRS:
                yield from rows()
                number, held = {}, []
    yield from rows()


def cooccurrence(df: DataFrame, text: str, window: int, stop: list[str]) -> DataFrame:
    """(a, b, weight): unordered pairs of different terms less than `window` places apart, stop words left out. Pairs are counted in the task that reads their texts, as numbers; only counts are shuffled, once."""
    t = spread(df.select(text)).select(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)).alias("t"))
    p = t.mapInArrow(lambda batches: pair_counts(batches, window, stop), "a string, b string, n long")
    return p.groupBy("a", "b").agg(F.sum("n").alias("weight"))


def entities(df: DataFrame, key: str, text: str, rules: dict[str, str], gazetteer: DataFrame) -> DataFrame:
    """(key, kind, entity, n): typed entities by patterns, and by the names of a gazetteer (name, entity, kind), counted for each text."""
    out = name_matches(df, gazetteer, text, key).select(key, "kind", "entity")
    for kind, pattern in rules.items():
        out = out.unionByName(df.select(key, F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("entity")))
    return out.groupBy(key, "kind", "entity").agg(F.count(F.lit(1)).alias("n"))


def sentences(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, sentence)"""
    return df.select(*key, F.posexplode(F.split(text, r"[.!?]+[ \n]+")).alias("pos", "sentence")).where(F.length(F.trim("sentence")) > 0)


def events(df: DataFrame, key: str, text: str, triggers: DataFrame, gazetteer: DataFrame, date_pattern: str, most_chars: int = 300) -> DataFrame:
    """(key, pos, event_type, date, place, text): the sentences of each text that hold a trigger word.

    triggers: (term, kind); a sentence is of the kind of which it holds the most different terms, ties to the kind of the smaller name. date and place: the first in the sentence, else the first in the
    whole text, else null; places by name_matches(). Keys name one text each. text: the sentence's first characters.
    """
    s = cut(sentences(df, [key], text).withColumn("sentence", F.trim("sentence")).withColumn("at", F.concat_ws("#", F.col(key).cast("string"), "pos")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    few = [r["term"] for r in triggers.select("term").distinct().limit(MOST_FIRSTS + 1).collect()]
    if len(few) <= MOST_FIRSTS:  # told from other words in the sentence's row
        words = F.filter(words, lambda w: w.isin(*few))
    words = s.select("at", F.explode_outer(words).alias("term")).where("term is not null")
    kinds = words.join(sent(triggers), "term").groupBy("at", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("at").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind"))["kind"].alias("event_type"))
    names = cut(name_matches(s.select("at", "sentence"), gazetteer.where("kind = 'PLACE'"), "sentence", "at").groupBy("at").agg(F.min(F.struct("start", "entity"))["entity"].alias("place")))
    dated = s.select(key, "pos", "at", "sentence", F.nullif(F.regexp_extract("sentence", date_pattern, 0), F.lit("")).alias("date")).join(names, "at", "left")
    first = dated.groupBy(key).agg(F.min_by("date", F.when(F.col("date").isNotNull(), F.col("pos"))).alias("any_date"), F.min_by("place", F.when(F.col("place").isNotNull(), F.col("pos"))).alias("any_place"))
    got = dated.join(kinds, "at").join(first, key)
    return got.select(key, "pos", "event_type", F.coalesce("date", "any_date").alias("date"), F.coalesce("place", "any_place").alias("place"), F.substring("sentence", 1, most_chars).alias("text"))
