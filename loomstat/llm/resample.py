"""Target-distribution importance resampling over hashed n-grams, by batch concatenation.

A batch's texts are joined with separator sentinels, and one regular-expression pass finds all their words. A search of the words' places among the
documents' offsets tells whose each word is, which masks the n-grams that would cross documents before anything is counted. Hashes of n-grams come from
those of their words: the CRC of two joined strings is that of the first, carried over the second's length (a linear map, read from tables), xor that of the second.

Two passes over the texts: one counts all features by bucket (one array of fixed length leaves each task), the other adds each document's gains. What comes to
the driver is one number for each bucket. Ranks come from a global sort of narrow rows, whose places in files are their numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import cut, numbered, small_batches

#: Words in UTF-8, after A-Z are lower-cased: digits, a-z, and whatever isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Between texts: no word holds it.
SENTINEL = b"\n"
#: Whatever no word holds.
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of which features are made at once, about; a longer text is worked on piece by piece.
BYTES_AT_ONCE = 1 << 21
#: Words of fewer bytes are carried over by table, longer ones are joined and hashed whole.
TABLED = 64
#: The longest n-grams.
LONGEST = 3


@lru_cache(maxsize=1)
def carry_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a CRC, being b, becomes once n zero bytes follow (without the inversions, so a linear map)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)  # fixed value: the polynomial of CRC-32
    out = np.zeros((TABLED, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, TABLED):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


def carried(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs carried over n bytes each: xor the CRC of these bytes to get that of both together."""
    t = carry_tables().reshape(-1)
    at = n * 1024
    out = t[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= t[at + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    return out


@lru_cache(maxsize=1)
def word_bytes() -> np.ndarray:
    """For each byte: can it be in a word?"""
    return np.array([bool(WORD.match(bytes((b,)))) for b in range(256)])


def features(joined: bytes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of joined texts, piece by piece: of which text each is, its unsigned CRC-32, and whether it is a single word.

    joined: lower-cased texts, each followed by SENTINEL; starts: where each begins.
    """
    space = zlib.crc32(b" ")
    before: list[bytes] = []  # the last words of the piece before, and where they begin
    place_before = np.zeros(0, dtype=np.int64)
    at = 0
    while at < len(joined):
        gap = GAP.search(joined, min(at + BYTES_AT_ONCE, len(joined) - 1))
        at, begin = gap.end() if gap else len(joined), at
        new = WORD.findall(joined, begin, at)
        if not new:
            continue
        is_word = word_bytes()[np.frombuffer(joined, dtype=np.uint8, count=at - begin, offset=begin)]
        is_word[1:] &= ~is_word[:-1]  # left are the first bytes of words
        place = np.concatenate((place_before, begin + np.flatnonzero(is_word)))
        raw = before + new
        old, total = len(before), len(raw)
        n = np.fromiter(map(len, raw), dtype=np.int64, count=total)
        crc = np.fromiter(map(zlib.crc32, raw), dtype=np.uint32, count=total)
        doc = np.searchsorted(starts, place, "right") - 1
        yield doc[old:], crc[old:], np.ones(total - old, dtype=bool)
        gram = crc  # of the n-gram that ends with each word
        for length in range(2, LONGEST + 1):
            # An n-gram is the shorter one that ends a word before, a space, and the word; a word of another document masks it.
            last = np.arange(max(old, length - 1), total)
            last = last[doc[last] == doc[last - length + 1]]
            short = n[last] < TABLED
            after = np.zeros(total, dtype=np.uint32)
            near = last[short]
            after[near] = carried(carried(gram[near - 1], np.ones(len(near), dtype=np.int64)) ^ np.uint32(space), n[near]) ^ crc[near]
            for k in last[~short].tolist():
                after[k] = zlib.crc32(b" ".join(raw[k - length + 1 : k + 1]))
            # The next length starts from this one's n-grams, those that end in the words of the piece before included.
            for k in range(length - 1, old):
                after[k] = zlib.crc32(b" ".join(raw[k - length + 1 : k + 1]))
            yield doc[last], after[last], np.zeros(len(last), dtype=bool)
            gram = after
        before, place_before = raw[-(LONGEST - 1) :], place[-(LONGEST - 1) :]


def joined(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """The texts in UTF-8, A-Z lower-cased, each followed by SENTINEL, and where each begins."""
    raw = [t.encode().lower() for t in texts]
    starts = np.zeros(len(raw), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in raw[:-1]], out=starts[1:])
    return SENTINEL.join(raw) + SENTINEL, starts


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all features of the column text, buckets without a feature left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part in textvec.parts(batch, chars=1 << 20):
                for _, crc, _ in features(*joined(part)):
                    total += np.bincount(crc % buckets, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """What a feature of each bucket adds to a document's weight: 1000 times the log ratio of its smoothed shares in target and docs, rounded down.

    Both frames have a column text without nulls. One row for each bucket comes to the driver.
    """
    n = {k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) for k in ("docs", "target")}
    counts = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for k, frame in (("docs", docs), ("target", target)):
        counts = counts.join(bucket_counts(frame, buckets).withColumnRenamed("n", f"n_{k}"), "bucket", "left")
    counts = cut(counts.select("bucket", *[x.alias(f"n_{k}") for k, x in n.items()]))
    whole = counts.agg(*[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(k) for k in n]).first()
    all_docs, all_target = (F.lit(float(whole[k] + buckets)) for k in n)
    d = {k: F.col(f"n_{k}").cast("double") for k in n}
    ratio = (d["target"] + 1) * all_docs / ((d["docs"] + 1) * all_target)
    rows = counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()
    return [r["gain"] for r in sorted(rows, key=lambda r: r["bucket"])]


def noise(id_col: Column, seed: int) -> Column:
    """A Gumbel variate of a document, times 1000 and rounded down: from a SHA-256 of seed and id (a null id counts as empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42
) -> DataFrame:
    """Every row with its weight, score and place in the draw: (id, n_features, weight, score, rank).

    Features: all runs of one to three consecutive words (digits, a-z and all that isn't ASCII; only A-Z are lower-cased), repeats counted, hashed to buckets.
    weight: the sum of the gains() of a document's features; score: weight plus Gumbel noise. Of the N rows of at least `least_words` words the
    floor(percent * N / 100) of the highest scores are drawn, equal scores by ascending id (null ids last), which is drawing without replacement in proportion to
    exp(weight / 1000). rank: 1, 2, ... in that order; null for what isn't drawn. Null and empty texts have no feature and weight 0; rows that repeat an id or a
    text are rows of their own (with the same noise for the same id); texts may be of any length and are used whole; an empty target leaves the smoothed shares;
    other columns are not looked at. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), plain(text_col))
    gain = np.array(gains(rows, target.select(plain(target_text_col)), buckets), dtype=np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, part in textvec.parts(batch, chars=1 << 20):
                n_words, n_features, weight = (np.zeros(len(part), dtype=np.int64) for _ in range(3))
                for doc, crc, single in features(*joined(part)):
                    if len(doc):  # texts in order: one sum for each run of features of one text
                        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                        of = doc[first]
                        n = np.diff(np.append(first, len(doc)))
                        n_features[of] += n
                        weight[of] += np.add.reduceat(gain[crc % buckets], first)
                        if single[0]:
                            n_words[of] += n
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x) for x in (n_words, n_features, weight))], ["id", "n_words", "n_features", "weight"])

    id_type = rows.schema["id"].dataType.simpleString()
    weighed = rows.mapInArrow(weigh, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = F.col("n_words") >= least_words
    n_drawn = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.desc("weight"), "n_features"]
    placed = numbered(scored.where(able).orderBy(*order), "place").withColumn("rank", F.when(F.col("place") < n_drawn, F.col("place") + 1)).drop("place")
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
