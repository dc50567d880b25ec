"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams (words and word pairs; character-shape 2- and 3-grams, present or making up a good part of the text; runs of
repeated words) are scaled by the log of their class count ratio, counted over all training rows, and a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import small_batches

BITS = 17
SIZE = 1 << BITS
#: Shares of a text's shape n-grams from which one counts as making up a good part of it.
SHARES = (0.01, 0.04, 0.12, 0.3)
#: A label list of at most so many rows is sent to every executor; a longer one is joined by a shuffle.
MOST_SENT = 1_000_000


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return textvec.mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55) + np.uint64(salt))


def shapes() -> np.ndarray:
    """A class for each code point: 1 small letter, 2 capital, 3 digit, 4 line feed, 5 other white space, 6 other letters, else a class of its own."""
    out = np.arange(0x110000, dtype=np.uint64) + np.uint64(16)
    for c in range(0x3000):
        s = chr(c)
        k = 1 if s.islower() else 2 if s.isupper() else 3 if s.isdigit() else 4 if s == "\n" else 5 if s.isspace() else 6 if s.isalpha() else 0
        if k:
            out[c] = k
    out[0x3040:0xD7FF] = 6
    return out


SHAPES: list[np.ndarray] = []


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The indicator numbers (below SIZE, sorted) of each text, and their bounds."""
    if not SHAPES:
        SHAPES.append(shapes())
    parts, counts = [], []
    for i, j in textvec.batches(texts):
        m = j - i
        is_word, lower, _ = textvec.tables()
        _, cp, starts = textvec.codes(texts[i:j])
        a, b = textvec.runs(is_word[cp])
        w = textvec.run_hashes(lower[cp], a, b)
        doc = np.searchsorted(starts, a, "right") - 1
        n = np.bincount(doc, minlength=m)
        pair = doc[1:] == doc[:-1]
        docs, found = [doc, doc[1:][pair], np.arange(m)], [salted(w, 1), salted(w[:-1][pair] * np.uint64(3) + w[1:][pair], 2), salted(np.zeros(m), 3)]
        for back, salt in ((1, 4), (2, 5)):
            same = (w[back:] == w[:-back]) & (doc[back:] == doc[:-back])
            share = np.bincount(doc[back:][same], minlength=m) / np.maximum(n, 1)
            for k, low in enumerate((0.02, 0.06, 0.15, 0.3, 0.5)):
                docs.append(np.flatnonzero(share >= low))
                found.append(salted(np.full(len(docs[-1]), k), salt))
        docs.append(np.arange(m))
        found.append(salted(np.log2(n + 1).astype(np.int64), 6))
        # Shapes: letters and white space once for each run, other characters up to three times.
        c = SHAPES[0][cp]
        new = np.ones(len(c), dtype=bool)
        new[1:] = c[1:] != c[:-1]
        if len(c) > 3:
            new[3:] |= (c[3:] >= 16) & ~((c[3:] == c[2:-1]) & (c[3:] == c[1:-2]) & (c[3:] == c[:-3]))
        c, at = c[new], np.searchsorted(starts, np.flatnonzero(new), "right") - 1
        for size in (2, 3):
            if len(c) < size:
                continue
            k = len(c) - size + 1
            g = np.zeros(k, dtype=np.uint64)
            for d in range(size):
                g = g * np.uint64(0x100000001B3) + c[d : d + k]
            inside = at[:k] == at[size - 1 :]
            g, of = textvec.mix(g[inside]) >> np.uint64(64 - 20), at[:k][inside]
            key, times = np.unique((of.astype(np.int64) << 20) | g.astype(np.int64), return_counts=True)
            of, g = key >> 20, key & ((1 << 20) - 1)
            share = times / np.maximum(np.bincount(of, times, minlength=m), 1)[of]
            docs.append(of)
            found.append(salted(g, 16 * size))
            for low, cut_at in enumerate(SHARES):
                much = share >= cut_at
                docs.append(of[much])
                found.append(salted(g[much], 16 * size + 1 + low))
        key = np.unique((np.concatenate(docs).astype(np.int64) << BITS) | (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64))
        parts.append((key & (SIZE - 1)).astype(np.int32))
        counts.append(np.bincount(key >> BITS, minlength=m))
    if not parts:
        return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def dual_descent(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int = 0) -> np.ndarray:
    """Weights of the hinge-loss model on indicators scaled by ratio (L1 loss, L2 penalty): one dual variable at a time."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(SIZE), np.zeros(len(rows))
    scale = [ratio[r] / max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]
    for _ in range(rounds):
        change = 0.0
        for i in rng.permutation(len(rows)):
            r, v, y = rows[i], scale[i], label[i]
            slope = y * float(w[r] @ v) - 1
            new = min(max(alpha[i] - slope, 0.0), cost)
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y * v
                change = max(change, abs(new - alpha[i]))
                alpha[i] = new
        if change < 1e-3:
            break
    return w


class Model:
    """Weights for indicators, already scaled; a text's indicators are normed by their scaled length."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, slope: float, shift: float):
        self.square, self.weight, self.slope, self.shift = ratio**2, ratio * weights, slope, shift

    def margins(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        at = bounds[:-1]  # every text has indicators
        return np.add.reduceat(self.weight[index], at) / np.sqrt(np.maximum(np.add.reduceat(self.square[index], at), 1e-18))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(*features(texts)) + self.shift, -30, 30)))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Is crc32 of the id's text, modulo parts, just this part? False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, cost: float = 1.0, rounds: int = 10, smooth: float = 1.0) -> Model:
    """Fit on the rows of docs that have a label 0 or 1 (others, and null ids, aren't used).

    Log-count ratios use all such rows; the hinge-loss model uses the `sample` rows of the smallest hash of id and text. Without rows of both
    classes every text scores (ones + 1) / (rows + 2).
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = F.broadcast(known) if known.count() <= MOST_SENT else known
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(known, "id").select("id", "text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, SIZE), dtype=np.int64)
        seen = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for b, texts in textvec.parts(batch):
                index, bounds = features(texts)
                y = b.column("y").to_numpy()
                both = np.repeat(y, np.diff(bounds))
                for k in (0, 1):
                    n[k] += np.bincount(index[both == k], minlength=SIZE)
                    seen[k] += int((y == k).sum())
        there = np.flatnonzero(n.sum(axis=0))
        found = (np.append(there, -1).astype(np.int32), np.append(n[0][there], seen[0]), np.append(n[1][there], seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["f", "n0", "n1"])

    # At most SIZE + 1 rows, whatever the input.
    counts = rows.select("text", "y").mapInArrow(count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    f, n = counts["f"].to_numpy(), counts[["n0", "n1"]].to_numpy()
    seen = n[f < 0].sum(axis=0)
    if not len(f) or seen.min() == 0:
        odds = (seen[1] + 1) / (seen[0] + 1) if len(f) else 1.0
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, float(np.log(odds)))
    full = np.full((2, SIZE), smooth)
    full[:, f[f >= 0]] += n[f >= 0].T
    ratio = np.log(full[1] / (seen[1] + 2 * smooth)) - np.log(full[0] / (seen[0] + 2 * smooth))
    ratio[full.sum(axis=0) <= 2 * smooth + 2] = 0  # seen less than three times

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in textvec.parts(batch):
                found, bounds = features(texts)
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found))], ["y", "f"])

    h = F.xxhash64("id", "text")
    if int(seen.sum()) > sample:  # the sample lies below a bound that leaves room for chance
        room = min(1.0, (sample + 8 * sample**0.5) / int(seen.sum()))
        rows = rows.where(h < F.lit(int(-(2**63) + room * (2**64 - 1))))
    few = rows.orderBy(h).limit(sample).select("text", "y").mapInArrow(index, "y int, f array<int>").toArrow()
    y = few.column("y").to_numpy() * 2 - 1
    if abs(int(y.sum())) == len(y):
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, float(np.log((seen[1] + 1) / (seen[0] + 1))))
    sets: list[np.ndarray] = []
    for chunk in few.column("f").chunks:
        flat, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        sets += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    w = dual_descent(sets, y, ratio, cost, rounds)
    return Model(ratio, w, 4.0, 0.0)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, predicted) for every row, and the columns named in keep.

    score: 0 to 1, higher where label 1 is likelier; predicted: 1 from 0.5. Null and empty texts are scored like any other, by the
    indicators of an empty text; ids may be null or repeat, and each row has its own result; texts are read whole, whatever their length; columns may have any names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep if c != text_col])
    own = {c: "text" if c == text_col else f"keep_{c}" for c in keep}
    names = ["id", *own.values()]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", score double"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in textvec.parts(batch):
                s = sent.value.scores(texts)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s, pa.float64())], [*names, "score"])

    out = rows.mapInArrow(score, fields)
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(own[c]).alias(c) for c in keep])
