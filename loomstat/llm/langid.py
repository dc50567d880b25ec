"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (in lower case; and for single characters that it lacks). The
probability of a word, a run of letters and marks of any length, is the sum over all its segmentations into pieces, found by the forward algorithm, which
runs over all different words of a batch at once and keeps as many columns as the longest piece has characters. Piece probabilities are expected
counts over all segmentations of the training words (forward and backward from a uniform start, which favours few pieces).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import small_batches

#: Training takes expected counts of longer runs of letters window by window, each with so many letters more on both sides.
WINDOW, MARGIN = 1024, 128
#: Expected counts of wider words are taken in logarithms.
LOGS_FROM = 40
#: Languages that are scored together.
TOGETHER = 256
#: Characters of the vocabulary with a column of their own in the trie's table; steps by others are looked up.
DENSE = 160


class Pieces:
    """The vocabulary as a trie over compact symbols: 0 nothing, 1 the word mark, then characters of pieces, then blocks of 128 other characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "\u2581"
        lower, word = textvec.tables()[1], letters()[0]
        found = set()
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i):
                continue
            p = sp.id_to_piece(i)
            body = "".join(chr(lower[ord(c)]) for c in p.removeprefix(mark))
            if body and all(word[ord(c)] for c in body):
                found.add(p[: len(p) - len(body)] + body)
        often: dict[str, int] = {}
        for p in found:
            for c in p.removeprefix(mark):
                often[c] = often.get(c, 0) + 1
        chars = sorted(often, key=lambda c: (-often[c], c))
        self.longest = max(map(len, found), default=1)
        self.n_chars = len(chars)
        self.symbol = (np.arange(0x110000, dtype=np.int32) >> 7) + self.n_chars + 2
        for k, c in enumerate(chars):
            self.symbol[ord(c)] = k + 2
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for number, p in enumerate([mark, *chars, *sorted(p for p in found if len(p) > 1)]):
            node = 0
            for c in p:
                s = 1 if c == mark else int(self.symbol[ord(c)])
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    piece.append(-1)
                node = children[node][s]
            piece[node] = number
        self.n_own = number + 1
        self.size = self.n_own + (0x110000 >> 7)
        self.piece = np.array(piece, dtype=np.int32)
        self.table = np.zeros((len(children), DENSE), dtype=np.int32)
        rest = {}
        for node, kids in enumerate(children):
            for s, child in kids.items():
                if s < DENSE:
                    self.table[node, s] = child
                else:
                    rest[node * (self.n_chars + 2) + s] = child
        self.keys = np.array(sorted(rest), dtype=np.int64)
        self.child = np.array([rest[k] for k in sorted(rest)], dtype=np.int32)

    def step(self, node: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The trie's nodes after symbols of pieces, 0 where there is none."""
        rare = s >= DENSE
        out = self.table[node, np.where(rare, 0, s)]
        if len(self.keys) and rare.any():
            key = node[rare].astype(np.int64) * (self.n_chars + 2) + s[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.child[at], 0)
        return out

    def matches(self, s: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, pieces) of all pieces that begin at place i in the rows of symbols."""
        rows = np.flatnonzero(s[:, i])
        block = s[rows, i] >= self.n_chars + 2
        if block.any():
            yield i + 1, rows[block], s[rows[block], i] - (self.n_chars + 2) + self.n_own
            rows = rows[~block]
        node = np.zeros(len(rows), dtype=np.int32)
        for j in range(i, min(s.shape[1], i + self.longest)):
            c = s[rows, j]
            on = (c > 0) & (c < self.n_chars + 2)
            if not on.all():
                rows, node, c = rows[on], node[on], c[on]
            node = self.step(node, c)
            on = node > 0
            if not on.all():
                rows, node = rows[on], node[on]
            if not len(rows):
                break
            p = self.piece[node]
            is_piece = p >= 0
            if is_piece.any():
                yield j + 1, rows[is_piece], p[is_piece]

    def forward(self, s: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Log-probabilities of whole words [row, language]; prob: [piece, language]. Columns are kept as long as a piece can reach them, and rescaled."""
        n = self.longest + 1
        length = (s > 0).sum(axis=1)
        a = np.zeros((n, len(s), prob.shape[1]))
        a[0] = 1
        scale = np.zeros(a.shape[1:])
        out = np.zeros(a.shape[1:])
        for i in range(s.shape[1] + 1):
            done = np.flatnonzero(length == i)
            if len(done):
                out[done] = np.log(np.maximum(a[i % n, done], 1e-300)) + scale[done]
            if i == s.shape[1]:
                break
            for j, rows, p in self.matches(s, i):
                a[j % n, rows] += a[i % n, rows] * prob[p]
            a[i % n] = 0
            if i % 8 == 7:
                top = a.max(axis=0)
                top[top <= 0] = 1
                a /= top
                scale += np.log(top)
        return out

    def expected(self, s: np.ndarray, inner: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, piece, expected count) of words, all pieces alike beforehand; of pieces that begin from inner[0] up to inner[1] only, if given."""
        width = s.shape[1]
        length = (s > 0).sum(axis=1)
        even = 1.0 / self.n_own
        m = [(i, j, rows, p) for i in range(width) for j, rows, p in self.matches(s, i)]
        here = np.arange(len(s))
        if width > LOGS_FROM:  # sums of long words would leave the range of doubles
            even = np.log(even)
            a, b = np.full((width + 1, len(s)), -np.inf), np.full((width + 1, len(s)), -np.inf)
            a[0], b[length, here] = 0, 0
            for i, j, rows, p in m:
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + even)
            for i, j, rows, p in reversed(m):
                b[i, rows] = np.logaddexp(b[i, rows], b[j, rows] + even)
            weight = lambda i, j, rows: np.exp(a[i, rows] + even + b[j, rows] - a[length[rows], rows])
        else:
            a, b = np.zeros((width + 1, len(s))), np.zeros((width + 1, len(s)))
            a[0], b[length, here] = 1, 1
            for i, j, rows, p in m:
                a[j, rows] += a[i, rows] * even
            for i, j, rows, p in reversed(m):
                b[i, rows] += b[j, rows] * even
            weight = lambda i, j, rows: a[i, rows] * even * b[j, rows] / a[length[rows], rows]
        out = []
        for i, j, rows, p in m:
            share = weight(i, j, rows)
            if inner is not None:
                on = (inner[0][rows] <= i) & (i < inner[1][rows])
                rows, p, share = rows[on], p[on], share[on]
            out.append((rows, p, share))
        return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter or a mark; is it a letter."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    return np.array([k in "LM" for k in kind]), np.array([k == "L" for k in kind])


def different_words(v: Pieces, texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Groups (numbers, symbols [word, place]) of the different words, those of like length together; for each word of the texts, its number; its text; which texts have a letter."""
    _, cp, starts = textvec.codes(texts)
    is_word, is_letter = letters()
    a, b = textvec.runs(is_word[cp])
    has = np.add.reduceat(is_letter[cp], starts[:-1]) > 0 if len(texts) else np.zeros(0, dtype=bool)
    cp = textvec.tables()[1][cp]
    text = np.searchsorted(starts, a, "right") - 1
    _, one, which = np.unique(textvec.run_hashes(cp, a, b), return_index=True, return_inverse=True)
    a, n = a[one], (b - a)[one]
    group = np.ceil(np.log2(np.maximum(n, 16))).astype(int)
    out = []
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        k = n[rows]
        s = np.zeros((len(rows), int(k.max()) + 1), dtype=np.int32)
        s[:, 0] = 1
        row = np.repeat(np.arange(len(rows)), k)
        place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        s[row, place + 1] = v.symbol[cp[a[rows][row] + place]]
        out.append((rows, s))
    return out, which, text, has


def windows(s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]]:
    """(rows, symbols, places to count) of words: as they are, or window by window where they are long."""
    if s.shape[1] <= WINDOW:
        step = max(1, 4_000_000 // s.shape[1])
        for k in range(0, len(s), step):
            yield np.arange(k, min(k + step, len(s))), s[k : k + step], None
        return
    length = (s > 0).sum(axis=1)
    for at in range(0, s.shape[1], WINDOW):
        rows = np.flatnonzero(length > at)
        lo = max(0, at - MARGIN)
        for k in range(0, len(rows), 2000):
            some = rows[k : k + 2000]
            yield some, s[some, lo : at + WINDOW + MARGIN], (np.full(len(some), at - lo), np.full(len(some), at - lo + WINDOW))


class Model:
    """Languages, their log prior and their piece counts, held as (piece, language, count) triples by language."""

    def __init__(self, langs: list[str], prior: np.ndarray, size: int, piece: np.ndarray, lang: np.ndarray, n: np.ndarray, smooth: float):
        order = np.argsort(lang, kind="stable")
        self.langs, self.prior, self.size = langs, prior, size
        self.piece, self.lang, self.n = piece[order], lang[order], n[order]
        both = np.bincount(piece, n, size) + 0.5
        self.base = both / both.sum()
        self.total = np.bincount(lang, n, len(langs))
        self.share = smooth * self.total + 1
        self.block: tuple[int, np.ndarray] | None = None

    def prob(self, first: int) -> np.ndarray:
        """Piece probabilities [piece, language] of TOGETHER languages from this one on."""
        if self.block is None or self.block[0] != first:
            to = min(first + TOGETHER, len(self.langs))
            lo, hi = np.searchsorted(self.lang, [first, to])
            dense = self.base[:, None] * self.share[None, first:to]
            dense[self.piece[lo:hi], self.lang[lo:hi] - first] += self.n[lo:hi]
            self.block = (first, dense / (self.total + self.share)[None, first:to])
        return self.block[1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"block": None}


def fit(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.01) -> Model:
    """Piece counts of each language, from all rows with a text and a language; null and empty ones, and those without letters, add nothing.

    Counts are summed where the rows are; what comes to the driver is bounded by vocabulary x languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(per)
    number = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(vocabulary)
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0)
        for batch in batches:
            for part, texts in textvec.parts(batch, chars=1 << 20):
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                groups, which, text, _ = different_words(v, texts)
                if not len(which):
                    continue
                # How often each different word occurs in each language.
                used, times = np.unique(which * np.int64(len(langs)) + lang[text], return_counts=True)
                word, spoken = used // len(langs), used % len(langs)
                parts_k, parts_n = [keys], [sums]
                for names, s in groups:
                    for some, symbols, inner in windows(s):
                        row, piece, share = v.expected(symbols, inner)
                        row = names[some][row]
                        lo, hi = np.searchsorted(word, row), np.searchsorted(word, row, "right")
                        at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
                        parts_k.append(np.repeat(piece, hi - lo).astype(np.int64) * len(langs) + spoken[at])
                        parts_n.append(np.repeat(share, hi - lo) * times[at])
                keys, inverse = np.unique(np.concatenate(parts_k), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate(parts_n), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array((keys // max(1, len(langs))).astype(np.int32)), pa.array((keys % max(1, len(langs))).astype(np.int32)), pa.array(sums)], ["piece", "k", "n"])

    found = rows.mapInArrow(count, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas() if langs else pd.DataFrame({"piece": [], "k": [], "n": []})
    prior = np.log(np.array([per[x] for x in langs], dtype=float) / max(1, sum(per.values())))
    return Model(langs, prior, pieces(vocabulary).size, found["piece"].to_numpy(dtype=np.int64), found["k"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=float), smooth)


def log_words(v: Pieces, model: Model, s: np.ndarray) -> np.ndarray:
    """Log-probabilities of words [row, language]."""
    logs = np.empty((len(s), len(model.langs)))
    for first in range(0, len(model.langs), TOGETHER):
        prob = model.prob(first)
        step = max(1, 2_000_000 // ((v.longest + 1) * prob.shape[1]))
        for k in range(0, len(s), step):
            logs[k : k + step, first : first + prob.shape[1]] = v.forward(s[k : k + step], prob)
    return logs


def predict(docs: DataFrame, model: Model, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text.

    lang_pred: the language of the highest posterior (ties: the first by name), `und` where the text is null or has no letter, or no language is known; score: that
    posterior, 0 for `und`. Ids may be null or repeat; other columns are not looked at. Runs of letters are segmented whole, whatever their length and script.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(vocabulary)
        langs, prior = sent.value.langs, sent.value.prior
        for batch in batches:
            for part, texts in textvec.parts(batch, chars=1 << 20):
                groups, which, text, known = different_words(v, texts)
                if not langs:
                    known[:] = False
                total = np.tile(prior, (len(texts), 1))
                if len(which) and langs:
                    logs = np.empty((int(which.max()) + 1, len(langs)))
                    for names, s in groups:
                        logs[names] = log_words(v, sent.value, s)
                    for k in range(len(langs)):
                        total[:, k] += np.bincount(text, logs[which, k], len(texts))
                if langs:
                    top = total.argmax(axis=1)
                    best = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lang = [langs[top[k]] if known[k] else "und" for k in range(len(texts))]
                posterior = [float(best[k]) if known[k] else 0.0 for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(posterior, pa.float64())], ["id", "lang_pred", "score"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Is crc32 of the id's text, modulo parts, just this part? False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
