"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the powers of two of its length's binary form (full
sequences first), and pieces of one length form a bucket. A sequence is one piece, so no sequence crosses documents,
none needs padding, and a batch of one bucket has one shape. Documents are decomposed one by one: no shuffle, and no
group that could be hot.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import small_batches
from .fst_tokens import byte_symbols

#: Texts with other characters are left to the tokenizer library itself: here case and normal forms are plain.
PLAIN = re.compile("[^\x00-įı-ɏ‐-‧]")
SPACE = [*range(9, 14), 32, 0x85, 0xA0]
#: Remembered words are forgotten beyond so many.
MOST_WORDS = 1_000_000


class WordTokenizer:
    """Ids of whole texts by a lower-casing word-BPE tokenizer (tokenizers .json), word by word with repeats looked up.

    Its split rule (English contractions, runs of letters, single digits, runs of others; white space dropped) is applied to all texts of a
    batch at once; each different word goes through the library once and is then found by a 64-bit hash.
    Texts with special strings or with characters outside a plain range go through the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.hf = Tokenizer.from_file(path)
        self.special = [t.content for t in self.hf.get_added_tokens_decoder().values()]
        kind = np.full(0x110000, 3, dtype=np.uint8)
        for c in range(0x2030):
            s = chr(c)
            kind[c] = 0 if c in SPACE else 1 if regex.match(r"\p{L}", s) else 2 if regex.match(r"\p{N}", s) else 3
        self.kind = kind
        self.symbol = byte_symbols()
        self.clear()

    def clear(self) -> None:
        self.known, self.n_words = textvec.Memo(), 0
        self.at = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 17, dtype=np.uint32)
        self.used = 0

    def add(self, hashes: list[int], words: list[str]) -> None:
        for h, w in zip(hashes, words, strict=True):
            k = self.n_words
            self.known.add(h, k)
            self.n_words += 1
            new = [t.id for t in self.hf.model.tokenize(w if w.isascii() and w.isprintable() else "".join(self.symbol[b] for b in w.encode()))]
            if k + 2 > len(self.at):
                self.at = np.concatenate((self.at, np.zeros_like(self.at)))
            if self.used + len(new) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(new)), dtype=np.uint32)))
            self.ids[self.used : self.used + len(new)] = new
            self.used += len(new)
            self.at[k + 1] = self.used

    def words(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of lower-cased code points."""
        kind = self.kind[cp]
        start = kind > 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        q = np.flatnonzero(start & (cp == 39))
        if len(q):
            pad = np.concatenate((cp, np.zeros(4, dtype=cp.dtype)))
            padded_kind = np.concatenate((kind, np.zeros(4, dtype=np.uint8)))
            a, b = pad[q + 1], pad[q + 2]
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for hit, n in ((q[two], 2), (q[three], 3)):
                start[hit + 1] = False
                after = hit + n
                after = after[padded_kind[after] == 1]
                start[after] = True
        inside = kind > 0
        last = inside.copy()
        last[:-1] &= ~inside[1:] | start[1:]
        return np.flatnonzero(start), np.flatnonzero(last) + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's ids start (one more for the end)."""
        odd = [k for k, t in enumerate(texts) if PLAIN.search(t) or any(s in t for s in self.special)]
        plain = list(texts)
        for k in odd:
            plain[k] = ""
        _, cp, starts = textvec.codes(plain)
        cp = textvec.tables()[1][cp]
        a, b = self.words(cp)
        uniq, first, inverse = np.unique(textvec.run_hashes(cp, a, b), return_index=True, return_inverse=True)
        if len(self.known) > MOST_WORDS:
            self.clear()
        which, missing = self.known.find(uniq)
        if missing:
            joined = cp.astype("<u4")
            which[missing] = np.arange(self.n_words, self.n_words + len(missing))
            self.add(uniq[missing].tolist(), [joined[a[first[k]] : b[first[k]]].tobytes().decode("utf-32-le") for k in missing])
            self.known.settle()
        which = which[inverse]
        n = self.at[which + 1] - self.at[which]
        bounds = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.at[which] - bounds[:-1], n) + np.arange(bounds[-1])]
        bounds = bounds[np.searchsorted(a, starts)]
        if odd:
            own = {k: np.array(self.hf.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32) for k in odd}
            parts = [own[k] if k in own else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
            ids = np.concatenate(parts)
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def decompose(n: int, most: int) -> list[int]:
    """Piece lengths of a document of n ids: full ones, then the powers of two of the rest, largest first."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if (n % most) >> k & 1]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = 4096, end_id: int = 2, keep_ids: bool = True, order_col: str | None = None) -> DataFrame:
    """Cut every document into pieces of power-of-two length, each of which is a sequence.

    tokenizer: path of a tokenizers .json file on every machine; most: longest sequence, a power of two. A document is its
    ids and end_id. Returns one row per piece: (id, start, length, bucket = log2(length), ids if keep_ids, ids_crc32,
    doc_tokens, sequence_id, offset = 0). Null text counts as empty: one piece, end_id. Repeated ids stay apart as
    sequences of their own; null ids stay null; other columns are not looked at. sequence_id is the row's place in its
    scan task: the same whenever a lost task runs again. With order_col, a column of different numbers from 0, sequence_id rises with that
    number (returned as position) and then with start, whatever order rows are read in: position * 2**k + number of the piece in its document.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.col(order_col).cast("long").alias("position")] if order_col else []))
    fields = f"id {rows.schema['id'].dataType.simpleString()}, start bigint, length bigint, bucket int, ids_crc32 bigint, doc_tokens bigint"
    fields += ", ids array<int>" if keep_ids else ""
    fields += ", position bigint, sequence_id bigint" if order_col else ""
    # A text has less than 2**31 tokens, so less than 2**room pieces.
    room = 32 - (most.bit_length() - 1)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer)
        for batch in batches:
            for part, texts in textvec.parts(batch, chars=1 << 20):
                ids, bounds = tok.encode(texts)
                n = np.diff(bounds)
                full = np.full(len(ids) + len(n), end_id, dtype="<u4")
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                lengths = [decompose(int(k) + 1, most) for k in n]
                per = np.array([len(x) for x in lengths])
                length = np.fromiter((x for one in lengths for x in one), dtype=np.int64, count=int(per.sum()))
                ends = np.cumsum(length)
                doc = np.repeat(np.arange(len(n)), per)
                start = ends - length - (bounds[:-1] + np.arange(len(n)))[doc]
                raw = memoryview(full).cast("B")
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), length.tolist(), strict=True)]
                out = [part.column("id").take(pa.array(doc)), start, length, np.log2(length).astype(np.int32), pa.array(crc, pa.int64()), (n + 1)[doc]]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(full.astype(np.int32))))
                if order_col:
                    position = part.column("position").to_numpy()[doc]
                    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                    out += [position, (position << room) + number]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], [f.split()[0] for f in fields.split(", ")])

    out = rows.mapInArrow(pieces, fields)
    if not order_col:
        out = out.withColumn("sequence_id", F.monotonically_increasing_id())
    out = out.withColumn("offset", F.lit(0).cast("long"))
    return out.withColumnRenamed("id", id_col)
