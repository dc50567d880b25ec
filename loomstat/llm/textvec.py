"""Vectorised views of many texts at once: code points, character runs and 64-bit run hashes.

All texts of an Arrow batch become one array of code points, so the per-character work is numpy's and
nothing loops over words in Python. Used inside tasks only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, for an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter or digit; its lower case (where that is one character); a random 64-bit value."""
    word = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x32400):  # beyond it there are no letters or digits
        s = chr(c)
        word[c] = s.isalnum()
        low = s.lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return word, lower, mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def powers() -> np.ndarray:
    """Powers of an odd number, one for each place in a run; longer runs use them again, mixed with the block's number."""
    p, x = [], 1
    for _ in range(1 << 12):
        p.append(x)
        x = x * 0x9E3779B97F4A7C55 % (1 << 64)
    return np.array(p, dtype=np.uint64)


#: Characters that are worked on together: temporary arrays are some 150 bytes for each.
CHARS = 1 << 18


def parts(batch: pa.RecordBatch, column: str = "text", chars: int = CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of an Arrow batch whose texts hold about so many bytes together (one long text may hold more), and these texts."""
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + chars, "right")))
        piece = batch.slice(at, to - at)
        yield piece, piece.column(column).to_pylist()
        at = to


def batches(texts: Iterable[str | None], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of list positions that together hold about so many characters; one long text may hold more."""
    start = n = 0
    i = -1
    for i, t in enumerate(texts):
        n += len(t) if t else 0
        if n >= chars:
            yield start, i + 1
            start, n = i + 1, 0
    if start <= i:
        yield start, i + 1


def codes(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts as one, each followed by one line feed; its code points; and where each text starts (one more for the end)."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=starts[1:])
    return joined, cp, starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def run_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of cp[start:end] for each run; runs don't overlap and are in order."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    value, power = tables()[2], powers()
    n = end - start
    total = int(n.sum())
    first = np.cumsum(n) - n
    place = np.arange(total) - np.repeat(first, n)
    at = np.repeat(start, n) + place
    v = value[cp[at]]
    if int(n.max()) > len(power):
        v = mix(v + (place // len(power)).astype(np.uint64))
        place = place % len(power)
    return mix(np.add.reduceat(v * power[place], first) + n.astype(np.uint64))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, lower-cased) of the texts, and where each text's words start (one more for the end)."""
    is_word, lower, _ = tables()
    _, cp, starts = codes(texts)
    a, b = runs(is_word[cp])
    return run_hashes(lower[cp], a, b), np.searchsorted(a, starts)


def shingles(word: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of so many words (all its words, if fewer), repeats included, and their bounds."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate(([0], np.cumsum(count)))
    total = int(out_bounds[-1])
    at = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(total)
    left = np.repeat(np.minimum(n, width), count)
    h = np.zeros(total, dtype=np.uint64)
    for j in range(width):
        inside = left > j
        w = word[np.minimum(at + j, max(len(word) - 1, 0))] if len(word) else word
        h = np.where(inside, mix(h * np.uint64(0x9E3779B97F4A7C55) + w), h)
    return h, out_bounds


class Memo:
    """64-bit hash -> whole number, in sorted arrays (16 bytes an entry) and a small dictionary of what came last."""

    MERGE = 1 << 15

    def __init__(self) -> None:
        self.keys, self.values, self.recent = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), {}

    def __len__(self) -> int:
        return len(self.keys) + len(self.recent)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The values of different hashes, and the positions of those that aren't known (their values mean nothing)."""
        out = np.zeros(len(hashes), dtype=np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            out = self.values[at]
            rest = np.flatnonzero(self.keys[at] != hashes)
        else:
            rest = np.arange(len(hashes))
        missing, recent = [], self.recent
        for k, h in zip(rest.tolist(), hashes[rest].tolist(), strict=True):
            if (v := recent.get(h)) is None:
                missing.append(k)
            else:
                out[k] = v
        return out, missing

    def add(self, key: int, value: int) -> None:
        self.recent[key] = value

    def settle(self) -> None:
        """Move what came last into the arrays once it is much."""
        if len(self.recent) < self.MERGE:
            return
        keys = np.concatenate((self.keys, np.fromiter(self.recent.keys(), dtype=np.uint64, count=len(self.recent))))
        values = np.concatenate((self.values, np.fromiter(self.recent.values(), dtype=np.int64, count=len(self.recent))))
        order = np.argsort(keys)
        self.keys, self.values, self.recent = keys[order], values[order], {}
