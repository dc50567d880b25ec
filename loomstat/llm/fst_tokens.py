"""Token counts by a compiled finite-state tokenizer.

The byte-level BPE tokenizer (split rule and merges together) is compiled, as texts need it, into one
deterministic transducer over characters. Each transition carries the number of tokens that it adds to the
count, so counting is one dictionary step for each character and no token is ever built.

A state is what can still matter of the text read so far: the place in the split rule, and for the piece being read
its longest suffix that a longer token could start with, together with the last token and relative count of BPE's
result at each place in that suffix. BPE results are those token sequences whose neighbours are all
compatible (BPE gives back just these two for their joined text), so the last token at a place follows from the
last tokens before it, and the window is enough: there are finitely many states. Counts may fall (a merge), hence
transitions may carry negative numbers.

A white space after another character is a sure boundary: every state becomes the start state there. So the stretches
between sure boundaries add up, and a stretch that comes again (found by a 64-bit hash) is not read again.

Long texts are cut into chunks. A chunk's map says for each state that is live at its beginning which state it ends in and how many tokens it adds.
The first live state of a chunk is the one that some characters before it lead to; then every state in which a chunk can end is live at the next one,
round by round until nothing is new (nearly always at once, as states soon forget what was before). Maps compose associatively, so they are
combined as a parallel prefix scan, 64 neighbours at a time, by Spark. No map holds text.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import cut, small_batches

#: White space (Unicode's and the ASCII separators), and those of it that stretches are cut before.
SPACE = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CUT_BEFORE = [9, 10, 13, 32]
#: Remembered stretches are forgotten beyond so many.
MOST_STRETCHES = 1_000_000
#: States are dropped and made again as needed beyond so many transitions; counts don't change.
MOST_TRANSITIONS = 600_000
#: Maps composed at a time, and characters before a chunk that its first live state is guessed from.
FAN_IN, LOOK = 64, 256


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return out


class State(dict):
    """Character -> (next state, tokens added). Missing transitions are computed once."""

    __slots__ = ("machine", "kind", "data")

    def __init__(self, machine: Machine, kind: str, data: tuple):
        super().__init__()
        self.machine, self.kind, self.data = machine, kind, data

    def __missing__(self, ch: str) -> tuple[State, int]:
        m = self.machine
        m.made += 1
        self[ch] = out = m.step(self.kind, self.data, ch)
        return out


class Machine:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.hf = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbol = byte_symbols()
        self.byte = {s: b for b, s in self.symbol.items()}
        added = set(self.special)
        self.tokens: dict[bytes, int] = {bytes(map(self.byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.text = {i: t for t, i in self.tokens.items()}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.classes: dict[str, str] = {}
        self.known = textvec.Memo()
        self.is_space = np.zeros(0x110000, dtype=bool)
        self.is_space[SPACE] = True
        self.is_cut = np.zeros(0x110000, dtype=bool)
        self.is_cut[CUT_BEFORE] = True
        self.reset()

    def reset(self) -> None:
        self.made = 0
        self.states: dict[tuple, State] = {}
        self.shared: dict[tuple, tuple] = {}
        self.start = self.state("start", ())

    def state(self, kind: str, data: tuple) -> State:
        s = self.states.get((kind, data))
        if s is None:
            s = self.states[kind, data] = State(self, kind, data)
        return s

    def bpe(self, text: bytes) -> list[int]:
        return [t.id for t in self.hf.model.tokenize("".join(self.symbol[b] for b in text))]

    def fits(self, left: int | None, token: int) -> bool:
        """Can token follow left (None: begin a piece) in a BPE result?"""
        if left is None:
            if (ok := self.alone.get(token)) is None:
                ok = self.alone[token] = self.bpe(self.text[token]) == [token]
            return ok
        if (ok := self.pairs.get((left, token))) is None:
            ok = self.pairs[left, token] = self.bpe(self.text[left] + self.text[token]) == [left, token]
        return ok

    def cls(self, ch: str) -> str:
        """L letter, N number, O other, S white space, as the tokenizer's own split rule has it."""
        if (c := self.classes.get(ch)) is None:
            whole = lambda a, b: len(self.hf.pre_tokenizer.pre_tokenize_str(a + ch + b)) == 1
            c = self.classes[ch] = "L" if whole("a", "b") else "N" if whole("1", "2") else "O" if whole("!", "!") else "S"
        return c

    # A piece read so far is (suffix, ends): ends[k] is (last token, count relative to now) at the k-th place of the suffix.
    EMPTY = (b"", ((None, 0),))

    def push(self, piece: tuple, data: bytes) -> tuple[tuple, int]:
        """The piece after more bytes, and how its token count changes."""
        total = 0
        one = self.shared.setdefault
        for b in data:
            suffix, ends = piece
            suffix += bytes((b,))
            for k in range(len(ends)):
                token = self.tokens.get(suffix[k:])
                if token is not None and self.fits(ends[k][0], token):
                    added = ends[k][1] + 1
                    break
            else:
                raise ValueError("no token fits; the vocabulary lacks single bytes")
            if added:
                ends = tuple([one(e, e) for e in [(t, n - added) for t, n in ends]])
            ends = (*ends, one((token, 0), (token, 0)))
            drop = next(k for k in range(len(suffix) + 1) if k == len(suffix) or suffix[k:] in self.prefixes)
            piece = (suffix[drop:], ends[drop:])
            piece = one(piece, piece)
            total += added
        return piece, total

    def step(self, kind: str, data: tuple, ch: str) -> tuple[State, int]:
        raw = ch.encode("utf-8", "surrogatepass")
        c = self.cls(ch)
        if kind == "start":
            piece, n = self.push(self.EMPTY, raw)
            if ch == "'":
                return self.state("quote", (piece,)), n
            if c == "S":
                return self.state("space", (piece, -n, ch)), n
            return self.state("run", (c, piece)), n
        if kind == "run":
            if c == data[0]:
                piece, n = self.push(data[1], raw)
                return self.state("run", (c, piece)), n
            return self.start[ch]
        if kind == "quote":  # an apostrophe that begins a piece
            if ch in "stmd":
                return self.start, self.push(data[0], raw)[1]
            if ch in "rvl":
                piece, n = self.push(self.EMPTY, raw)
                return self.state("quote2", (ch, piece, len(self.bpe(b"'" + raw + (b"l" if ch == "l" else b"e"))) - len(self.bpe(b"'")) - n)), n
            if c == "O":
                piece, n = self.push(data[0], raw)
                return self.state("run", ("O", piece)), n
            return self.start[ch]
        if kind == "quote2":
            first, piece, rest = data
            if ch == ("l" if first == "l" else "e"):
                return self.start, rest
            return self.state("run", ("L", piece))[ch]
        piece, before, last = data  # white space; before: how the count changes without its last character
        if c == "S":
            longer, n = self.push(piece, raw)
            return self.state("space", (longer, -n, ch)), n
        own, n = self.push(self.EMPTY, last.encode("utf-8", "surrogatepass"))
        if last == " ":  # goes with what follows
            own, more = self.push(own, raw)
            return self.state("run", (c, own)), before + n + more
        nxt, more = self.start[ch]
        return nxt, before + n + more

    def run(self, s: State, text: str) -> tuple[State, int]:
        """The state after the text, and the tokens that it adds."""
        if self.made > MOST_TRANSITIONS:
            self.reset()
        n = 0
        parts = self.cut_special.split(text) if self.cut_special and any(t in text for t in self.special) else [text]
        for k, part in enumerate(parts):
            if k:  # a special string: one token, then a new beginning
                s, n = self.start, n + 1
            for ch in part:
                s, d = s[ch]
                n += d
        return s, n

    def count(self, text: str) -> int:
        return self.run(self.start, text)[1]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The count of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        for i, j in textvec.batches(texts, 1 << 20):
            joined, cp, starts = textvec.codes(texts[i:j])
            cut = self.is_cut[cp]
            cut[1:] &= ~self.is_space[cp[:-1]]
            cut[starts[1:] - 1] = False
            cut[starts[:-1][np.diff(starts) > 1]] = True
            begin = np.flatnonzero(cut)
            if not len(begin):
                continue
            of = np.searchsorted(starts, begin, "right") - 1
            end = np.minimum(np.append(begin[1:], len(cp)), starts[of + 1] - 1)
            uniq, first, inverse = np.unique(textvec.run_hashes(cp, begin, end), return_index=True, return_inverse=True)
            if len(self.known) > MOST_STRETCHES:
                self.known = textvec.Memo()
            n, missing = self.known.find(uniq)
            for k in missing:
                at = first[k]
                n[k] = self.count(joined[begin[at] : end[at]])
                self.known.add(int(uniq[k]), int(n[k]))
            self.known.settle()
            np.add.at(out, i + of, n[inverse])
        return out

    def name(self, s: State) -> str:
        return repr((s.kind, s.data))

    def named(self, name: str) -> State:
        return self.state(*ast.literal_eval(name))

    def sure(self, text: str) -> np.ndarray:
        """Sure boundaries inside a text."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return np.flatnonzero(self.is_cut[cp[1:]] & ~self.is_space[cp[:-1]]) + 1

    def guess(self, look: str) -> str:
        """The state that the characters before a chunk lead to: surely, if there is a sure boundary among them."""
        at = self.sure(look)
        return self.name(self.run(self.start, look[at[-1] :] if len(at) else look)[0])

    def map(self, text: str, names: list[str]) -> list[tuple[str, int]]:
        """For each of these states before the chunk, the state after it and the tokens added."""
        at = self.sure(text)
        if not len(at):
            ends = [self.run(self.named(x), text) for x in names]
            return [(self.name(e), n) for e, n in ends]
        between = int(self.counts([text[at[0] : at[-1]]])[0])
        end, rest = self.run(self.start, text[at[-1] :])
        return [(self.name(end), self.run(self.named(x), text[: at[0]])[1] + between + rest) for x in names]

    def chunks(self, text: str, size: int) -> Iterator[tuple[int, str, str]]:
        """(number, characters before, chunk); special strings aren't cut."""
        borders = np.arange(0, max(1, len(text)), size)
        if self.cut_special:
            for m in self.cut_special.finditer(text):
                i = np.searchsorted(borders, m.start(), "right")
                borders[i : np.searchsorted(borders, m.end())] = m.start()
        ends = [*borders[1:].tolist(), len(text)]
        for k, (a, b) in enumerate(zip(borders.tolist(), ends, strict=True)):
            yield k, text[max(0, a - LOOK) : a], text[a:b]


@lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    return Machine(path)


def composed(b: pd.DataFrame) -> pd.DataFrame:
    """The map of neighbouring chunks from theirs."""
    maps: dict[int, dict[str, tuple[str, int]]] = {}
    for chunk, s, e, n in zip(b["chunk"], b["s"], b["e"], b["n"], strict=True):
        maps.setdefault(chunk, {})[s] = (e, n)
    first, *rest = [maps[k] for k in sorted(maps)]
    out = []
    for s, (e, n) in first.items():
        for one in rest:
            e, more = one[e]
            n += more
        out.append((b["row"].iloc[0], min(maps) // FAN_IN, s, e, n))
    return pd.DataFrame(out, columns=["row", "chunk", "s", "e", "n"])


def count_long(long: DataFrame, tokenizer: str, chunk_chars: int) -> DataFrame | None:
    """(id, n_bytes, n_tokens) of long texts (id, text, n_bytes), by their chunks' maps; None if there are none."""
    id_type = long.schema["id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer)
        for batch in batches:
            for b, texts in textvec.parts(batch):
                ids = b.column("id")
                for i, (row, n, text) in enumerate(zip(b.column("row").to_pylist(), b.column("n_bytes").to_pylist(), texts, strict=True)):
                    for k, look, piece in m.chunks(text, chunk_chars):
                        one = [pa.array([row]), pa.array([k], pa.int32()), ids.slice(i, 1), pa.array([n]), pa.array([look]), pa.array([piece])]
                        yield pa.RecordBatch.from_arrays(one, ["row", "chunk", "id", "n_bytes", "look", "piece"])

    # A row's own key, so that repeated ids stay apart.
    rows = long.withColumn("row", F.monotonically_increasing_id())
    chunks = cut(rows.mapInArrow(pieces, f"row bigint, chunk int, id {id_type}, n_bytes bigint, look string, piece string"))
    most = chunks.agg(F.max("chunk")).first()[0]
    if most is None:
        return None
    fields = "row bigint, chunk int, s string, e string, n bigint"

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = machine(tokenizer)
        start = m.name(m.start)
        for b in batches:
            out = []
            for row, chunk, look, piece, asked in zip(b["row"], b["chunk"], b["look"], b["piece"], b["asked"], strict=True):
                names = list(asked) if asked is not None else [m.guess(look) if chunk else start]
                out += [(row, chunk, x, e, n) for x, (e, n) in zip(names, m.map(piece, names), strict=True)]
            yield pd.DataFrame(out, columns=["row", "chunk", "s", "e", "n"])

    columns = ("row", "chunk", "look", "piece")
    known = cut(chunks.select(*columns, F.lit(None).cast("array<string>").alias("asked")).repartition("row", "chunk").mapInPandas(maps, fields))
    while True:
        ends = known.where(F.col("chunk") < most).select("row", (F.col("chunk") + 1).alias("chunk"), F.col("e").alias("s")).distinct()
        asked = ends.join(known, ["row", "chunk", "s"], "left_anti").join(chunks.select("row", "chunk"), ["row", "chunk"], "left_semi")
        asked = cut(asked.groupBy("row", "chunk").agg(F.collect_set("s").alias("asked")))
        if asked.isEmpty():
            break
        new = chunks.select(*columns).join(asked, ["row", "chunk"]).select(*columns, "asked").mapInPandas(maps, fields)
        known = cut(known.unionByName(new))
    level = known
    while most > 0:
        level = level.groupBy("row", F.floor(F.col("chunk") / FAN_IN).alias("block")).applyInPandas(composed, fields)
        most //= FAN_IN
    whole = level.where(F.col("s") == repr(("start", ()))).select("row", F.col("n").alias("n_tokens"))
    return chunks.where("chunk = 0").join(whole, "row").select("id", "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk_chars: int = 32_768) -> DataFrame:
    """Tokens of every whole text, as a byte-level BPE tokenizer gives them.

    tokenizer: path of a tokenizers .json file on every machine. Returns (id, n_bytes, n_tokens, over_limit), one row for
    each input row. Null text counts as empty (0 bytes, 0 tokens); repeated ids stay repeated rows and are counted
    each for itself; null ids stay null; other columns are not looked at. A text of more than two chunks is cut, its
    chunks are mapped anywhere in the cluster and their maps are composed.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > 2 * chunk_chars

    def short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer)
        for batch in batches:
            for b, texts in textvec.parts(batch, chars=1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(m.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    id_type = rows.schema["id"].dataType.simpleString()
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.where(~long).select("id", "text", n_bytes).mapInArrow(short_counts, f"id {id_type}, n_bytes bigint, n_tokens bigint")

    rest = count_long(rows.where(long).select("id", "text", n_bytes), tokenizer, chunk_chars)
    both = short.unionByName(rest) if rest is not None else short
    return both.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
