"""Importance resampling, ranked search and token files against brute force, with hard rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_ops import HARD, SCHEMA, empty, tokenizer

from loomstat.llm import common, queries, ranked_search, resample, token_files

BYTE_BPE = "byte_bpe_50k.json"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA).withColumn("id", F.lit("clash")).withColumn("score", F.lit(-1)).withColumn("rank", F.lit(0)).withColumn("n", F.lit(2)).repartition(3)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_k2_treap_search"])
def test_sql(spark, sf, name):
    got = sorted(map(tuple, queries.queries()[name](spark, sf).collect()), key=str)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    assert got == sorted(c.execute(queries.oracle_sql()[name]).fetchall(), key=str)


# 11 Importance resampling


def plain_features(text):
    w = WORDS.findall(lowered(text))
    return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain_resample(rows, target, percent, least, buckets):
    features = [plain_features(t) for _, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (np.bincount([bucket(f) for fs in x for f in fs] or [0], minlength=buckets) - (0 if any(x) else np.eye(1, buckets, dtype=int)[0]) for x in ([f for _, f in features], [plain_features(x)[1] for x in target]))
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for (d, _), (n, fs) in zip(rows, features, strict=True):
        h = int(sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in fs)
        out.append([d, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_features_equal_plain_ones(monkeypatch):
    """Words of any length, no n-gram across texts, whatever the size of the pieces."""
    texts = ["A b", "", "c", "x" * 200 + " Ünï-Côdé 9 " + "y" * 64 + " z " + "w" * 63, " ".join(f"w{k}" for k in range(500)), "end\x00of\x7fall"]
    want = sorted((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in plain_features(t)[1])
    for size in (1 << 21, 64, 1):
        monkeypatch.setattr(resample, "BYTES_AT_ONCE", size)
        assert sorted((int(d), int(c)) for doc, crc, _ in resample.features(*resample.joined(texts)) for d, c in zip(doc, crc, strict=True)) == want


@pytest.mark.parametrize("percent, least", [(50, 1), (100, 0), (0, 1), (30, 5)])
def test_resample_hard_rows(spark, hard, percent, least):
    target = ["the cat and the dog", None, "", "word word word"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(hard, frame, percent=percent, least_words=least, buckets=1000).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample([(d, t) for d, t, *_ in HARD], target, percent, least, 1000)
    assert resample.resample(empty(hard), frame).count() == 0
    assert resample.resample(hard, empty(frame)).count() == len(HARD)


# 12 Ranked lexical search


def plain_search(rows, items, k):
    docs = [(d, Counter(w := WORDS.findall(lowered(t))), len(w)) for d, t in rows]
    docs = [d for d in docs if d[2]]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item, text in items:
        q = Counter(t for t in WORDS.findall(lowered(text)) if t in df)
        scored = []
        for d, tf, size in docs:
            m = 75 + 25 * size * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, r in q.items() if t in tf)
            if s:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "the CAT the the dog sat"), (2, None), (3, "..."), (3, "word ab x"), (None, "中文 é two"), (5, "unknown terms only"), (6, "one " * 300 + "two")]


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 20, 256, 8 << 20), (1 << 14, 1 << 20, 256, 40), (2, 5, 1, 40)])
def test_search_hard_rows(spark, hard, monkeypatch, sizes):
    for name, x in zip(("BLOCK_DOCS", "BLOCK_CELLS", "BUNDLE", "MOST_BYTES"), sizes, strict=True):
        monkeypatch.setattr(ranked_search, name, x)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("id", F.lit("clash"))
    for k in (2, 20):
        assert sorted(map(tuple, ranked_search.search(hard, items, k).collect()), key=str) == plain_search([(d, t) for d, t, *_ in HARD], ITEMS, k)
    assert ranked_search.search(empty(hard), items).count() == 0
    assert ranked_search.search(hard, empty(items)).count() == 0


def test_search_ties_and_copies(spark):
    """Hundreds of equal documents: the smallest ids; and rows of random words in several blocks."""
    rng = np.random.default_rng(3)
    rows = [(int(d), " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 30) % 200)) for d in rng.permutation(3000)]
    rows = [(d, "same text t1 t2 in many copies" if d % 3 == 0 else t) for d, t in rows]
    items = [(k, " ".join(f"t{int(x)}" for x in rng.integers(0, 200, 12))) for k in range(20)] + [(100, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = ranked_search.search(df, spark.createDataFrame(items, "item_id long, text string"), 20).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, items, 20)


def test_treap_holds_its_grid_and_opens_little():
    rng = np.random.default_rng(5)
    row, col = np.nonzero(rng.random((60, 1000)) < 0.05)
    impact = rng.integers(1, 1000, len(row))
    t = ranked_search.Treap(row, col, impact)
    grid = np.zeros((64, 1 << t.height), dtype=np.int64)
    grid[row, col] = impact
    node, most = np.zeros(grid.size, dtype=np.int64), np.full(grid.size, t.root)
    r, c = (x.ravel() for x in np.indices(grid.shape))
    for level in reversed(range(t.height)):
        node, most = t.below(node, most, 2 * (r >> level & 1) + (c >> level & 1))
    assert (most == grid.ravel()).all()
    best = ranked_search.Best(3)
    opened = ranked_search.descend(t, np.arange(1 << t.height), np.array([3]), np.array([1]), best)
    top = sorted((-x, k) for k, x in enumerate(grid[3]) if x)[:3]
    assert list(zip(best.score.tolist(), best.id.tolist(), strict=True)) == [(-x, k) for x, k in top] and opened < 1000


# 13 Token files


def plain_stream(rows):
    t = tokenizer(BYTE_BPE)
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in rows]


@pytest.mark.parametrize("length, batch, file", [(1024, 1 << 18, 1 << 26), (8, 64, 256), (5, 10, 1), (1, 1, 100_000)])
def test_token_files(spark, sf, monkeypatch, length, batch, file):
    monkeypatch.setattr(token_files, "BATCH_IDS", batch)
    monkeypatch.setattr(token_files, "FILE_IDS", file)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    if length < 100:
        docs = docs.where("doc_id < 40")  # many small files
    folder = token_files.write(docs, public_tokenizers.path(BYTE_BPE), length=length)
    stream = plain_stream(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    want, at = [], 0
    for d, ids in stream:
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.documents(spark, folder).collect())) == want
    # Random access: sequences of all files, in order, without their padding, are the stream.
    found = []
    for r in sorted(token_files.manifest(spark, folder).collect(), key=lambda r: (r["part"], r["file"])):
        s = token_files.Sequences(f"{folder}/{r['name']}")
        rows = [(ids, mask.to_numpy(zero_copy_only=False)) for ids, mask in (s[k] for k in range(len(s)))]
        assert all(len(ids) == len(mask) == length and not ids.flags.owndata for ids, mask in rows)
        assert all(mask.all() for _, mask in rows[:-1])
        mine = [ids[mask] for ids, mask in rows]
        assert sum(map(len, mine)) == r["n_ids"]
        found += mine
        with pytest.raises(IndexError):
            s[len(s)]
    assert np.concatenate(found).tolist() == [x for _, ids in stream for x in ids]


def test_token_files_hard_rows(spark, hard):
    """Null and repeated ids, null and empty texts, special strings, long runs; ids of another type; an empty table."""
    folder = token_files.write(hard, public_tokenizers.path(BYTE_BPE))
    want = [(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in plain_stream([(d, t) for d, t, *_ in HARD])]
    got = token_files.documents(spark, folder).orderBy("start").collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert [r["doc_id"] for r in got] == sorted((d for d, *_ in HARD), key=lambda d: (d is not None, d))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    named = hard.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    other = token_files.documents(spark, token_files.write(named, public_tokenizers.path(BYTE_BPE)), id_type="string")
    assert sorted((r["doc_id"] or "") for r in other.collect()) == sorted("" if d is None else f"d{d}" for d, *_ in HARD)
    assert token_files.documents(spark, token_files.write(empty(hard), public_tokenizers.path(BYTE_BPE))).count() == 0


def test_token_files_of_lost_tasks_do_not_count(spark, sf):
    """A file that the manifest doesn't name is no part of the folder, and is deleted by the writer."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/token-files-test"
    path = folder.removeprefix("file://")
    import os

    os.makedirs(path)
    open(f"{path}/part-000000-0000-left.arrow", "wb").write(b"half a file")
    token_files.write(docs, public_tokenizers.path(BYTE_BPE), folder)
    names = {r["name"] for r in token_files.manifest(spark, folder).collect()}
    assert {n for n in os.listdir(path) if n.endswith(".arrow")} == names
    assert token_files.documents(spark, folder).count() == docs.count()
