"""Token ids as Arrow files of fixed-size-list batches.

Documents in ascending order of their ids form one long stream of token ids, which is cut into sequences of one length. A file is an Arrow IPC
file whose rows are sequences: ids (of two bytes where the vocabulary allows, else four) and mask (true: an id, false: padding after a file's last id; a bit each) as fixed-size
lists, and the documents that begin in the sequence (id, place, number of ids). Every batch but a file's last has the same number of rows, so that a sequence's place
follows from its number, and ids and masks of a batch are one plain buffer each: with a memory map nothing is copied or parsed.

Spark sorts the documents; each task writes the files of its range under names of its own attempt, batch by batch, and returns a row for each. Only the
files that the written table of these rows (the manifest) names count, so a task that runs twice leaves no double; what it left is deleted.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import MADE, shared_dir, small_batches

#: White space; a stretch begins at one of the second list that follows a character which isn't white space: there byte-level BPE surely begins anew.
SPACE = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CUT_BEFORE = [9, 10, 13, 32]
#: Remembered stretches are forgotten beyond so many, or beyond so many ids.
MOST_STRETCHES, MOST_IDS = 1_000_000, 8_000_000
#: Ids of a batch, about, and of a file at most (a multiple of it): 1 MB and 256 MB.
BATCH_IDS, FILE_IDS = 1 << 18, 1 << 26


class StretchTokenizer:
    """Ids of whole texts by a byte-level BPE tokenizer (tokenizers .json), stretch by stretch.

    Stretches are cut from all texts of a batch at once. Each different one goes through the library once and is then found by a 64-bit hash.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.hf = Tokenizer.from_file(path)
        self.size = max(self.hf.get_vocab(with_added_tokens=True).values()) + 1
        self.is_space = np.zeros(0x110000, dtype=bool)
        self.is_space[SPACE] = True
        self.is_cut = np.zeros(0x110000, dtype=bool)
        self.is_cut[CUT_BEFORE] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.n = textvec.Memo(), 0
        self.at = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)

    def add(self, hashes: list[int], stretches: list[str]) -> None:
        for first in range(0, len(stretches), 4096):
            for h, e in zip(hashes[first : first + 4096], self.hf.encode_batch(stretches[first : first + 4096], add_special_tokens=False), strict=True):
                new, used = e.ids, int(self.at[self.n])
                if self.n + 2 > len(self.at):
                    self.at = np.concatenate((self.at, np.zeros_like(self.at)))
                if used + len(new) > len(self.ids):
                    self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(new)), dtype=np.uint32)))
                self.ids[used : used + len(new)] = new
                self.known.add(h, self.n)
                self.n += 1
                self.at[self.n] = used + len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's ids start (one more for the end)."""
        whole, cp, starts = textvec.codes(texts)
        cut = self.is_cut[cp]
        cut[1:] &= ~self.is_space[cp[:-1]]
        cut[starts[1:] - 1] = False
        cut[starts[:-1][np.diff(starts) > 1]] = True
        begin = np.flatnonzero(cut)
        end = np.minimum(np.append(begin[1:], len(cp)), starts[np.searchsorted(starts, begin, "right")] - 1)
        uniq, first, inverse = np.unique(textvec.run_hashes(cp, begin, end), return_index=True, return_inverse=True)
        if len(self.known) > MOST_STRETCHES or self.at[self.n] > MOST_IDS:
            self.clear()
        which, missing = self.known.find(uniq)
        if missing:
            which[missing] = np.arange(self.n, self.n + len(missing))
            self.add(uniq[missing].tolist(), [whole[begin[first[k]] : end[first[k]]] for k in missing])
            self.known.settle()
        which = which[inverse]
        n = self.at[which + 1] - self.at[which]
        bounds = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.at[which] - bounds[:-1], n) + np.arange(bounds[-1])]
        return ids, bounds[np.searchsorted(begin, starts)]


@lru_cache(maxsize=2)
def stretch_tokenizer(path: str) -> StretchTokenizer:
    return StretchTokenizer(path)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, by its scheme, and the path in it; local files are mapped."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), uri
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return (fs.LocalFileSystem(use_mmap=True), path) if isinstance(system, fs.LocalFileSystem) else (system, path)


def file_schema(id_type: pa.DataType, token_type: pa.DataType, length: int) -> pa.Schema:
    docs = pa.list_(pa.struct([("id", id_type), ("at", pa.int32()), ("n", pa.int64())]))
    return pa.schema([("ids", pa.list_(token_type, length)), ("mask", pa.list_(pa.bool_(), length)), ("docs", docs)])


class Writer:
    """Files of one task: ids and documents come in, full batches go out; no more than a batch and one slice of texts is held."""

    def __init__(self, folder: str, prefix: str, schema: pa.Schema, length: int, batch_ids: int, file_ids: int):
        self.system, self.path = store(folder)
        self.prefix, self.schema, self.length = prefix, schema, length
        self.per_batch = max(1, batch_ids // length)
        self.per_file = max(1, file_ids // (self.per_batch * length)) * self.per_batch * length
        self.files: list[tuple[str, int, int, int]] = []  # name, number of the file, documents, ids
        self.sink = None
        self.open()

    def open(self) -> None:
        self.ids: list[np.ndarray] = []
        self.waiting = self.written = self.n_docs = 0
        self.docs: list[tuple] = []  # (place in the file, id, n)

    def add(self, ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> None:
        """Documents of these ids, one after the other. A document isn't cut between files: a file may hold one more than its limit."""
        begin, at = 0, np.concatenate(([0], np.cumsum(counts)))
        for k, (d, n) in enumerate(zip(doc_ids, counts.tolist(), strict=True)):
            if self.written + self.waiting + at[k] - at[begin] >= self.per_file:
                self.take(ids[at[begin] : at[k]])
                begin = k
                self.close()
            self.docs.append((self.written + self.waiting + int(at[k] - at[begin]), d, n))
            self.n_docs += 1
        self.take(ids[at[begin] :])

    def take(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.waiting += len(ids)
        size = self.per_batch * self.length
        if self.waiting >= size:
            whole = np.concatenate(self.ids)
            end = len(whole) // size * size
            for k in range(0, end, size):
                self.batch(whole[k : k + size], size)
            self.ids, self.waiting = [whole[end:]], len(whole) - end

    def batch(self, ids: np.ndarray, real: int) -> None:
        if self.sink is None:
            name = f"{self.prefix}-{len(self.files):04d}-{uuid.uuid4().hex}.arrow"
            self.name, self.sink = name, self.system.open_output_stream(f"{self.path}/{name}")
            self.file = ipc.new_file(self.sink, self.schema)
        mask = np.arange(len(ids)) < real
        rows, upto = len(ids) // self.length, self.written + len(ids)
        n = next((k for k, d in enumerate(self.docs) if d[0] >= upto), len(self.docs))
        mine, self.docs = self.docs[:n], self.docs[n:]
        place = np.array([d[0] - self.written for d in mine], dtype=np.int64)
        bounds = np.searchsorted(place, np.arange(rows + 1) * self.length)
        kinds = self.schema.field("docs").type.value_type
        values = [pa.array([d[1] for d in mine], kinds.field(0).type), pa.array(place % self.length, pa.int32()), pa.array([d[2] for d in mine], pa.int64())]
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(values, fields=list(kinds)))
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.schema.field("ids").type.value_type), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length), listed]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.written += real

    def close(self) -> None:
        """End the file; its last sequence is padded."""
        rest = np.concatenate(self.ids) if self.ids else np.zeros(0, dtype=np.uint32)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, dtype=np.uint32)
            padded[: len(rest)] = rest
            self.batch(padded, len(rest))
        if self.sink is not None:
            self.file.close()
            self.sink.close()
            self.sink = None
            self.files.append((self.name, len(self.files), self.n_docs, self.written))
        self.open()


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2) -> str:
    """Write every document's ids, and end_id after each, in ascending order of document ids; returns the folder.

    folder: a new one in a store that pyarrow's file systems reach by its scheme (file, hdfs, s3, gs) and all executors share; by default below
    spark.checkpoint.dir. tokenizer: path of a tokenizers .json file on every machine; texts are encoded whole, without special tokens of its own. Files have rows (ids,
    mask, docs), see the module; `folder`/manifest is a Parquet table of one row for each file, in the order of the stream: (part, file, name, n_docs, n_ids). Null
    text counts as empty: end_id alone. Null ids come first; rows that repeat an id follow each other, ordered by a hash of their texts, so a document of very many
    rows is dealt on to several files; ids of any Arrow type; texts of any length; other columns are not looked at. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if folder is None:
        folder = f"{shared_dir(spark)}/loomstat-{uuid.uuid4().hex}"
        MADE.append(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    batch_ids, file_ids = BATCH_IDS, FILE_IDS

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        tok = stretch_tokenizer(tokenizer)
        for batch in batches:
            if writer is None:
                token_type = pa.uint16() if max(tok.size, end_id + 1) <= 1 << 16 else pa.uint32()
                writer = Writer(folder, f"part-{part:06d}", file_schema(batch.schema.field("id").type, token_type, length), length, batch_ids, file_ids)
            for b, texts in textvec.parts(batch, chars=1 << 20):
                ids, bounds = tok.encode(texts)
                n = np.diff(bounds)
                full = np.full(len(ids) + len(n), end_id, dtype=np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                writer.add(full, b.column("id").to_pylist(), n + 1)
        if writer is not None:
            writer.close()
            made = writer.files
            columns = [pa.array([part] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[0] for m in made]), *(pa.array([m[k] for m in made], pa.int64()) for k in (2, 3))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "file", "name", "n_docs", "n_ids"])

    ordered.mapInArrow(to_files, "part bigint, file bigint, name string, n_docs bigint, n_ids bigint").write.parquet(f"{folder}/manifest")
    system, where = store(folder)
    named = {r["name"] for r in manifest(spark, folder).select("name").collect()}
    for found in system.get_file_info(fs.FileSelector(where)):
        if found.base_name.endswith(".arrow") and found.base_name not in named:
            system.delete_file(found.path)
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, file, name, n_docs, n_ids) of each file of a folder that write() made."""
    return spark.read.schema("part bigint, file bigint, name string, n_docs bigint, n_ids bigint").parquet(f"{folder}/manifest")


def document_rows(file: ipc.RecordBatchFileReader, first: int) -> Iterator[tuple[list, list[int], list[int], list[int]]]:
    """Documents that end in each batch of a file: ids, starts, numbers of ids, CRCs of the ids (little-endian, four bytes each). first: ids of the stream before the file."""
    at, open_doc = first, None  # the document that goes on: id, start, n, ids still to come, CRC so far
    for k in range(file.num_record_batches):
        b = file.get_batch(k)
        flat = b.column("ids").flatten().to_numpy(zero_copy_only=True)
        raw, length = memoryview(flat.astype("<u4")).cast("B"), b.column("ids").type.list_size
        docs = b.column("docs")
        begins = np.repeat(np.arange(b.num_rows), np.diff(docs.offsets.to_numpy())) * length + docs.values.field("at").to_numpy()
        out: tuple[list, list[int], list[int], list[int]] = ([], [], [], [])

        def ended(doc: tuple) -> None:
            for x, column in zip((doc[0], doc[1], doc[2], doc[4]), out, strict=True):  # noqa: B023
                column.append(x)

        def read(doc: tuple, begin: int) -> tuple | None:
            """The document after what this batch holds of it; None if that ends it."""
            d, start, n, left, crc = doc
            some = min(left, len(flat) - begin)  # noqa: B023
            crc = zlib.crc32(raw[4 * begin : 4 * (begin + some)], crc)  # noqa: B023
            if some == left:
                ended((d, start, n, 0, crc))
                return None
            return d, start, n, left - some, crc

        if open_doc is not None:
            open_doc = read(open_doc, 0)
        for d, begin, n in zip(docs.values.field("id").to_pylist(), begins.tolist(), docs.values.field("n").to_pylist(), strict=True):
            open_doc = read((d, at + begin, n, n, 0), begin)
        at += len(flat)
        yield out


def documents(spark: SparkSession, folder: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """What a folder's files hold of each document: (id, start, n_tokens, ids_crc32), read from the files.

    start: ids of all documents before it in the stream. One row for each file comes to the driver.
    """
    files, first = [], 0
    for r in sorted(manifest(spark, folder).collect(), key=lambda r: (r["part"], r["file"])):
        files.append((f"{folder}/{r['name']}", first))
        first += r["n_ids"]
    listed = spark.createDataFrame(files, "path string, first long").repartition(max(1, len(files)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                system, where = store(path)
                with system.open_input_file(where) as source:
                    file = ipc.open_file(source)
                    kind = file.schema.field("docs").type.value_type.field(0).type
                    for ids, starts, n, crc in document_rows(file, before):
                        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in (starts, n, crc))], ["id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


class Sequences:
    """Random access to the sequences of one file, without a copy where the store maps files: len(), and [k] -> (ids: a numpy view, mask: an Arrow view of bits)."""

    def __init__(self, path: str):
        system, where = store(path)
        self.file = ipc.open_file(system.open_input_file(where))
        self.n_batches = self.file.num_record_batches
        self.per_batch = self.file.get_batch(0).num_rows if self.n_batches else 1
        self.kept: tuple[int, tuple[np.ndarray, pa.BooleanArray]] | None = None

    def __len__(self) -> int:
        return (self.n_batches - 1) * self.per_batch + self.file.get_batch(self.n_batches - 1).num_rows if self.n_batches else 0

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """A whole batch: ids, one row for each sequence, and the mask of them all."""
        if self.kept is None or self.kept[0] != k:
            b = self.file.get_batch(k)
            self.kept = (k, (b.column("ids").flatten().to_numpy(zero_copy_only=True).reshape(b.num_rows, -1), b.column("mask").flatten()))
        return self.kept[1]

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        ids, mask = self.batch(k // self.per_batch)
        row, length = k % self.per_batch, ids.shape[1]
        return ids[row], mask.slice(row * length, length)
