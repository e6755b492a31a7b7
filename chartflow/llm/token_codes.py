"""Token-ID output (operator 2): directly addressable codes.

An id is cut into chunks of ``WIDTH`` bits.  Level 0 holds the lowest chunk of
every id, level k the next chunk of those ids that still have bits left; a
bitmap beside each level says which ids go on.  A directory of the set bits
before each 512-bit block turns "my place in the next level" into one lookup
and one popcount, so any token is read in a few byte reads, without decoding
its neighbours.

One file holds the documents of one range of ids, in ascending order:

    8 bytes   magic ``DACTOK02``
    6 x u64   documents, those of them without an id (the first ones), tokens, levels, chunk width in bits, crc32 of all that follows
    levels    u64 ids in each level
    i64       id of each document, 0 where it has none
    u64       end of each document in tokens
    per level chunks (u8), bitmap (u64 words), directory (u64 per 512 bits)

each section padded to 8 bytes, numbers little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import ENCODE_BYTES, encoder

MAGIC, WIDTH, BLOCK = b"DACTOK02", 8, 512
END_ID = 2
#: Bytes of text that one file is made from, about.
FILE_TEXT_BYTES = 16 << 20
#: Ranges of ids at most; beyond that a range is written as several files.
RANGES = 32_768
#: Ranges whose tokens one task sums up.
RUN = 256


def _bitmap(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags as 64-bit words, in whole blocks, and the set bits before each block."""
    words = np.zeros(-(-len(flags) // BLOCK) * BLOCK // 64, dtype="<u8")
    packed = np.packbits(flags, bitorder="little")
    words.view(np.uint8)[: len(packed)] = packed
    ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
    before = np.zeros(len(ones), dtype="<u8")
    np.cumsum(ones[:-1], out=before[1:])
    return words, before


class TokenWriter:
    """Takes documents one chunk after another and keeps them as levels, about two bytes a token."""

    def __init__(self):
        self.nulls = 0
        self.doc_ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.levels: list[tuple[list[np.ndarray], list[np.ndarray]]] = []

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> None:
        """ids are those of all documents, one after another; the first nulls of doc_ids stand for none."""
        self.nulls += nulls
        self.doc_ids.append(np.asarray(doc_ids, dtype="<i8"))
        self.lengths.append(np.asarray(lengths, dtype=np.int64))
        rest, k = np.asarray(ids, dtype=np.uint32), 0
        while len(rest) or not k:
            if k == len(self.levels):
                self.levels.append(([], []))
            more = rest >> np.uint32(WIDTH)
            self.levels[k][0].append(rest.astype(np.uint8))
            self.levels[k][1].append(more > 0)
            rest, k = more[more > 0], k + 1

    def finish(self) -> tuple[int, int, bytes]:
        """Documents, tokens and the file."""
        body = bytearray()

        def put(a: np.ndarray) -> None:
            body.extend(memoryview(np.ascontiguousarray(a)).cast("B") if a.size else b"")
            body.extend(bytes(-len(body) % 8))

        doc_ids, ends = np.concatenate(self.doc_ids), np.cumsum(np.concatenate(self.lengths)).astype("<u8")
        put(np.array([sum(map(len, c)) for c, _ in self.levels], dtype="<u8"))
        put(doc_ids)
        put(ends)
        for chunks, flags in self.levels:
            put(np.concatenate(chunks))
            for a in _bitmap(np.concatenate(flags)):
                put(a)
        tokens = int(ends[-1]) if len(ends) else 0
        head = MAGIC + np.array([len(doc_ids), self.nulls, tokens, len(self.levels), WIDTH, zlib.crc32(body)], dtype="<u8").tobytes()
        return len(doc_ids), tokens, head + body


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file for these documents; ids are those of all documents, one after another."""
    w = TokenWriter()
    w.add(doc_ids, lengths, ids)
    return w.finish()[2]


class TokenFile:
    """Random access to the tokens of one file, from its bytes or a memory map of it."""

    def __init__(self, data: bytes | memoryview, check: bool = False):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("this is no token file")
        docs, self.nulls, self.tokens, n_levels, width, crc = np.frombuffer(data, "<u8", 6, 8).tolist()
        if width != WIDTH or check and zlib.crc32(data[56:]) != crc:
            raise ValueError("this token file is damaged")
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        sizes = take("<u8", n_levels).tolist()
        self.doc_ids, self.ends = take("<i8", docs), take("<u8", docs)
        self.levels = [(take("u1", n), take("<u8", (blocks := -(-n // BLOCK)) * BLOCK // 64), take("<u8", blocks)) for n in sizes]

    def token(self, i: int) -> int:
        """The id at place i of the file."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for k, (chunk, bits, before) in enumerate(self.levels):
            out |= int(chunk[i]) << (WIDTH * k)
            word, block = i // 64, i // BLOCK
            if not int(bits[word]) >> (i % 64) & 1:
                break
            rank = int(before[block]) + int(np.bitwise_count(bits[block * (BLOCK // 64) : word]).sum())
            i = rank + (int(bits[word]) & ((1 << (i % 64)) - 1)).bit_count()
        return out

    def slice(self, i: int, j: int) -> np.ndarray:
        """The ids at places i to j, j excluded."""
        out = np.zeros(max(0, j - i), dtype=np.uint32)
        on = np.arange(len(out))
        for k, (chunk, bits, before) in enumerate(self.levels):
            if not len(on):
                break
            out[on] |= chunk[i:j].astype(np.uint32) << np.uint32(WIDTH * k)
            flags = np.unpackbits(bits[i // 64 : -(-j // 64)].view(np.uint8), bitorder="little")[i % 64 :][: j - i].astype(bool)
            block = i // BLOCK
            lead = np.unpackbits(bits[block * (BLOCK // 64) : -(-i // 64)].view(np.uint8), bitorder="little")[: i - block * BLOCK]
            i = int(before[block]) + int(lead.sum()) if len(before) else 0
            on = on[flags]
            j = i + len(on)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that executors share, and the path in it."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    if scheme in ("s3a", "s3n"):  # names that only Hadoop uses
        uri = "s3" + uri[len(scheme) :]
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write all documents as token files under folder, in ascending order of id; return the list of files.

    One row for each file: part and seq (ascending with the ids), name, documents, tokens.
    file_bytes is the text that a file is made from, about; a task holds one file, some two bytes a token.
    A null text is empty.  Null ids come first; rows with the same id go by a
    hash of their texts, so even an id that many rows share is spread out.  A
    task that runs again writes other files, and the list names those that count.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(RANGES, -(-int(total) // file_bytes)))
    ordered = source.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size, w = TaskContext.get().partitionId(), 0, 0, TokenWriter()

        def written() -> pa.RecordBatch:
            n_docs, n_tokens, data = w.finish()
            to, path = filesystem(folder)
            to.create_dir(path, recursive=True)
            name = f"{part:05d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with to.open_output_stream(f"{path}/{name}") as f:
                f.write(data)
            return pa.record_batch([pa.array([part]), pa.array([seq]), pa.array([name]), pa.array([n_docs]), pa.array([n_tokens])], ["part", "seq", "name", "documents", "tokens"])

        for b in common.chunks(batches, "text", ENCODE_BYTES):
            ids, n = encoder(tokenizer).encode_all(b.column("text"), end_id)
            key = b.column("id")
            w.add(key.fill_null(0).to_numpy(), n, ids, key.null_count)
            size += common.text_bytes(b.column("text"))[1][-1]
            if size >= 1.5 * file_bytes:  # a range is about file_bytes long, so this is for ranges that hold more
                yield written()
                seq, size, w = seq + 1, 0, TokenWriter()
        if w.doc_ids:
            yield written()

    ordered.mapInArrow(run, "part long, seq long, name string, documents long, tokens long").write.parquet(f"{folder}/_files")
    return spark.read.parquet(f"{folder}/_files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """Of each document in the files: doc_id, start, n_tokens and the crc32 of its ids.

    start counts the ids of all documents before it; it needs the tokens of
    each file alone, summed inside runs of ``RUN`` ranges and then over the runs.
    """
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("run", F.expr(f"part div {RUN}"))
    runs = files.groupBy("run").agg(F.sum("tokens").alias("sum"))
    runs = runs.select("run", F.coalesce(F.sum("sum").over(earlier().orderBy("run")), F.lit(0)).alias("lead"))
    inside = files.select("run", "name", F.coalesce(F.sum("tokens").over(earlier("run").orderBy("part", "seq")), F.lit(0)).alias("inside"))
    todo = inside.join(runs, "run").select("name", (F.col("lead") + F.col("inside")).alias("before")).repartition(max(1, min(RANGES, files.count())), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                place, path = filesystem(folder)
                with place.open_input_file(f"{path}/{row['name']}") as f:
                    t = TokenFile(f.read(), check=True)
                ends = t.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                for i in range(0, len(ends), 4096):
                    lo, hi = starts[i], ends[min(i + 4096, len(ends)) - 1]
                    raw = memoryview(t.slice(int(lo), int(hi)).astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (s - lo) : 4 * (e - lo)]) for s, e in zip(starts[i : i + 4096].tolist(), ends[i : i + 4096].tolist(), strict=True)]
                    names = t.doc_ids[i : i + 4096]
                    yield pa.record_batch([pa.array(names, mask=np.arange(i, i + len(names)) < t.nulls), pa.array(starts[i : i + 4096] + row["before"]), pa.array((ends - starts)[i : i + 4096]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, **options) -> DataFrame:
    """Write the files in the shared folder and read them back."""
    folder = common.fresh_folder(docs.sparkSession, "tokens")
    return read(write(docs, folder, **options), folder)
