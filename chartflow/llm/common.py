"""What the operators of this folder share: words as numpy arrays, hashes, shared folders.

Words are the maximal runs of bytes other than space and 0x09-0x0D.  No byte
of a multi-byte UTF-8 character is one of these, so words can be cut on bytes.
All functions work on a chunk of documents that lie one after another in one
buffer, so that numpy is called a fixed number of times for each chunk.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on together; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and where each row starts (one more at the end).  Null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if offsets and len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of about ``most`` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task; a Python worker lives on, and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words:
    """The words of a chunk: where they start and end in ``body``, and how many each document has.  between: the bytes that are part of no word."""

    def __init__(self, body: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE):
        self.body, self.at = body, at
        self.solid = solid = ~between[body]
        first = np.empty(len(body), dtype=bool)
        last = np.empty(len(body), dtype=bool)
        if len(body):
            first[0] = last[-1] = True
            first[1:] = ~solid[:-1]
            last[:-1] = ~solid[1:]
            inner = at[(at > 0) & (at < len(body))]
            first[inner] = True
            last[inner - 1] = True
        self.start = np.flatnonzero(solid & first)
        self.end = np.flatnonzero(solid & last) + 1
        self.word_at = np.searchsorted(self.start, at)  # of each document's first word
        self.count = np.diff(self.word_at)
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes that are flagged lie in each document."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.at])

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of the bytes start:end, by default of each word."""
        return piece_hashes(self.body, self.start if start is None else start, self.end if end is None else end)


def ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start[i] .. start[i] + size[i] - 1 of all i in one array, the place of each inside its i, and where each i begins."""
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    return np.repeat(start, size) + place, place, first


def _wide(body: np.ndarray, last: int) -> np.ndarray:
    """The eight bytes from each byte on, as numbers; body has eight more behind the last one that is asked for, or is copied."""
    if len(body) < last + 8:
        body = np.concatenate([body[:last], np.zeros(8, dtype=np.uint8)])
    return np.ndarray(last + 1, dtype="<u8", buffer=np.ascontiguousarray(body), strides=(1,))


def _blocks(wide: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The blocks of eight bytes of all pieces, zero beyond their ends."""
    left = np.repeat(size, blocks) - 8 * place
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.clip(left, 1, 8))).astype(np.uint64)
    return np.where(left > 0, wide[np.repeat(start, blocks) + 8 * place] & mask, 0)


def piece_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each body[start:end].

    Blocks of eight bytes are mixed with their place before they are summed, so
    the sum of a piece is not a linear form of its bytes.  Where equality of
    bytes matters it is still checked on bytes (same_bytes, numbers).
    """
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    blocks = np.maximum((size + 7) >> 3, 1)
    _, place, first = ragged(start, blocks)
    value = _blocks(_wide(body, len(body)), start, size, place, blocks)
    keys = mix(np.arange(1, int(blocks.max()) + 1, dtype=np.uint64))
    total = np.add.reduceat(mix(value ^ keys[place]), first)
    return mix(total ^ mix(size.astype(np.uint64)))


def same_bytes(body: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, start2: np.ndarray, end2: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether body[start:end] is other[start2:end2], pair by pair, eight bytes at a time and about ``most`` bytes together."""
    size = end - start
    same = size == end2 - start2
    todo = np.flatnonzero(same & (size > 0))
    if not len(todo):
        return same
    left, right = _wide(body, int(end[todo].max())), _wide(other, int(end2[todo].max()))
    blocks = (size[todo] + 7) >> 3
    total = np.cumsum(8 * blocks)
    i = 0
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        k, n = todo[i:j], blocks[i:j]
        _, place, first = ragged(start[k], n)
        same[k] = np.logical_and.reduceat(_blocks(left, start[k], size[k], place, n) == _blocks(right, start2[k], size[k], place, n), first)
        i = j
    return same


def numbers(body: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each body[start:end]; two are equal exactly if their bytes are, whatever the hashes say."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    twin = np.zeros(len(h), dtype=bool)
    twin[1:] = h[1:] == h[:-1]
    i = np.flatnonzero(twin)
    a, b = order[i], order[i - 1]
    wrong = i[~same_bytes(body, start[a], end[a], body, start[b], end[b])]
    out = np.empty(len(h), dtype=np.int64)
    out[order] = np.cumsum(~twin)
    if len(wrong):  # different bytes under one hash: those hashes are numbered by their bytes
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(np.isin(hashes, h[wrong])).tolist():
            out[k] = -1 - known.setdefault(bytes(body[start[k] : end[k]]), len(known))
    return out


def windows(words: np.ndarray, count: np.ndarray, length: int, factor: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words inside one document, and the index of their first words; words are hashes or numbers of words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, dtype=np.uint64)
    f = np.uint64(factor)
    for k in range(length):
        out = out * f + words[k : k + n]
    end = np.repeat(np.cumsum(count), count)[:n]
    inside = np.flatnonzero(np.arange(n) + length <= end)
    return mix(out[inside]), inside


def covered(n: int, first: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a run of ``length`` words that starts at one of ``first``."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + length, n), -1)
    return np.cumsum(step[:-1]) > 0


#: Folders in the shared folder that this program has made.
_made: list[str] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from spark.checkpoint.dir of the session; only where that is
    unset and all runs on one machine, as in tests, a folder under the warehouse
    is used, and taken away when the program ends.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if house not in _own:
            _own[house] = f"{house}/_shared-{uuid.uuid4().hex}"
            if urlparse(house).scheme in ("", "file"):
                atexit.register(shutil.rmtree, urlparse(_own[house]).path, ignore_errors=True)
        place = _own[house]
    return place.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new name inside the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast at most.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; otherwise the join is Spark's choice.  df should be a written table, as it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A group with more than one in so many rows is hot.
SHARE = 10_000


def meet(rows: DataFrame, groups: DataFrame, on: list[str], size: str = "n", least: int = 1000) -> DataFrame:
    """rows joined with groups (one row for each key, size: how many rows have it), so that no key is one task.

    Keys of more than one in SHARE of all rows are SHARE at most, so they are
    broadcast, and their rows stay where they are; the others are joined as Spark
    likes.  Both should be written tables, as they are read twice.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(least, int(total) // SHARE)
    hot, rest = groups.where(F.col(size) > bound), groups.where(F.col(size) <= bound)
    near = rows.join(F.broadcast(hot), on)
    return near.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet: name, with as many underscores behind it as are needed."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def mark() -> int:
    """How many folders this program has made so far."""
    return len(_made)


def remove_written(spark: SparkSession, since: int = 0) -> int:
    """Delete what this program has written to the shared folder (since mark() gave that number), once no result that reads it is needed; how many folders."""
    n = 0
    while len(_made) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
