"""Packing (operator 5): cuts by dynamic programming with a monotone queue.

Tokens of all documents of a partition make one stream, in order.  Cuts may lie
after a document, after a sentence or, dearer, between words.  The cost of a
window is its padding, a fixed cost and the penalty of the cut that ends it:

    best[j] = penalty[j] + SEQUENCE + SIZE - at[j] + min(best[i] + at[i]),  at[j] - at[i] <= SIZE

The minimum slides along with j, so a queue of rising values gives each in
constant time.  A window whose length is a power of two needs no padding; these
few transitions are looked up beside the queue.  Every end of a document or a
sentence is a place; only where ``GRID`` tokens hold none of them is a place
between words taken, one for each such stretch.

A partition is worked on in stretches; the last window of a stretch begins the
next one.  Nothing is shuffled: a sequence holds documents of one partition.
What is left at its end is cut into powers of two, wherever these end, where that
costs less than padding; sequences of a power of two are what a packed window may
be as well, down to ``SHORTEST``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import ENCODE_BYTES, encoder

SIZE, END_ID = 2048, 1
GRID = 32
#: In tokens of padding: what a further sequence costs, and cuts after a sentence and inside one.
SEQUENCE, SENTENCE, HARD = 32, 4, 24
SHORTEST = 64

_kinds: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}


def token_kinds(tokenizer: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each id: whether it ends a sentence, and whether it begins a word or line."""
    if tokenizer not in _kinds:
        t = encoder(tokenizer).tokenizer
        words = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        _kinds[tokenizer] = (np.array([w[-1:] in (".", "!", "?", "Ċ") for w in words]), np.array([w[:1] in ("Ġ", "Ċ") for w in words]))
    return _kinds[tokenizer]


def places(ids: np.ndarray, doc_ends: np.ndarray, tokenizer: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, in ascending order from 0 to its end, and what each cut costs."""
    n = len(ids)
    closes, opens = token_kinds(tokenizer)
    cost = np.full(n + 1, -1, dtype=np.int64)
    cost[np.flatnonzero(closes[np.minimum(ids, len(closes) - 1)]) + 1] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    cell = np.arange(n + 1) // GRID
    bare = np.ones(n // GRID + 1, dtype=bool)  # cells without an end of a sentence or document
    bare[cell[cost >= 0]] = False
    pick = np.arange(len(bare)) * GRID
    word = np.flatnonzero(opens[np.minimum(ids[1:], len(opens) - 1)]) + 1
    pick[cell[word]] = word
    cost[pick[bare]] = HARD
    if cost[n] < 0:
        cost[n] = HARD
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """The places (numbers in at) that end the windows of least cost, the last place included."""
    m = len(at)
    jumps: list[list[int]] = [[] for _ in range(m)]
    k = SHORTEST
    while k < size:
        i = np.searchsorted(at, at - k)
        hit = np.flatnonzero((at >= k) & (at[np.minimum(i, m - 1)] == at - k))
        for j, s in zip(hit.tolist(), i[hit].tolist(), strict=True):
            jumps[j].append(s)
        k *= 2
    pos, pen = at.tolist(), cost.tolist()
    best, came = [0] * m, [0] * m
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + at, number), values rising
    for j in range(1, m):
        p = pos[j]
        low = p - size
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, source = queue[0]
        value += size - p
        for i in jumps[j]:
            if best[i] < value:
                value, source = best[i], i
        best[j] = value = value + pen[j] + SEQUENCE
        came[j] = source
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], m - 1
    while j:
        out.append(j)
        j = came[j]
    return out[::-1]


def _rest(length: int, size: int = SIZE) -> list[int]:
    """The lengths that what is left at the end is cut into."""
    if size - length <= (SEQUENCE + HARD) * (length.bit_count() - 1):
        return [length]
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of at most size tokens.

    doc_id, start (ids of the document before the piece), length, ids (binary,
    32-bit little-endian), doc_tokens, sequence_id, offset.  A null or empty
    text is its end id alone.  Repeated rows are packed each.  Sequences are
    those of one partition of docs, numbered from its number times 2 ** 33.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])

    def pieces(docs_: pa.Array, begin: np.ndarray, total: np.ndarray, ids: np.ndarray, base: int, ends: np.ndarray, number: int) -> pa.RecordBatch:
        """Cut ids (stream places from base) at ends; begin and total: place and size of each document."""
        starts = np.concatenate([[0], ends[:-1]])
        lo = np.union1d(starts, np.maximum(begin - base, 0)[begin - base < ends[-1]])
        hi = np.append(lo[1:], ends[-1])
        doc = np.searchsorted(begin - base, lo, "right") - 1
        seq = np.searchsorted(starts, lo, "right") - 1
        raw = pa.py_buffer(ids[: ends[-1]].astype("<u4").tobytes())
        binary = pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer((np.append(lo, ends[-1]) * 4).astype(np.int32)), raw])
        return pa.record_batch([docs_.take(pa.array(doc)), pa.array(lo + base - begin[doc]), pa.array(hi - lo), pa.array(total[doc]), pa.array(seq + number), pa.array(lo - starts[seq]), binary], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        base, ids = 0, np.zeros(0, np.uint32)
        names: pa.Array | None = None
        begin, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in common.chunks(batches, "text", ENCODE_BYTES):
            got, n = encoder(tokenizer).encode_all(b.column("text"), end_id)
            begin = np.concatenate([begin, base + len(ids) + np.concatenate([[0], np.cumsum(n)[:-1]])])
            total = np.concatenate([total, n])
            names = b.column("doc_id") if names is None else pa.concat_arrays([names, b.column("doc_id")])
            ids = np.concatenate([ids, got])
            at, cost = places(ids, (begin + total - base)[begin + total > base], tokenizer)
            ends = at[cuts(at, cost, size)][:-1]  # the last window waits for what follows
            if len(ends):
                yield pieces(names, begin, total, ids, base, ends, number)
                number += len(ends)
                ids, base = ids[ends[-1] :], base + int(ends[-1])
                live = np.flatnonzero(begin + total > base)
                names, begin, total = names.take(pa.array(live)), begin[live], total[live]
        if names is not None and len(ids):
            yield pieces(names, begin, total, ids, base, np.cumsum(_rest(len(ids), size)), number)

    return source.mapInArrow(run, out)
