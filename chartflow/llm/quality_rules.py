"""Quality rules (operator 1): boosted trees over document statistics.

Statistics come from whole texts, a chunk of documents at a time, in numpy.
The trees are fitted on the driver on at most ``max_labels`` labelled documents
(those with the smallest hash of their id, so the choice is the same on every
run); nothing else is sampled.  Scoring is a map over partitions: no shuffle.

Defined results: a null or empty text has no words and fails the base rule.
Repeated rows are scored each by itself.  Without labels, or with labels of one
class alone, the model is a constant that accepts, and the base rule decides.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .boosting import Trees, fit

#: Labelled documents that the trees are fitted on at most.
MAX_LABELS = 20_000
#: A document needs this probability of being good.
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate",
    "end_rate", "comma_rate", "other_mark_rate", "words_per_line", "distinct_rate", "wide_rate", "open_line_rate",
]
#: A document does not become better by any of these.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "other_mark_rate": -1}


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL, _IS_UPPER, _IS_DIGIT = _lut(SYMBOLS), _lut(bytes(range(65, 91))), _lut(bytes(range(48, 58)))
_IS_LETTER = _IS_UPPER | _lut(bytes(range(97, 123)))
_IS_END, _IS_COMMA = _lut(b".!?"), _lut(b",;:")
_IS_OTHER = _lut(bytes(range(33, 127))) & ~(_IS_LETTER | _IS_DIGIT | _IS_END | _IS_COMMA)


def twice(keys: np.ndarray, words: np.ndarray, first: np.ndarray, doc: np.ndarray, length: int = REPEAT_WINDOW) -> np.ndarray:
    """Which runs of ``length`` words from first on occur twice or more in their document; equal runs have equal keys."""
    order = np.argsort(keys, kind="stable")
    i = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
    a, b = order[i], order[i - 1]
    equal = doc[a] == doc[b]
    for k in range(length):
        equal &= words[first[a] + k] == words[first[b] + k]
    out = np.zeros(len(keys), dtype=bool)
    out[a] = out[b] = True
    for key in np.unique(keys[a[~equal]]).tolist():  # different runs under one key: settled run by run
        mine = np.flatnonzero(keys == key)
        runs = np.stack([doc[mine], *(words[first[mine] + k] for k in range(length))], axis=1)
        _, which, count = np.unique(runs, axis=0, return_inverse=True, return_counts=True)
        out[mine] = count[which.ravel()] > 1
    return out


def distinct_words(w: common.Words, words: np.ndarray) -> np.ndarray:
    """How many different numbers of words each document has."""
    order = np.lexsort((words, w.doc))
    one = np.ones(len(words), dtype=bool)
    one[1:] = (words[order][1:] != words[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    return np.bincount(w.doc[order][one], minlength=len(w.count))


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and the matrix of FEATURES."""
    body, at = common.text_bytes(texts)
    w = common.Words(body, at)
    n = len(at) - 1
    char = (body & 0xC0) != 0x80
    words = common.numbers(body, w.start, w.end, w.hashes())
    doc_salt = common.mix(np.arange(1, n + 1, dtype=np.uint64))  # keeps documents apart when keys are sorted together

    # Words inside windows that the same document holds twice.
    runs, first = common.windows(words.view(np.uint64), w.count, REPEAT_WINDOW)
    again = twice(runs ^ doc_salt[w.doc[first]], words, first, w.doc[first])
    repeat = np.bincount(w.doc[common.covered(len(words), first[again], REPEAT_WINDOW)], minlength=n) if again.any() else np.zeros(n, int)

    # Lines: pieces between \n and document edges.
    cut = np.flatnonzero(body == 10)
    line_start = np.sort(np.concatenate([at[:-1], cut + 1]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(at, cut, "right") - 1]), kind="stable")
    line_end = np.append(line_start[1:], len(body))
    line_end = np.where(np.append(line_doc[1:] == line_doc[:-1], False), line_end - 1, at[line_doc + 1])
    solid = np.zeros(len(body) + 1, dtype=np.int64)
    np.cumsum(w.solid, out=solid[1:])
    full = np.flatnonzero(solid[line_end] > solid[line_start])
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    lines_ = common.numbers(body, line_start, line_end, w.hashes(line_start, line_end))
    order = np.lexsort((lines_, line_doc))
    dup = order[1:][(lines_[order][1:] == lines_[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])]
    dup_lines = np.bincount(line_doc[dup], minlength=n)
    lines = np.bincount(line_doc, minlength=n)
    closed = np.bincount(line_doc, _IS_END[body[np.maximum(line_end - 1, 0)]] if len(line_end) else None, minlength=n)

    word_chars = w.per_doc(char & w.solid)
    base = {"n_words": w.count, "word_chars": word_chars, "n_symbols": w.per_doc(_IS_SYMBOL[body]), "n_dup_lines": dup_lines, "n_repeat_words": repeat}

    distinct = distinct_words(w, words)
    nw, nc, nl = np.maximum(w.count, 1), np.maximum(word_chars, 1), np.maximum(lines, 1)
    letters = np.maximum(w.per_doc(_IS_LETTER[body]), 1)
    x = np.stack(
        [
            np.log1p(w.count), word_chars / nw, base["n_symbols"] / nw, dup_lines / nl, repeat / nw, w.per_doc(_IS_UPPER[body]) / letters, w.per_doc(_IS_DIGIT[body]) / nc,
            w.per_doc(_IS_END[body]) / nw, w.per_doc(_IS_COMMA[body]) / nw, w.per_doc(_IS_OTHER[body]) / nw, np.log1p(w.count / nl), distinct / nw, w.per_doc(char & (body >= 0x80)) / nc, 1 - closed / nl,
        ],
        axis=1,
    )
    return base, x


def _failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> Trees:
    """Fit the trees on at most max_labels labelled documents.  Rows without an id or a label are left out."""
    sample = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    sample = sample.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labels)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("y", "text")

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            _, x = statistics(b.column("text"))
            yield pa.record_batch([b.column("y").cast(pa.float64()), *map(pa.array, x.T.copy())], ["y", *FEATURES])

    figures = chosen.mapInArrow(matrix, ", ".join(f"{c} double" for c in ["y", *FEATURES]))
    figures = figures.orderBy(F.xxhash64("y", *FEATURES)).limit(max_labels)  # ids may repeat; the same rows are taken on every run
    rows = np.array(figures.collect(), dtype=np.float64).reshape(-1, 1 + len(FEATURES))
    rows = rows[np.lexsort(rows.T)]  # the same order on every run
    y = rows[:, 0]
    if len(np.unique(y)) < 2:
        return fit(rows[:0, 1:], np.ones(0), FEATURES) if not len(y) or y[0] > 0 else fit(rows[:, 1:], y, FEATURES)
    return fit(rows[:, 1:], y, FEATURES, MONOTONE)


def score(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Of each document: the base counts, base_failed, quality (a probability) and kept."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            base, x = statistics(b.column("text"))
            failed, p = _failed(base), model.probability(x)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(base[c].astype(np.int64)) for c in BASE), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], ["doc_id", *BASE, "base_failed", "kept", "quality"])

    return source.mapInArrow(run, out)


def keep(docs: DataFrame, model: Trees, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, text_col):
            base, x = statistics(b.column(text_col))
            yield b.filter(pa.array(~_failed(base) & (model.probability(x) >= threshold)))

    return docs.mapInArrow(run, docs.schema)
