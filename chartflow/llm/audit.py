"""Filter interaction audit (operator 13): what each of five filters removes, in every order of them.

Texts are scanned in Arrow's own buffers, a chunk of documents at a time: byte
classes and prefix sums count words, capitals, code points and symbols of each
document, and distinct words are counted by sorting each document's word
hashes, which are verified on bytes.  What a document fails is a mask of five
bits.  Masks are all that is left of a document: they are counted by part, and
kept, removed, redundant and the other figures of all 120 orders are sums over
the 32 counts of a part.

    A  fewer than 200 words
    B  fewer than half of the words are distinct
    C  more than 3 % of the code points are capitals A-Z
    D  it holds one of # $ % & * |
    E  its text is also that of a document with a smaller id

E looks at the whole table.  A text is known by its SHA-256; the least id of
each text that occurs twice meets its documents again by checked broadcast where
copies are many, so a text that a third of all documents have is no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_rules import distinct_words

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
COPY = 1 << FILTERS.index("E")

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def masks(texts: pa.Array) -> np.ndarray:
    """Of each text, which of the filters A to D it fails: bit 0 is A."""
    body, at = common.text_bytes(texts)
    w = common.Words(body, at)
    distinct = distinct_words(w, common.numbers(body, w.start, w.end, w.hashes()))
    capitals, symbols, points = (w.per_doc(flags) for flags in (_CAPITAL[body], _SYMBOL[body], (body & 0xC0) != 0x80))
    failed = [w.count < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * w.count, 100 * capitals > MAX_CAPITAL_PERCENT * points, symbols > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def facts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, sum): the mask of A to D, and the digest of the text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            body, at = common.text_bytes(b.column("text"))
            raw, ends = memoryview(body.tobytes()), at.tolist()
            sums = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.record_batch([b.column("doc_id"), b.column("part"), pa.array(masks(b.column("text"))), pa.array(sums, pa.binary())], ["doc_id", "part", "mask", "sum"])

    return source.mapInArrow(run, "doc_id long, part string, mask int, sum binary")


def counted(docs: DataFrame, labels: DataFrame, *, good: str = "quality", toxic: str = "toxic", **columns) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the filters that they fail, with how many are labelled so."""
    base = common.written(facts(docs, **columns), "facts")
    first = base.groupBy("sum").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    copies = common.meet(base.select("sum", "doc_id", "part", "mask"), common.written(first, "first"), ["sum"]).where("doc_id > first")
    # A copy leaves the mask that it has without E for that with E.
    moved = copies.select("doc_id", "part", F.inline(F.array(F.struct("mask", F.lit(-1).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), F.lit(1).alias("n")))))
    rows = base.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(moved)
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))  # rows of one id become few before they meet its label
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(good).alias("good"), F.col(toxic).alias("toxic")).groupBy("doc_id").agg(flag("good").alias("good"), flag("toxic").alias("toxic")).where("good + toxic > 0")
    return rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("docs"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))


def orders() -> list[tuple[str, int, int, int]]:
    """filter_order, step (from 1), the bit of its filter, and the bits of those before it."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append((order, step, bit, before))
            before |= bit
    return out


def figures(counts: DataFrame) -> DataFrame:
    """The figures of every part, order and step, from counted(): at most 32 rows a part, so one row for each part and step is all that grows."""
    every = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for c in ("docs", "good", "toxic") for m in range(32)]
    parts = counts.groupBy("part").agg(*(F.array(*every[32 * k : 32 * k + 32]).alias(c) for k, c in enumerate(("docs", "good", "toxic"))))
    steps = F.expr("array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'bit', {bit}, 'before', {before})" for o, s, bit, before in orders()) + ")")
    rows = parts.select("*", F.inline(steps))
    all_masks = F.array(*map(F.lit, range(32)))

    def total(of: str, value) -> Column:
        """The sum over all masks of their count times value(mask)."""
        return F.aggregate(F.zip_with(F.col(of), all_masks, lambda n, m: n * value(m)), F.lit(0).cast("long"), lambda a, x: a + x).cast("long")

    one = lambda c: c.cast("long")
    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    earlier = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: one(fails(m) & ~earlier(m))
    # Of the 120 orders, a filter comes first among the k that a document fails in 120 / k.
    share = lambda m: one(fails(m)) * F.element_at(F.array(*map(F.lit, (0, 120, 60, 40, 30, 24))), F.bit_count(m) + 1)
    return rows.select(
        "part", "filter_order", "step",
        total("docs", lambda m: one(~fails(m) & ~earlier(m))).alias("kept"), total("docs", here).alias("removed"), total("docs", lambda m: one(fails(m) & earlier(m))).alias("redundant"),
        total("docs", lambda m: one(m == bit)).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("docs", share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty; a null part is the empty string.  A null id is smaller
    than none and larger than none, so it fails E never; rows that share id and
    text are no copies of each other.  A label counts for all rows of its id; of
    several labels one that says 1 is enough.  Parts without a document have no
    rows, so an empty table gives none.  Other columns are ignored.
    """
    return figures(counted(docs, labels, **columns))


def sql(documents: str = "documents", labels: str = "labels") -> str:
    """What audit() gives, for DuckDB: every document by every order and step."""
    return f"""
    WITH base AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM {documents}),
    fails AS (
        SELECT doc_id, part, {{'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
            'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
            'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}} AS f
        FROM base),
    marked AS (
        SELECT f.*, f.doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1) AS good, f.doc_id IN (SELECT doc_id FROM {labels} WHERE toxic = 1) AS toxic,
            CAST(f.f.A AS INT) + CAST(f.f.B AS INT) + CAST(f.f.C AS INT) + CAST(f.f.D AS INT) + CAST(f.f.E AS INT) AS failed
        FROM fails f),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders),
    judged AS (
        SELECT part, s.filter_order, s.step, good, toxic, failed,
            CASE substr(s.filter_order, s.step, 1) WHEN 'A' THEN m.f.A WHEN 'B' THEN m.f.B WHEN 'C' THEN m.f.C WHEN 'D' THEN m.f.D ELSE m.f.E END AS here,
            (m.f.A AND strpos(s.filter_order, 'A') < s.step) OR (m.f.B AND strpos(s.filter_order, 'B') < s.step) OR (m.f.C AND strpos(s.filter_order, 'C') < s.step)
                OR (m.f.D AND strpos(s.filter_order, 'D') < s.step) OR (m.f.E AND strpos(s.filter_order, 'E') < s.step) AS earlier
        FROM marked m, steps s),
    figures AS (
        SELECT part, filter_order, step, count(*) FILTER (NOT here AND NOT earlier) AS kept, count(*) FILTER (here AND NOT earlier) AS removed, count(*) FILTER (here AND earlier) AS redundant,
            count(*) FILTER (here AND failed = 1) AS unique_fails, count(*) FILTER (here AND NOT earlier AND good) AS good_lost, count(*) FILTER (here AND NOT earlier AND toxic) AS toxic_lost
        FROM judged GROUP BY ALL)
    SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM figures"""
