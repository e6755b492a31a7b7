"""Substring deduplication (operator 6) by level-wise doubling.

A window of ``length`` words can only repeat in another document if each part
of it does.  Level by level, windows of 7, then 13 (or 7, 13, 25, 50 ...) words
are looked at: only where the shorter one occurs in two documents or more is
the text extended to twice its length (the last level stops at ``length``),
until nothing is left to extend or the full length is reached.

Of the shorter windows inside each full window one is enough, as long as equal
full windows pick equal ones: the one with the least hash.  That thins a level
to about 2 / (length - k + 2) of the places without losing any repeat.

Documents that are equal to an earlier one are settled first: all their windows
start there.  Texts are dealt by id once, and every level and the result read
that same shuffle again.  Level rows are (hash, document), one for a hash and
document.  Hashes that very many documents have, such as those of a passage in
every third one, are found in a sample of documents and dealt to ``SALTS`` tasks
each; the sample decides where rows go, never which are looked at.  No group is
collected but the list of one document.

Hashes of words and parts only choose what is looked at further.  What decides
is a digest of 128 bits of each full window's own bytes (BLAKE2b of its words,
joined by spaces), and SHA-256 for whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 13
#: No level is shorter than this by half.
FIRST = 7
#: One document in so many is looked at for hashes that are dealt to SALTS tasks: those in the most of these documents, COMMON at least, HOT at most.
SAMPLED, COMMON, HOT, SALTS = 64, 16, 2000, 32


def levels(length: int = LENGTH) -> list[int]:
    """Lengths of the levels, each at most twice the one before it."""
    out = [length]
    while out[0] > FIRST:
        out.insert(0, -(-out[0] // 2))
    return out


def _chunk(batch: pa.RecordBatch) -> tuple[common.Words, np.ndarray]:
    w = common.Words(*common.text_bytes(batch.column("text")))
    return w, w.hashes()


def least_parts(words: np.ndarray, count: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of length words: the least hash of its parts of k words, and its first word."""
    h, first = common.windows(words, count, k)
    _, full = common.windows(words, count, length)
    at = np.full(len(words), -1, dtype=np.int64)
    at[first] = np.arange(len(first))
    out = h[at[full]]
    for j in range(1, length - k + 1):
        np.minimum(out, h[at[full + j]], out=out)
    return out, full


def _digests(w: common.Words, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a digest of the length words from each first one on, joined by spaces."""
    size = w.end - w.start
    where, _, at = common.ragged(w.start, size + 1)  # each word, and the byte after it
    joined = w.body[np.minimum(where, len(w.body) - 1)]
    joined[at + size] = 32
    raw = memoryview(joined.tobytes())
    begin, finish = at[first].tolist(), (at + size)[first + length - 1].tolist()
    digest = hashlib.blake2b
    out = np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(begin, finish, strict=True)]), dtype="<i8").reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _among(batch: pa.RecordBatch, doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Whether each key is in the list of its document (column hits)."""
    salt = common.mix(np.arange(1, n + 1, dtype=np.uint64))
    hits = batch.column("hits")
    flat = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    have = np.sort(common.mix(flat) ^ np.repeat(salt, size))
    if not len(have):
        return np.zeros(len(keys), dtype=bool)
    mine = common.mix(keys) ^ salt[doc]
    k = np.minimum(np.searchsorted(have, mine), len(have) - 1)
    return have[k] == mine


def _some(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    """Rows of one document in so many, by a hash of its id."""
    for b in batches:
        ids = b.column("doc_id").to_numpy().view(np.uint64)
        yield b if one_in == 1 else b.filter(pa.array(common.mix(ids) % np.uint64(one_in) == 0))


def _dealt(rows: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt by keys and salt; salt is -1 but for hashes that are common in some, which are dealt to SALTS tasks each by document.

    They are dealt by just the columns that they are joined by, or the join would deal them again.
    """
    hot = some.groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") >= COMMON).orderBy(F.col("_n").desc(), "h").limit(HOT).select("h", F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(-1)
    salted = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", salt).drop("_hot")
    return salted.select(*(_never_null(c, "int") if c == "salt" else F.col(c) for c in salted.columns)).repartition(*keys, "salt")


def _least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, salt, lo: for the keys that two documents or more have the least of them, once for each salt.

    The least is taken of whole rows: were columns left out, Spark would work
    out and shuffle the rows a second time for this.
    """
    more = [c for c in rows.columns if c not in (*keys, "salt", "doc_id")]
    least = F.min(F.struct("doc_id", *more))["doc_id"] if more else F.min("doc_id")
    part = rows.groupBy(*keys, "salt").agg(least.alias("lo"), F.max("doc_id").alias("hi"), F.max("salt").alias("s"))
    alone = part.where("s < 0 AND lo < hi").select(*keys, "salt", "lo")
    met = part.where("s >= 0").groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    met = met.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "lo")
    return alone.union(met)


def _parts(base: DataFrame, k: int, before: int | None, length: int, one_in: int = 1) -> DataFrame:
    """(h, doc_id): the distinct parts of k words that stand for windows which the level before left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(_some(batches, one_in), "text"):
            w, words = _chunk(b)
            h, full = least_parts(words, w.count, k, length)
            doc = w.doc[full]
            if before is not None:
                old, _ = least_parts(words, w.count, before, length)
                live = _among(b, doc, old, b.num_rows)
                h, doc = h[live], doc[live]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            one = np.ones(len(h), dtype=bool)
            one[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[one], minlength=b.num_rows))]).astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(h[one].view(np.int64)))], ["doc_id", "hs"])

    found = base.mapInArrow(run, "doc_id long, hs array<long>").select(F.explode("hs").alias("h"), "doc_id")
    return found.select(_never_null("h"), _never_null("doc_id"))


def _never_null(name: str, kind: str = "long") -> Column:
    """Tells Spark what holds anyway; it would filter nulls on one side of a join alone, and then shuffle the same rows twice."""
    return F.coalesce(name, F.lit(0).cast(kind)).alias(name)


def _windows(base: DataFrame, before: int, length: int, one_in: int = 1) -> DataFrame:
    """(h, check, doc_id, at, more): the distinct full windows that are left over, by the two halves of a digest of their words.

    at is the first word of the first one in its document; more has those of
    all others, null if there are none, so a line that fills a document is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(_some(batches, one_in), "text"):
            w, words = _chunk(b)
            old, full = least_parts(words, w.count, before, length)
            live = _among(b, w.doc[full], old, b.num_rows)
            h, check = _digests(w, full[live], length)
            doc = w.doc[full[live]]
            at = (full[live] - w.word_at[doc]).astype(np.int32)
            order = np.lexsort((at, check, h, doc))
            h, check, doc, at = h[order], check[order], doc[order], at[order]
            one = np.ones(len(h), dtype=bool)
            one[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (doc[1:] != doc[:-1])
            size = np.diff(np.append(np.flatnonzero(one), len(h)))
            more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32)), pa.array(at[~one]), mask=pa.array(size == 1))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[one], minlength=b.num_rows))]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(h[one]), pa.array(check[one]), pa.array(at[one]), more], ["h", "check", "at", "more"])
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(ends, rows)], ["doc_id", "rows"])

    found = base.mapInArrow(run, "doc_id long, rows array<struct<h: bigint, check: bigint, at: int, more: array<int>>>").select("doc_id", F.inline("rows"))
    return found.select(_never_null("h"), _never_null("check"), _never_null("doc_id"), "at", "more")


def _result(base: DataFrame, length: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept: the words left, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            ids, n_words, n_removed, digests, left = b.column("doc_id"), [], [], [], []
            copies, hits, more = b.column("copy").to_pylist(), b.column("hits"), b.column("more")
            for i, text in enumerate(b.column("text").to_pylist()):
                words = (text or "").encode().split()
                gone = np.zeros(0, np.int64)
                if copies[i] and len(words) >= length:
                    kept = []
                elif hits[i].is_valid:
                    gone = common.covered(len(words), np.concatenate([hits[i].values.to_numpy(), more[i].values.to_numpy()]), length)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                left.append(joined.decode())
            yield pa.record_batch([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return base.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Remove each word that a window of length words covers which also starts in a document with a smaller id.

    Repeats inside one document stay.  Windows are judged on the input.  A null
    text has no words; a null id counts as smaller than any other; rows that
    share an id are one document as far as "smaller" goes, and share what is
    found in either, so ids should be distinct.  Other columns are ignored.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sums = common.written(source.where("text IS NOT NULL").select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sum")), "sums")
    first = sums.groupBy("sum").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    copies = common.meet(sums, common.written(first, "first"), ["sum"]).where("doc_id > first").select("doc_id").distinct()
    copies = common.written(copies, "copies")

    # Merge joins are asked for throughout: were Spark to change its mind for one use of a shuffle, it would not find it again for the next.
    dealt = source.repartition("doc_id")
    base = dealt.join(copies.withColumn("copy", F.lit(True)).hint("merge"), "doc_id", "left")
    fresh = base.where("copy IS NULL").select("doc_id", "text")

    before, hits = None, None
    for k in levels(length)[:-1]:
        if hits is not None:  # each level's plan holds that before it several times, so of many levels all but the last are written
            hits = common.written(hits, "hits")
        todo = fresh if hits is None else fresh.join(hits.hint("merge"), "doc_id")
        rows = _dealt(_parts(todo, k, before, length), _parts(todo, k, before, length, SAMPLED), ["h"])
        hits = rows.join(_least(rows, ["h"]).hint("merge"), ["h", "salt"]).groupBy("doc_id").agg(F.collect_list("h").alias("hits"))
        before = k
    if hits is None:  # a length so short that there is one level
        raise ValueError(f"length must be more than {FIRST}")
    todo = fresh.join(hits.hint("merge"), "doc_id")
    rows = _dealt(_windows(todo, before, length), _windows(todo, before, length, SAMPLED), ["h", "check"])
    gone = rows.join(_least(rows, ["h", "check"]).hint("merge"), ["h", "check", "salt"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_list("at").alias("hits"), F.flatten(F.collect_list("more")).alias("more"))
    out = _result(base.join(gone.hint("merge"), "doc_id", "left"), length)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def sql(documents: str = "documents", length: int = LENGTH) -> str:
    """What deduplicate() gives (but for the kept text itself), for DuckDB: every window of every document, and the least id that has it."""
    return f"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
    windows AS (SELECT doc_id, k, array_to_string(w[k:k + {length - 1}], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - {length - 2})) AS k FROM docs WHERE len(w) >= {length})),
    first AS (SELECT phrase, min(doc_id) AS lo FROM windows GROUP BY phrase),
    gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + {length})) AS place, TRUE AS gone FROM windows JOIN first USING (phrase) WHERE lo < doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM docs),
    kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (gone IS NULL) AS text FROM words LEFT JOIN gone USING (doc_id, place) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept k USING (doc_id)"""
