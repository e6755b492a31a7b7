"""Benchmark decontamination (operator 12) by a distributed positional inverted index.

``index`` stores the postings of all tokens of all documents: documents are
dealt to shards of bounded size, and a shard is one row with its dictionary and,
for each term, the ascending places at which it stands (as gaps, the first one
as it is).  Places count through the shard's documents, with one place between
two documents at which nothing stands, so a phrase never runs from one to the next.

``search`` takes test items as queries, in blocks of bounded size.  A window of
an item is a phrase.  In each shard the terms of a window are put in order of
their lists' lengths; the list of the rarest, moved by the term's offset, gives
the candidate starts, and each further term keeps those at which it stands
itself.  Windows with a term that the shard lacks end at once.  Terms are
compared as strings, so matches are exact.  With slack, a match is a stretch of
so many words more that holds every term of the window, in any order.

Nothing is shuffled but what is found, by document.  The work of a shard is
bounded by its own size and that of a block, so neither common terms nor
passages that very many documents share make a hot task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Bytes of text in a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of item texts that are searched for in one pass over the index; a longer item is a block of its own.
BLOCK_BYTES = 16 << 20
#: Candidate starts that are worked on together in a shard.
CANDIDATES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are part of no word once A-Z is lower-cased: those below 0x80 but digits and letters.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Bytes of a row group of the index, about.  Rows are large, and the writer by itself looks at sizes first
#: after 100 rows, which would hold, and have each reader hold, hundreds of MB a task; so it looks at every row.
GROUP_BYTES = 16 << 20
_FILES = {"compression": "zstd", "parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

INDEX = "ids array<bigint>, sizes array<int>, terms array<string>, counts array<int>, gaps array<int>"


def _words(texts: pa.Array) -> common.Words:
    body, at = common.text_bytes(texts)
    return common.Words(_LOWER[body], at, _BETWEEN)


def _strings(w: common.Words, which: np.ndarray) -> pa.Array:
    """The words of these numbers as an Arrow column."""
    size = (w.end - w.start)[which]
    where, _, _ = common.ragged(w.start[which], size)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(w.body[where])))


def postings(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a shard: words of each text, its terms, how often each stands, and the gaps of all lists."""
    w = _words(texts)
    number = common.numbers(w.body, w.start, w.end, w.hashes())
    order = np.argsort(number, kind="stable")
    first = np.ones(len(order), dtype=bool)
    first[1:] = number[order][1:] != number[order][:-1]
    place = (np.arange(len(order)) + w.doc)[order]
    gaps = place.copy()
    gaps[1:] -= np.where(first[1:], 0, place[:-1])
    begin = np.flatnonzero(first)
    return w.count, _strings(w, order[begin]), np.diff(np.append(begin, len(order))), gaps


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD_BYTES) -> DataFrame:
    """The index as a written table, one row a shard: ids and sizes (in words) of its documents, terms, counts and gaps.

    A null text has no words.  Repeated rows are documents of their own, and a
    null id stays null.  Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values.cast(kind))
        for b in common.chunks(batches, "text", shard):
            sizes, terms, counts, gaps = postings(b.column("text"))
            columns = [one(b.column("doc_id"), pa.int64()), one(sizes.astype(np.int32), pa.int32()), one(terms, pa.string()), one(counts.astype(np.int32), pa.int32()), one(gaps.astype(np.int32), pa.int32())]
            yield pa.record_batch(columns, ["ids", "sizes", "terms", "counts", "gaps"])

    # Files get the number of each shard, so it is the same whenever they are read.
    spark = docs.sparkSession
    path = common.fresh_folder(spark, "index")
    rows = source.mapInArrow(run, INDEX).withColumn("shard", F.monotonically_increasing_id())
    rows.write.options(**_FILES).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@dataclass
class Queries:
    """A block of items as windows: numbers of terms one after another, and where each window begins in them."""

    vocabulary: pa.Array
    terms: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    #: For each window the items that have it: items[item_at[i] : item_at[i + 1]].
    items: np.ndarray
    item_at: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, names: list[str | None], texts: list[str | None], window: int = WINDOW) -> Queries:
        w = _words(pa.array(texts, pa.string()))
        coded = _strings(w, np.arange(len(w.start))).dictionary_encode()
        terms = coded.indices.to_numpy().astype(np.int32)
        begin, length, item, seen = [], [], [], {}
        for i, (at, n) in enumerate(zip(w.word_at.tolist(), w.count.tolist(), strict=False)):
            size = min(n, window)
            for a in range(at, at + n - size + 1) if n else ():
                k = seen.setdefault(terms[a : a + size].tobytes(), len(begin))
                if k == len(begin):
                    begin.append(a)
                    length.append(size)
                    item.append({})
                item[k][i] = None
        size = [len(x) for x in item]
        return cls(coded.dictionary, terms, np.array(begin, np.int64), np.array(length, np.int64), np.array([i for x in item for i in x], np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), names)


class Shard:
    """The lists of a shard for the terms of a block of items."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        sizes = row["sizes"].to_numpy().astype(np.int64)
        self.sizes = sizes
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # the place of each document's first word
        self.places = int((sizes + 1).sum())
        counts = row["counts"].to_numpy().astype(np.int64)
        known = pc.index_in(row["terms"].cast(pa.large_string()), value_set=vocabulary)
        term = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        mine = term >= 0
        gaps = row["gaps"].to_numpy()[np.repeat(mine, counts)].astype(np.int64)
        counts, term = counts[mine], term[mine]
        place = np.cumsum(gaps)
        head = np.cumsum(counts) - counts
        place -= np.repeat(place[head] - gaps[head], counts)
        #: term * places + place of all postings, ascending.
        self.keys = np.sort(np.repeat(term, counts) * self.places + place)
        self.count = np.zeros(len(vocabulary), dtype=np.int64)
        self.count[term] = counts
        self.head = np.cumsum(self.count) - self.count

    def places_of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of these terms, one list after another, and how long each list is."""
        n = self.count[term]
        where, _, _ = common.ragged(self.head[term], n)
        return self.keys[where] - np.repeat(term, n) * self.places, n

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place at or after place at which the term stands; places (the end) if none."""
        want = term * self.places + place
        k = np.searchsorted(self.keys, want)
        found = self.keys[np.minimum(k, len(self.keys) - 1)] if len(self.keys) else want
        return np.where((k < len(self.keys)) & (found < (term + 1) * self.places), found - term * self.places, self.places)


def _alive(shard: Shard, q: Queries) -> np.ndarray:
    """The windows whose terms all stand in the shard."""
    lacking = np.concatenate([[0], np.cumsum(shard.count[q.terms] == 0)])
    return np.flatnonzero(lacking[q.begin + q.length] == lacking[q.begin])


def _ordered(shard: Shard, q: Queries, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the windows' words by the lengths of their lists, rarest first, and the length of the shortest."""
    offset = np.arange(window)
    inside = offset < q.length[which][:, None]
    count = np.where(inside, shard.count[q.terms[np.where(inside, q.begin[which][:, None] + offset, 0)]], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    return order, np.take_along_axis(count, order[:, :1], axis=1)[:, 0]


def _parts(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes sum up to most, or of one row."""
    total, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def matches(shard: Shard, q: Queries, window: int = WINDOW, slack: int | None = None, most: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, first place, number of words) of all matches, part by part; without slack these are phrases."""
    alive = _alive(shard, q)
    for some in _parts(np.full(len(alive), window), most):
        order, least = _ordered(shard, q, alive[some], window)
        for part in _parts(least * (1 if slack is None else window + slack), most):
            which, ranks = alive[some][part], order[part]
            rarest = ranks[:, 0]
            place, n = shard.places_of(q.terms[q.begin[which] + rarest].astype(np.int64))
            row = np.repeat(np.arange(len(which)), n)
            size = q.length[which]
            if slack is None:
                start = place - rarest[row]
                row, start = row[start >= 0], start[start >= 0]
            else:
                size = size + slack
                many = size[row]
                where, _, _ = common.ragged(place - many + 1, many)
                doc = np.repeat(np.searchsorted(shard.begin, place, "right") - 1, many)
                row = np.repeat(row, many)
                # The stretch lies in the document of the word that it was built around; a shorter document is one stretch.
                head, stop = shard.begin[doc], shard.begin[doc] + shard.sizes[doc]
                keep = (where >= head) & (np.minimum(where + size[row], stop) - where >= np.minimum(size[row], stop - head))
                pair = np.unique(row[keep] * np.int64(shard.places) + where[keep])
                row, start = pair // shard.places, pair % shard.places
            for k in range(1 if slack is None else 0, window):
                live = k < q.length[which[row]]
                offset = ranks[row, np.minimum(k, window - 1)]
                term = q.terms[np.where(live, q.begin[which[row]] + offset, 0)].astype(np.int64)
                if slack is None:
                    want = start + offset
                    good = ~live | (shard.next(term, want) == want)
                else:
                    doc = np.searchsorted(shard.begin, start, "right") - 1
                    good = ~live | (shard.next(term, start) < np.minimum(start + size[row], shard.begin[doc] + shard.sizes[doc]))
                row, start = row[good], start[good]
            if len(row):
                doc = np.searchsorted(shard.begin, start, "right") - 1
                yield which[row], start, np.minimum(size[row], shard.begin[doc] + shard.sizes[doc] - start)


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int, window: int) -> Iterator[Queries]:
    """The items in blocks of about most bytes; the driver holds one block at a time."""
    names, texts, size = [], [], 0
    for name, text in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        more = len((text or "").encode())
        if texts and size + more > most:
            yield Queries.of(names, texts, window)
            names, texts, size = [], [], 0
        names.append(name)
        texts.append(text)
        size += more
    yield Queries.of(names, texts, window)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of an index, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].values for c in ("ids", "sizes", "terms", "counts", "gaps")} | {"shard": b.column("shard")[i].as_py()}
    common.give_back()


def _runs(places: int, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches that are covered."""
    step = np.zeros(places + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    inside = np.concatenate([[False], np.cumsum(step) > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def search(index_: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slack: int | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """(shard, number, doc_id, item_id, start, end): the stretches of words of each document that matches of each item cover.

    number is the document's in its shard; start and end count its words, end
    exclusive.  A match is a phrase: a window of consecutive item words as they
    stand, or all of a shorter item.  With slack it is a stretch of that many
    words more than the window, or a whole document that is shorter, with every
    word of the window in it, in any order.  Items that share an id are one
    item; an item without words has no windows.
    """
    parts = []
    for q in _blocks(items, item_col, text_col, block, window):
        sent = index_.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            name_of = {n: k for k, n in enumerate(dict.fromkeys(q.names))}
            named = np.array([name_of[n] for n in q.names], dtype=np.int64)
            names = pa.array(list(name_of), pa.string())
            for row in _rows(batches):
                shard = Shard(row, q.vocabulary)
                found = [np.zeros((0, 3), np.int64)]
                for which, start, size in matches(shard, q, window, slack):
                    n = q.item_at[which + 1] - q.item_at[which]
                    where, _, _ = common.ragged(q.item_at[which], n)
                    found.append(np.stack([named[q.items[where]], np.repeat(start, n), np.repeat(start + size, n)], axis=1))
                hit = np.unique(np.concatenate(found), axis=0)
                if not len(hit):
                    continue
                item, start, end = hit.T
                doc = np.searchsorted(shard.begin, start, "right") - 1
                # Stretches that touch or overlap become one: a running maximum of ends, apart for each item and document.
                group = np.cumsum(np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])))
                reach = np.maximum.accumulate(end + group * (shard.places + 1)) - group * (shard.places + 1)
                fresh = np.append(True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1]))
                last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
                item, doc, start, end = item[fresh], doc[fresh], start[fresh], reach[last]
                columns = [pa.array(np.full(len(doc), row["shard"])), pa.array(doc), row["ids"].take(pa.array(doc)), names.take(pa.array(item)), pa.array(start - shard.begin[doc]), pa.array(end - shard.begin[doc])]
                yield pa.record_batch(columns, ["shard", "number", "doc_id", "item_id", "start", "end"])

        parts.append(common.written(index_.mapInArrow(run, "shard long, number long, doc_id long, item_id string, start long, end long"), "matches"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def report(index_: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK_BYTES) -> DataFrame:
    """Of each document: doc_id, n_words, n_hit (words inside a phrase that an item has), n_items, items, contaminated.

    items are the ids of items with a phrase in the document, as strings, in
    order; an item without an id marks words but is not among them.  Every row
    that was indexed has a row.  Without items nothing is hit.
    """
    parts = []
    for number, q in enumerate(_blocks(items, item_col, text_col, block, window)):
        sent = index_.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            q = sent.value
            name_of = {n: k for k, n in enumerate(sorted({n for n in q.names if n is not None}))}
            named = np.array([name_of.get(n, -1) for n in q.names], dtype=np.int64)
            names = pa.array(list(name_of), pa.string())
            for row in _rows(batches):
                shard = Shard(row, q.vocabulary)
                starts, sizes, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for which, start, size in matches(shard, q, window):
                    starts.append(start)
                    sizes.append(size)
                    # Each window once in a document, before it becomes its items.
                    doc = np.searchsorted(shard.begin, start, "right") - 1
                    once = np.unique(doc * np.int64(len(q.begin)) + which)
                    doc, which = once // len(q.begin), once % len(q.begin)
                    n = q.item_at[which + 1] - q.item_at[which]
                    where, _, _ = common.ragged(q.item_at[which], n)
                    mine = named[q.items[where]]
                    pairs.append(np.unique((np.repeat(doc, n) * np.int64(len(name_of) + 1) + mine)[mine >= 0]))
                begin, end = _runs(shard.places, np.concatenate(starts), np.concatenate(sizes))
                pair = np.unique(np.concatenate(pairs))
                n = len(shard.sizes)
                doc = np.searchsorted(shard.begin, begin, "right") - 1
                item_doc, item = pair // (len(name_of) + 1), pair % (len(name_of) + 1)
                ends = lambda d: pa.array(np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))]).astype(np.int32))  # noqa: B023, E731
                spans = pa.StructArray.from_arrays([pa.array((begin - shard.begin[doc]).astype(np.int32)), pa.array((end - shard.begin[doc]).astype(np.int32))], ["start", "end"])
                columns = [pa.array(np.full(n, row["shard"])), pa.array(np.arange(n)), row["ids"], pa.array(shard.sizes), pa.ListArray.from_arrays(ends(doc), spans), pa.ListArray.from_arrays(ends(item_doc), names.take(pa.array(item)))]
                out = pa.record_batch(columns, ["shard", "number", "doc_id", "n_words", "spans", "items"])
                # The first block reports every document, the others those in which they found something.
                yield out if not number else out.filter(pc.greater(pc.list_value_length(out.column("spans")), 0))

        parts.append(common.written(index_.mapInArrow(run, "shard long, number long, doc_id long, n_words long, spans array<struct<start: int, end: int>>, items array<string>"), "hits"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.groupBy("shard", "number").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add)["n"].cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (hit > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """report()'s rows with the SHA-256 of the items in place of the items."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs without a phrase of an item, with all their columns; rows that share an id go if one of them has one, and a row without an id always stays."""
    found = report(index(docs, id_col=id_col, text_col=text_col), items, item_col=item_col, text_col=item_text_col, window=window)
    bad = found.where("contaminated").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, docs[id_col].cast("long") == bad[id_col], "left_anti")


def sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """What digest(report()) gives, for DuckDB: every stretch of a document's words against the windows of all items, length by length."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH docs AS (SELECT doc_id, {words("text")} AS w FROM {documents}),
    items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words("text")} AS w FROM {benchmark}),
    sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM sized)),
    sizes AS (SELECT DISTINCT size FROM windows),
    stretches AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM docs, sizes WHERE len(w) >= size)),
    found AS (SELECT doc_id, k, s.size, item_id FROM stretches s JOIN windows USING (size, phrase)),
    hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM (SELECT DISTINCT doc_id, k, size FROM found)) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id"""
