"""SimHash near-duplicates (operator 3) by covering locality-sensitive hashing.

A fingerprint has 64 bits.  For radius r every bit position gets a non-zero
vector of r + 1 bits, and each non-zero vector v of r + 1 bits makes one table:
its mask keeps the positions whose vector has an odd product with v.  Any r
positions span at most r dimensions, so some v is orthogonal to all of them:
its mask hides every bit in which two fingerprints within the radius differ,
and the two collide in that table.  No pair is missed; 7 tables serve r = 2.

Equal fingerprints are put together first.  In a bucket of up to ``BUCKET``
fingerprints all pairs are compared.  A larger one is linked without its pairs:
for r = 2, two fingerprints are linked exactly if some third word is within one
bit of both, so each emits itself and its neighbours at one bit that the mask
hides; all that meet at one word are links of each other and hang on the least.
Such a group has at most 65 members, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a bucket whose pairs are compared one by one.
BUCKET = 64


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits."""
    size = (1 << (radius + 1)) - 1
    vector = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_values(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit number."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts.to_pylist()):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(joined, seed))
            counts[i] = 1
            continue
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], end[:-1] + 1])
        hashes += [digest(joined[a:b], seed) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)]
        counts[i] = len(words) - shingle + 1
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(counts)
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    if len(full):
        ones[full] = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts[full])[:-1]]), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, and the row's own number if row_col is given.  A null or wordless text has fingerprint zero."""
    more = [] if row_col is None else [F.col(row_col).cast("long").alias("row")]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", *(["row"] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text", common.CHUNK_BYTES // 2):
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(fingerprint_values(b.column("text")).view(np.int64))], [*names, "fp"])

    return source.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


def link(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(x, y), x < y: links between distinct fingerprints fp that connect all pairs of at most two differing bits."""
    tables = masks()
    buckets = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(tables))))
    sigs = prints.select("fp", buckets.alias("s")).select("fp", "s.t", "s.key")
    sizes = common.written(sigs.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = common.written(common.meet(sigs, sizes, ["t", "key"]).select("t", "key", "fp", "n"), "buckets")

    few = met.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    few = few.select(F.explode("fps").alias("x"), "fps").select("x", F.explode(F.filter("fps", lambda y: (y > F.col("x")) & (F.bit_count(y.bitwiseXOR(F.col("x"))) <= RADIUS))).alias("y"))

    hidden = F.element_at(F.array(*(F.array(F.lit(0), *(F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in tables)), F.col("t") + 1)
    many = met.where(F.col("n") > bucket).select("fp", F.explode(F.transform(hidden, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("word")).distinct()
    many = many.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    many = many.select(F.array_min("fps").alias("x"), F.explode("fps").alias("y")).where("x < y")
    return few.union(many).distinct()


def _components(prints: DataFrame) -> DataFrame:
    """(fp, rep, rows, component): each distinct fingerprint, the least id and the number of rows that have it, and the component that links put it in."""
    reps = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "representatives")
    groups = components(link(reps).select(F.col("x").alias("a"), F.col("y").alias("b")))
    return reps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "rows", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, **columns) -> DataFrame:
    """Of each document: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach.

    Repeated rows come out as often as they come in.  A null id gets a row, and
    counts as larger than any id of its group; a group of null ids alone has none.
    """
    prints = common.written(fingerprints(docs, **columns), "fingerprints")
    named = common.written(_components(prints), "named")
    least = common.written(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "least")
    ids = common.written(common.meet(named, least, ["component"]).select("fp", "component_id", "rows"), "ids")
    return common.meet(prints, ids, ["fp"], "rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **columns) -> DataFrame:
    """One row of each group: that with the least id, null ids last; of rows that share it the one with the least number.

    Rows are numbered once, as they are written, so null and repeated ids stay
    apart; the number has a name that no column of docs has.  Empty tables stay empty.
    """
    number = common.free(docs, "_row")
    rows = common.written(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    prints = common.written(fingerprints(rows, id_col=id_col, row_col=number, **columns), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    of_print = prints.groupBy("fp").agg(first.alias("first"))
    kept = _components(prints).join(of_print, "fp").groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(number))
    return rows.join(kept, number, "left_semi").select(*docs.columns)
