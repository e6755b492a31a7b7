"""Quality classifier (operator 7): an interpolated modified Kneser-Ney model of characters.

Counts of character n-grams come from all trusted documents (labelled good and
not toxic), for each language.  Continuation counts, discounts and backoff
weights are grouped sums, and the probability of an n-gram is joined together
order by order, sharded by language and n-gram.

Texts are dealt to blocks of bounded size once.  A block reports its distinct
n-grams, which are far fewer than its characters; their probabilities come back
as the block's lexicon, and both meet again by block (the same shuffle of texts
serves both ways).  A document's perplexity is that of all its characters and
an end mark.  One in ``HELD_OUT`` trusted documents is kept from the counts, by
a hash of its id; the threshold of a language is a quantile over these.  A
language that has none of these has no threshold, and keeps all.

A character is its one or two 16-bit units of UTF-16, and an n-gram a number of
``ORDER`` units, so no two characters count as one.  The marks are the units
FFFE and FFFF; the two characters of that name are written as pairs that
UTF-16 does not have otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: Share of a language's held-out trusted documents that its threshold lets through.
QUANTILE = 0.99
HELD_OUT = 5
#: Bytes of text in a block, about.
BLOCK_BYTES = 32 << 20
START, END = 0xFFFE, 0xFFFF
#: Probability of a character where a language has no trusted text.
UNSEEN = 1.0 / 65536


def units(text: str | None) -> np.ndarray:
    """The 16-bit units of a text; none of them is a mark."""
    out = np.frombuffer((text or "").encode("utf-16-le"), dtype="<u2")
    if len(out) and out.max() >= START:
        out = np.frombuffer(text.replace("\ufffe", "\udc00\udc00").replace("\uffff", "\udc00\udc01").encode("utf-16-le", "surrogatepass"), dtype="<u2")
    return out


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, one after another, and how many each has (its units and the end mark)."""
    parts = [units(t) for t in texts.to_pylist()]
    size = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    if not len(size):
        return np.zeros(0, np.int64), size
    lead = np.full(order - 1, START, dtype=np.uint16)
    end = np.array([END], dtype=np.uint16)
    line = np.concatenate([x for p in parts for x in (lead, p, end)]).astype(np.int64)
    out = np.zeros(len(line) - order + 1, dtype=np.int64)
    for k in range(order):
        out = (out << 16) | line[k : k + len(out)]
    at = np.concatenate([[0], np.cumsum(size + order - 1)[:-1]])
    return out[np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())], size


def _by_language(texts: pa.Table) -> list[tuple[str, pa.Table]]:
    names = texts["lang"].combine_chunks().unique().to_pylist()
    return [(n, texts.filter(pc.equal(texts["lang"], n))) for n in names]


def _slices(t: pa.Table) -> list[pa.RecordBatch]:
    return list(common.chunks(iter(t.combine_chunks().to_batches()), "text", common.CHUNK_BYTES))


def _found(left: pa.Table, right: pa.Table) -> pa.Table:
    """(block, lang, g, c): the distinct n-grams of a block, and their count in trusted documents."""
    block = left["block"][0].as_py() if left.num_rows else 0
    out = {"block": [], "lang": [], "g": [], "c": []}
    trusted = pc.unique(right["doc_id"].combine_chunks())
    for name, part in _by_language(left) if left.num_rows else []:
        seen, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in _slices(part):
            g, size = grams(b.column("text"))
            good = np.repeat(pc.is_in(b.column("doc_id"), trusted).to_numpy(zero_copy_only=False), size)
            order = np.argsort(g)
            g, good = g[order], good[order]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            both, c = np.concatenate([seen, g[first]]), np.concatenate([count, np.add.reduceat(good.astype(np.int64), first)])
            seen, inverse = np.unique(both, return_inverse=True)
            count = np.bincount(inverse, c).astype(np.int64)
        out["block"].append(np.full(len(seen), block))
        out["lang"] += [name] * len(seen)
        out["g"].append(seen)
        out["c"].append(count)
    join = lambda k: pa.array(np.concatenate([np.zeros(0, np.int64), *out[k]]).astype(np.int64))
    return pa.table({"block": join("block"), "lang": pa.array(out["lang"], pa.string()), "g": join("g"), "c": join("c")})


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """(doc_id, lang, chars, n, logp) of a block's documents, from its lexicon (lang, g, logp in single precision, summed in double)."""
    parts = []
    for name, part in _by_language(left) if left.num_rows else []:
        mine = right.filter(pc.equal(right["lang"], name))
        key, value = mine["g"].to_numpy(), mine["logp"].to_numpy().astype(np.float64)
        order = np.argsort(key)
        key, value = key[order], value[order]
        for b in _slices(part):
            g, size = grams(b.column("text"))
            p = value[np.searchsorted(key, g)]
            total = np.add.reduceat(p, np.concatenate([[0], np.cumsum(size)[:-1]]))
            parts.append(pa.table({"doc_id": b.column("doc_id"), "lang": b.column("lang"), "chars": pc.utf8_length(b.column("text")).cast(pa.int64()), "n": pa.array(size), "logp": pa.array(total)}))
    return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "chars": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "logp": pa.array([], pa.float64())})


def discount(c: Column) -> Column:
    return F.when(c.isNull(), 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 from how often counts of 1 to 4 occur; where one of them is missing, plain halves."""
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in range(1, 5)]
    t = counts.groupBy("lang").agg(*n).withColumn("y", F.expr("try_divide(n1, n1 + 2 * n2)"))
    d = lambda k: F.greatest(F.lit(0.1), F.least(F.lit(float(k)), F.coalesce(F.expr(f"{k} - {k + 1} * y * try_divide(n{k + 1}, n{k})"), F.lit(k / 2))))
    return t.select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def probabilities(found: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, p) for every n-gram that is found anywhere."""
    mask = [(1 << (16 * k)) - 1 for k in range(order + 1)]
    # One table for each order: all n-grams that are asked for, and their counts, 0 where trusted text has none.
    asked = {order: common.written(found.groupBy("lang", "g").agg(F.sum("c").alias("c")), "counts")}
    for n in range(order - 1, 0, -1):
        tail = F.col("g").bitwiseAND(F.lit(mask[n])).alias("g")
        asked[n] = common.written(asked[n + 1].groupBy("lang", tail).agg(F.count_if(F.col("c") > 0).alias("c")), "counts")
    # Figures of whole languages are one row each, broadcast if they are few.
    known = common.small(common.written(asked[1].where("c > 0").groupBy("lang").agg((F.count("*") + 1).cast("double").alias("chars")), "alphabets"))
    p = None
    for n in range(1, order + 1):
        head = F.shiftright("g", 16).alias("h")
        seen = asked[n].where("c > 0")
        rates = common.small(common.written(discounts(seen), "discounts"))
        heads = seen.join(rates, "lang").select("lang", head, "c", F.least(discount(F.col("c")), F.col("c").cast("double")).alias("d")).groupBy("lang", "h").agg(F.sum("c").alias("s"), (F.sum("d") / F.sum("c")).alias("back"))
        now = asked[n].select("lang", "g", F.when(F.col("c") > 0, F.col("c")).alias("c"), head).join(heads, ["lang", "h"], "left").join(rates, "lang", "left")
        if p is None:
            now = now.join(known, "lang", "left").withColumn("lower", F.coalesce(1 / F.col("chars"), F.lit(UNSEEN)))
        else:
            now = now.withColumn("tail", F.col("g").bitwiseAND(F.lit(mask[n - 1]))).join(p.select("lang", F.col("g").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        own = F.greatest(F.coalesce(F.col("c").cast("double"), F.lit(0.0)) - discount(F.col("c")), F.lit(0.0))
        p = common.written(now.select("lang", "g", F.when(F.col("s").isNull(), F.col("lower")).otherwise(own / F.col("s") + F.col("back") * F.col("lower")).alias("p")), "probabilities")
    return p


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Of each document: doc_id, lang, n_chars, perplexity, threshold of its language, and kept.

    A null language is the language "".  A null or empty text is its end mark.
    Repeated rows are scored each; a label counts for all rows of its id, and
    rows without an id have none.  Rows are dealt to blocks by id, those without
    one by their text.  A language without held-out trusted text has no threshold, and keeps all.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = max(1, -(-int(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    of_row = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)).alias("block")  # that of the id, where there is one
    trusted = common.written(labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct(), "trusted")
    dealt = source.select(of_row, "doc_id", "lang", "text").groupBy("block")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    found = dealt.cogroup(trusted.where(~held).select(block, "doc_id").groupBy("block")).applyInArrow(_found, "block long, lang string, g long, c long")
    found = common.written(found, "grams")
    lexicon = found.select("block", "lang", "g").join(probabilities(found), ["lang", "g"]).select("block", "lang", "g", F.log("p").cast("float").alias("logp"))
    scored = dealt.cogroup(lexicon.groupBy("block")).applyInArrow(_scored, "doc_id long, lang string, chars long, n long, logp double")
    scored = common.written(scored.select("doc_id", "lang", F.col("chars").alias("n_chars"), F.exp(-F.col("logp") / F.col("n")).alias("perplexity")), "scored")
    place = lambda x: F.percentile_approx(x, quantile, 10_000)
    limits = scored.join(trusted, "doc_id", "left_semi").groupBy("lang").agg(place(F.when(held, F.col("perplexity"))).alias("threshold"))
    limits = common.small(common.written(limits, "limits"))
    return scored.join(limits, "lang", "left").select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
