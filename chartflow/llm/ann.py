"""Approximate nearest neighbours (operator 10) by randomly rotated one-bit codes.

Vectors are dealt to lists by their nearest centre.  A vector is scaled to
length one, its list's centre is taken away, the rest is turned by a random
rotation and only the signs are kept, with two correction scalars: the length
of the rest, and the product of rest and code.  A query is turned in the same
way and rounded to ``PLANES`` bits a figure; its product with a code is then a
few popcounts of packed words, and divided by the second scalar it estimates
the product with the vector.  The error falls as 1 / sqrt(dimension) and is
bounded by ``EPSILON`` standard deviations.  Only vectors whose upper bound
reaches the k-th best value so far are scored exactly, on the original vectors,
in double precision.

Every row is indexed.  Centres are fitted on a sample, rows with a small hash,
``SAMPLE`` rows or ``SAMPLE_FIGURES`` figures in all; on the same sample the
number of lists that a query has to visit is set, as the least that holds
``REACH`` of the true neighbours of ``TRIED`` of its rows.  Where vectors lie in
clusters these are few lists; where they have none, nearly all.

Of equal vectors only the k + 1 least ids can be among the k nearest, so others
are left out before anything is compared (and before the shuffle); a vector that
a third of all rows share is a handful of candidates.  A list is cut into parts
of bounded size, and its queries into bounded chunks; a part keeps its codes in
memory and a chunk of queries streams past it, so each task is bounded.

Vectors are scaled by a power of two before they are multiplied: that changes no
digit of a cosine, and neither tiny nor huge figures underflow or overflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Standard deviations of the estimate that the bounds allow for: one neighbour in about 700 may be missed.
EPSILON = 3.0
#: Bits that a query's figures are rounded to.
PLANES = 4
#: Rows, and figures of all rows, that centres are fitted on at most.
SAMPLE, SAMPLE_FIGURES = 16_384, 1 << 22
#: Rows of a list, about, as long as lists are fewer than MOST_LISTS and a list has 16 rows of the sample.
LIST_ROWS, MOST_LISTS = 1024, 1024
#: Share of the true neighbours that the visited lists must hold, and sampled rows that it is measured on.
REACH, TRIED = 0.99, 256
#: Bytes of vectors (in double precision) in a part of a list, and queries in a chunk, about.
GROUP_BYTES, CHUNK = 16 << 20, 1 << 16
#: Vectors and queries that are compared at once.
BLOCK, QUERIES = 4096, 128
#: What single precision may add to an estimate's error.
SINGLE = 1e-5
#: Pairs that are scored exactly at once.
PAIRS = 1 << 16
#: Tasks of the search at most.
TASKS = 20_000

INDEX = "id long, dim int, list int, vector array<double>, code binary, rest double, fit double"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(fine & F.exists("vector", lambda x: x != 0))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of each vector the k + 1 least ids that have it, once each.  Both ranks are cut off before the shuffle too."""
    same = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("_rank", F.dense_rank().over(same)).where(F.col("_rank") <= k + 1)
    return few.withColumn("_rank", F.row_number().over(Window.partitionBy("vector", "id").orderBy("id"))).where("_rank = 1").drop("_rank")


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, its largest figure between a half and one."""
    top = np.abs(x).max(axis=1, keepdims=True)
    _, e = np.frexp(top)
    half = -e // 2  # in two steps, as the power alone may be out of range
    return np.ldexp(np.ldexp(x, half), -e - half)


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / _length(x)[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def centres(unit: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Means of the vectors nearest to each, by a few rounds over a sample in a fixed order."""
    middle = unit[:lists].copy()
    for _ in range(rounds):
        of = (unit @ middle.T).argmax(axis=1)
        total = np.zeros_like(middle)
        np.add.at(total, of, unit)
        count = np.bincount(of, minlength=lists)
        middle = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], middle)
    return middle


def nearest_lists(unit: np.ndarray, middle: np.ndarray, n: int) -> np.ndarray:
    """The n lists whose centres are nearest, for each vector, the nearest first."""
    d = (middle * middle).sum(axis=1) - 2 * (unit @ middle.T)
    if n == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def visits(unit: np.ndarray, middle: np.ndarray, k: int) -> int:
    """How many lists hold REACH of the k nearest in the sample, for TRIED of its rows."""
    if len(middle) == 1 or len(unit) < 2:
        return 1
    asked = unit[-TRIED:]
    of = nearest_lists(unit, middle, 1)[:, 0]
    s = asked @ unit.T
    s[np.arange(len(asked)), np.arange(len(unit) - len(asked), len(unit))] = -2
    near = np.argpartition(-s, min(k, len(unit) - 1) - 1, axis=1)[:, :k]
    order = nearest_lists(asked, middle, len(middle))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(middle))[None, :].repeat(len(asked), 0), axis=1)
    return int(np.quantile(np.take_along_axis(place, of[near], axis=1), REACH, method="higher")) + 1


class Layout:
    """Centres of the lists, the number of lists to visit, and the sample (ids, scaled vectors), for each dimension; one list without a centre for others."""

    def __init__(self, middle: dict[int, np.ndarray], visit: dict[int, int], known: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.middle, self.visit, self.known = middle, visit, known or {}

    def centres(self, dim: int) -> np.ndarray:
        return self.middle[dim] if dim in self.middle else np.zeros((1, dim))

    def bar(self, ids: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
        """A score that k rows other than the query's own reach: the k-th best in the sample."""
        names, known = self.known.get(unit.shape[1], (np.zeros(0, np.int64), np.zeros((0, unit.shape[1]))))
        if len(names) <= k:
            return np.full(len(unit), -np.inf)
        s = unit @ known.T
        s[ids[:, None] == names] = -np.inf
        return np.partition(s, -k, axis=1)[:, -k] - 1e-9

    @classmethod
    def fit(cls, rows: DataFrame, k: int) -> Layout:
        n, figures = rows.agg(F.count("*"), F.sum(F.size("vector").cast("long"))).first()
        if not n:
            return cls({}, {})
        want = min(SAMPLE, max(1, SAMPLE_FIGURES * n // figures))
        place = F.shiftrightunsigned(F.xxhash64("id"), 12)
        low = rows.where(place <= int(min(1.0, want / n) * 2**52)).limit(2 * want)
        found: dict[int, list] = {}
        for r in low.select("vector", place.alias("h"), "id").toLocalIterator():
            found.setdefault(len(r.vector), []).append((r.h, r.id, r.vector))
        middle, visit, known = {}, {}, {}
        total = sum(map(len, found.values()))
        for dim, sample in found.items():
            every = _unit(np.array([v for _, _, v in sorted(sample)]))
            names, once = np.unique([i for _, i, _ in sorted(sample)], return_index=True)
            known[dim] = names, every[once]
            unit = np.unique(every, axis=0)
            unit = unit[np.random.default_rng(dim).permutation(len(unit))]
            lists = max(1, min(MOST_LISTS, len(sample) * n // total // LIST_ROWS, len(unit) // 16))
            middle[dim] = centres(unit, lists)
            visit[dim] = visits(unit, middle[dim], k)
        return cls(middle, visit, known)


def build_index(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row for each (id, vector): itself, its list, its packed code, and the correction scalars rest and fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("vector").value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                all_ = b.filter(pa.array(dims == dim))
                middle = layout.centres(dim)
                for i in range(0, all_.num_rows, BLOCK):
                    part = all_.slice(i, BLOCK)
                    unit = _unit(_matrix(part.column("vector"), dim))
                    of = nearest_lists(unit, middle, 1)[:, 0]
                    r = unit - middle[of]
                    rest = _length(r)
                    turned = (r / np.maximum(rest, 1e-300)[:, None]) @ rotation(dim)
                    fit = np.abs(turned).sum(axis=1) / np.sqrt(dim)
                    code = np.packbits(turned > 0, axis=1, bitorder="little")
                    yield pa.record_batch([part.column("id"), pa.array(np.full(len(of), dim, np.int32)), pa.array(of.astype(np.int32)), part.column("vector"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(rest), pa.array(np.where(rest > 0, fit, 1.0))], ["id", "dim", "list", "vector", "code", "rest", "fit"])

    return rows.mapInArrow(run, INDEX)


def visited(asked: DataFrame, layout: Layout, k: int) -> DataFrame:
    """(id, dim, vector, list, bar): a row for each list that a query visits, with a score that its k-th best reaches at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("vector").value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                all_ = b.filter(pa.array(dims == dim))
                n = layout.visit.get(dim, 1)
                for i in range(0, all_.num_rows, QUERIES):
                    part = all_.slice(i, QUERIES)
                    unit = _unit(_matrix(part.column("vector"), dim))
                    lists, bar = nearest_lists(unit, layout.centres(dim), n), layout.bar(part.column("id").to_numpy(), unit, k)
                    again = part.take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                    yield pa.record_batch([again.column("id"), pa.array(np.full(again.num_rows, dim, np.int32)), again.column("vector"), pa.array(lists.ravel().astype(np.int32)), pa.array(np.repeat(bar, n))], ["id", "dim", "vector", "list", "bar"])

    return asked.mapInArrow(run, "id long, dim int, vector array<double>, list int, bar double")


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of packed bytes as 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view("<u8")


class Group:
    """The indexed rows of a part of a list."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, rest: np.ndarray, fit: np.ndarray, middle: np.ndarray):
        self.ids, self.middle = ids, middle
        self.x = scaled(x)
        self.length = _length(self.x)
        self.code = np.ascontiguousarray(_words(code).T)  # word by word
        self.ones = np.bitwise_count(self.code).sum(axis=0, dtype=np.int64)
        self.distinct = len(np.unique(ids)) == len(ids)
        dim = x.shape[1]
        self.aside = (self.x * middle).sum(axis=1) / self.length - (middle * middle).sum()
        self.gain = (rest / (fit * np.sqrt(dim))).astype(np.float32)
        self.error = rest * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * EPSILON / np.sqrt(max(dim - 1, 1))
        self.rounding = rest / fit * EPSILON / np.sqrt(12)

    def products(self, planes: list[np.ndarray], s: slice, kind: type) -> np.ndarray:
        """The sum of a query's rounded figures where a code has a bit, for all queries and the codes of s."""
        words = self.code[:, s]
        out = np.zeros((len(planes[0]), words.shape[1]), dtype=kind)
        both = np.empty(out.shape, dtype=np.uint64)
        count = np.empty(out.shape, dtype=np.uint8)
        for j, plane in enumerate(planes):
            for w in range(len(words)):
                np.bitwise_and(plane[:, w, None], words[w], out=both)
                np.bitwise_count(both, out=count)
                out += count.astype(kind) << kind(j)
        return out

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of the k best for each query that bounds and scores have found; those surely under its bar are left out."""
        dim = q.shape[1]
        q = scaled(q)
        q_length = _length(q)
        unit = q / q_length[:, None]
        qr = unit - self.middle
        q_rest = _length(qr)
        turned = (qr / np.maximum(q_rest, 1e-300)[:, None]) @ rotation(dim)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = [_words(np.packbits(level >> j & 1, axis=1, bitorder="little")) for j in range(PLANES)]
        whole = dim * low + step * level.sum(axis=1, dtype=np.int64)
        q_aside = (unit * self.middle).sum(axis=1)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        bar = bar.copy()
        for i in range(0, len(self.ids), BLOCK):
            s = slice(i, i + BLOCK)
            got = self.products(planes, s, np.uint16 if dim <= 4096 else np.uint32).astype(np.float32)
            got *= self.gain[s]
            got *= (2 * q_rest * step)[:, None]
            got += np.stack([2 * q_rest * low, -q_rest * whole, np.ones(len(q)), q_aside], axis=1, dtype=np.float32) @ np.stack([self.gain[s] * self.ones[s], self.gain[s], self.aside[s], np.ones(got.shape[1])], dtype=np.float32)
            error = np.stack([q_rest, q_rest * step, np.full(len(q), SINGLE)], axis=1, dtype=np.float32) @ np.stack([self.error[s], self.rounding[s], np.ones(got.shape[1])], dtype=np.float32)
            if self.distinct and got.shape[1] > k:  # one of the k + 1 best may be the query's own row
                bar = np.maximum(bar, np.partition(got - error, -k - 1, axis=1)[:, -k - 1])
            got += error
            a, b = np.nonzero(got >= bar.astype(np.float32)[:, None])
            b += i
            other = qid[a] != self.ids[b]
            a, b = a[other], b[other]
            scores = np.concatenate([np.zeros(0), *((q[a[j : j + PAIRS]] * self.x[b[j : j + PAIRS]]).sum(axis=1) / (q_length[a[j : j + PAIRS]] * self.length[b[j : j + PAIRS]]) for j in range(0, len(a), PAIRS))])
            best = top(*(np.concatenate(c) for c in zip(best, (a, self.ids[b], scores), strict=True)), k)
            count = np.bincount(best[0], minlength=len(q))
            last = np.cumsum(count) - 1
            full = count == k
            bar[full] = np.maximum(bar[full], best[2][last[full]])
        return tuple(best)


def top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """The k first ids of each query by falling score, then rising id; an id comes once, by its best score."""
    order = np.lexsort((-score, ids, query))
    once = order[np.append(True, (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1]))[: len(order)]]
    query, ids, score = query[once], ids[once], score[once]
    order = np.lexsort((ids, -score, query))
    query = query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return [query[keep], ids[order][keep], score[order][keep]]


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by cosine, without the row itself.

    Null ids and vectors that are null, zero, or hold null or non-finite values
    take no part; finite values of any size do.  Vectors are compared with those
    of their own length.  An id that several rows share is no neighbour of
    itself, and comes once for a query, by its best score; a query whose id has
    several vectors gets the nearest to any of them.
    """
    rows = candidates(clean(vectors, id_col, vector_col), k)
    asked = clean(vectors.where(is_query), id_col, vector_col).dropDuplicates(["id", "vector"])
    layout = Layout.fit(clean(vectors, id_col, vector_col), k)
    index = common.written(build_index(rows, layout), "index")
    visit = visited(asked, layout, k)

    # Parts and chunks of each list; of lists there are at most MOST_LISTS for a dimension.
    size = index.groupBy("dim", "list").agg(F.count("*").alias("rows"))
    part = F.ceil(F.col("rows") * F.col("dim") * 8 / GROUP_BYTES)
    chunk = F.greatest(F.ceil(F.col("queries") / CHUNK), F.lit(1).cast("long"))
    lists = size.join(visit.groupBy("dim", "list").agg(F.count("*").alias("queries")), ["dim", "list"]).select("dim", "list", part.alias("parts"), chunk.alias("chunks"))
    lists = common.written(lists, "lists")
    groups = int(lists.agg(F.sum(F.col("parts") * F.col("chunks"))).first()[0] or 0)
    lists = common.small(lists)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    data = index.join(lists, ["dim", "list"]).withColumn("part", dealt("parts")).withColumn("chunk", each("chunks")).withColumn("kind", F.lit(0)).drop("parts", "chunks")
    queries = visit.join(lists, ["dim", "list"]).withColumn("chunk", dealt("chunks")).withColumn("part", each("parts")).withColumn("kind", F.lit(1)).drop("parts", "chunks")
    keys = ["dim", "list", "part", "chunk"]
    both = data.unionByName(queries, allowMissingColumns=True).repartition(max(1, min(groups, TASKS)), *keys).sortWithinPartitions(*keys, "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group = None, [], None
        for batch in batches:
            k_ = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, "kind")], axis=1)
            edges = [0, *(np.flatnonzero((k_[1:] != k_[:-1]).any(axis=1)) + 1).tolist(), len(k_)] if len(k_) else [0]
            for i, j in zip(edges, edges[1:], strict=False):
                *here, kind = k_[i].tolist()
                some = batch.slice(i, j - i)
                if here != key:
                    key, held, group = here, [], None
                if kind == 0:
                    held.append(some)
                    continue
                dim = here[0]
                if held and group is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
                    group = Group(t["id"].to_numpy(), _matrix(t["vector"].chunk(0), dim), code, t["rest"].to_numpy(), t["fit"].to_numpy(), layout.centres(dim)[here[1]])
                for at in range(0, some.num_rows if group else 0, QUERIES):
                    few = some.slice(at, QUERIES)
                    qid = few.column("id").to_numpy()
                    a, ids, score = group.search(qid, _matrix(few.column("vector"), dim), k, few.column("bar").to_numpy())
                    yield pa.record_batch([pa.array(qid[a]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
