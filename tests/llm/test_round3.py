"""Operators 11 to 13 against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter
from itertools import permutations
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chartflow.llm import audit, decontamination, fim

from .test_operators import TEXTS, WORD, empty, frame, labels, odd, one_hash, prose

# 11


def plain_cut(text, doc_id):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD_LINES = ["\n", "\n\n\n", "a\n", "a\n\nb", "a<P>b", "<M", "<S" + ">", "<<\n>P>\n<\n", "é\n😀 x\n\ry", "no\nend\n" * 400]


def test_fill_in_middle(spark):
    texts = TEXTS + ODD_LINES
    got = {r["doc_id"]: r for r in fim.transform(frame(spark, texts)).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_cut(t or "", i) and r["back"] == (t or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    assert sorted(Counter(r["doc_id"] for r in fim.transform(odd(spark)).collect()).items(), key=str) == sorted(Counter(r["doc_id"] for r in odd(spark).collect()).items(), key=str)
    assert fim.transform(odd(spark)).where("doc_id IS NULL").first()["output"] == plain_cut(prose(50, 9), None)[4]
    assert fim.digest(fim.transform(empty(spark))).count() == 0


@pytest.mark.parametrize("unit", ["word", "char"])
def test_other_units_and_rates(spark, unit):
    rule = fim.Rule("<|pre|>", "<|suf|>", "<|mid|>", unit=unit, seed=3, rate=60, spm=30)
    docs = frame(spark, [prose(20, k) for k in range(200)])
    got = fim.transform(docs, rule).withColumn("back", fim.restore(F.col("output"), F.col("form"), rule)).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r["back"] == r["text"] for r in got)
    forms = Counter(r["form"] for r in got)
    assert 90 <= forms["psm"] + forms["spm"] <= 150 and forms["psm"] > forms["spm"] > 0
    assert all(r["n"] == (len(r["text"]) if unit == "char" else len(re.findall(r"\s*\S+\s*", r["text"]))) for r in got)


def test_sentinels_must_not_overlap(spark):
    for marks in (("<P>", "P>x", "<M>"), ("aa", "b", "c"), ("<P>", "<P>2", "m"), ("", "s", "m")):
        with pytest.raises(ValueError):
            fim.Rule(*marks)
    broken = spark.createDataFrame([("<S>a<P>b<M>c", "psm"), ("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm")], "output string, form string")
    assert [r[0] for r in broken.select(fim.restore(F.col("output"), F.col("form"))).collect()] == [None] * 3


# 12


LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(t):
    return LOW.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_report(docs, items, window=10):
    """doc_id, n_words, n_hit, items of every document; a list, as ids may repeat."""
    phrases = {}
    for name, t in items:
        ws = low_words(t)
        size = min(len(ws), window)
        for k in range(len(ws) - size + 1) if ws else ():
            phrases.setdefault(tuple(ws[k : k + size]), set()).add(name)
    out = []
    for i, t in docs:
        ws, hit, names = low_words(t), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(ws) - size + 1):
                if (p := tuple(ws[k : k + size])) in phrases:
                    hit |= set(range(k, k + size))
                    names |= phrases[p]
        out.append((i, len(ws), len(hit), sorted(str(n) for n in names if n is not None)))
    return sorted(out, key=str)


def planted():
    """Texts with passages of items: whole, cut, upper-cased, over line ends, repeated, beside each other and split between two documents."""
    passages = [prose(40, 200 + k) for k in range(6)]
    a, b = passages[0].split(), passages[1].split()
    texts = [
        *TEXTS, prose(30, 1000) + " " + passages[0] + " " + prose(30, 1001), " ".join(a[5:15]), " ".join(a[5:14]), " ".join(a[:9]), " ".join(a[9:20]), passages[1].upper().replace(" ", " -\n"),
        " ".join(b[:12] + a[20:35]), (passages[2] + "\n") * 30, "so so so " * 50, "short one", "a short one here", "Ünï short ONE x", passages[3] + passages[4], *(["x y " + passages[5]] * 12),
    ]
    items = [*enumerate(passages), (7, "short one"), (8, None), (9, ""), (10, "so " * 14), (11, passages[2]), (11, passages[3]), (None, passages[4]), (12, "!!"), (13, "nothing of this stands anywhere in any of the documents here at all"), (2, "x y")]
    return texts, items


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=str)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in items], "item_id long, text string, n_words long, doc_id string")


@pytest.mark.parametrize(("shard", "block", "window"), [(1 << 22, 1 << 24, 10), (3000, 500, 10), (1, 1, 4)])
def test_decontamination(spark, shard, block, window):
    texts, items = planted()
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id > 40")).unionByName(frame(spark, ["so so " + items[3][1]], [None]))
    index = decontamination.index(docs, shard=shard)
    got = decontamination.report(index, item_frame(spark, items), block=block, window=window)
    want = plain_report([(r["doc_id"], r["text"]) for r in docs.collect()], items, window)
    assert found(got) == want and any(w[2] for w in want)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got.collect())


def test_equal_hashes_are_not_equal_terms(monkeypatch):
    one_hash(monkeypatch)
    texts = ["aa bb cc dd", "cc dd aa bb", None, "bb aa", "aa bb aa"]
    sizes, terms, counts, gaps = decontamination.postings(pa.array(texts, pa.string()))
    row = {"sizes": pa.array(sizes), "terms": terms, "counts": pa.array(counts), "gaps": pa.array(gaps), "ids": None}
    q = decontamination.Queries.of(["1"], ["aa bb"])
    shard = decontamination.Shard(row, q.vocabulary)
    assert sorted(terms.to_pylist()) == ["aa", "bb", "cc", "dd"]
    assert [s.tolist() for w, s, n in decontamination.matches(shard, q)] == [[0, 7, 14]]


def test_nothing_to_find(spark):
    texts, items = planted()
    docs, none = frame(spark, texts), item_frame(spark, [(1, "x")]).where("item_id < 0")
    assert found(decontamination.report(decontamination.index(docs), none)) == plain_report(list(enumerate(texts)), [])
    assert decontamination.report(decontamination.index(empty(spark)), item_frame(spark, items)).count() == 0
    assert decontamination.search(decontamination.index(docs), none).count() == 0


@pytest.mark.parametrize("slack", [0, 3])
def test_proximity(spark, slack):
    a = prose(12, 300).replace("\n", " ").split()
    docs = [" ".join(prose(20, 301).split() + list(reversed(a[:8])) + prose(20, 302).split()), " ".join(a[:4] + ["zz", "zy"] + a[4:8]), " ".join(a[:4] + ["zz"] * 6 + a[4:8]), " ".join(a[:3]), None, " ".join(a[7::-1]), " ".join(a[:4]), " ".join(a[4:8])]
    items = [(1, " ".join(a[:8])), (2, " ".join(a[:2]))]
    got = {(r["doc_id"], r["item_id"], w) for r in decontamination.search(decontamination.index(frame(spark, docs)), item_frame(spark, items), slack=slack).collect() for w in range(r["start"], r["end"])}
    want = set()
    for d, t in enumerate(docs):
        ws = low_words(t)
        for i, item in items:
            need = set(low_words(item))
            size = len(low_words(item)) + slack
            for k in range(max(1, len(ws) - size + 1)):
                if need <= set(ws[k : k + size]):
                    want |= {(d, str(i), w) for w in range(k, min(k + size, len(ws)))}
    assert got == want and want


def test_phrases_with_their_places(spark):
    texts, items = planted()
    docs = frame(spark, texts)
    got = {(r["doc_id"], r["item_id"], w) for r in decontamination.search(decontamination.index(docs, shard=3000), item_frame(spark, items), block=700).collect() for w in range(r["start"], r["end"])}
    want = set()
    for d, t in enumerate(texts):
        ws = low_words(t)
        for i, item in items:
            iw = low_words(item)
            size = min(10, len(iw))
            for k in range(len(iw) - size + 1) if iw else ():
                for s in range(len(ws) - size + 1):
                    if ws[s : s + size] == iw[k : k + size]:
                        want |= {(d, None if i is None else str(i), w) for w in range(s, s + size)}
    assert got == want
    clean = {r["doc_id"] for r in decontamination.decontaminate(docs, item_frame(spark, items)).collect()}
    assert clean == set(range(len(texts))) - {d for d, _, _ in want}


# 13


def plain_audit(rows, known):
    """rows: doc_id, part, text."""
    fails = []
    for i, part, text in rows:
        t = text or ""
        ws = WORD.findall(t)
        f = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": any(j is not None and i is not None and j < i and (u or "") == t for j, _, u in rows)}
        fails.append((part or "", {k for k, v in f.items() if v}, *known.get(i, (False, False))))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [f for f in left if k in f[1]]
                kept = [f for f in left if k not in f[1]]
                shapley[k] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), sum(k in f[1] for f in mine) - sum(k in f[1] for f in left), sum(f[1] == {k} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                left = kept
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[key[1][key[2] - 1]])
    return out


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark, monkeypatch):
    loud = [prose(220, 400).upper(), "Aa Bb # " * 90, prose(260, 401) + " $", prose(260, 401) + " $", "", None, " ", prose(250, 402), prose(250, 402), prose(250, 402)]
    docs = frame(spark, TEXTS + loud)
    docs = docs.unionByName(docs.where("doc_id IN (6, 44)")).unionByName(frame(spark, [prose(300, 1), ""], [None, None]))
    marks = labels(spark, range(0, 40), [k % 2 for k in range(40)]).union(spark.createDataFrame([(3, 1, 1), (6, 0, 1), (7, None, 1), (44, 1, 0)], "doc_id long, quality int, toxic int"))
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    known = {}
    for r in marks.collect():
        g, t = known.get(r["doc_id"], (False, False))
        if r["doc_id"] is not None:
            known[r["doc_id"]] = (g or r["quality"] == 1, t or r["toxic"] == 1)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in NAMES] for r in audit.audit(docs, marks).collect()}
    assert got == plain_audit(rows, known)
    assert audit.audit(empty(spark), marks).count() == 0
    before = audit.masks(pa.array(TEXTS + loud, pa.string()))
    one_hash(monkeypatch)
    assert np.array_equal(before, audit.masks(pa.array(TEXTS + loud, pa.string())))


def test_every_order_and_step():
    assert len(audit.orders()) == 600 and len({(o, s) for o, s, _, _ in audit.orders()}) == 600


def test_row_groups_of_an_index_are_bounded(spark):
    """An index of fewer than 100 large rows is still read a few MB at a time, and its rows come back whole."""
    words = F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda x: F.lower(F.hex(F.xxhash64(x, F.col("doc_id")))))
    docs = spark.range(0, 60, 1, 1).withColumnRenamed("id", "doc_id").select("doc_id", F.array_join(words, " ").alias("text"))
    index = decontamination.index(docs, shard=1)
    groups = []
    for name in index.inputFiles():
        meta = pq.ParquetFile(urlparse(name).path).metadata
        groups += [(meta.row_group(i).num_rows, meta.row_group(i).total_byte_size) for i in range(meta.num_row_groups)]
    assert sum(n for n, _ in groups) == 60 and sum(size for _, size in groups) > 32 << 20
    assert max(size for _, size in groups) <= 32 << 20
    assert index.select(F.sum(F.element_at("sizes", 1)), F.sum(F.size("terms"))).first() == (3_000_000, 3_000_000)
