"""Every query of an operator on the smallest tables: against its SQL, or else against a plain version."""

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from chartflow.llm.queries import QUERIES, SQL

from .test_operators import base_counts, check_kneser_ney, pii, plain_components, plain_dedup, plain_ids, plain_print, plain_spans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())


def by_id(spark, name):
    got = QUERIES[name](spark, DATA).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    return {r["doc_id"]: r for r in got}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got, want = QUERIES[name](spark, DATA).toPandas(), c.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))


def test_quality_rules(spark, texts):
    got = by_id(spark, "op1_quality_rules")
    assert set(got) == set(texts)
    for i, t in texts.items():
        n, chars, symbols, lines, repeat = base_counts(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["kept"] and r["base_failed"])


def test_token_codes(spark, texts):
    got, start = by_id(spark, "op2_token_codes"), 0
    for i in sorted(texts):
        ids = np.array([*plain_ids(texts[i]), 2], dtype="<u4")
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_simhash(spark, texts):
    got = by_id(spark, "op3_simhash_near_dedup")
    prints = {i: plain_print(t) for i, t in texts.items()}
    groups = plain_components(prints)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


def test_packing(spark, texts):
    got = QUERIES["op5_packing"](spark, DATA).toPandas()
    assert set(got.doc_id) == set(texts)
    for i, g in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*plain_ids(texts[i]), 1], dtype="<u4")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids) and set(g.doc_tokens) == {len(ids)}
        assert g.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length, strict=True)]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_substring_dedup(spark, texts):
    got = by_id(spark, "op6_substring_dedup")
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == plain_dedup(texts, 13)


def test_kneser_ney(spark, texts):
    got = by_id(spark, "op7_kneser_ney")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    clean = [r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"] and r["doc_id"] in got]
    assert set(got) == set(texts) and sum(got[i]["kept"] for i in clean) >= 0.95 * len(clean)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    check_kneser_ney(spark, got, texts, langs, {r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]})
    junk = [r["doc_id"] for r in labels if r["quality"] == 0 and r["doc_id"] in got]
    assert not junk or sum(not got[i]["kept"] for i in junk) >= 0.8 * len(junk)


def test_personal_data(spark, texts):
    got = by_id(spark, "op9_personal_data")
    for i, t in texts.items():
        want = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(t)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(got[i]["spans"].split(","))


def test_nearest_vectors(spark):
    got = QUERIES["op10_nearest_vectors"](spark, DATA).toPandas()
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    length = np.sqrt((x * x).sum(axis=1))
    hit = total = 0
    for q, g in got.groupby("query_id"):
        score = x @ rows[q] / (length * np.linalg.norm(rows[q]))
        want = [i for i in ids[np.lexsort((ids, -score))] if i != q][:5]
        hit, total = hit + len(set(want) & set(g.vec_id)), total + len(want)
        assert sorted(g["rank"]) == [1, 2, 3, 4, 5] and np.allclose(g.score, score[np.searchsorted(ids, g.vec_id)], rtol=0, atol=1e-14)
    assert set(got.query_id) == {i for i in ids.tolist() if i % 50 == 0} and hit >= 0.9 * total
