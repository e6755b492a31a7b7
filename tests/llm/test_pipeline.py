"""The pipeline, stage by stage, on the smallest tables."""

import os
import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from chartflow.llm import mixing, packing

from .test_operators import plain_components, plain_ids, plain_print, plain_spans, plain_targets

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    place = tmp_path_factory.mktemp("stages")
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, DATA).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        out.append(docs.toPandas())
    return out


def test_stages(spark, stages):
    first = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().set_index("doc_id")
    rules, unique, clean, mixed, packed = stages
    assert all(list(s.columns) == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:4])

    good = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    kept = set(rules.doc_id)
    long_enough = {i for i, t in first.text.items() if len(WORD.findall(t)) >= 20}
    clean_ids = set(good[good.quality == 1].doc_id) & long_enough
    junk = set(good[good.quality == 0].doc_id)
    assert len(clean_ids & kept) >= 0.97 * len(clean_ids) and len(junk & kept) <= 0.1 * len(junk)
    assert (rules.set_index("doc_id").text == first.text[rules.doc_id]).all()

    want = plain_components({i: plain_print(t) for i, t in zip(rules.doc_id, rules.text, strict=True)})
    assert set(unique.doc_id) == {i for i, c in want.items() if i == c}

    assert set(clean.doc_id) == set(unique.doc_id) and (clean.n_chars == clean.text.str.len()).all()
    for i, t in zip(clean.doc_id, clean.text, strict=True):
        assert not plain_spans(t)
        if not plain_spans(first.text[i]):
            assert t == first.text[i]

    size = {i: len(WORD.findall(t)) for i, t in zip(clean.doc_id, clean.text, strict=True)}
    taken, got = Counter(), Counter()
    for i, t, s in zip(mixed.doc_id, mixed.text, mixed.source, strict=True):
        taken[i] += len(WORD.findall(t))
        got[s] += len(WORD.findall(t))
    assert all(n <= 3 * size[i] for i, n in taken.items())
    sizes = Counter()
    for i, s in zip(clean.doc_id, clean.source, strict=True):
        sizes[s] += size[i]
    for s, goal in plain_targets(sizes).items():
        assert abs(got[s] - goal) <= max(3 * mixing.BLOCK_WORDS, 0.03 * goal)

    assert packed.length.sum() == sum(len(plain_ids(t)) + 1 for t in mixed.text)
    totals = packed.groupby("sequence_id").length.sum()
    padding = sum(packing.SIZE - n for n in totals if n & (n - 1))
    assert totals.max() <= packing.SIZE and padding <= 0.02 * totals.sum()


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() == len(stages[-1])
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
