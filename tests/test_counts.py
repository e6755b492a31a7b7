"""Prefix index, links between tables, extreme residuals and column figures against plain forms."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chartflow.clinical import comorbidity
from chartflow.functions import scalars
from chartflow.operators import aggregates, prefix
from chartflow.quality import checks, report
from chartflow.quality.schema import ColumnRule, Schema
from chartflow.sources import io


def test_prefix_index_is_the_patterns(spark):
    r = random.Random(5)
    conditions = {f"c{i}": ["".join(r.choice("abc1") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 6))] for i in range(130)}
    codes = [(k % 20, None if k % 17 == 0 else "".join(r.choice("abc12") for _ in range(r.randint(0, 6)))) for k in range(400)] + [(99, None), (98, "zzz"), (None, "a")]
    df = spark.createDataFrame(codes, "k int, code string")
    got = {row["k"]: row.asDict() for row in prefix.flags(df, ["k"], F.col("code"), conditions).collect()}
    assert set(got) == {k for k, _ in codes}
    for k, row in got.items():
        mine = [c for i, c in codes if i == k and c is not None]
        assert {n: row[n] for n in conditions} == {n: int(any(c.startswith(p) for c in mine for p in ps)) for n, ps in conditions.items()}
    plan = prefix.flags(df, ["k"], F.col("code"), conditions)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan.upper()


#: Cases written out, by condition of each index; not read from the library's lists.
CASES = {
    "charlson": [("I21.4", "myocardial_infarction"), ("I50.2", "congestive_heart_failure"), ("N18.6", "renal_disease"), ("B20", "aids"), ("J44.1", "chronic_pulmonary_disease"), ("Z00.0", None)],
    "elixhauser": [
        ("I50.2", ["congestive_heart_failure"]), ("E11.9", ["diabetes_uncomplicated"]), ("E11.22", ["diabetes_complicated"]), ("C50.9", ["solid_tumor_without_metastasis"]), ("C78.0", ["metastatic_cancer"]), ("K70.3", ["alcohol_abuse", "liver_disease"]),
        ("N18.6", ["renal_failure"]), ("B20", ["aids_hiv"]), ("J44.1", ["chronic_pulmonary_disease"]), ("Z00.0", []),
    ],
}


def test_indices_flag_known_codes(spark):
    of = lambda name: spark.createDataFrame([(c, c, "ICD10CM") for c, _ in CASES[name]], "hospitalization_id string, diagnosis_code string, diagnosis_code_format string")
    other = {r["hospitalization_id"]: r.asDict() for r in comorbidity.elixhauser(of("elixhauser"), hierarchy=False).collect()}
    assert {c: sorted(n for n in comorbidity.ELIXHAUSER.conditions if other[c][n]) for c, _ in CASES["elixhauser"]} == dict(CASES["elixhauser"])
    got = {r["hospitalization_id"]: r.asDict() for r in comorbidity.charlson(of("charlson")).collect()}
    for code, condition in CASES["charlson"]:
        on = [n for n in comorbidity.CHARLSON.conditions if got[code][n]]
        assert on == ([condition] if condition else [])


def test_links(spark):
    one = lambda ids, name="id": spark.createDataFrame([(i,) for i in ids], f"{name} string")
    many = {f"t{i}": one([str(j) for j in range(i, 100)]) for i in range(70)}  # more tables than bits in a number
    tables = {**many, "a": one(["1", "1", None, "200"]), "b": one(["1", "2"]), "none": one([]), "other": one(["1"], "x")}
    links = [("a", "b", "id"), ("a", "none", "id"), ("none", "a", "id"), ("t69", "t0", "id"), ("t0", "t69", "id"), ("a", "other", "id"), ("a", "gone", "id"), *((f"t{i}", f"t{i + 1}", "id") for i in range(60))]
    got = {(r["child"], r["parent"]): (r["child_ids"], r["orphans"], r["parent_ids"], r["unused"]) for r in checks.links_between(tables, links).collect()}
    assert len(got) == 65 and got["a", "b"] == (2, 1, 2, 1) and got["a", "none"] == (2, 2, 0, 0) and got["none", "a"] == (0, 0, 2, 2)
    assert got["t0", "t69"] == (100, 69, 31, 0) and got["t69", "t0"] == (31, 0, 100, 69) and all(got[f"t{i}", f"t{i + 1}"] == (100 - i, 1, 99 - i, 0) for i in range(60))
    found = checks.relations(tables, [("a", "b", "id"), ("a", "other", "id")])
    assert [(f.code, f.table, f.severity, f.metrics["bad"], f.metrics["of"]) for f in found] == [("K.4", "a", "error", 1, 2), ("K.4", "b", "warning", 1, 2)]
    plan = checks.links_between(tables, links)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert checks.links_between(tables, []).count() == 0 and checks.relations({}, links) == []


def plain_extremes(pairs, k, least):
    o = Counter(pairs)
    r, c = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    cells = [(x, y, o[x, y], r[x] * c[y] / len(pairs)) for x in r for y in c if o[x, y] >= least]
    cells = [(x, y, n, e, (n - e) / math.sqrt(e)) for x, y, n, e in cells]
    return [("positive", i + 1, *v) for i, v in enumerate(sorted(cells, key=lambda v: (-v[4], v[0], v[1]))[:k])] + [("negative", i + 1, *v) for i, v in enumerate(sorted(cells, key=lambda v: (v[4], v[0], v[1]))[:k])]


@pytest.mark.parametrize(("k", "least"), [(5, 0), (40, 0), (7, 1), (1000, 0), (3, 99)])
def test_extreme_residuals(spark, k, least):
    r = random.Random(11)
    pairs = [(f"r{min(int(r.expovariate(0.3)), 25)}", f"c{min(int(r.expovariate(0.2)), 30)}") for _ in range(600)] + [("r0", f"c{j}") for j in range(31)]
    df = spark.createDataFrame([*pairs, (None, "c1"), ("r1", None)], "a string, b string")
    got = [tuple(row) for row in aggregates.extreme_residuals(df, "a", "b", k, least).orderBy(F.col("side").desc(), "place").collect()]
    want = plain_extremes(pairs, k, least)
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[6] - w[6]) < 1e-9 for g, w in zip(got, want, strict=True))
    everything = aggregates.contingency_residuals(df, "a", "b")
    assert everything.count() == len({a for a, _ in pairs}) * len({b for _, b in pairs})
    for plan in (df_._jdf.queryExecution().executedPlan().toString() for df_ in (everything, aggregates.extreme_residuals(df, "a", "b", k, least))):
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert aggregates.extreme_residuals(df.where("false"), "a", "b").count() == 0 == aggregates.contingency_residuals(df.where("false"), "a", "b").count()


def test_cells_of_residuals_are_never_broadcast(spark, monkeypatch):
    """However small their files are; levels are broadcast only if they were counted."""
    df = spark.createDataFrame([(f"r{i % 40}", f"c{i % 23}") for i in range(300)], "a string, b string")
    joins = lambda out: [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    for out in (aggregates.extreme_residuals(df, "a", "b", 5), aggregates.contingency_residuals(df, "a", "b")):
        anti = [line for line in joins(out) if "LeftAnti" in line]
        assert anti and all("SortMergeJoin" in line for line in anti)
    want = aggregates.extreme_residuals(df, "a", "b", 5).collect()
    monkeypatch.setattr(aggregates.shared, "SMALL", 10)
    out = aggregates.extreme_residuals(df, "a", "b", 5)
    assert all("SortMergeJoin" in line for line in joins(out) if "__row" in line) and out.collect() == want


def test_column_figures(spark):
    df = spark.createDataFrame([(1, "a", None, 0.5), (1, None, None, 1e20), (2, "a", None, float("nan"))], "i int, `odd.name` string, n string, x double")
    got = {r["column"]: (r["n_rows"], r["nulls"], r["distinct"]) for r in aggregates.column_figures(df).collect()}
    assert got == {"i": (3, 0, 2), "odd.name": (3, 1, 1), "n": (3, 3, 0), "x": (3, 0, 3)}
    assert "Expand" not in aggregates.column_figures(df)._jdf.queryExecution().executedPlan().toString()
    assert {f["column"]: (f["rows"], f["distinct"], f["min"]) for f in report.table_figures(df)}["i"] == (3, 2, "1")
    assert [f["rows"] for f in report.table_figures(df.where("false"))] == [0] * 4
    assert io.summary(df.withColumn("patient_id", F.lit("p")))["ids"] == {"patient_id": 1}


def test_numbers_as_reports_print_them(spark):
    values = [0.0, -0.0, 1.0, 0.1, 1e-5, 0.0001, 123456.789, 12345678.5, 1e7, 1e15, 123456789012345.6, 1e16, 1.5e300, -2.5e-7, 1e22, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(report.shortest(F.col("v"))).collect()]
    assert got == [repr(v) for v in values]


def test_table_statistics(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (None, None, "a"), (7, -1e17, None)], "i int, x double, t string")
    s = Schema("t", [ColumnRule("t"), ColumnRule("x", "DOUBLE"), ColumnRule("i", "INT"), ColumnRule("gone", "DOUBLE")])
    got = {r["column"]: tuple(r)[1:] for r in report.table_statistics(df, s).collect()}
    assert got == {"t": ("VARCHAR", 1, 33.3, 1, None, None), "x": ("DOUBLE", 1, 33.3, 2, "-1e+17", "2.5"), "i": ("INT", 1, 33.3, 2, "1", "7")}
    assert report.table_statistics(df.where("false"), s).count() == 0


def test_units_as_they_are_spelt(spark):
    """Spellings and what they become, written out."""
    cases = {"MG / hour": "mg/hr", "mcg/kg/min": "mcg/kg/min", "Units/hr": "u/hr", "milliliters": "ml", "grams/kg/h": "g/kg/hr", "puffs": "puffs", "milli-units / minute": "mu/min", "UG/KG/HR": "mcg/kg/hr", " ": None, "liters": "l"}
    df = spark.createDataFrame([(c,) for c in cases], "unit string").withColumn("clean", scalars.clean_unit_name(scalars.clean_unit_format(F.col("unit"))))
    assert {r["unit"]: r["clean"] for r in df.collect()} == cases
