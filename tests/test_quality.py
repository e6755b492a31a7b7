"""The data-quality engine on a small table with known faults."""

import datetime as dt

import pytest

from chartflow.quality import checks, report
from chartflow.quality.schema import ColumnRule, Schema

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def faulty(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [
        ("1", "icu", "Critical", h(0), h(5), 10.0, None), ("1", "ICU ", "critical", h(0), h(5), 500.0, "x"),
        ("2", "ward", "critical", h(6), h(5), 50.0, None), ("3", "moon", None, h(8), None, None, None),
    ]
    return spark.createDataFrame(rows, "hospitalization_id string, location_category string, location_group string, in_dttm timestamp, out_dttm timestamp, score double, note string")


@pytest.fixture()
def schema():
    c = ColumnRule
    return Schema(
        "adt", [c("hospitalization_id", required=True), c("location_category", category=True, values=["icu", "ward", "ed"]), c("in_dttm", "DATETIME", True), c("out_dttm", "DATETIME"), c("score", "INT"), c("note"), c("gone", required=True)],
        keys=["hospitalization_id", "location_category"], groups={("location_category", "location_group"): {"icu": "critical", "ward": "general"}},
        ranges=[("score", ["location_category"], [("icu", 0, 100)])], order=[("in_dttm", "out_dttm", False)], conditions=[("note for icu", "location_category = 'icu'", "note")],
        plausible=[("score known", "location_category = 'moon'", "score IS NOT NULL")], periods=(["hospitalization_id"], "in_dttm", "out_dttm"), time_column="in_dttm", entity="hospitalization_id",
    )


def test_findings(faulty, schema):
    out = checks.full(faulty, schema)
    every = [f for fs in out.values() for f in fs]
    by = {(f.code, f.column): f for f in every}
    assert by["C.2", "gone"].severity == "error"
    assert by["C.3", "score"].severity == "pass"  # whole numbers
    assert by["C.5", "location_category"].metrics["top"] == [("moon", 1)]
    assert by["K.3", "location_category"].metrics["unseen"] == ["ed"]
    assert [f.message for f in every if f.code == "C.6" and f.severity == "warning"] == ["ward: critical"]
    assert (by["K.1", "out_dttm"].severity, by["K.1", "hospitalization_id"].severity) == ("warning", "pass")
    assert by["K.2", "note"].metrics["bad"] == 1
    assert by["P.1", "in_dttm - out_dttm"].metrics["bad"] == 1
    assert by["P.2", "score, icu"].metrics["above"] == 1
    assert by["P.7", "hospitalization_id, location_category"].metrics["bad"] == 1
    assert by["P.5", "in_dttm - out_dttm"].metrics["bad"] == 1
    assert checks.status(every) == "incomplete" and 0 < checks.score(every) < 100
    text, csv, html, js = report.as_text("adt", out), report.as_csv({"adt": out}), report.as_html({"adt": out}), report.as_json(out)
    assert "C.2" in text and csv.count("\r\n") == len(every) - sum(f.severity == "info" for f in every) + 1 + len({f.column for f in every if f.severity == "info"})
    assert "<table>" in html and '"P.7"' in js
    assert {r["column"]: r["nulls"] for r in report.table_figures(faulty)}["note"] == 3


def test_thresholds_can_be_set(faulty, schema):
    strict = checks.Thresholds(missing=(1.0, 20.0))
    by = {(f.code, f.column): f.severity for f in checks.one_pass(faulty, schema, strict)}
    assert by["K.1", "out_dttm"] == "error" and by["K.1", "hospitalization_id"] == "pass"


def test_across_tables(spark, faulty):
    stays = spark.createDataFrame([("1", T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=9), "Expired", "p"), ("9", T0, T0, "Home", "q")], "hospitalization_id string, admission_dttm timestamp, discharge_dttm timestamp, discharge_category string, patient_id string")
    patient = spark.createDataFrame([("p", None)], "patient_id string, death_dttm timestamp")
    t = {"adt": faulty, "hospitalization": stays, "patient": patient}
    k4 = checks.relations(t, [("adt", "hospitalization", "hospitalization_id")])
    assert [(f.metrics["bad"], f.severity) for f in k4] == [(2, "error"), (1, "warning")]
    assert checks.across(t, [("hospitalization", "discharge_category = 'Expired'", "patient", "patient_id", "death_dttm")])[0].metrics["bad"] == 1
    p8 = checks.stay_times(t, {"adt": ["in_dttm"]})[0]
    assert (p8.metrics["bad"], p8.metrics["before"]) == (2, 2)


def test_empty_table(spark, schema):
    out = checks.full(spark.createDataFrame([], "a int"), schema)
    assert out["conformance"][0].severity == "error" and checks.status(out["conformance"]) == "incomplete"
