"""Cases worked out by hand for the clinical layer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chartflow.clinical import comorbidity, crosswalk, resistance, sepsis, sofa, stitching, tables, waterfall
from chartflow.functions import scalars, text
from chartflow.operators import extremal, prefix, sequences, units
from chartflow.sources import config, io

T0 = dt.datetime(2024, 1, 10)


def at(hours: float = 0, days: float = 0) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours, days=days)


def one(df) -> dict:
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()


LADDERS = [
    ("platelet_count", "sofa_coag", [(19.9, 4), (20.0, 3), (49.9, 3), (50.0, 2), (100.0, 1), (149.9, 1), (150.0, 0), (None, None)]),
    ("bilirubin_total", "sofa_liver", [(12.0, 4), (11.9, 3), (6.0, 3), (5.9, 2), (2.0, 2), (1.9, 1), (1.2, 1), (1.1, 0)]),
    ("creatinine", "sofa_renal", [(5.0, 4), (4.9, 3), (3.5, 3), (3.4, 2), (2.0, 2), (1.9, 1), (1.2, 1), (1.1, 0)]),
    ("gcs_total", "sofa_cns", [(5.0, 4), (6.0, 3), (9.0, 3), (10.0, 2), (12.0, 2), (13.0, 1), (14.0, 1), (15.0, 0), (9.5, None)]),
    ("map", "sofa_cv_97", [(69.9, 1), (70.0, 0)]),
    ("norepinephrine_mcg_kg_min", "sofa_cv_97", [(0.11, 4), (0.1, 3), (0.0, 3)]),
    ("dopamine_mcg_kg_min", "sofa_cv_97", [(15.1, 4), (15.0, 3), (5.1, 3), (5.0, 2), (0.0, 2)]),
    ("dobutamine_mcg_kg_min", "sofa_cv_97", [(0.1, 2), (0.0, None)]),
]


@pytest.mark.parametrize("column,score,cases", LADDERS)
def test_score_ladders(spark, column, score, cases):
    wide = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], f"id int, {column} double")
    got = {r["id"]: r[score] for r in sofa.from_wide(wide, id_col="id", fill_missing=False).collect()}
    assert got == {i: s for i, (_, s) in enumerate(cases)}


def test_respiratory_needs_support_below_200(spark):
    rows = [(1, 90.0, 1.0, "IMV"), (2, 90.0, 1.0, "imv"), (3, 150.0, 1.0, "CPAP"), (4, 250.0, 1.0, None), (5, 350.0, 1.0, None), (6, 84.0, 0.21, None)]
    wide = spark.createDataFrame(rows, "id int, po2_arterial double, fio2_set double, device_category string")
    got = {r["id"]: r["sofa_resp"] for r in sofa.from_wide(wide, id_col="id", fill_missing=False).collect()}
    assert got == {1: 4, 2: None, 3: 3, 4: 2, 5: 1, 6: 0}


def test_score_total_outliers_and_cohort(spark):
    rows = [("h", at(0), 65.0, 900.0), ("h", at(5), 80.0, 100.0), ("h", at(30), 40.0, None)]
    wide = spark.createDataFrame(rows, "id string, event_time timestamp, map double, po2_arterial double")
    cohort = spark.createDataFrame([("h", at(1), at(5))], "id string, start_time timestamp, end_time timestamp")
    assert one(sofa.from_wide(wide, id_col="id"))["sofa_total"] == 1
    assert one(sofa.from_wide(wide, id_col="id", cohort=cohort))["sofa_total"] == 0
    assert one(sofa.from_wide(wide, id_col="id", fill_missing=False))["sofa_total"] is None


def test_imputed_pressure(spark):
    got = spark.createDataFrame([(90.0,), (97.0,), (100.0,), (None,)], "s double").select(scalars.pao2_from_spo2(F.col("s"))).collect()
    assert 55 < got[0][0] < 62 and [r[0] for r in got[1:]] == [None, None, None]


def test_score_from_tables(spark):
    ts = "timestamp"
    cohort = spark.createDataFrame([("h", at(0), at(24))], f"hospitalization_id string, start_time {ts}, end_time {ts}")
    labs = spark.createDataFrame([("h", at(1), "creatinine", 2.5), ("h", at(2), "po2_arterial", 90.0), ("h", at(10), "po2_arterial", 60.0), ("h", at(50), "creatinine", 9.0)], f"hospitalization_id string, lab_result_dttm {ts}, lab_category string, lab_value_numeric double")
    vitals = spark.createDataFrame([("h", at(1), "map", 60.0), ("h", at(0), "weight_kg", 50.0)], f"hospitalization_id string, recorded_dttm {ts}, vital_category string, vital_value double")
    gcs = spark.createDataFrame([("h", at(3), "gcs_total", 11.0)], f"hospitalization_id string, recorded_dttm {ts}, assessment_category string, numerical_value double")
    support = spark.createDataFrame([("h", at(1), "IMV", None, 0.5), ("h", at(2), None, None, None)], f"hospitalization_id string, recorded_dttm {ts}, device_category string, mode_category string, fio2_set double")
    doses = spark.createDataFrame([("h", at(2), "norepinephrine", 600.0, "mcg/hr")], f"hospitalization_id string, admin_dttm {ts}, med_category string, med_dose double, med_dose_unit string")
    got = one(sofa.from_tables(cohort, labs, vitals, gcs, support, doses))
    # 600 mcg/hr at 50 kg is 0.2 mcg/kg/min; 90 / 0.5 goes together, the pressure of hour 10 is over four hours from any setting
    assert (got["sofa_renal"], got["sofa_cv_97"], got["sofa_cns"], got["p_f"], got["sofa_resp"], got["sofa_total"]) == (2, 4, 2, 180.0, 3, 11)


def test_charlson(spark):
    rows = [("a", "I21.4", "ICD10CM"), ("a", "E11.9", "icd10cm"), ("a", "E11.2", "icd10cm"), ("b", "C80.1", "ICD10CM"), ("b", "C50", "ICD10CM"), ("c", "410", "ICD9CM"), ("d", None, "ICD10CM")]
    d = spark.createDataFrame(rows, "hospitalization_id string, diagnosis_code string, diagnosis_code_format string")
    got = {r["hospitalization_id"]: r for r in comorbidity.charlson(d).collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"]["myocardial_infarction"], got["a"]["diabetes_uncomplicated"], got["a"]["cci_score"]) == (1, 0, 1)
    assert (got["b"]["cancer"], got["b"]["cci_score"], got["d"]["cci_score"]) == (0, 6, 0)
    free = {r["hospitalization_id"]: r["cci_score"] for r in comorbidity.charlson(d, hierarchy=False).collect()}
    assert free["b"] == 8
    assert sum(map(len, comorbidity.CHARLSON.conditions.values())) == 289 and len(comorbidity.ELIXHAUSER.conditions) == 31


def test_index_from_yaml(spark, tmp_path):
    (tmp_path / "x.yaml").write_text("diagnosis_code_mappings: {ICD10CM: {a: {codes: [A1]}, b: {codes: [B]}}}\nweights: {a: -2, b: 5}\nhierarchies: {x: [b, a]}\n")
    d = spark.createDataFrame([("h", "A10", "ICD10CM")], "hospitalization_id string, diagnosis_code string, diagnosis_code_format string")
    assert one(comorbidity.elixhauser(d, comorbidity.Index.from_yaml(str(tmp_path / "x.yaml"))))["elix_score"] == -2


def test_resistance(spark):
    o = resistance.ORGANISMS["pseudomonas_aeruginosa"]
    c = spark.createDataFrame([("h", "o1", "pseudomonas_aeruginosa"), ("h", "o2", "pseudomonas_aeruginosa"), ("h", "o3", "escherichia_coli")], "hospitalization_id string, organism_id string, organism_category string")
    tests = [("o1", a, "non_susceptible") for a in o.agents] + [("o2", "gentamicin", "susceptible"), ("o2", "gentamicin", "intermediate"), ("o2", "meropenem", "non_susceptible"), ("o2", "aztreonam", "susceptible"), ("o2", "colistin", "non_susceptible")]
    s = spark.createDataFrame(tests, "organism_id string, antimicrobial_category string, susceptibility_category string")
    got = {r["organism_id"]: r for r in resistance.flags(c, s, "pseudomonas_aeruginosa").collect()}
    assert [got["o1"][k] for k in ("MDR", "XDR", "PDR", "DTR")] == [1, 1, 1, 1]
    assert [got["o2"][k] for k in ("gentamicin", "tobramycin", "n_resistant_groups", "MDR", "XDR", "PDR", "DTR")] == ["intermediate", "not_tested", 3, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        resistance.flags(c, s, "nothing")


def test_stitching(spark):
    rows = [("p", "a", at(0), at(10)), ("p", "b", at(16), at(20)), ("p", "c", at(26.1), at(30)), ("q", "d", at(0), at(50)), ("q", "e", at(40), at(45))]
    h = spark.createDataFrame(rows, "patient_id string, hospitalization_id string, admission_dttm timestamp, discharge_dttm timestamp")
    _, _, exact = stitching.stitch(h, h.select("hospitalization_id"), 6, exact_ids=True)
    assert {r[0]: r[1] for r in exact.collect()} == {"a": 2, "b": 2, "c": 3, "d": 5, "e": 5}
    _, _, named = stitching.stitch(h, h.select("hospitalization_id"), 6, exact_ids=False)
    assert {r[0]: r[1] for r in named.collect()} == {"a": "b", "b": "b", "c": "c", "d": "e", "e": "e"}


def test_worst_results_are_met_without_sorting_tests(spark):
    """Every order of results, null and unknown categories, agents that only required names, organisms of two stays; the plan has no window and no lists."""
    o = resistance.Organism({"g": ["a", "b"], "h": ["c"]}, ["a", "z"], resistant=("non_susceptible", "odd"), min_groups=1, max_susceptible=0)
    kinds = ["non_susceptible", "intermediate", "susceptible", "NA", None, "odd", "new"]
    tests = [(i, x, k) for i in range(40) for j, x in enumerate(["a", "b", "c", "z", "y", None]) for m, k in enumerate(kinds) if (k == "odd" if i == 39 else (i * 7 + j * 3 + m * m) % 11 < 2)]
    pairs = [(f"h{i % 5}", i) for i in range(41)] + [("h9", 3), ("h9", 3), ("h9", None), (None, 4)]
    cultures = spark.createDataFrame([(*p, "x") for p in pairs], "hospitalization_id string, organism_id int, organism_category string")
    out = resistance.flags(cultures, spark.createDataFrame([*tests, (None, "a", "odd")], "organism_id int, antimicrobial_category string, susceptibility_category string"), "x", organisms={"x": o})
    rank = lambda k: (4 if k is None else kinds.index(k) if k in kinds[:4] else 5, k or "")
    want = set()
    for h, i in set(pairs):
        worst = {x: min((k for n, y, k in tests if n == i and y == x), key=rank, default="not_tested") for x in "abcz"}
        bad = {x for x, k in worst.items() if k in o.resistant}
        g, c = int(bool(bad & {"a", "b"})), int("c" in bad)
        want.add((h, i, *(worst[x] or "not_tested" for x in "abc"), g, c, g + c, int(g + c >= 1), int(g + c >= 2), int(bad >= {"a", "b", "c"}), int(bad >= {"a", "z"})))
    rows = [tuple(r) for r in out.collect()]
    assert out.columns == ["hospitalization_id", "organism_id", "a", "b", "c", "g", "h", "n_resistant_groups", "MDR", "XDR", "PDR", "DTR"]
    assert len(rows) == len(want) and set(rows) == want and {r[-2:] for r in rows} >= {(0, 0), (1, 1)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_set" not in plan


def test_waterfall_sorts_scaffold_rows_twice(spark):
    """Windows of runs share the order of the key, and rows are not compared in the end; fills in runs are those of windows by run."""
    rows = [(k, f"2024-01-01 {h:02}:00:00", d) for k in ("x", "y", None) for h, d in ((0, "IMV"), (0, "IMV"), (5, None), (9, "NIPPV"))]
    support = spark.createDataFrame(rows, "hospitalization_id string, t string, device_category string").withColumn("recorded_dttm", F.to_timestamp("t")).drop("t")
    out = waterfall.waterfall(support)
    above = out._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert above.count("Sort [") <= 2 and "Aggregate" not in above
    assert out.count() == out.distinct().count() == out.select("hospitalization_id", "recorded_dttm", "is_scaffold").distinct().count() == 3 * (2 + 10)
    runs = spark.createDataFrame([(k, i, 1 + i // 3, None if i % 4 else i) for k in (1, None) for i in range(14)], "k int, t int, run long, v int")
    want = sequences.fill_forward(runs, ["k", "run"], ["t"], ["v"])
    got = sequences.fill_in_runs(runs, ["k"], ["t"], "run", ["v"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.where("v IS NULL").count() > 0


def test_waterfall(spark):
    kind = "hospitalization_id string, recorded_dttm timestamp, device_category string, device_name string, mode_category string, mode_name string, fio2_set double, peep_set double, tidal_volume_set double, resp_rate_set double"
    rows = [
        ("h", at(0.1), "IMV", "Vent", "SIMV", "simv", 50.0, 8.0, 400.0, 14.0),
        ("h", at(1.1), None, None, None, None, None, 8.0, 400.0, 14.0),
        ("h", at(3.1), "Room Air", None, None, None, None, None, None, None),
        ("h", at(4.1), "NIPPV", None, None, None, 40.0, None, None, None),
        ("h", at(4.1), "IMV", None, None, None, 60.0, None, None, None),
        ("k", at(0.0), "Trach Collar", None, None, None, 30.0, None, None, None),
    ]
    out = waterfall.waterfall(spark.createDataFrame(rows, kind))
    got = {(r["hospitalization_id"], r["recorded_dttm"]): r for r in out.collect()}
    assert len(got) == out.count()
    assert (got["h", at(1.1)]["device_category"], got["h", at(1.1)]["fio2_set"]) == ("imv", 0.5)
    assert got["h", dt.datetime(2024, 1, 10, 2, 59, 59)]["peep_set"] == 8.0
    assert got["h", at(3.1)]["fio2_set"] == 0.21
    assert (got["h", at(4.1)]["device_category"], got["h", at(4.1)]["fio2_set"]) == ("imv", 0.6)
    assert got["k", at(0.0)]["fio2_set"] is None
    assert waterfall.waterfall(spark.createDataFrame(rows, kind), strict=False).where("hospitalization_id = 'k' AND NOT is_scaffold").first()["fio2_set"] == 0.3


def site(spark, **given):
    ts = "timestamp"
    kinds = {
        "hospitalization": f"hospitalization_id string, patient_id string, admission_dttm {ts}, discharge_dttm {ts}, discharge_category string",
        "patient": f"patient_id string, death_dttm {ts}",
        "microbiology_culture": f"hospitalization_id string, fluid_category string, collect_dttm {ts}",
        "medication_admin_intermittent": f"hospitalization_id string, admin_dttm {ts}, med_category string, med_route_category string",
        "medication_admin_continuous": f"hospitalization_id string, admin_dttm {ts}, med_category string, med_group string, med_dose double",
        "labs": f"hospitalization_id string, lab_category string, lab_value_numeric double, lab_value string, lab_result_dttm {ts}, lab_order_dttm {ts}",
        "respiratory_support": f"hospitalization_id string, recorded_dttm {ts}, device_category string",
        "adt": f"hospitalization_id string, in_dttm {ts}, out_dttm {ts}, location_category string",
        "hospital_diagnosis": "hospitalization_id string, diagnosis_code string",
    }
    return {k: spark.createDataFrame(given.get(k, []), v) for k, v in kinds.items()}


def test_sepsis(spark):
    days = lambda h, *ds: [(h, at(days=d, hours=9), "cefepime", "iv") for d in ds]
    t = site(
        spark,
        hospitalization=[("full", "p1", at(-5), at(days=20), "home"), ("short", "p2", at(-5), at(days=20), "home"), ("dead", "p3", at(-5), at(days=2, hours=20), "expired"), ("none", "p4", at(-5), at(days=9), "home"), ("renal", "p5", at(-5), at(days=20), "home")],
        patient=[(p, None) for p in ("p1", "p2", "p3", "p4", "p5")],
        microbiology_culture=[(h, "blood_buffy", at(hours=6)) for h in ("full", "short", "dead", "renal")] + [("none", "urine", at(6))],
        medication_admin_intermittent=days("full", 0, 1, 3, 4) + days("short", 0, 1) + days("dead", 0, 1, 2) + days("renal", 0, 1, 2, 3),
        medication_admin_continuous=[("dead", at(8), "norepinephrine", "vasoactives", 5.0), ("full", at(8), "epinephrine", "vasoactives", 5.0), ("none", at(3), "epinephrine", "vasoactives", 1.0)],
        adt=[("full", at(7), at(9), "procedural")],
        labs=[("full", "creatinine", 1.0, None, at(1), None), ("full", "creatinine", None, "2.0", at(30), None), ("full", "lactate", 4.0, None, at(20), None), ("renal", "creatinine", 1.0, None, at(1), None), ("renal", "creatinine", 3.0, None, at(30), None)],
        hospital_diagnosis=[("renal", "N18.6")],
    )
    got = {r["hospitalization_id"]: r for r in sepsis.events(t).collect()}
    f = got["full"]
    assert (f["presumed_infection"], f["sepsis"], f["sepsis_wo_lactate"], f["total_qad"], f["aki_dttm"], f["vasopressor_dttm"], f["final_qad_status"]) == (1, 1, 1, 5, at(30), None, "Meets QAD (standard)")
    assert (f["ase_onset_w_lactate_dttm"], f["ase_first_criteria_w_lactate"], f["type"], f["episode_id"]) == (at(0), "first_qad", "community", 1)
    assert (got["short"]["presumed_infection"], got["short"]["no_sepsis_reason"]) == (0, "no_presumed_infection")
    assert (got["dead"]["final_qad_status"], got["dead"]["sepsis"], got["dead"]["vasopressor_name"]) == ("Meets QAD (censoring exception)", 1, "norepinephrine")
    assert (got["renal"]["presumed_infection"], got["renal"]["sepsis"], got["renal"]["has_esrd"]) == (1, 0, 1)
    assert (got["none"]["no_sepsis_reason"], got["none"]["vasopressor_dttm"], got["none"]["bc_id"]) == ("no_blood_culture", at(3), None)


def test_dose_units(spark):
    rows = [("h", at(1), "a", 60.0, "MG / hour"), ("h", at(2), "b", 2.0, "mcg/kg/min"), ("k", at(1), "b", 2.0, "mcg/kg/min"), ("h", at(3), "c", 5.0, "puffs"), ("h", at(3), "d", 1.0, "units"), ("h", at(3), "e", 1.0, None)]
    d = spark.createDataFrame(rows, "hospitalization_id string, admin_dttm timestamp, med_category string, med_dose double, med_dose_unit string")
    v = spark.createDataFrame([("h", at(0), "weight_kg", 50.0), ("h", at(5), "weight_kg", 99.0)], "hospitalization_id string, recorded_dttm timestamp, vital_category string, vital_value double")
    out, counts = units.convert_doses(d, v, {"a": "mcg/min", "b": "mg/hr", "d": "mg"}, strict=False)
    got = {(r["hospitalization_id"], r["med_category"]): r for r in out.collect()}
    assert got["h", "a"]["med_dose_converted"] == pytest.approx(1000.0) and got["h", "a"]["med_dose_unit_converted"] == "mcg/min"
    assert abs(got["h", "b"]["med_dose_converted"] - 6.0) < 1e-12
    # without a weight the dose stays by kilogram, and is converted as if it were not
    assert abs(got["k", "b"]["med_dose_converted"] - 0.12) < 1e-12
    assert got["h", "c"]["_convert_status"] == "original unit puffs is not recognized"
    assert got["h", "d"]["_convert_status"] == "cannot convert unit to mass"
    assert got["h", "e"]["_convert_status"] == "original unit is missing"
    assert counts.agg(F.sum("count")).first()[0] == 6
    with pytest.raises(ValueError):
        units.convert_doses(d, v, {"a": "drops"})
    with pytest.raises(ValueError):
        units.convert_doses(d, v, {"zzz": "mg"})


def test_crosswalk_and_migration(spark, tmp_path):
    df = spark.createDataFrame([("1", "ICU / Step Down", "old"), ("2", "Ward-A", "keep"), ("3", None, None)], "hospitalization_id string, location_category string, location_type string")
    v = crosswalk.Vocabulary({"location_type": {"old": "new"}}, {"location_type": {"keep"}})
    assert [tuple(r)[1:] for r in crosswalk.crosswalk(df, v).orderBy("hospitalization_id").collect()] == [("icu_or_step_down", "new"), ("ward_a", "keep"), (None, None)]
    assert {(r["old"], r["how"]) for r in crosswalk.report(df, v).collect()} == {("ICU / Step Down", "normalised"), ("Ward-A", "normalised"), ("old", "renamed"), ("keep", "unresolved")}
    io.save(df, io.table_path(str(tmp_path / "in"), "adt"))
    records = crosswalk.migrate(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["adt", "labs"], v)
    assert [r["status"] for r in records] == ["done", "missing"]
    assert [r["status"] for r in crosswalk.migrate(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["adt"], v)] == ["exists"]


def test_migration_is_audited_before_it_is_published(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("1", "ICU", at()), ("2", None, None)], "hospitalization_id string, location_category string, in_dttm timestamp")
    io.save(df.withColumn("plain", F.col("in_dttm").cast("timestamp_ntz")), io.table_path(source, "adt"))
    assert io.footers(spark, io.table_path(source, "adt"))["zones"] == {"in_dttm": "UTC", "plain": None}
    v, true = crosswalk.Vocabulary({}, {}), crosswalk.crosswalk
    faults = {
        "zones": lambda d, v: true(d, v).withColumn("in_dttm", F.col("in_dttm").cast("timestamp_ntz")), "rows, ids": lambda d, v: true(d, v).where("hospitalization_id = '1'"), "types": lambda d, v: true(d, v).withColumn("hospitalization_id", F.col("hospitalization_id").cast("int")),
    }
    for message, fault in faults.items():
        monkeypatch.setattr(crosswalk, "crosswalk", fault)
        (r,) = crosswalk.migrate(spark, source, target, ["adt"], v)
        assert (r["status"], r["message"]) == ("failed", message) and not io.exists(spark, io.table_path(target, "adt"))
    monkeypatch.setattr(crosswalk, "crosswalk", true)
    (r,) = crosswalk.migrate(spark, source, target, ["adt"], v)
    assert r["status"] == "done" and r["zones"] == "match" and io.raw(spark, io.table_path(target, "adt")).count() == 2
    log = crosswalk.run_log(spark, target).collect()
    assert sorted(x["status"] for x in log) == ["done", "failed", "failed", "failed"] and len({x["run"] for x in log}) == 4
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]


def test_zone_status():
    assert crosswalk.zone_status({"a": "UTC"}, {"a": "UTC"}) == ("match", False) and crosswalk.zone_status({"a": "US/Eastern", "b": None}, {"a": "UTC", "b": None}) == ("relabel->UTC (instants preserved)", False)
    assert crosswalk.zone_status({"a": None}, {"a": "UTC"}) == ("CHANGED {a: naive->UTC}", True) and crosswalk.zone_status({"a": "UTC"}, {"a": None})[1] and crosswalk.zone_status({"a": "UTC"}, {})[1]


def test_tables(spark):
    demo = io.demo(spark, 10)
    assert one(tables.stay_summary(demo["hospitalization"]))["mean_days"] == 4.0
    assert one(tables.mortality_pct(demo["hospitalization"]))["mortality_pct"] == 20.0
    adt = spark.createDataFrame([("h", at(0), at(5), "icu"), ("h", at(4), at(9), "ward"), ("k", at(0), at(5), "icu"), ("k", at(4), at(9), "icu")], "hospitalization_id string, in_dttm timestamp, out_dttm timestamp, location_category string")
    assert [r[0] for r in tables.overlapping_admissions(adt).collect()] == ["h"]
    c = spark.createDataFrame([(1, at(1), at(0), at(2)), (2, at(0.01), at(0), at(2)), (3, at(0), at(3), at(2))], "id int, order_dttm timestamp, collect_dttm timestamp, result_dttm timestamp")
    assert sorted(r["id"] for r in tables.culture_times_out_of_order(c).collect()) == [1, 3]
    labs = spark.createDataFrame([(1, "x", "MG / dL"), (2, "x", "g/l"), (3, "y", "mg/dl"), (4, "x", None), (5, "w", "K/uL (calc)"), (6, "w", "10*3/μL"), (7, "w", "x10E3/uL")], "id int, lab_category string, reference_unit string")
    got = tables.standard_units(labs, {"x": ["mg/dL"], "w": ["10^3/uL", "10*3/μL"]}).orderBy("id").collect()
    assert [r["reference_unit"] for r in got] == ["mg/dL", "g/l", "mg/dl", None, "10^3/uL", "10*3/μL", "10^3/uL"]


def test_extremes_that_share_a_row(spark):
    e = spark.createDataFrame([("h", at(1), "map", 60.0), ("h", at(2), "map", 80.0), ("k", at(1), "map", 90.0), ("k", at(2), "map", 70.0)], "id string, t timestamp, c string, v double")
    w = spark.createDataFrame([("h", at(0), at(5)), ("k", at(0), at(5)), ("h", at(8), at(9))], "id string, start_time timestamp, end_time timestamp")
    got = {r["id"]: r for r in extremal.extremal_lookup(e, w, ["id"], "t", "c", "v", {"map": ["min"]}, extras=True).collect()}
    assert (got["h"]["map_min"], got["h"]["map_max"], got["h"]["map_latest"]) == (60.0, None, None)
    assert (got["k"]["map_min"], got["k"]["map_max"], got["k"]["map_latest"]) == (70.0, None, 70.0)
    assert extremal.extremal_lookup(e, w, ["id"], "t", "c", "v", {"map": ["min"]}).columns == ["id", "start_time", "end_time", "map_min"]
    with pytest.raises(ValueError):
        extremal.extremal_lookup(e, w, ["id"], "t", "c", "v", {"map": ["mean"]})


def test_sources_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "patient_id double, sex string")
    path = io.table_path(str(tmp_path), "patient")
    io.save(df, path)
    with pytest.raises(Exception):
        io.save(df, path)
    got = io.read(spark, path, columns=["patient_id"], filters={"sex": ["b"]})
    assert [r[0] for r in got.collect()] == ["2"]
    assert "In(sex, [a,b])" in io.read(spark, path, filters={"sex": ["a", "b"]})._jdf.queryExecution().executedPlan().toString()
    io.save(df, io.table_path(str(tmp_path), "patient", prefix="site_"))
    assert io.read_table(spark, str(tmp_path), "patient", prefix="site_").count() == 2
    assert io.read_table(spark, str(tmp_path), "labs") is None and io.size(spark, path) > 0
    assert config.resolve(data_directory="x", filetype="csv", timezone="UTC")["filetype"] == "csv"
    config.example_config(str(tmp_path / "c.json"))
    assert config.resolve(str(tmp_path / "c.json"), filetype="csv")["filetype"] == "csv"
    assert text.csv_field('a"b,c') == '"a""b,c"' and text.plain_number(3.0) == "3" and "polyline" in text.sparkline([1, 2])
