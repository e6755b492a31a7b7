"""Surveillance of adult sepsis: infection, organ dysfunction, onset, repeats (C11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import aggregates, intervals, sequences

WINDOW_DAYS, RUN_DAYS, REPEAT_DAYS = 2, 4, 14
# Largest plausible results, codes of end-stage renal disease, routes, ends of stay that excuse a short run.
HIGHEST = {"creatinine": 20.0, "bilirubin_total": 80.0, "platelet_count": 2000.0, "lactate": 30.0}
RENAL_CODES = ["n186", "z4931", "z4901", "i120", "i1311", "i132", "i272"]
PARENTERAL = ["iv", "im", "intravenous", "intramuscular"]
EXCUSED = ["expired", "Expired", "acute_care_hospital", "Acute Care Hospital", "hospice", "Hospice"]
H = "hospitalization_id"
CAUSES = {"blood_culture_dttm": "blood_culture", "first_qad_dttm": "first_qad", "vasopressor_dttm": "vasopressor", "imv_dttm": "imv", "aki_dttm": "aki", "hyperbilirubinemia_dttm": "hyperbilirubinemia", "thrombocytopenia_dttm": "thrombocytopenia", "lactate_dttm": "lactate"}
COLUMNS = [H, "bc_id", "episode_id", "type", "presumed_infection", "sepsis", "sepsis_wo_lactate", "no_sepsis_reason", "blood_culture_dttm", "total_qad", "qad_start_date", "qad_end_date", "first_qad_dttm", "presumed_infection_onset_dttm", "ase_onset_w_lactate_dttm", "ase_first_criteria_w_lactate", "ase_onset_wo_lactate_dttm", "ase_first_criteria_wo_lactate", "vasopressor_dttm", "vasopressor_name", "imv_dttm", "aki_dttm", "hyperbilirubinemia_dttm", "thrombocytopenia_dttm", "lactate_dttm", "has_esrd", "anchor_meds_in_window", "anchor_parenteral_meds_in_window", "run_meds", "final_qad_status"]


def blood_cultures(cultures: DataFrame) -> DataFrame:
    """hospitalization_id, bc_id, culture_time and culture_day, one row for each time of collection."""
    rows = cultures.where(F.lower("fluid_category") == "blood_buffy").where(F.col("collect_dttm").isNotNull())
    rows = rows.select(H, F.col("collect_dttm").alias("culture_time")).distinct()
    return rows.withColumn("bc_id", F.row_number().over(sequences.ordered([H], ["culture_time"]))).withColumn("culture_day", F.to_date("culture_time"))


def antibiotic_runs(cultures: DataFrame, doses: DataFrame, stays: DataFrame) -> DataFrame:
    """The run of qualifying days for each culture with a new antibiotic near it.

    Days are kept whose midnight lies inside the stay.  A drug begins anew after
    a gap of over two days; vancomycin by mouth is a drug of its own.
    """
    given = doses.where(F.lower("med_group") == "cms_sepsis_qualifying_antibiotics") if "med_group" in doses.columns else doses
    iv = F.coalesce(F.lower("med_route_category").isin(PARENTERAL), F.lit(False)).cast("int")
    drug = F.when(F.lower("med_category") == "vancomycin", F.when(iv == 1, "vancomycin_iv").otherwise("vancomycin_oral")).otherwise(F.col("med_category"))
    days = given.select(H, F.to_date("admin_dttm").alias("day"), drug.alias("drug"), iv.alias("iv")).where("day IS NOT NULL")
    days = days.join(stays.select(H, "admission_dttm", "discharge_dttm"), H).where("CAST(day AS timestamp) BETWEEN admission_dttm AND discharge_dttm")
    days = days.groupBy(H, "drug", "day").agg(F.max("iv").alias("iv"))
    courses = sequences.day_courses(days, [H, "drug"], "day", 2).groupBy(H, "drug", "course").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.min_by("iv", "day").alias("first_iv"))
    near = cultures.join(courses, H).withColumn("new", F.abs(F.datediff("first", "culture_day")) <= WINDOW_DAYS)
    c = [H, "bc_id"]
    start = F.min(F.when(F.col("new"), F.col("first"))).over(Window.partitionBy(*c))
    near = near.withColumn("qad_start_day", start).where("qad_start_day IS NOT NULL")
    named = lambda cond: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("drug")))), ", "), F.lit(""))
    later = F.col("first") >= F.col("qad_start_day")
    facts = near.groupBy(*c, "culture_time", "culture_day", "qad_start_day").agg(F.max((F.col("new") & (F.col("first_iv") == 1)).cast("int")).alias("has_new_parenteral"), named(F.col("new")).alias("anchor_meds_in_window"), named(F.col("new") & (F.col("first_iv") == 1)).alias("anchor_parenteral_meds_in_window"), named(later).alias("run_meds"))
    covered = intervals.expand_days(near.where(later), "first", "last", "covered").where("datediff(covered, qad_start_day) BETWEEN 0 AND 6").select(*c, "qad_start_day", "covered").distinct()
    w = sequences.ordered(c, ["covered"])
    run = covered.withColumn("_off", F.datediff("covered", "qad_start_day") - F.row_number().over(w) + 1).where("_off = 0").groupBy(*c).agg(F.count("*").alias("qad_days"), F.min("covered").alias("qad_run_start"), F.max("covered").alias("qad_run_end"))
    return facts.join(run, c)


def infections(runs: DataFrame, stays: DataFrame, patients: DataFrame) -> DataFrame:
    """Whether each run is long enough, or excused by death or transfer within its first days."""
    df = runs.join(stays.select(H, "patient_id", "discharge_dttm", "discharge_category"), H).join(patients.select("patient_id", "death_dttm"), "patient_id", "left")
    censor = F.to_date(F.coalesce("discharge_dttm", "death_dttm"))
    full = (F.col("has_new_parenteral") == 1) & (F.col("qad_days") >= RUN_DAYS)
    excused = (F.col("qad_days") >= 1) & (F.col("has_new_parenteral") == 1) & F.col("discharge_category").isin(EXCUSED) & (F.datediff(censor, "qad_start_day") <= 3) & (F.datediff("qad_run_end", censor) >= -1)
    excused = F.coalesce(excused, F.lit(False))
    status = F.when(full, "Meets QAD (standard)").when(excused, "Meets QAD (censoring exception)").when(F.col("has_new_parenteral") == 0, "Fails QAD: no new IV/IM in window").otherwise("Fails QAD: insufficient QAD days")
    return df.withColumn("presumed_infection", (full | excused).cast("int")).withColumn("final_qad_status", status).drop("patient_id", "discharge_dttm", "discharge_category", "death_dttm", "culture_time", "culture_day")


def laboratory(cultures: DataFrame, labs: DataFrame, renal: DataFrame) -> DataFrame:
    """First times of kidney, liver, platelet and lactate dysfunction near each culture, by both baselines."""
    value = F.coalesce(F.col("lab_value_numeric").cast("double"), scalars.number(F.col("lab_value")))
    highest = F.element_at(F.create_map(*(x for k, v in HIGHEST.items() for x in (F.lit(k), F.lit(v)))), F.col("lab_category"))
    rows = labs.where(F.col("lab_category").isin(list(HIGHEST))).select(H, "lab_category", value.alias("value"), F.coalesce("lab_result_dttm", "lab_order_dttm").alias("at"), highest.alias("most"))
    rows = rows.where("value IS NOT NULL AND at IS NOT NULL AND value <= most").join(cultures.select(H).distinct(), H, "left_semi")
    c = [H, "bc_id"]
    near = intervals.around_days(rows, cultures.select(H, "bc_id", "culture_day"), [H], "at", "culture_day", WINDOW_DAYS)
    of = lambda k: F.col("lab_category") == k

    def baseline(s: str) -> list[Column]:
        """The least creatinine and bilirubin, the most platelets if ever 100 or more."""
        v = F.col("value")
        return [F.min(F.when(of("creatinine"), v)).alias(f"cr_{s}"), F.min(F.when(of("bilirubin_total"), v)).alias(f"bili_{s}"), F.max(F.when(of("platelet_count") & (v >= 100), v)).alias(f"plt_{s}")]

    stay, window = rows.groupBy(H).agg(*baseline("co")), near.groupBy(*c).agg(*baseline("ho"))
    all_ = near.join(stay, H, "left").join(window, c, "left").join(renal.select(H).distinct().withColumn("esrd", F.lit(1)), H, "left")
    v, out = F.col("value"), []
    for s in ("co", "ho"):
        out += [
            aggregates.earliest("at", of("creatinine") & F.col("esrd").isNull() & (v >= 2.0 * F.col(f"cr_{s}"))).alias(f"aki_{s}"),
            aggregates.earliest("at", of("bilirubin_total") & (v >= 2.0) & (v >= 2.0 * F.col(f"bili_{s}"))).alias(f"bili_{s}"),
            aggregates.earliest("at", of("platelet_count") & (v < 100) & (v <= 0.5 * F.col(f"plt_{s}"))).alias(f"plt_{s}"),
        ]
    return all_.groupBy(*c).agg(*out, aggregates.earliest("at", of("lactate") & (v >= 2.0)).alias("lactate_dttm"))


def _new_starts(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    w = sequences.ordered(keys, [time])
    gap = F.datediff(F.to_date(time), F.to_date(F.lag(time).over(w)))
    return rows.withColumn("_gap", gap).where("_gap IS NULL OR _gap > 1").drop("_gap")


def pressors(doses: DataFrame, adt: DataFrame) -> DataFrame:
    """Doses of vasoactive drugs outside procedures."""
    rows = doses.where((F.lower("med_group") == "vasoactives") & (F.col("med_dose") > 0)).select(H, "admin_dttm", "med_category")
    place = adt.select(H, "in_dttm", "out_dttm", "location_category")
    return intervals.outside_intervals(rows, place, [H], "admin_dttm", "in_dttm", "out_dttm", F.col("w.location_category").isNull() | (F.lower("w.location_category") != "procedural"))


def interventions(cultures: DataFrame, doses: DataFrame, adt: DataFrame, support: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New vasopressors and new invasive ventilation within two days, by the clock, of each culture."""
    at = cultures.select(H, "bc_id", "culture_time")
    c = [H, "bc_id"]
    drugs = intervals.around_days(_new_starts(pressors(doses, adt), [H, "med_category"], "admin_dttm"), at, [H], "admin_dttm", "culture_time", WINDOW_DAYS, calendar=False)
    drugs = drugs.groupBy(*c).agg(F.min("admin_dttm").alias("vasopressor_dttm"), aggregates.first_by("med_category", "admin_dttm").alias("vasopressor_name"))
    tubes = support.where(F.lower("device_category") == "imv").select(H, "recorded_dttm")
    tubes = intervals.around_days(_new_starts(tubes, [H], "recorded_dttm"), at, [H], "recorded_dttm", "culture_time", WINDOW_DAYS, calendar=False)
    return drugs, tubes.groupBy(*c).agg(F.min("recorded_dttm").alias("imv_dttm"))


def _onset(names: list[str]) -> tuple[Column, Column]:
    onset = F.least(*(F.col(n) for n in names))
    first = F.lit(None).cast("string")
    for n in reversed(names):
        first = F.when(F.col(n) == onset, CAUSES[n]).otherwise(first)
    return onset, first


def events(t: dict[str, DataFrame], *, repeats: bool = True) -> DataFrame:
    """One row for each blood culture, and one for each stay without any.

    t has hospitalization, patient, microbiology_culture, medication_admin_continuous,
    medication_admin_intermittent, labs, respiratory_support, adt, hospital_diagnosis.
    With repeats, hospital-onset events within 14 days after the last kept one go.
    """
    stays = t["hospitalization"].select(H, "patient_id", "admission_dttm", "discharge_dttm", "discharge_category")
    cultures = blood_cultures(t["microbiology_culture"])
    found = infections(antibiotic_runs(cultures, t["medication_admin_intermittent"], stays), stays, t["patient"])
    renal = t["hospital_diagnosis"].where(scalars.clean_code(F.col("diagnosis_code")).isin(RENAL_CODES)).select(H).distinct()
    drugs, tubes = interventions(cultures, t["medication_admin_continuous"], t["adt"], t["respiratory_support"])
    c = [H, "bc_id"]
    df = cultures.withColumnRenamed("culture_time", "blood_culture_dttm").join(stays.select(H, "admission_dttm"), H).join(found, c, "left").join(drugs, c, "left").join(tubes, c, "left").join(laboratory(cultures, t["labs"], renal), c, "left")
    df = df.join(renal.withColumn("has_esrd", F.lit(1)), H, "left").fillna(0, ["has_esrd", "presumed_infection"])
    stay_day = lambda x: F.datediff(F.to_date(x), F.to_date("admission_dttm")) + 1
    early = stay_day("blood_culture_dttm") <= 2
    df = df.withColumn("first_qad_dttm", F.when(F.col("has_new_parenteral") == 1, F.col("qad_start_day").cast("timestamp")))
    df = df.withColumns({n: F.when(early, F.col(f"{k}_co")).otherwise(F.col(f"{k}_ho")) for n, k in (("aki_dttm", "aki"), ("hyperbilirubinemia_dttm", "bili"), ("thrombocytopenia_dttm", "plt"))})
    organs = ["vasopressor_dttm", "imv_dttm", "aki_dttm", "hyperbilirubinemia_dttm", "thrombocytopenia_dttm"]
    some = F.coalesce(*(F.col(o) for o in organs)).isNotNull()
    infected = F.col("presumed_infection") == 1
    with_l, without = list(CAUSES), [n for n in CAUSES if n != "lactate_dttm"]
    (on_w, by_w), (on_o, by_o) = _onset(with_l), _onset(without)
    df = df.withColumns({
        "sepsis": (infected & (some | F.col("lactate_dttm").isNotNull())).cast("int"), "sepsis_wo_lactate": (infected & some).cast("int"),
        "presumed_infection_onset_dttm": F.when(infected, F.least("blood_culture_dttm", "first_qad_dttm")),
        "ase_onset_w_lactate_dttm": on_w, "ase_first_criteria_w_lactate": by_w, "ase_onset_wo_lactate_dttm": on_o, "ase_first_criteria_wo_lactate": by_o,
        "total_qad": F.col("qad_days"), "qad_start_date": F.col("qad_run_start").cast("timestamp"), "qad_end_date": F.col("qad_run_end").cast("timestamp"),
    })
    df = df.withColumn("type", F.when(on_w.isNull() | F.col("admission_dttm").isNull(), None).when(stay_day("ase_onset_w_lactate_dttm") <= 2, "community").otherwise("hospital"))
    df = df.withColumn("no_sepsis_reason", F.when(F.col("sepsis") == 1, None).when(~infected, "no_presumed_infection").otherwise("no_organ_dysfunction"))
    if repeats:
        ill = df.where("sepsis = 1")
        kept = sequences.suppress_repeats(ill, [H], "ase_onset_w_lactate_dttm", REPEAT_DAYS, F.col("type") == "hospital", "bc_id")
        df = kept.unionByName(df.where("sepsis = 0"))
    df = df.withColumn("episode_id", F.when(F.col("sepsis") == 1, F.row_number().over(Window.partitionBy(H, "sepsis").orderBy(F.col("ase_onset_w_lactate_dttm").asc_nulls_last(), "bc_id"))))
    bare = without_cultures(stays, cultures, t, renal)
    return df.select(*COLUMNS).unionByName(bare, allowMissingColumns=True).select(*COLUMNS)


def without_cultures(stays: DataFrame, cultures: DataFrame, t: dict[str, DataFrame], renal: DataFrame) -> DataFrame:
    """Stays without a blood culture, with the first signs of organ dysfunction at any time."""
    rest = stays.select(H).join(cultures.select(H), H, "left_anti")
    drugs = pressors(t["medication_admin_continuous"], t["adt"]).groupBy(H).agg(F.min("admin_dttm").alias("vasopressor_dttm"), aggregates.first_by("med_category", "admin_dttm").alias("vasopressor_name"))
    tubes = t["respiratory_support"].where(F.lower("device_category") == "imv").groupBy(H).agg(F.min("recorded_dttm").alias("imv_dttm"))
    v, at, k = F.coalesce(F.col("lab_value_numeric").cast("double"), scalars.number(F.col("lab_value"))), F.coalesce("lab_result_dttm", "lab_order_dttm"), F.lower("lab_category")
    labs = t["labs"].groupBy(H).agg(aggregates.earliest(at, (k == "lactate") & (v >= 2)).alias("lactate_dttm"), aggregates.earliest(at, (k == "platelet_count") & (v < 100)).alias("thrombocytopenia_dttm"), aggregates.earliest(at, (k == "bilirubin_total") & (v >= 2)).alias("hyperbilirubinemia_dttm"))
    out = rest.join(drugs, H, "left").join(tubes, H, "left").join(labs, H, "left").join(renal.withColumn("has_esrd", F.lit(1)), H, "left").fillna(0, ["has_esrd"])
    return out.withColumns({"presumed_infection": F.lit(0), "sepsis": F.lit(0), "sepsis_wo_lactate": F.lit(0), "no_sepsis_reason": F.lit("no_blood_culture")})
