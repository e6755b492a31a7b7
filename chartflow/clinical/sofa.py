"""Organ-failure scores, from the wide table (C4) and from long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, asof, intervals, ranges, sequences
from ..operators.reshape import with_columns

# What the score needs, by table.
REQUIRED = {
    "labs": ["creatinine", "platelet_count", "po2_arterial", "bilirubin_total"],
    "vitals": ["map", "spo2"],
    "patient_assessments": ["gcs_total"],
    "medication_admin_continuous": ["norepinephrine", "epinephrine", "dopamine", "dobutamine"],
    "respiratory_support": ["device_category", "fio2_set"],
}
HIGHEST = ["norepinephrine_mcg_kg_min", "epinephrine_mcg_kg_min", "dopamine_mcg_kg_min", "dobutamine_mcg_kg_min", "fio2_set", "creatinine", "bilirubin_total"]
LOWEST = ["map", "spo2", "po2_arterial", "pao2_imputed", "platelet_count", "gcs_total"]
DEVICES = ["IMV", "NIPPV", "CPAP", "High Flow NC", "Face Mask", "Trach Collar", "Nasal Cannula", "Other", "Room Air"]
SUPPORTED = ["IMV", "NIPPV", "CPAP"]
PLAUSIBLE = {"po2_arterial": (0.0, 700.0), "fio2_set": (0.21, 1.0), "spo2": (50.0, 100.0)}
SCORES = ["sofa_cv_97", "sofa_coag", "sofa_liver", "sofa_resp", "sofa_cns", "sofa_renal"]


def device_rank(device: Column) -> Column:
    """1 for most support; names as written, upper and lower case told apart."""
    out = F.lit(None).cast("int")
    for i, d in enumerate(DEVICES, 1):
        out = F.when(device == d, i).otherwise(out)
    return out


def device_of(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, DEVICES)), rank - 1)


def _steps(x: Column, bounds: list[float], *, falling: bool) -> Column:
    """4 to 0 by four bounds, from the worst on; rising values are worse unless falling."""
    if falling:
        out = F.when(x < bounds[0], 4)
        for score, b in zip((3, 2, 1), bounds[1:], strict=True):
            out = out.when(x < b, score)
        return out.when(x >= bounds[-1], 0)
    out = F.when(x >= bounds[0], 4)
    for score, b in zip((3, 2, 1), bounds[1:], strict=True):
        out = out.when(x >= b, score)
    return out.when(x < bounds[-1], 0)


def cardiovascular(dopamine: Column, epinephrine: Column, norepinephrine: Column, dobutamine: Column, pressure: Column) -> Column:
    """A dose of epinephrine or norepinephrine that is known counts 3 even at zero."""
    return (
        F.when((dopamine > 15) | (epinephrine > 0.1) | (norepinephrine > 0.1), 4)
        .when((dopamine > 5) | (epinephrine <= 0.1) | (norepinephrine <= 0.1), 3)
        .when((dopamine <= 5) | (dobutamine > 0), 2)
        .when(pressure < 70, 1)
        .when(pressure >= 70, 0)
    )


def respiratory(ratio: Column, device: Column) -> Column:
    supported = device.isin(SUPPORTED)
    return F.when((ratio < 100) & supported, 4).when((ratio >= 100) & (ratio < 200) & supported, 3).when((ratio >= 200) & (ratio < 300), 2).when((ratio >= 300) & (ratio < 400), 1).when(ratio >= 400, 0)


def nervous(gcs: Column) -> Column:
    """Fractions between the steps score nothing."""
    return F.when(gcs < 6, 4).when(gcs.between(6, 9), 3).when(gcs.between(10, 12), 2).when(gcs.between(13, 14), 1).when(gcs == 15, 0)


def _scored(df: DataFrame, ratio: Column, device: Column) -> DataFrame:
    c = F.col
    return df.withColumns({
        "sofa_cv_97": cardiovascular(c("dopamine_mcg_kg_min"), c("epinephrine_mcg_kg_min"), c("norepinephrine_mcg_kg_min"), c("dobutamine_mcg_kg_min"), c("map")),
        "sofa_coag": _steps(c("platelet_count"), [20, 50, 100, 150], falling=True),
        "sofa_liver": _steps(c("bilirubin_total"), [12, 6, 2, 1.2], falling=False),
        "sofa_resp": respiratory(ratio, device),
        "sofa_cns": nervous(c("gcs_total")),
        "sofa_renal": _steps(c("creatinine"), [5, 3.5, 2, 1.2], falling=False),
    })


def from_wide(wide: DataFrame, *, id_col: str = "encounter_block", cohort: DataFrame | None = None, time: str = "event_time", fill_missing: bool = True, remove_outliers: bool = True) -> DataFrame:
    """Scores of the worst values of each id.

    cohort (id, start_time, end_time) keeps what lies inside its windows, ends
    included.  Columns that are missing count as null.  The total is that of
    six scores; with fill_missing a score that is missing counts 0.
    """
    if cohort is not None:
        wide = intervals.interval_join(wide, cohort.select(id_col, "start_time", "end_time"), [id_col], time, "start_time", "end_time").drop("start_time", "end_time")
    wide = with_columns(with_columns(wide, [*HIGHEST, *LOWEST]), ["device_category"], "string")
    if remove_outliers:
        wide = ranges.clamp_columns(wide, PLAUSIBLE)
    wide = wide.withColumn("pao2_imputed", scalars.pao2_from_spo2(F.col("spo2"))).withColumn("device_rank", device_rank(F.col("device_category")))
    worst = aggregates.worst_values(wide, [id_col], HIGHEST, [*LOWEST, "device_rank"])
    worst = worst.withColumn("p_f", F.try_divide("po2_arterial", "fio2_set")).withColumn("p_f_imputed", F.try_divide("pao2_imputed", "fio2_set"))
    out = _scored(worst, F.col("p_f"), device_of(F.col("device_rank")))
    return with_total(out, fill_missing).select(id_col, "p_f", "p_f_imputed", *SCORES, "sofa_total")


def with_total(df: DataFrame, fill_missing: bool) -> DataFrame:
    if fill_missing:
        df = df.fillna(0, SCORES)
    total = F.col(SCORES[0])
    for s in SCORES[1:]:
        total = total + F.col(s)
    return df.withColumn("sofa_total", total)


def dose_per_kg_minute(dose: Column, unit: Column, weight_kg: Column) -> Column:
    """A dose of any amount unit in mcg/kg/min, by looser rules than those of the unit converter."""
    u = F.lower(F.regexp_replace(unit, "\\s+", ""))
    amount = F.when(u.startswith("mg"), dose * 1000).when(u.startswith("ng"), dose / 1000).when(u.rlike("^g/"), dose * 1_000_000).otherwise(dose)
    by_time = F.when(u.rlike("/h(r|our)?$"), amount / 60).otherwise(amount)
    return F.when(u.contains("/kg"), by_time).when(u.contains("/lb"), by_time * scalars.LB_PER_KG).otherwise(F.try_divide(by_time, weight_kg))


def episodes(support: DataFrame, *, key: str = "hospitalization_id", time: str = "recorded_dttm") -> DataFrame:
    """Respiratory records with devices inferred and carried forward, and runs numbered."""
    mode = F.lower("mode_category")
    device = F.when(F.col("device_category").isNull() & scalars.true(mode.rlike("assist control-volume control|simv|pressure control")), "IMV").otherwise(F.col("device_category"))
    df = support.withColumn("device_category", device)
    df = df.withColumn("fio2_set", F.when((F.lower("device_category") == "room air") & F.col("fio2_set").isNull(), 0.21).otherwise(F.col("fio2_set")))
    df = sequences.fill_forward(df, [key], [time], ["device_category"])
    df = sequences.change_island(df, [key], [time], "device_category", "device_cat_id")
    df = sequences.fill_forward(df, [key, "device_cat_id"], [time], ["mode_category"])
    df = sequences.change_island(df, [key], [time], "mode_category", "mode_cat_id")
    return sequences.fill_forward(df, [key, "device_cat_id", "mode_cat_id"], [time], ["fio2_set"])


def concurrent_ratios(oxygen: DataFrame, support: DataFrame, keys: list[str], *, time: str = "event_time", minutes: int = 240) -> DataFrame:
    """Each oxygen pressure with the fraction and device at or before it, at most so many minutes old."""
    hit = asof.asof_join(oxygen, support.where(F.col("fio2_set").isNotNull() & F.col("device_category").isNotNull()), keys, time, "recorded_dttm", ["fio2_set", "device_category"], tolerance_seconds=minutes * 60)
    return hit.withColumn("p_f", F.try_divide("po2_arterial", "fio2_set")).withColumn("p_f_imputed", F.try_divide("pao2_imputed", "fio2_set"))


def from_tables(cohort: DataFrame, labs: DataFrame, vitals: DataFrame, assessments: DataFrame, support: DataFrame, doses: DataFrame, *, id_col: str = "hospitalization_id", fill_missing: bool = True) -> DataFrame:
    """Scores inside each window of cohort (id, start_time, end_time), with ratios of values that go together.

    Records of respiratory support count from 24 hours before the window.  The
    device is that of the worst ratio.  Every part is one aggregation by window.
    """
    w = [id_col, "start_time", "end_time"]
    windows = cohort.select(*w)

    def inside(df: DataFrame, time: str, ws: DataFrame = windows) -> DataFrame:
        return intervals.interval_join(df, ws, [id_col], time, "start_time", "end_time")

    def wide(df: DataFrame, category: str, value: str, how: dict[str, list[str]]) -> DataFrame:
        v = F.col(value).cast("double")
        return df.groupBy(*w).agg(*((F.max if k == "max" else F.min)(F.when(F.lower(category) == c, v)).alias(c) for k, cs in how.items() for c in cs))

    lab = inside(labs, "lab_result_dttm")
    out = windows.join(wide(lab, "lab_category", "lab_value_numeric", {"max": ["creatinine", "bilirubin_total"], "min": ["platelet_count"]}), w, "left")
    vital = inside(vitals, "recorded_dttm")
    out = out.join(wide(vital, "vital_category", "vital_value", {"min": ["map"]}), w, "left")
    gcs = inside(assessments.where(F.lower("assessment_category") == "gcs_total"), "recorded_dttm")
    out = out.join(gcs.groupBy(*w).agg(F.min(F.col("numerical_value").cast("double")).alias("gcs_total")), w, "left")

    weights = vitals.where(F.lower("vital_category") == "weight_kg").select(id_col, "recorded_dttm", F.col("vital_value").cast("double").alias("weight_kg"))
    given = asof.asof_join(inside(doses, "admin_dttm"), weights, [id_col], "admin_dttm", "recorded_dttm", ["weight_kg"])
    given = given.withColumn("rate", dose_per_kg_minute(F.col("med_dose"), F.col("med_dose_unit"), F.col("weight_kg")))
    drugs = REQUIRED["medication_admin_continuous"]
    out = out.join(given.groupBy(*w).agg(*(F.max(F.when(F.lower("med_category") == d, F.col("rate"))).alias(f"{d}_mcg_kg_min") for d in drugs)), w, "left")

    early = windows.withColumn("_own", F.col("start_time")).withColumn("start_time", F.expr("start_time - INTERVAL 24 HOURS"))
    near = inside(support, "recorded_dttm", early).withColumn("start_time", F.col("_own")).drop("_own")
    near = episodes(near.withColumn("_window", F.struct(*w)), key="_window").drop("_window")
    pressures = lab.where(F.lower("lab_category") == "po2_arterial").select(*w, F.col("lab_result_dttm").alias("event_time"), ranges.clamp(F.col("lab_value_numeric").cast("double"), 0.0, 700.0).alias("po2_arterial"), F.lit(None).cast("double").alias("pao2_imputed"))
    saturation = vital.where(F.lower("vital_category") == "spo2").select(*w, F.col("recorded_dttm").alias("event_time"), F.lit(None).cast("double").alias("po2_arterial"), scalars.pao2_from_spo2(ranges.clamp(F.col("vital_value").cast("double"), 50.0, 100.0)).alias("pao2_imputed"))
    ratio = concurrent_ratios(pressures.unionByName(saturation), near.withColumn("fio2_set", ranges.clamp(F.col("fio2_set"), 0.21, 1.0)), w)
    worst = ratio.groupBy(*w).agg(F.min("p_f").alias("p_f"), F.min("p_f_imputed").alias("p_f_imputed"), F.min_by("device_category", "p_f").alias("device_category"))
    out = out.join(worst, w, "left")
    return with_total(_scored(out, F.col("p_f"), F.col("device_category")), fill_missing).select(*w, "p_f", "p_f_imputed", *SCORES, "sofa_total")
