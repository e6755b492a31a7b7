"""Dose units: one spelling, base units, preferred units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .asof import asof_join


def latest_weight(doses: DataFrame, vitals: DataFrame, *, key: str = "hospitalization_id", dose_time: str = "admin_dttm", vital_time: str = "recorded_dttm") -> DataFrame:
    """doses with weight_kg, the last known at or before the dose."""
    weights = vitals.where(F.lower("vital_category") == "weight_kg").select(key, vital_time, F.col("vital_value").cast("double").alias("weight_kg"))
    return asof_join(doses, weights, [key], dose_time, vital_time, ["weight_kg"], skip_null="weight_kg", matched_time="_weight_recorded_dttm")


def to_base(doses: DataFrame, *, dose: str = "med_dose", unit: str = "med_dose_unit") -> DataFrame:
    """_clean_unit, _unit_class, _base_dose and _base_unit (mcg, ml, u; by minute for rates).  Needs weight_kg."""
    df = doses.withColumn("_clean_unit", s.clean_unit_name(s.clean_unit_format(F.col(unit))))
    u = F.col("_clean_unit")
    df = df.withColumn("_unit_class", s.unit_class(u)).withColumn("_weighted", s.is_weighted(u).cast("int"))
    known = F.col("_unit_class") != "unrecognized"
    factor = F.when(known, s.amount_factor(u) * s.time_factor(u) * s.weight_factor(u, F.col("weight_kg"))).otherwise(1.0)
    stuck = (F.col("_weighted") == 1) & F.col("weight_kg").isNull()
    family = s.unit_family(u)
    base = F.when(family == "mass", "mcg").when(family == "volume", "ml").when(family == "unit", "u")
    base = F.when(F.col("_unit_class") == "rate", F.concat(base, F.lit("/min"))).otherwise(base)
    return df.withColumn("_base_dose", F.when(stuck, F.col(dose)).otherwise(F.col(dose) * factor)).withColumn("_base_unit", F.when(stuck | ~known, u).otherwise(base))


def to_preferred(df: DataFrame, *, dose: str = "med_dose", strict: bool = True) -> DataFrame:
    """med_dose_converted, med_dose_unit_converted and _convert_status from _base_dose, _base_unit and _preferred_unit.

    strict raises if a preferred unit is none that can be made.  What cannot be
    converted keeps its dose and clean unit, and the status says why.
    """
    p, b = F.col("_preferred_unit"), F.col("_base_unit")
    if strict:
        known = {None, *s.RATE_UNITS, *s.AMOUNTS}
        bad = [r[0] for r in df.select(p).distinct().limit(10 * len(known)).collect() if r[0] not in known]
        if bad:
            raise ValueError(f"cannot convert to these units: {sorted(bad)}")
    kind = F.col("_unit_class") if "_unit_class" in df.columns else s.unit_class(b)
    df = df.withColumn("_unit_class", kind).withColumn("_unit_subclass", s.unit_family(b)).withColumn("_unit_class_preferred", s.unit_class(p)).withColumn("_unit_subclass_preferred", s.unit_family(p))
    c, f, cp, fp = (F.col(x) for x in ("_unit_class", "_unit_subclass", "_unit_class_preferred", "_unit_subclass_preferred"))
    no = "unrecognized"
    status = (
        F.when(s.is_weighted(p) & F.col("weight_kg").isNull(), "cannot convert to a weighted unit if weight_kg is missing")
        .when(b.isNull(), "original unit is missing")
        .when((c == no) | (f == no), F.concat(F.lit("original unit "), b, F.lit(" is not recognized")))
        .when((cp == no) | (fp == no), F.concat(F.lit("user-preferred unit "), p, F.lit(" is not recognized")))
        .when(c != cp, F.concat(F.lit("cannot convert "), c, F.lit(" to "), cp))
        .when(f != fp, F.concat(F.lit("cannot convert "), f, F.lit(" to "), fp))
        .otherwise("success")
    )
    df = df.withColumn("_convert_status", status)
    done = F.col("_convert_status") == "success"
    factor = F.try_divide(F.lit(1.0), s.amount_factor(p) * s.time_factor(p) * s.weight_factor(p, F.col("weight_kg")))
    kept_dose, kept_unit = F.col(dose if dose in df.columns else "_base_dose"), F.col("_clean_unit" if "_clean_unit" in df.columns else "_base_unit")
    return df.withColumn("med_dose_converted", F.when(done, F.col("_base_dose") * factor).otherwise(kept_dose)).withColumn("med_dose_unit_converted", F.when(done, p).otherwise(kept_unit))


def convert_doses(doses: DataFrame, vitals: DataFrame | None, preferred: dict[str, str], *, strict: bool = True, keep_steps: bool = False, key: str = "hospitalization_id") -> tuple[DataFrame, DataFrame]:
    """Doses in the preferred unit of their category (its base unit if none is given), and counts by conversion."""
    if strict and preferred:
        known = {r[0] for r in doses.where(F.col("med_category").isin(list(preferred))).select("med_category").distinct().collect()}
        if missing := sorted(set(preferred) - known):
            raise ValueError(f"no such categories among the doses: {missing}")
    df = doses if "weight_kg" in doses.columns else latest_weight(doses, vitals, key=key)
    df = to_base(df)
    wanted = F.lit(None).cast("string")
    for category, unit in preferred.items():
        wanted = F.when(F.col("med_category") == category, unit).otherwise(wanted)
    out = to_preferred(df.withColumn("_preferred_unit", F.coalesce(wanted, F.col("_base_unit"))), strict=strict)
    counts = out.groupBy("med_category", "med_dose_unit", "_clean_unit", "_base_unit", "_unit_class", "_preferred_unit", "med_dose_unit_converted", "_convert_status").agg(F.count("*").alias("count")).orderBy("med_category", F.col("count").desc())
    if not keep_steps:
        out = out.drop("_weight_recorded_dttm", "_weighted", "_base_dose", "_base_unit", "_preferred_unit", "_unit_class_preferred", "_unit_subclass", "_unit_subclass_preferred")
    return out, counts
