"""Figures and filters of single tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import aggregates, ranks

H = "hospitalization_id"


def of_category(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one category; null is none."""
    return df.where(F.col(column) == value)


def length_of_stay(stays: DataFrame) -> DataFrame:
    """Days with fractions."""
    return stays.withColumn("length_of_stay_days", (F.unix_micros("discharge_dttm") - F.unix_micros("admission_dttm")) / 86_400_000_000)


def mortality_pct(stays: DataFrame) -> DataFrame:
    """Share of stays that end with exactly "Expired"."""
    return stays.agg(F.avg((F.coalesce(F.col("discharge_category") == "Expired", F.lit(False))).cast("double") * 100).alias("mortality_pct"))


def stay_summary(stays: DataFrame) -> DataFrame:
    d = length_of_stay(stays)
    return d.agg(F.count("*").alias("stays"), F.count_distinct("patient_id").alias("patients"), F.avg("length_of_stay_days").alias("mean_days"), F.median("length_of_stay_days").alias("median_days"), F.avg("age_at_admission").alias("mean_age"), F.min("admission_dttm").alias("first"), F.max("discharge_dttm").alias("last"))


def stays_per_patient(stays: DataFrame) -> DataFrame:
    return stays.groupBy("patient_id").agg(F.count("*").alias("stays"), F.min("admission_dttm").alias("first"), F.max("admission_dttm").alias("last"))


def diagnosis_summary(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("rows"), F.count_distinct(H).alias("stays"), F.count_distinct("diagnosis_code").alias("codes"), F.sum(F.coalesce("diagnosis_primary", F.lit(0))).alias("primary"), F.sum(F.coalesce("poa_present", F.lit(0))).alias("present_on_admission"))


def primary_diagnoses(d: DataFrame, most: int = 20) -> DataFrame:
    return aggregates.value_counts(d.where("diagnosis_primary = 1"), ["diagnosis_code"]).limit(most)


def diagnosis_by_format(d: DataFrame) -> DataFrame:
    return d.groupBy("diagnosis_code_format").agg(F.count("*").alias("rows"), F.count_distinct("diagnosis_code").alias("codes"), F.count_distinct(H).alias("stays"))


def present_on_admission(d: DataFrame) -> DataFrame:
    p = F.col("poa_present")
    return d.groupBy(F.col("diagnosis_primary").alias("primary")).agg(F.count("*").alias("rows"), F.count_if(p == 1).alias("present"), F.count_if(p == 0).alias("absent"), F.count_if(p.isNull()).alias("unknown"))


def diagnoses_per_stay(d: DataFrame) -> DataFrame:
    return d.groupBy(H).agg(F.count("*").alias("rows"), F.count_distinct("diagnosis_code").alias("codes"), F.sum(F.coalesce("diagnosis_primary", F.lit(0))).alias("primary"))


def position_stats(p: DataFrame) -> DataFrame:
    return p.groupBy("position_category").agg(F.count("*").alias("rows"), F.count_distinct(H).alias("stays"))


def category_names(df: DataFrame, category: str, name: str, *, by: str = "count", most: int | None = None) -> DataFrame:
    """Of each category its names with counts, by count or by name (A24); most: so many of them."""
    if by not in ("count", "name"):
        raise ValueError("by is count or name")
    n = df.groupBy(category, name).agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col(name).asc_nulls_first()] if by == "count" else [F.col(name).asc_nulls_first()]
    if most is None:
        placed = n.withColumn("__place", F.row_number().over(Window.partitionBy(category).orderBy(*order)))
    else:  # of a category with very many names only the first few are brought together
        placed = ranks.number_rows(n, order, "__place", keys=[category]).where(F.col("__place") <= most)
    listed = F.array_sort(F.collect_list(F.struct("__place", F.col(name).alias("name"), "n")))
    return placed.groupBy(category).agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("names"))


def reference_units(labs: DataFrame) -> DataFrame:
    """Units of each laboratory category, null first."""
    return labs.groupBy("lab_category", "reference_unit").agg(F.count("*").alias("n")).orderBy("lab_category", F.col("reference_unit").asc_nulls_first())


def standard_units(labs: DataFrame, targets: dict[str, list[str]], *, lowercase: bool = False) -> DataFrame:
    """Reference units written as the first accepted one of their category that says the same (C14).

    A unit that is accepted as it stands stays, as does one that matches none.
    targets is a list in the program; both sides are compared in the form of
    lab_unit().
    """
    rows = [(c, u, us[0]) for c, us in targets.items() for u in us]
    t = labs.sparkSession.createDataFrame(rows, "lab_category string, _unit string, _first string").withColumn("_key", scalars.lab_unit(F.col("_unit")))
    t = t.groupBy("lab_category", "_key").agg(F.first("_first").alias("_first"), F.collect_set("_unit").alias("_as_is")).where("_key <> ''")
    out = labs.withColumn("_key", scalars.lab_unit(F.col("reference_unit"))).join(F.broadcast(t), ["lab_category", "_key"], "left")
    new = F.when(F.col("_first").isNull() | F.array_contains("_as_is", F.col("reference_unit")), F.col("reference_unit")).otherwise(F.col("_first"))
    return out.withColumn("reference_unit", F.lower(new) if lowercase else new).select(*labs.columns)


def overlapping_admissions(adt: DataFrame) -> DataFrame:
    """Stays with a segment that ends after the next begins, at another place; a place that is unknown is another."""
    w = Window.partitionBy(H).orderBy(F.col("in_dttm").asc_nulls_last(), F.col("out_dttm").asc_nulls_last())
    d = adt.withColumn("_in", F.lead("in_dttm").over(w)).withColumn("_place", F.lead("location_category").over(w))
    return d.where((F.col("out_dttm") > F.col("_in")) & ~F.coalesce(F.col("location_category") == F.col("_place"), F.lit(False))).select(H).distinct()


def culture_times_out_of_order(cultures: DataFrame, grace_seconds: int = 60) -> DataFrame:
    """Cultures ordered after they were collected, or collected after their result, by the grace or more."""
    late = lambda a, b: F.coalesce(F.unix_micros(a) - F.unix_micros(b) >= grace_seconds * 1_000_000, F.lit(False))
    return cultures.where(late("order_dttm", "collect_dttm") | late("collect_dttm", "result_dttm"))


def organism_outliers(cultures: DataFrame, most: int = 10) -> DataFrame:
    """Pairs of fluid and organism group that are most over and under what chance gives."""
    r = aggregates.contingency_residuals(cultures, "fluid_category", "organism_group")
    return r.orderBy(F.col("residual").desc(), "fluid_category", "organism_group").limit(most).unionByName(r.orderBy("residual", "fluid_category", "organism_group").limit(most))
