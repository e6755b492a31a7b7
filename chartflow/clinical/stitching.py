"""Hospitalizations that follow one another within hours as one encounter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ranks


def stitch(hospitalization: DataFrame, adt: DataFrame, hours: float = 6, *, exact_ids: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hospitalization and adt with encounter_block, and the mapping.

    A stay links to the next of its patient if that begins at most so many
    hours after its discharge; overlapping stays link.  A block's name is the id
    of its last stay, and nothing leaves the patient.  With exact_ids it is
    numbered by the place of its last stay among all, by patient and admission;
    stays are numbered by ranges, in many tasks (ranks.number_rows).
    """
    stays = hospitalization.select("patient_id", "hospitalization_id", "admission_dttm", "discharge_dttm").distinct()
    w = Window.partitionBy("patient_id").orderBy(F.col("admission_dttm").asc_nulls_last(), "hospitalization_id")
    gap = (F.unix_micros(F.lead("admission_dttm").over(w)) - F.unix_micros("discharge_dttm")) / 3_600_000_000
    linked = F.coalesce(gap <= hours + 1e-6, F.lit(False)) & F.col("patient_id").isNotNull()
    stays = stays.withColumn("_linked", linked)
    stays = stays.withColumn("_new", F.when(F.coalesce(F.lag("_linked").over(w), F.lit(False)), 0).otherwise(1))
    stays = stays.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("patient_id", "_chain")
    if exact_ids:
        mapping = ranks.number_rows(stays, ["patient_id", "admission_dttm", "hospitalization_id"], "_n").withColumn("encounter_block", F.max("_n").over(chain))
    else:
        mapping = stays.withColumn("encounter_block", F.max_by("hospitalization_id", F.struct("admission_dttm", "hospitalization_id")).over(chain))
    mapping = mapping.select("hospitalization_id", "encounter_block")
    return hospitalization.join(mapping, "hospitalization_id", "left"), adt.join(mapping, "hospitalization_id", "left"), mapping
