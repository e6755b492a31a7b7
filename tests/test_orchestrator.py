"""The orchestrator over demo tables written to a folder."""

from pyspark.sql import functions as F

from chartflow.clinical.orchestrator import Orchestrator
from chartflow.quality.schema import ColumnRule, Schema
from chartflow.sources import io


def test_from_files_to_scores(spark, tmp_path):
    t = io.demo(spark, 6)
    hours = t["vitals"].where("vital_category = 'map'").select("hospitalization_id", "recorded_dttm")
    t["patient_assessments"] = hours.select("hospitalization_id", "recorded_dttm", F.lit("gcs_total").alias("assessment_category"), F.lit(14.0).alias("numerical_value"), F.lit(None).cast("string").alias("categorical_value"))
    t["respiratory_support"] = hours.select("hospitalization_id", "recorded_dttm", F.lit("IMV").alias("device_category"), F.lit(0.5).alias("fio2_set"))
    t["medication_admin_continuous"] = hours.select("hospitalization_id", F.col("recorded_dttm").alias("admin_dttm"), F.lit("norepinephrine").alias("med_category"), F.lit(840.0).alias("med_dose"), F.lit("mcg/hour").alias("med_dose_unit"))
    t["adt"] = t["hospitalization"].select("hospitalization_id", F.col("admission_dttm").alias("in_dttm"), F.col("discharge_dttm").alias("out_dttm"))
    for name, df in t.items():
        io.save(df, io.table_path(str(tmp_path), name))
    o = Orchestrator(spark, data_directory=str(tmp_path), filetype="parquet", timezone="US/Central")
    o.convert_doses("medication_admin_continuous", {"norepinephrine": "mcg/kg/min"})
    scores = o.sofa().collect()
    # 840 mcg/hr at 70 kg is 0.2 mcg/kg/min; GCS 14 scores 1
    assert len(scores) == 6 and {(r["sofa_cv_97"], r["sofa_cns"]) for r in scores} == {(4, 1)}
    blocks = o.sofa(id_col="encounter_block").count()
    assert blocks == 6
    wide = o.wide({"vitals": ["map", "spo2"]}, ids=t["hospitalization"].where("hospitalization_id = 'h001'"))
    assert wide.count() == 49 and wide.agg(F.max("day_number")).first()[0] == 3
    windows = o.hourly(wide, {"max": ["map"], "mean": ["spo2"]}, gaps=True)
    assert windows.count() == 49 and {"map_max", "spo2_mean"} <= set(windows.columns)
    io.save(spark.createDataFrame([("h001", "I50.1", "ICD10CM")], "hospitalization_id string, diagnosis_code string, diagnosis_code_format string"), io.table_path(str(tmp_path), "hospital_diagnosis"))
    assert (o.cci().first()["cci_score"], o.elixhauser().first()["elix_score"]) == (2, 7)
    found = o.validate_all({"vitals": Schema("vitals", [ColumnRule("vital_value", "DOUBLE", True)]), "position": Schema("position", [])})
    assert (found["vitals"]["status"], found["position"]["status"], found["position"]["score"]) == ("complete", "incomplete", 0.0)
