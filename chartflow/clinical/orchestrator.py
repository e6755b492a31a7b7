"""One place for the tables of a site and what is made from them (C17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reshape, units
from ..quality import checks
from ..quality.schema import Schema
from ..sources import config, io
from . import comorbidity, sofa, stitching

# Times, categories and values of long tables.
LONG = {
    "vitals": ("recorded_dttm", "vital_category", "vital_value"),
    "labs": ("lab_result_dttm", "lab_category", "lab_value_numeric"),
    "patient_assessments": ("recorded_dttm", "assessment_category", "assessment_value"),
    "medication_admin_continuous": ("admin_dttm", "med_category", "med_dose"),
    "medication_admin_intermittent": ("admin_dttm", "med_category", "med_dose"),
}
WIDE = {"respiratory_support": "recorded_dttm", "crrt_therapy": "recorded_dttm"}
H = "hospitalization_id"


class Orchestrator:
    """Tables are read when first asked for; nothing is computed before an action."""

    def __init__(self, spark: SparkSession, path: str | None = None, **settings):
        self.spark, self.settings, self.tables = spark, config.resolve(path, **settings), {}
        self.mapping: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            df = io.read_table(self.spark, self.settings["data_directory"], name, self.settings["filetype"], prefix=self.settings.get("file_prefix", ""))
            if df is None:
                raise FileNotFoundError(name)
            self.tables[name] = df
        return self.tables[name]

    def stitch(self, hours: float = 6, **options) -> DataFrame:
        self.tables["hospitalization"], self.tables["adt"], self.mapping = stitching.stitch(self.table("hospitalization"), self.table("adt"), hours, **options)
        return self.mapping

    def convert_doses(self, name: str, preferred: dict[str, str], **options) -> DataFrame:
        """Doses of a medication table in preferred units, with the unit in the category's name."""
        out, _ = units.convert_doses(self.table(name), self.table("vitals"), preferred, **options)
        unit = F.translate("med_dose_unit_converted", "/- .", "____")
        out = out.withColumn("med_category", F.when(F.col("_convert_status") == "success", F.concat_ws("_", "med_category", unit)).otherwise(F.col("med_category"))).withColumn("med_dose", F.col("med_dose_converted"))
        self.tables[name] = out
        return out

    def wide(self, categories: dict[str, list[str]], *, ids: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
        """The wide table of the categories asked for; tables that are wide already come with the columns named."""
        zone = self.settings["timezone"]
        cohort = self.table("hospitalization").select(H, "patient_id", "age_at_admission")
        if ids is not None:
            cohort = cohort.join(ids.select(H), H, "left_semi")
        longs, wides = [], []
        for name, wanted in categories.items():
            df = self.table(name)
            if name in LONG:
                time, category, value = LONG[name]
                text = name == "patient_assessments"
                if text:
                    df = df.withColumn(value, reshape.coalesced_value("numerical_value", *(c for c in ("categorical_value", "text_value") if c in df.columns)))
                longs.append(reshape.Long(df.where(F.col(category).isin(wanted)), time, category, value, tuple(wanted), text))
            elif name in WIDE:
                wides.append((df.select(H, WIDE[name], *[c for c in wanted if c in df.columns]), WIDE[name]))
            else:
                raise ValueError(f"{name} has no place in a wide table")
        w = windows.select(H, "start_time", "end_time") if windows is not None else None
        return reshape.wide_from_long(cohort, longs, [H], zone=zone, windows=w, wides=wides)

    def hourly(self, wide: DataFrame, config: dict[str, list[str]], *, hours: int = 1, keys: list[str] | None = None, gaps: bool = False) -> DataFrame:
        """Windows of so many hours of a wide table; config maps max, min, mean and so on to columns.  gaps adds the windows without rows."""
        keys = keys or [H]
        out = reshape.aggregate_windows(wide, keys, "event_time", hours, config)
        return reshape.fill_windows(out, keys, hours) if gaps else out

    def cci(self, **options) -> DataFrame:
        return comorbidity.charlson(self.table("hospital_diagnosis"), **options)

    def elixhauser(self, definition: comorbidity.Index = comorbidity.ELIXHAUSER, **options) -> DataFrame:
        return comorbidity.elixhauser(self.table("hospital_diagnosis"), definition, **options)

    def validate_all(self, schemas: dict[str, Schema], **options) -> dict[str, dict]:
        """Findings, status and score of each table that has a schema; of one that is not there just that."""
        out = {}
        for name, schema in schemas.items():
            try:
                parts = checks.full(self.table(name), schema, **options)
            except FileNotFoundError:
                parts = checks.absent(schema)
            every = [f for part in parts.values() for f in part]
            out[name] = {"findings": parts, "status": checks.status(every), "score": checks.score(every)}
        return out

    def sofa(self, *, id_col: str = H, cohort: DataFrame | None = None, **options) -> DataFrame:
        """Scores from the wide table; doses must have been converted to mcg/kg/min before."""
        drugs = [f"{d}_mcg_kg_min" for d in sofa.REQUIRED["medication_admin_continuous"]]
        wide = self.wide({**{k: v for k, v in sofa.REQUIRED.items() if k != "medication_admin_continuous"}, "medication_admin_continuous": drugs})
        wide = reshape.numeric_columns(wide, ["gcs_total"])
        if id_col == "encounter_block":
            wide = wide.join(self.mapping if self.mapping is not None else self.stitch(), H)
        return sofa.from_wide(wide, id_col=id_col, cohort=cohort, **options)
