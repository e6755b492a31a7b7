"""Reading and writing tables (S1 to S14).  Existence and removal go through Hadoop's file system, so any store works."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates

KINDS = ("csv", "parquet", "json", "orc")


def table_path(folder: str, table: str, kind: str = "parquet", prefix: str = "") -> str:
    """<folder>/<prefix><table>.<kind> (S1); what names begin with is a setting of the site."""
    return f"{folder.rstrip('/')}/{prefix}{table}.{kind}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a file or folder inside one store; what is at new must be gone before."""
    fs, a = _hadoop(spark, old)
    _, b = _hadoop(spark, new)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{old} cannot be moved to {new}")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    fs, p = _hadoop(spark, path)
    return fs.getContentSummary(p).getLength()


def read(spark: SparkSession, path: str, kind: str = "parquet", *, columns: list[str] | None = None, filters: dict | None = None, limit: int | None = None) -> DataFrame:
    """A table with ids as strings and times as instants.

    filters maps a column to a value or a list of values; they and the columns
    reach the scan.  A limit takes any rows.  Nothing is read until it is used.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    df = reader.format(kind).load(path)
    for c, v in (filters or {}).items():
        values = list(v) if isinstance(v, (list, tuple, set)) else [v]
        df = df.where(F.col(c).cast("string").isin([str(x) for x in values]) if dict(df.dtypes)[c] not in ("string", "bigint", "int", "double") else F.col(c).isin(values))
    if columns:
        df = df.select(*columns)
    if limit is not None:
        df = df.limit(limit)
    return typed(df)


def typed(df: DataFrame) -> DataFrame:
    """Columns ending in _id as strings, timestamps without a zone as instants of the session's zone (UTC)."""
    new = {}
    for c, k in df.dtypes:
        if c.endswith("_id"):
            new[c] = scalars.id_string(F.col(c), k)
        elif k == "timestamp_ntz":
            new[c] = F.col(c).cast("timestamp")
    return df.withColumns(new)


def read_table(spark: SparkSession, folder: str, table: str, kind: str = "parquet", *, prefix: str = "", **options) -> DataFrame | None:
    """read() by the naming rule; None if there is no such file."""
    path = table_path(folder, table, kind, prefix)
    return read(spark, path, kind, **options) if exists(spark, path) else None


def read_all(spark: SparkSession, folder: str, tables: list[str], kind: str = "parquet", *, prefix: str = "") -> dict[str, DataFrame]:
    """Every table that is there."""
    found = {t: df for t in tables if (df := read_table(spark, folder, t, kind, prefix=prefix)) is not None}
    if not found:
        raise FileNotFoundError(f"none of {tables} is in {folder}")
    return found


def save(df: DataFrame, path: str, kind: str = "parquet", *, overwrite: bool = False) -> None:
    """Write, and refuse what is there already unless overwrite is set."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    df.write.format(kind).option("header", True).mode("overwrite" if overwrite else "errorifexists").save(path)


def rewrite(spark: SparkSession, source: str, target: str, change, kind: str = "parquet", *, overwrite: bool = False) -> None:
    """From file to file through change(df), without holding it."""
    save(change(spark.read.option("header", True).format(kind).load(source)), target, kind, overwrite=overwrite)


def summary(df: DataFrame, ids: tuple[str, ...] = ("hospitalization_id", "patient_id")) -> dict:
    """Rows, columns, zones of timestamp columns, distinct ids.

    A timestamp without a zone has none; one with a zone is an instant, shown in
    the session's zone.  Rows come from a count that reads no column, ids from
    one count of (column, value) pairs.
    """
    have = [c for c in ids if c in df.columns]
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    distinct = {r["column"]: r["distinct"] for r in aggregates.column_figures(df, have).collect()} if have else {}
    return {"rows": df.count(), "columns": sorted(df.columns), "zones": {c: zone if k == "timestamp" else None for c, k in df.dtypes if k.startswith("timestamp")}, "ids": {c: distinct[c] for c in have}}


def raw(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A table as it is stored, without typing of ids and times."""
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    return reader.format(kind).load(path)


def footers(spark: SparkSession, path: str, kind: str = "parquet") -> dict:
    """Rows, types, and zones of timestamps (UTC for instants, None for those without a zone) as files state them.

    Types come from the schema that files hold, and rows from a count that asks
    for no column, which Parquet answers from its footers, task by task.
    """
    df = raw(spark, path, kind)
    return {"rows": df.count(), "types": dict(df.dtypes), "zones": {c: "UTC" if k == "timestamp" else None for c, k in df.dtypes if k.startswith("timestamp")}}


def to_json(value, path: str | None = None) -> str:
    """JSON with ISO times (S11); written to a driver-side file if a path is given."""
    plain = lambda x: x.isoformat() if isinstance(x, (date, datetime)) else str(x)
    text = json.dumps(value, default=plain, indent=2)
    if path:
        with open(path, "w") as f:
            f.write(text)
    return text


def demo(spark: SparkSession, patients: int = 20) -> dict[str, DataFrame]:
    """Small made-up tables of the data model, for trying things out."""
    n = spark.range(patients).withColumn("patient_id", F.format_string("p%03d", "id"))
    admit = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400)
    hosp = n.select("patient_id", F.format_string("h%03d", "id").alias("hospitalization_id"), admit.alias("admission_dttm"), (admit + F.expr("INTERVAL 4 DAYS")).alias("discharge_dttm"), (F.lit(40) + F.col("id") % 50).cast("int").alias("age_at_admission"), F.when(F.col("id") % 7 == 0, "Expired").otherwise("Home").alias("discharge_category"))
    hours = hosp.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(48)))).withColumn("recorded_dttm", F.timestamp_seconds(F.unix_seconds("admission_dttm") + F.col("h") * 3600))
    wave = lambda base, swing, c: F.lit(base) + F.lit(swing) * F.sin(F.col("h") / c)
    vitals = hours.select("hospitalization_id", "recorded_dttm", F.explode(F.map_from_arrays(F.array(*map(F.lit, ["map", "spo2", "heart_rate", "weight_kg"])), F.array(wave(72.0, 12.0, 5.0), wave(94.0, 4.0, 7.0), wave(85.0, 20.0, 3.0), F.lit(70.0)))).alias("vital_category", "vital_value"))
    labs = hours.where("h % 8 = 0").select("hospitalization_id", F.col("recorded_dttm").alias("lab_collect_dttm"), (F.col("recorded_dttm") + F.expr("INTERVAL 1 HOUR")).alias("lab_result_dttm"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ["creatinine", "platelet_count", "bilirubin_total", "po2_arterial"])), F.array(wave(1.5, 1.0, 9.0), wave(160.0, 80.0, 11.0), wave(1.5, 1.2, 10.0), wave(85.0, 20.0, 6.0)))).alias("lab_category", "lab_value_numeric"))
    return {"patient": n.select("patient_id"), "hospitalization": hosp, "vitals": vitals, "labs": labs}
