"""Values of one version of a vocabulary written as those of the next (C12), and migration of a folder."""

from __future__ import annotations

from dataclasses import dataclass, field

import uuid
from datetime import datetime, timezone

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources import io


def apply_column(df: DataFrame, column: str, renames: dict[str, str], unresolved: set[str] = frozenset()) -> DataFrame:
    """Renames first; what is unresolved stays as it is; everything else is put in normal form."""
    c = F.col(column)
    out = F.when(c.isin(sorted(unresolved)), c) if unresolved else None
    for old, new in renames.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    normal = scalars.normalize_category(c)
    return df.withColumn(column, normal if out is None else out.otherwise(normal))


# By table and column, what version 3.0 calls a value of 2.1, and values that only a person can resolve.
RENAMES = {
    "patient": {"language_category": {"Unknown or NA": "unknown"}},
    "hospitalization": {
        "discharge_category": {
            "Skilled Nursing Facility (SNF)": "snf",
            "Acute Inpatient Rehab Facility": "acute_ip_rehab",
            "Long Term Care Hospital (LTACH)": "ltach",
            "Acute Care Hospital": "acute_care_hosp",
            "Against Medical Advice (AMA)": "ama",
            "Psychiatric Hospital": "mental_health_hosp",
        }
    },
    "labs": {"lab_category": {"glucose_fingerstick": "glucose"}, "lab_specimen_category": {"blood/plasma/serum": "plasma_blood"}},
    "respiratory_support": {
        "device_category": {"High Flow NC": "hfnc"},
        "mode_category": {"Assist Control-Volume Control": "acvc", "Pressure-Regulated Volume Control": "prvc", "Pressure Support/CPAP": "ps_or_cpap"},
    },
    "microbiology_culture": {"organism_category": {"clostridium_difficile": "clostridioides_difficile", "staphyloccocus_coagneg": "staphylococcus_coagneg"}},
}
UNRESOLVED = {"medication_admin_continuous": {"med_category": {"albumin"}}, "labs": {"lab_specimen_category": {"csf", "other"}}}


def vocabulary_of(table: str) -> Vocabulary:
    return Vocabulary(RENAMES.get(table, {}), UNRESOLVED.get(table, {}))


@dataclass
class Vocabulary:
    """Of each column: renames, and values that no rule resolves."""

    renames: dict[str, dict[str, str]] = field(default_factory=dict)
    unresolved: dict[str, set[str]] = field(default_factory=dict)
    suffixes: tuple[str, ...] = ("_category", "_group", "_type")

    @classmethod
    def from_yaml(cls, path: str, table: str) -> Vocabulary:
        """renames and unresolved of one table from a file."""
        with open(path) as f:
            t = yaml.safe_load(f)
        text = lambda d: {str(k): str(v) for k, v in d.items()}
        return cls({c: text(r) for c, r in ((t.get("renames") or {}).get(table) or {}).items()}, {c: set(map(str, v)) for c, v in ((t.get("unresolved") or {}).get(table) or {}).items()})

    def columns(self, df: DataFrame) -> list[str]:
        return [c for c, k in df.dtypes if k == "string" and c.endswith(self.suffixes)]


def crosswalk(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    for c in vocabulary.columns(df):
        df = apply_column(df, c, vocabulary.renames.get(c, {}), vocabulary.unresolved.get(c, set()))
    return df


def report(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """column, old, new, n and how: unresolved, renamed, normalised or unchanged; one pass over all columns."""
    columns = vocabulary.columns(df)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("old")) for c in columns)))
    counted = df.select(pairs.alias("p")).where("p.old IS NOT NULL").groupBy("p.column", "p.old").agg(F.count("*").alias("n"))
    how, new = F.lit(None).cast("string"), scalars.normalize_category(F.col("old"))
    for c in columns:
        of = F.col("column") == c
        for old, to in vocabulary.renames.get(c, {}).items():
            how, new = F.when(of & (F.col("old") == old), "renamed").otherwise(how), F.when(of & (F.col("old") == old), to).otherwise(new)
        if gone := sorted(vocabulary.unresolved.get(c, ())):
            how, new = F.when(of & F.col("old").isin(gone), "unresolved").otherwise(how), F.when(of & F.col("old").isin(gone), F.col("old")).otherwise(new)
    return counted.withColumn("new", new).withColumn("how", F.coalesce(how, F.when(F.col("old") == F.col("new"), "unchanged").otherwise("normalised")))


def zone_status(before: dict[str, str | None], after: dict[str, str | None]) -> tuple[str, bool]:
    """What became of the zones of timestamp columns, and whether that is a concern.

    A zone that becomes UTC keeps its instants; anything else that changes,
    such as an instant that loses its zone, a column without one that gets one,
    or a column that is gone, is a concern.
    """
    changed = {c: (before.get(c), after.get(c)) for c in [*before, *(c for c in after if c not in before)] if before.get(c) != after.get(c) or (c in before) != (c in after)}
    if not changed:
        return "match", False
    if all(new == "UTC" and old is not None for old, new in changed.values()):
        return "relabel->UTC (instants preserved)", False
    return "CHANGED {" + ", ".join(f"{c}: {old or 'naive'}->{new or 'naive'}" for c, (old, new) in changed.items()) + "}", True


#: What the log of a run holds of each table.
LOG = "run string, started timestamp, table string, status string, rows_before long, rows_after long, zones string, message string"


def run_log(spark: SparkSession, target: str) -> DataFrame:
    """All runs that wrote to a folder, a row for each table of each run."""
    return spark.read.schema(LOG).json(f"{target.rstrip('/')}/_runs")


def migrate(spark: SparkSession, source: str, target: str, tables: list[str], vocabulary: Vocabulary | None = None, *, kind: str = "parquet", prefix: str = "", skip_existing: bool = True) -> list[dict]:
    """Crosswalk every table of a folder into another; one record each, with figures before and after.

    A table is written to a staging folder, audited there and published by a
    rename, so nobody ever reads half of one or a wrong one: rows, columns,
    types, zones of timestamps and distinct ids must stay the same (a zone may
    become UTC).  Where they do not, what was written is taken away and the
    record says so.  Rows, types and zones are those of the files' footers.
    Each run adds its records to the log (run_log).
    """
    run, started, records = uuid.uuid4().hex, datetime.now(timezone.utc).replace(tzinfo=None), []
    staging = f"{target.rstrip('/')}/_staging-{run}"
    for name in tables:
        old, new = io.table_path(source, name, kind, prefix), io.table_path(target, name, kind, prefix)
        if not io.exists(spark, old):
            records.append({"table": name, "status": "missing"})
        elif skip_existing and io.exists(spark, new):
            records.append({"table": name, "status": "exists"})
        else:
            draft = io.table_path(staging, name, kind, prefix)
            df = io.raw(spark, old, kind)
            io.save(crosswalk(df, vocabulary or vocabulary_of(name)), draft, kind)
            before, after = (io.footers(spark, p, kind) | {"ids": io.summary(io.raw(spark, p, kind))["ids"]} for p in (old, draft))
            zones, concern = zone_status(before.pop("zones"), after.pop("zones"))
            wrong = [k for k in before if k != "types" and before[k] != after[k]]
            kinds = lambda t: {c: k for c, k in t["types"].items() if not k.startswith("timestamp")}
            wrong += ["types"] * (kinds(before) != kinds(after)) + ["zones"] * concern
            if not wrong:
                io.remove(spark, new)
                io.rename(spark, draft, new)
            records.append({"table": name, "status": "failed" if wrong else "done", "before": before, "after": after, "zones": zones, "message": ", ".join(wrong)})
    io.remove(spark, staging)
    rows = [(run, started, r["table"], r["status"], r.get("before", {}).get("rows"), r.get("after", {}).get("rows"), r.get("zones"), r.get("message")) for r in records]
    if rows:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(f"{target.rstrip('/')}/_runs")
    return records
