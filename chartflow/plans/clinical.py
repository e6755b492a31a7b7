"""Queries of the clinical layer and of the checks, over tables of their shape made from the driver's, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..clinical import comorbidity, crosswalk, resistance, sofa, tables
from ..functions import scalars
from ..operators import aggregates, predicates, ranges, reshape, sequences, units
from ..quality import checks, report
from ..quality.schema import ColumnRule, Schema
from ..sources import io, shared
from .queries import _CODE, _CODES, _HOLES, _RAW_UNIT, _doses, _holes, index_sql, query, table

# Tables of the clinical shape: stays, diagnoses, segments of stays, cultures, laboratory values.
_STAYS = """(SELECT o_orderkey AS hospitalization_id, o_custkey AS patient_id, o_orderdate AS admission_dttm, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 90) AS discharge_dttm,
    20 + o_custkey % 60 AS age_at_admission, CASE o_orderstatus WHEN 'F' THEN 'Expired' WHEN 'O' THEN 'Home' END AS discharge_category FROM orders)"""


def _stays(spark, d):
    o = table(spark, d, "orders")
    end = F.expr("o_orderdate + make_interval(0, 0, 0, 0, CAST(o_orderkey % 90 AS INT))")
    category = F.when(F.col("o_orderstatus") == "F", "Expired").when(F.col("o_orderstatus") == "O", "Home")
    return o.select(F.col("o_orderkey").alias("hospitalization_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("admission_dttm"), end.alias("discharge_dttm"), (20 + F.col("o_custkey") % 60).alias("age_at_admission"), category.alias("discharge_category"))


_CODE_OF_LINE = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"
_DIAGNOSES = f"""(SELECT l_orderkey AS hospitalization_id, {_CODE_OF_LINE} AS diagnosis_code, CASE l_linestatus WHEN 'F' THEN 'ICD10CM' ELSE 'ICD9CM' END AS diagnosis_code_format,
    CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS diagnosis_primary, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS poa_present FROM lineitem)"""


def _diagnoses(spark, d):
    r = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("hospitalization_id"), F.expr(_CODE_OF_LINE).alias("diagnosis_code"), F.when(F.col("l_linestatus") == "F", "ICD10CM").otherwise("ICD9CM").alias("diagnosis_code_format"),
        F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("diagnosis_primary"), F.when(r == "R", 1).when(r == "A", 0).alias("poa_present"),
    )


@query(f"""SELECT count(*) AS stays, count(DISTINCT patient_id) AS patients, round(avg(h / 24), 6) AS mean_days, median(h / 24) AS median_days, round(avg(age_at_admission), 6) AS mean_age, min(admission_dttm) AS first, max(discharge_dttm) AS last
    FROM (SELECT *, epoch(discharge_dttm - admission_dttm) / 3600.0 AS h FROM {_STAYS})""")
def stay_summary(spark, d):
    return tables.stay_summary(_stays(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_days", "mean_age")})


@query(f"SELECT round(count(*) FILTER (discharge_category = 'Expired') * 100.0 / count(*), 6) AS mortality_pct FROM {_STAYS}")
def stay_mortality(spark, d):
    return tables.mortality_pct(_stays(spark, d)).withColumn("mortality_pct", F.round("mortality_pct", 6))


@query(f"SELECT patient_id, count(*) AS stays, min(admission_dttm) AS first, max(admission_dttm) AS last FROM {_STAYS} GROUP BY patient_id")
def stays_per_patient(spark, d):
    return tables.stays_per_patient(_stays(spark, d))


@query(f"SELECT count(*) AS n_rows, count(DISTINCT hospitalization_id) AS stays, count(DISTINCT diagnosis_code) AS codes, CAST(sum(diagnosis_primary) AS BIGINT) AS \"primary\", CAST(count(*) FILTER (poa_present = 1) AS BIGINT) AS present_on_admission FROM {_DIAGNOSES}")
def diagnosis_summary(spark, d):
    return tables.diagnosis_summary(_diagnoses(spark, d)).withColumnRenamed("rows", "n_rows")


@query(f"SELECT diagnosis_code, count(*) AS n FROM {_DIAGNOSES} WHERE diagnosis_primary = 1 GROUP BY diagnosis_code ORDER BY n DESC, diagnosis_code LIMIT 5")
def primary_diagnoses(spark, d):
    return tables.primary_diagnoses(_diagnoses(spark, d), 5)


@query(f"SELECT diagnosis_code_format, count(*) AS n_rows, count(DISTINCT diagnosis_code) AS codes, count(DISTINCT hospitalization_id) AS stays FROM {_DIAGNOSES} GROUP BY diagnosis_code_format")
def diagnosis_by_format(spark, d):
    return tables.diagnosis_by_format(_diagnoses(spark, d)).withColumnRenamed("rows", "n_rows")


@query(f"SELECT diagnosis_primary AS \"primary\", count(*) AS n_rows, count(*) FILTER (poa_present = 1) AS present, count(*) FILTER (poa_present = 0) AS absent, count(*) FILTER (poa_present IS NULL) AS unknown FROM {_DIAGNOSES} GROUP BY diagnosis_primary")
def present_on_admission(spark, d):
    return tables.present_on_admission(_diagnoses(spark, d)).withColumnRenamed("rows", "n_rows")


@query(f"SELECT hospitalization_id, count(*) AS n_rows, count(DISTINCT diagnosis_code) AS codes, CAST(sum(diagnosis_primary) AS BIGINT) AS \"primary\" FROM {_DIAGNOSES} GROUP BY hospitalization_id")
def diagnoses_per_stay(spark, d):
    return tables.diagnoses_per_stay(_diagnoses(spark, d)).withColumnRenamed("rows", "n_rows")


@query("SELECT l_linestatus AS position_category, count(*) AS n_rows, count(DISTINCT l_orderkey) AS stays FROM lineitem GROUP BY l_linestatus")
def position_stats(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("position_category"), F.col("l_orderkey").alias("hospitalization_id"))
    return tables.position_stats(p).withColumnRenamed("rows", "n_rows")


@query("""SELECT p_type, string_agg(p_brand || ':' || n, ',' ORDER BY n DESC, p_brand) AS names FROM (
    SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS place FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY p_type, p_brand)) WHERE place <= 4 GROUP BY p_type""")
def category_names(spark, d):
    names = tables.category_names(table(spark, d, "part"), "p_type", "p_brand", most=4)
    return names.select("p_type", F.array_join(F.transform("names", lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))), ",").alias("names"))


_UNITS = ["MG/DL", "mg/dl", "10*3/ul", "K/uL", "mmol/L", None]
_UNIT = "CASE l_linenumber % 6 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_UNITS) if u) + " END"
_LABS = f"(SELECT l_orderkey AS hospitalization_id, CASE WHEN l_partkey % 3 = 0 THEN 'creatinine' WHEN l_partkey % 3 = 1 THEN 'platelet_count' ELSE 'sodium' END AS lab_category, {_UNIT} AS reference_unit FROM lineitem)"


def _labs(spark, d):
    k = F.col("l_partkey") % 3
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hospitalization_id"), F.when(k == 0, "creatinine").when(k == 1, "platelet_count").otherwise("sodium").alias("lab_category"), F.expr(_UNIT).alias("reference_unit"))


@query(f"SELECT lab_category, reference_unit, count(*) AS n FROM {_LABS} GROUP BY ALL")
def lab_reference_units(spark, d):
    return tables.reference_units(_labs(spark, d))


# mg/dL has spellings of the case alone; 10*3/uL is also written K/uL.
@query(f"""SELECT lab_category, CASE WHEN lab_category = 'creatinine' AND lower(reference_unit) = 'mg/dl' THEN 'mg/dL' WHEN lab_category = 'sodium' AND lower(reference_unit) = 'mmol/l' THEN 'mmol/L' ELSE reference_unit END AS reference_unit, count(*) AS n FROM {_LABS} GROUP BY ALL""")
def lab_standard_units(spark, d):
    out = tables.standard_units(_labs(spark, d), {"creatinine": ["mg/dL"], "sodium": ["mmol/L"]})
    return out.groupBy("lab_category", "reference_unit").agg(F.count("*").alias("n"))


_SEGMENTS = "(SELECT o_custkey AS hospitalization_id, o_orderdate AS in_dttm, o_orderdate + INTERVAL 30 DAY AS out_dttm, CASE o_orderstatus WHEN 'F' THEN 'icu' WHEN 'O' THEN 'ward' END AS location_category, o_orderkey FROM orders)"


@query(f"""SELECT DISTINCT hospitalization_id FROM (SELECT *, lead(in_dttm) OVER w AS i, lead(location_category) OVER w AS p FROM (SELECT hospitalization_id, in_dttm, min(out_dttm) AS out_dttm, min(location_category) AS location_category FROM {_SEGMENTS} GROUP BY ALL)
    WINDOW w AS (PARTITION BY hospitalization_id ORDER BY in_dttm)) WHERE out_dttm > i AND coalesce(location_category <> p, TRUE)""")
def overlapping_admissions(spark, d):
    o = table(spark, d, "orders")
    place = F.when(F.col("o_orderstatus") == "F", "icu").when(F.col("o_orderstatus") == "O", "ward")
    adt = o.select(F.col("o_custkey").alias("hospitalization_id"), F.col("o_orderdate").alias("in_dttm"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("out_dttm"), place.alias("location_category"))
    one = adt.groupBy("hospitalization_id", "in_dttm").agg(F.min("out_dttm").alias("out_dttm"), F.min("location_category").alias("location_category"))
    return tables.overlapping_admissions(one)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch(o_orderdate - l_shipdate) >= 60 OR epoch(l_shipdate - (o_orderdate + INTERVAL 60 DAY)) >= 60")
def culture_times(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cultures = both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o_orderdate").alias("order_dttm"), F.col("l_shipdate").alias("collect_dttm"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("result_dttm"))
    return tables.culture_times_out_of_order(cultures).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# Three groups of two agents each; a culture is an order, its tests are its lines.
_AGENTS = {"a": ["a1", "a2"], "b": ["b1", "b2"], "c": ["c1", "c2"]}
_AGENT = "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(x for g in _AGENTS.values() for x in g)) + " END"
_RESULT = "CASE l_returnflag WHEN 'R' THEN 'non_susceptible' WHEN 'A' THEN 'intermediate' ELSE 'susceptible' END"
_RESISTANCE = f"""WITH t AS (SELECT o_custkey AS hospitalization_id, o_orderkey AS organism_id, {_AGENT} AS agent, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS place FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
    w AS (SELECT hospitalization_id, organism_id, agent, min(place) AS place FROM t GROUP BY ALL),
    g AS (SELECT hospitalization_id, organism_id,
        {", ".join(f"coalesce(max(CASE WHEN agent = '{x}' THEN CASE place WHEN 1 THEN 'non_susceptible' WHEN 2 THEN 'intermediate' ELSE 'susceptible' END END), 'not_tested') AS {x}" for g in _AGENTS.values() for x in g)},
        {", ".join(f"coalesce(max(CASE WHEN agent IN ('{g[0]}', '{g[1]}') AND place < 3 THEN 1 ELSE 0 END), 0) AS {k}" for k, g in _AGENTS.items())},
        count(*) FILTER (agent IS NOT NULL AND place < 3) AS bad, CAST(count(*) FILTER (agent IN ('a1', 'b1') AND place < 3) = 2 AS INTEGER) AS DTR FROM w GROUP BY ALL)
    SELECT * EXCLUDE (bad, DTR), a + b + c AS n_resistant_groups, CAST(a + b + c >= 2 AS INTEGER) AS MDR, CAST(a + b + c >= 2 AS INTEGER) AS XDR, CAST(bad = 6 AS INTEGER) AS PDR, DTR FROM g"""


@query(_RESISTANCE)
def resistance_flags(spark, d):
    o = resistance.Organism(_AGENTS, ["a1", "b1"], min_groups=2, max_susceptible=1)
    cultures = table(spark, d, "orders").select(F.col("o_custkey").alias("hospitalization_id"), F.col("o_orderkey").alias("organism_id"), F.lit("x").alias("organism_category"))
    tests = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("organism_id"), F.expr(_AGENT).alias("antimicrobial_category"), F.expr(_RESULT).alias("susceptibility_category"))
    return resistance.flags(cultures, tests, "x", organisms={"x": o})


@query(index_sql(comorbidity.ELIXHAUSER, "elix_score"))
def elixhauser_index(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("hospitalization_id"), F.expr(_CODE).alias("diagnosis_code"), F.when(F.col("event_type") == "view", "ICD9CM").otherwise("ICD10CM").alias("diagnosis_code_format"))
    return comorbidity.elixhauser(rows)


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def value_counts(spark, d):
    return aggregates.value_counts(table(spark, d, "events"), ["event_type"], F.col("ts"))


@query("SELECT 'events' AS kind, (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) AS most")
def most_common_value(spark, d):
    return spark.range(1).select(F.lit("events").alias("kind"), F.lit(aggregates.most_common(table(spark, d, "events"), "event_type", "none")).alias("most"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts)) AS n_same FROM events")
def same_time_count(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return sequences.same_time_count(e, ["user_id", "hour"]).select("user_id", "event_id", "n_same")


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN CAST(value AS VARCHAR) END, event_type) AS v FROM (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS value FROM events)")
def coalesced_value(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_type") == "view", F.floor("value")).alias("value"))
    return e.select("event_id", reshape.coalesced_value("value", "event_type").alias("v"))


# Checks: findings as rows.


def _found(spark, findings, *codes):
    rows = checks.as_table(spark, [f for f in findings if not codes or f.code in codes])
    return rows.select("code", F.coalesce("column", F.lit("")).alias("column"), "severity", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("of", F.lit(0)).alias("n"))


def _level(bad: str, of: str, warning: float, error: float, over: str = ">") -> str:
    share = f"({bad}) * 100.0 / nullif({of}, 0)"
    return f"CASE WHEN ({bad}) = 0 THEN 'pass' WHEN {share} {over} {error} THEN 'error' WHEN {share} {over} {warning} THEN 'warning' ELSE 'pass' END"


_EVENTS = Schema("events", [ColumnRule("event_id", "INTEGER", True), ColumnRule("user_id", "INTEGER", True), ColumnRule("v", "DOUBLE"), ColumnRule("ts", "DATETIME", True), ColumnRule("place", "VARCHAR", True), ColumnRule("event_type", "INTEGER")])


# What the columns are is read from the table; so is whether values of another type can be converted.
_CONFORMANCE = f"""WITH rules(i, name, kind, required) AS (VALUES (1, 'event_id', 'INTEGER', TRUE), (2, 'user_id', 'INTEGER', TRUE), (3, 'v', 'DOUBLE', FALSE), (4, 'ts', 'DATETIME', TRUE), (5, 'place', 'VARCHAR', TRUE), (6, 'event_type', 'INTEGER', FALSE)),
    have AS (SELECT column_name AS name, column_type AS type FROM (DESCRIBE SELECT * FROM {_HOLES})),
    judged AS (SELECT r.*, h.type, CASE kind WHEN 'INTEGER' THEN type IN ('INTEGER', 'BIGINT', 'SMALLINT', 'TINYINT') WHEN 'DOUBLE' THEN type IN ('DOUBLE', 'FLOAT') OR type LIKE 'DECIMAL%' WHEN 'DATETIME' THEN type LIKE 'TIMESTAMP%' ELSE type = 'VARCHAR' END AS fits FROM rules r LEFT JOIN have h USING (name)),
    texts AS (SELECT count(event_type) AS n, count(try_cast(event_type AS BIGINT)) AS whole FROM {_HOLES})
    SELECT 'C.1' AS code, '' AS "column", CASE WHEN count(*) = 0 THEN 'error' ELSE 'pass' END AS severity FROM {_HOLES}
    UNION ALL SELECT 'C.2', name, CASE WHEN type IS NULL THEN 'error' ELSE 'pass' END FROM judged WHERE required
    UNION ALL SELECT 'C.3', name, CASE WHEN fits OR n = 0 THEN 'pass' WHEN n = whole THEN 'warning' ELSE 'error' END FROM judged, texts WHERE type IS NOT NULL
    UNION ALL SELECT 'C.4', name, CASE WHEN fits THEN 'pass' ELSE 'warning' END FROM judged WHERE type IS NOT NULL AND kind = 'DATETIME'"""


@query(_CONFORMANCE)
def dqa_conformance(spark, d):
    return _found(spark, checks.conformance(_holes(spark, d), _EVENTS)).select("code", "column", "severity")


@query(f"""SELECT 'K.1' AS code, c AS "column", {_level("bad", "n", 10, 50, ">=")} AS severity, bad, n FROM (
    SELECT 'event_id' AS c, count(*) FILTER (event_id IS NULL) AS bad, count(*) AS n FROM {_HOLES} UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL), count(*) FROM {_HOLES} UNION ALL
    SELECT 'ts', count(*) FILTER (ts IS NULL), count(*) FROM {_HOLES} UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), count(*) FROM {_HOLES} UNION ALL SELECT 'v', count(*) FILTER (v IS NULL), count(*) FROM {_HOLES})""")
def dqa_missingness(spark, d):
    return _found(spark, checks.one_pass(_holes(spark, d), _EVENTS), "K.1").withColumn("n", F.lit(0) + F.col("n"))


@query(f"""SELECT 'K.2' AS code, 'v' AS "column", {_level("bad", "n", 0, 101)} AS severity, bad, n FROM (SELECT count(*) FILTER (event_type = 'purchase' AND v IS NULL) AS bad, count(*) FILTER (event_type = 'purchase') AS n FROM {_HOLES})""")
def dqa_conditional(spark, d):
    s = Schema("events", [ColumnRule("v", "DOUBLE")], conditions=[("a purchase has a value", "event_type = 'purchase'", "v")])
    return _found(spark, checks.one_pass(_holes(spark, d), s), "K.2")


_LINES = "(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _lines(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"""SELECT 'P.1' AS code, 'o_orderdate - l_shipdate' AS "column", {_level("bad", "n", 0, 10)} AS severity, bad, n FROM (SELECT count(*) FILTER (o_orderdate > l_shipdate) AS bad, count(*) FILTER (o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL) AS n FROM {_LINES})""")
def dqa_chronology(spark, d):
    return _found(spark, checks.one_pass(_lines(spark, d), Schema("lines", [], order=[("o_orderdate", "l_shipdate", False)])), "P.1")


@query(f"""SELECT 'P.3' AS code, '' AS "column", {_level("bad", "n", 0, 101)} AS severity, bad, n FROM (SELECT count(*) FILTER (l_returnflag = 'N' AND NOT l_linestatus = 'O') AS bad, count(*) FILTER (l_returnflag = 'N') AS n FROM lineitem)""")
def dqa_plausible(spark, d):
    return _found(spark, checks.one_pass(table(spark, d, "lineitem"), Schema("lines", [], plausible=[("new lines are open", "l_returnflag = 'N'", "l_linestatus = 'O'")])), "P.3")


_RATE = f"regexp_matches(lower({_RAW_UNIT}), '/(sec|min|hr|hour|day)')"


@query(" UNION ALL ".join(f"""SELECT '{t}' AS kind, 'P.4' AS code, 'med_dose_unit' AS "column", {_level("bad", "n", 0, 101)} AS severity, bad, n FROM (SELECT count(*) FILTER ({wrong}) AS bad, count(*) AS n FROM lineitem)""" for t, wrong in (("medication_admin_continuous", f"NOT {_RATE}"), ("medication_admin_intermittent", _RATE))))
def dqa_dose_units(spark, d):
    """Continuous doses need a unit of time, others must not have one."""
    parts = [_found(spark, checks.one_pass(_doses(spark, d), Schema(t, [])), "P.4").withColumn("kind", F.lit(t)) for t in ("medication_admin_continuous", "medication_admin_intermittent")]
    return parts[0].unionByName(parts[1])


@query("SELECT lower(l_returnflag) AS category, lower(l_linestatus) AS grp, count(*) AS n FROM lineitem WHERE (l_returnflag = 'N' AND l_linestatus <> 'O') OR (l_returnflag <> 'N' AND l_linestatus <> 'F') GROUP BY ALL")
def dqa_group_mapping(spark, d):
    return checks.group_faults(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", {"N": "O", "R": "F", "A": "F"}).withColumnRenamed("group", "grp")


@query(f"""SELECT lab_category AS category, reference_unit AS unit, count(*) AS n, NOT coalesce(lower(reference_unit) = 'mg/dl', lab_category = 'sodium') AS fault
    FROM {_LABS} WHERE lab_category IN ('creatinine', 'sodium') AND NOT coalesce(lab_category = 'creatinine' AND reference_unit = 'mg/dL', FALSE) AND NOT (lab_category = 'sodium' AND coalesce(reference_unit = 'mmol/L', TRUE)) GROUP BY ALL""")
def dqa_units(spark, d):
    out = checks.unit_faults(_labs(spark, d), "lab_category", "reference_unit", {"creatinine": ["mg/dL"], "sodium": ["mmol/L", "mg/dl", "(no units)"]})
    return out


@query("""WITH words(w) AS (VALUES ('click'), ('error'), ('view'), ('refund')), seen AS (SELECT DISTINCT lower(trim(event_type)) AS w FROM events WHERE event_type IS NOT NULL),
    u AS (SELECT count(*) AS n FROM seen WHERE w NOT IN (SELECT w FROM words)), m AS (SELECT count(*) AS n, (SELECT count(*) FROM words) AS total FROM words WHERE w NOT IN (SELECT w FROM seen))
    SELECT 'C.5' AS code, 'event_type' AS "column", CASE WHEN n > 0 THEN 'warning' ELSE 'pass' END AS severity, 1 AS total, CAST(n = 0 AS INTEGER) AS passed FROM u
    UNION ALL SELECT 'K.3', 'event_type', CASE WHEN n > 0 THEN 'error' ELSE 'pass' END, CAST(total AS INTEGER), CAST(total - n AS INTEGER) FROM m""")
def dqa_vocabulary(spark, d):
    s = Schema("events", [ColumnRule("event_type", "VARCHAR", category=True, values=["click", "error", "view", "refund"])])
    return spark.createDataFrame([(f.code, f.column, f.severity, f.total, f.passed) for f in checks.vocabulary(table(spark, d, "events"), s)], "code string, column string, severity string, total int, passed int")


_RULES = [("click", 5.0, 60.0), ("error", 1.0, 40.0), ("purchase", 10.0, 80.0)]


@query(" UNION ALL ".join(f"""SELECT 'P.2' AS code, 'value, {t}' AS "column", {_level("bad", "n", 0, 10)} AS severity, bad, n FROM (SELECT count(*) FILTER (value < {a} OR value > {b}) AS bad, count(value) AS n FROM events WHERE event_type = '{t}') WHERE bad > 0""" for t, a, b in _RULES))
def dqa_ranges(spark, d):
    return _found(spark, checks.numeric_ranges(table(spark, d, "events"), Schema("events", [], ranges=[("value", ["event_type"], _RULES)])), "P.2")


@query("""SELECT category, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS years FROM (SELECT c.category, y.y FROM (SELECT DISTINCT o_custkey AS category FROM orders) c, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) y
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.category AND year(o.o_orderdate) = y.y)) GROUP BY category""")
def dqa_absent_years(spark, d):
    o = table(spark, d, "orders")
    return checks.absent_years(o, "o_custkey", "o_orderdate", "o_orderkey").select("category", F.array_join(F.array_sort(F.transform("years", lambda y: y.cast("string"))), ",").alias("years"))


@query(f"""SELECT 'K.5' AS code, 'o_custkey' AS "column", {_level("bad", "n", 0, 101)} AS severity, bad, n FROM (SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = k.o_custkey AND o.o_orderstatus = 'O')) AS bad, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) k)""")
def dqa_across(spark, d):
    o = table(spark, d, "orders")
    open_ = o.select("o_custkey", F.when(F.col("o_orderstatus") == "O", 1).alias("open"))
    return _found(spark, checks.across({"a": o, "b": open_}, [("a", "o_totalprice > 300000", "b", "o_custkey", "open")]), "K.5")


@query("""WITH w AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN value / 20 END) AS bilirubin, min(CASE WHEN event_type = 'view' THEN 3 + event_id % 13 END) AS gcs, min(CASE WHEN event_type = 'error' THEN value * 8 END) AS po2, max(CASE WHEN event_type = 'purchase' THEN least(0.21 + value / 200, 1.0) END) AS fio2,
        min(CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE 7 END END) AS device FROM events GROUP BY user_id),
    s AS (SELECT user_id, po2 / fio2 AS p_f,
        CASE WHEN bilirubin >= 12 THEN 4 WHEN bilirubin >= 6 THEN 3 WHEN bilirubin >= 2 THEN 2 WHEN bilirubin >= 1.2 THEN 1 ELSE 0 END AS sofa_liver,
        CASE WHEN gcs < 6 THEN 4 WHEN gcs BETWEEN 6 AND 9 THEN 3 WHEN gcs BETWEEN 10 AND 12 THEN 2 WHEN gcs BETWEEN 13 AND 14 THEN 1 ELSE 0 END AS sofa_cns,
        CASE WHEN po2 / fio2 < 100 AND device <= 3 THEN 4 WHEN po2 / fio2 >= 100 AND po2 / fio2 < 200 AND device <= 3 THEN 3 WHEN po2 / fio2 >= 200 AND po2 / fio2 < 300 THEN 2 WHEN po2 / fio2 >= 300 AND po2 / fio2 < 400 THEN 1 ELSE 0 END AS sofa_resp FROM w)
    SELECT user_id, round(p_f, 6) AS p_f, sofa_liver, sofa_cns, sofa_resp, sofa_liver + sofa_cns + sofa_resp AS sofa_total FROM s""")
def organ_scores_other(spark, d):
    e, v, t, i = table(spark, d, "events"), F.col("value"), F.col("event_type"), F.col("event_id")
    wide = e.select(
        "user_id", F.col("ts").alias("event_time"), F.when(t == "click", v / 20).alias("bilirubin_total"), F.when(t == "view", (3 + i % 13).cast("double")).alias("gcs_total"), F.when(t == "error", v * 8).alias("po2_arterial"),
        F.when(t == "purchase", F.least(0.21 + v / 200, F.lit(1.0))).alias("fio2_set"), F.when(t == "signup", F.when(i % 2 == 0, "IMV").otherwise("Nasal Cannula")).alias("device_category"),
    )
    return sofa.from_wide(wide, id_col="user_id", remove_outliers=False).select("user_id", F.round("p_f", 6).alias("p_f"), "sofa_liver", "sofa_cns", "sofa_resp", "sofa_total")


_EVENT_CATEGORY = "lower(trim(CASE event_type WHEN 'click' THEN 'Click / Tap' WHEN 'view' THEN 'page-view' ELSE upper(event_type) END))"


@query(f"""SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'fault' ELSE trim(regexp_replace(regexp_replace(replace(replace({_EVENT_CATEGORY}, '&', '_and_'), '/', '_or_'), '[ \\-,()]', '_', 'g'), '_+', '_', 'g'), '_') END AS event_category FROM events""")
def migrated_table(spark, d):
    """Events written as a table of a folder, migrated to another folder through a vocabulary, audited, published and read back."""
    folder = shared.fresh_folder(spark, "migration")
    category = F.when(F.col("event_type") == "click", "Click / Tap").when(F.col("event_type") == "view", "page-view").otherwise(F.upper("event_type"))
    io.save(table(spark, d, "events").select("event_id", "ts", category.alias("event_category")), io.table_path(f"{folder}/old", "events"))
    done = crosswalk.migrate(spark, f"{folder}/old", f"{folder}/new", ["events"], crosswalk.Vocabulary({"event_category": {"ERROR": "fault"}}, {}))
    if [r["status"] for r in done] != ["done"]:
        raise RuntimeError(f"the audit failed: {done}")
    return io.raw(spark, io.table_path(f"{folder}/new", "events"))


_ZONE = "America/New_York"
_LOCAL = f"timezone('{_ZONE}', timezone('UTC', ts))"


@query(f"""SELECT event_id, {_LOCAL} AS local_ts, strftime({_LOCAL}, '%Y%m%d%H%M') AS minute, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST({_LOCAL} AS DATE)) AS day_number FROM events""")
def local_times(spark, d):
    """The wall clock of a site that is not in the session's zone, its minutes and its days."""
    e = sequences.day_number(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", _ZONE)
    return e.select("event_id", scalars.site_local(F.col("ts"), _ZONE).alias("local_ts"), scalars.minute_key(F.col("ts"), _ZONE).alias("minute"), F.col("day_number").cast("long").alias("day_number"))


_IDS = {
    "customer": {"customer_id": "c_custkey"}, "orders": {"order_id": "o_orderkey", "customer_id": "o_custkey"}, "events": {"customer_id": "user_id"}, "part": {"part_id": "p_partkey"}, "supplier": {"supplier_id": "s_suppkey"},
    "lineitem": {"order_id": "l_orderkey", "part_id": "l_partkey", "supplier_id": "l_suppkey"},
}
_LINKS = [("orders", "customer", "customer_id"), ("events", "customer", "customer_id"), ("events", "orders", "customer_id"), ("lineitem", "orders", "order_id"), ("lineitem", "part", "part_id"), ("lineitem", "supplier", "supplier_id")]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS child, '{p}' AS parent, '{k}' AS key, count(c) AS child_ids, count(*) FILTER (p IS NULL) AS orphans, count(p) AS parent_ids, count(*) FILTER (c IS NULL) AS unused
    FROM (SELECT DISTINCT {_IDS[c][k]} AS c FROM {c}) FULL JOIN (SELECT DISTINCT {_IDS[p][k]} AS p FROM {p}) ON c = p""" for c, p, k in _LINKS))
def dqa_all_links(spark, d):
    tables_ = {t: table(spark, d, t).select(*(F.col(c).alias(k) for k, c in ids.items())) for t, ids in _IDS.items()}
    return checks.links_between(tables_, _LINKS)


_CELLS = """WITH e AS (SELECT user_id, strftime(ts, '%H:%M') AS minute FROM events), s AS (SELECT user_id, minute, count(*) AS o FROM e GROUP BY ALL), r AS (SELECT user_id, sum(o) AS r FROM s GROUP BY ALL), c AS (SELECT minute, sum(o) AS c FROM s GROUP BY ALL), n AS (SELECT sum(o) AS n FROM s),
    x AS (SELECT user_id, minute, CAST(coalesce(o, 0) AS BIGINT) AS observed, CAST(r AS BIGINT) * CAST(c AS BIGINT) / CAST(n AS BIGINT) AS expected FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN s USING (user_id, minute)),
    y AS (SELECT *, (observed - expected) / sqrt(expected) AS residual FROM x),
    z AS (SELECT 'positive' AS side, row_number() OVER (ORDER BY residual DESC, user_id, minute) AS place, * FROM y UNION ALL SELECT 'negative', row_number() OVER (ORDER BY residual, user_id, minute), * FROM y)
    SELECT side, CAST(place AS INTEGER) AS place, user_id, minute, observed, round(expected, 6) AS expected, round(residual, 6) AS residual FROM z WHERE place <= 25"""


@query(_CELLS)
def residual_extremes(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "HH:mm").alias("minute"))
    return aggregates.extreme_residuals(e, "user_id", "minute", 25).withColumns({c: F.round(c, 6) for c in ("expected", "residual")})


_STATED = [("event_id", "INT"), ("user_id", "INTEGER"), ("ts", "DATETIME"), ("event_type", "VARCHAR"), ("value", "DOUBLE")]
_SHOWN = {"INT": "CAST({f}({c}) AS VARCHAR)", "INTEGER": "CAST({f}({c}) AS VARCHAR)", "DATETIME": "strftime({f}({c}), '%Y-%m-%d %H:%M')", "VARCHAR": "CAST(NULL AS VARCHAR)", "DOUBLE": "CAST({f}({c}) AS VARCHAR)"}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, round_even(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 1) AS null_pct, count(DISTINCT {c}) AS "unique",
    {_SHOWN[k].format(f="min", c=c)} AS min, {_SHOWN[k].format(f="max", c=c)} AS max FROM events HAVING count(*) > 0""" for c, k in _STATED))
def table_statistics(spark, d):
    return report.table_statistics(table(spark, d, "events"), Schema("events", [ColumnRule(c, k) for c, k in [*_STATED, ("absent", "DOUBLE")]]))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS "distinct" FROM lineitem""" for c in ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")))
def column_figures(spark, d):
    return aggregates.column_figures(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]).drop("i")


# Generic operators that no query above runs.


@query("SELECT event_id, CASE WHEN value BETWEEN 20 AND 70 THEN value END AS value FROM events")
def clamp_columns(spark, d):
    return ranges.clamp_columns(table(spark, d, "events").select("event_id", "value"), {"value": (20.0, 70.0)}).select("event_id", "value")


_DOSE_RULES = [("click", "mg", 5.0, 60.0), ("click", "g", 1.0, 20.0), ("view", "mg", 30.0, 90.0)]


@query("SELECT event_id, " + "CASE " + " ".join(f"WHEN event_type = '{c}' AND unit = '{u}' AND (value < {a} OR value > {b}) THEN NULL" for c, u, a, b in _DOSE_RULES) + " ELSE value END AS value FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'mg' ELSE 'g' END AS unit FROM events)")
def outlier_null_by_unit(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value", F.when(F.col("event_id") % 2 == 0, "mg").otherwise("g").alias("unit"))
    return ranges.clamp_by_rule(e, "value", ["event_type", "unit"], _DOSE_RULES).select("event_id", "value")


@query(f"SELECT event_id FROM (SELECT *, CASE WHEN event_type = 'click' THEN user_id END AS u FROM {_HOLES}) WHERE v IS NOT NULL OR u IS NOT NULL")
def any_present(spark, d):
    h = _holes(spark, d).withColumn("u", F.when(F.col("event_type") == "click", F.col("user_id")))
    return predicates.present(h, ["v", "u"]).select("event_id")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def entity_filter(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return predicates.of_entities(table(spark, d, "events").select("event_id", "user_id"), rich, "user_id")


@query("SELECT CAST(least(20, count(DISTINCT user_id)) AS INTEGER) AS users, count(*) > 0 AS some FROM events")
def entity_sample(spark, d):
    e = table(spark, d, "events")
    return predicates.sample_entities(e, "user_id", 20).agg(F.count_distinct("user_id").cast("int").alias("users"), (F.count("*") > 0).alias("some"))


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS {t}" for t in ("click", "view")) + " FROM events GROUP BY user_id")
def long_to_wide(spark, d):
    return reshape.long_to_wide(table(spark, d, "events"), ["user_id"], "event_type", F.lit(1), ["click", "view"], 0).select("user_id", "click", "view")


@query("SELECT event_id, value, CAST(NULL AS DOUBLE) AS map, CAST(NULL AS DOUBLE) AS spo2 FROM events")
def missing_columns(spark, d):
    return reshape.with_columns(table(spark, d, "events").select("event_id", "value"), ["value", "map", "spo2"])


@query("SELECT event_id, CAST(v AS DOUBLE) AS v, t FROM (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN CAST(event_id AS VARCHAR) END AS v, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'x' END AS t FROM events)")
def numeric_columns(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(i % 50 > 0, i.cast("string")).alias("v"), F.when(i % 2 == 0, i.cast("string")).otherwise("x").alias("t"))
    return reshape.numeric_columns(e, ["v", "t"])


# A dose by weight without a weight keeps its number, and its unit is still one of mass and time.
@query(f"""SELECT {_RAW_UNIT} AS med_dose_unit, CASE l_linenumber % 6 WHEN 2 THEN 'cannot convert unit to mass' WHEN 3 THEN 'cannot convert amount to rate' WHEN 5 THEN 'original unit puffs is not recognized' ELSE 'success' END AS status, count(*) AS n
    FROM lineitem GROUP BY ALL""")
def conversion_counts(spark, d):
    _, counts = units.convert_doses(_doses(spark, d), None, {"x": "mg/hr"})
    return counts.groupBy("med_dose_unit", F.col("_convert_status").alias("status")).agg(F.sum("count").alias("n"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 1000 / 60 / w WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity / 1000 / w ELSE l_quantity * 2.20462 END, 3) AS dose
    FROM (SELECT *, 50 + l_discount * 100 AS w FROM lineitem)""")
def direct_dose(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (50 + F.col("l_discount") * 100).alias("w"))
    k = F.col("l_linenumber") % 4
    unit = F.when(k == 0, "mg / hr").when(k == 1, "mcg/kg/min").when(k == 2, "ng/min").otherwise("mcg/lb/min")
    dose = sofa.dose_per_kg_minute(F.col("l_quantity"), unit, F.col("w"))
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(dose, 3).alias("dose"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 9 ELSE 0 END AS rank FROM events")
def device_rank(spark, d):
    k = F.col("event_id") % 4
    device = F.when(k == 0, "IMV").when(k == 1, "Nasal Cannula").when(k == 2, "Room Air").otherwise("imv")
    return table(spark, d, "events").select("event_id", F.coalesce(sofa.device_rank(device), F.lit(0)).alias("rank"))


@query("""SELECT event_id, datediff('day', TIMESTAMP '2024-01-01', ts) AS days, try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS n, strftime(ts, '%Y%m%d%H%M') AS minute, CAST(event_id AS VARCHAR) AS id, lower(trim(' ' || upper(event_type) || ' ')) AS t FROM events""")
def scalar_forms(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select(
        "event_id", scalars.day_difference(F.col("ts"), F.lit("2024-01-01").cast("timestamp")).alias("days"), scalars.number(F.when(i % 3 == 0, "x").otherwise(i.cast("string"))).alias("n"), scalars.minute_key(F.col("ts")).alias("minute"),
        scalars.id_string(i.cast("double"), "double").alias("id"), scalars.for_validation(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).alias("t"),
    )


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, value FROM events WHERE value > 90")
def file_round_trip(spark, d):
    """Written by the rule of names and read back with the columns asked for."""
    place = shared.fresh_folder(spark, "round-trip")
    io.save(table(spark, d, "events").where("value > 90"), io.table_path(place, "events"))
    return io.read_table(spark, place, "events").select("event_id", "user_id", "value")
