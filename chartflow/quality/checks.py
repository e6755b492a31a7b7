"""The twenty checks, by code.  Each gives findings; what can be counted in one pass is counted in one pass."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import intervals, ranges
from .schema import KINDS, SPARK, Schema

#: Values that a finding names; it counts all of them.
SHOWN = 10
#: Findings of one kind that come one by one; a last one counts the rest, and the table of faults holds them all.
LISTED = 1000
#: A warning from any, never an error.
ANY = (0.0, 101.0)


@dataclass(frozen=True)
class Thresholds:
    """Shares in per cent from which a finding is a warning and an error."""

    missing: tuple[float, float] = (10.0, 50.0)
    broken: tuple[float, float] = (0.0, 10.0)
    orphans: tuple[float, float] = (1.0, 10.0)


DEFAULT = Thresholds()


@dataclass
class Finding:
    code: str
    table: str
    check: str
    severity: str  # error, warning, info or pass
    column: str | None = None
    message: str = ""
    metrics: dict = field(default_factory=dict)
    total: int = 1
    passed: int = 1

    def record(self) -> dict:
        return asdict(self)


def _level(share: float, bounds: tuple[float, float], inclusive: bool = False) -> str:
    over = (lambda b: share >= b) if inclusive else (lambda b: share > b)
    return "error" if over(bounds[1]) else "warning" if over(bounds[0]) else "pass"


def _grade(code: str, table: str, check: str, bad: int, of: int, bounds: tuple[float, float], column: str | None = None, inclusive: bool = False, **metrics) -> Finding:
    share = bad * 100.0 / of if of else 0.0
    severity = _level(share, bounds, inclusive) if bad else "pass"
    return Finding(code, table, check, severity, column, f"{bad:,} of {of:,} rows ({share:.1f}%)" if bad else "", {"bad": bad, "of": of, "pct": share, **metrics}, 1, int(severity == "pass"))


def conformance(df: DataFrame, s: Schema) -> list[Finding]:
    """C.1 to C.4: presence, required columns, types, times.  Only a type that does not fit reads rows, all of them."""
    out = []
    empty = not df.columns or not df.limit(1).count()
    out.append(Finding("C.1", s.table, "presence", "error" if empty else "pass", message="no rows" if empty else "", passed=int(not empty)))
    have = {f.name: f.dataType for f in df.schema}
    for c in s.columns:
        if c.required:
            ok = c.name in have
            out.append(Finding("C.2", s.table, "required column", "pass" if ok else "error", c.name, "" if ok else "missing", passed=int(ok)))
        if c.name not in have:
            continue
        if not isinstance(have[c.name], KINDS[c.kind]):
            cast = df.agg(F.count(c.name).alias("n"), F.count(F.col(c.name).cast("string").try_cast(SPARK[c.kind])).alias("ok")).first()
            whole = c.kind in ("INT", "INTEGER") and isinstance(have[c.name], KINDS["DOUBLE"]) and df.agg(F.bool_and(F.col(c.name) == F.floor(c.name))).first()[0]
            severity = "pass" if not cast["n"] or whole else "warning" if cast["n"] == cast["ok"] else "error"
            out.append(Finding("C.3", s.table, "type", severity, c.name, f"{have[c.name].simpleString()} for {c.kind}" if severity != "pass" else "", passed=int(severity == "pass")))
        else:
            out.append(Finding("C.3", s.table, "type", "pass", c.name))
        if c.kind == "DATETIME":
            ok = isinstance(have[c.name], KINDS["DATETIME"])
            out.append(Finding("C.4", s.table, "time", "pass" if ok else "warning", c.name, "" if ok else "no instant", passed=int(ok)))
    return out


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (trimmed, lower case), original and n for all category columns: one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("original")) for c in columns)))
    rows = df.select(pairs.alias("p")).where("p.original IS NOT NULL").groupBy("p.column", "p.original").agg(F.count("*").alias("n"))
    return rows.withColumn("value", scalars.for_validation(F.col("original")))


def vocabulary(df: DataFrame, s: Schema) -> list[Finding]:
    """C.5 values outside the vocabulary, K.3 values of the vocabulary never seen."""
    rules = {c.name: c for c in s.columns if c.category and c.values and c.name in df.columns}
    if not rules:
        return []
    allowed = [(c, v.strip().lower(), True) for c, r in rules.items() for v in r.values]
    known = df.sparkSession.createDataFrame(allowed, "column string, value string, known boolean").distinct()
    both = category_counts(df, list(rules)).join(known, ["column", "value"], "full")
    wrong, unseen = F.col("known").isNull(), F.col("n").isNull()
    place = F.row_number().over(Window.partitionBy("column", wrong).orderBy(F.col("n").desc_nulls_last(), "original"))
    both = both.withColumn("place", place).groupBy("column").agg(
        F.sum(F.when(wrong, F.col("n"))).alias("n"), F.count_if(wrong).alias("kinds"),
        F.array_sort(F.collect_list(F.when(wrong & (F.col("place") <= SHOWN), F.struct("place", "n", "original")))).alias("top"),
        F.array_sort(F.collect_set(F.when(unseen, F.col("value")))).alias("unseen"),
    )
    rows = {r["column"]: r for r in both.collect()}
    bad = {c: r for c, r in rows.items() if r["kinds"]}
    missing = {c: r["unseen"] for c, r in rows.items()}
    out = []
    for c, r in rules.items():
        b, m = bad.get(c), missing.get(c, [])
        out.append(Finding("C.5", s.table, "vocabulary", "warning" if b else "pass", c, f"{b['kinds']} unknown values" if b else "", {"n": b["n"], "top": [(x["original"], x["n"]) for x in b["top"]]} if b else {}, passed=int(not b)))
        out.append(Finding("K.3", s.table, "coverage", "error" if m else "pass", c, ", ".join(m[:SHOWN]), {"unseen": m}, len(r.values), len(r.values) - len(m)))
    return out


def group_faults(df: DataFrame, category: str, group: str, mapping: dict[str, str]) -> DataFrame:
    """category, group and n of all rows whose category stands with another group than its own."""
    t = F.broadcast(df.sparkSession.createDataFrame([(k.lower(), v.lower()) for k, v in mapping.items()], "category string, own string"))
    rows = df.select(scalars.for_validation(F.col(category)).alias("category"), scalars.for_validation(F.col(group)).alias("group")).where("category IS NOT NULL AND group IS NOT NULL")
    return rows.join(t, "category").where("group <> own").groupBy("category", "group").agg(F.count("*").alias("n"))


def _most(faults: DataFrame, by: str, name: str) -> DataFrame:
    """by, kinds, n and the SHOWN most frequent of each key's faults."""
    ranked = faults.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), name)))
    top = F.array_sort(F.collect_list(F.when(F.col("_place") <= SHOWN, F.struct("_place", F.col(name).alias("name"), "n"))))
    return ranked.groupBy(by).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), top.alias("top"))


def group_mapping(df: DataFrame, s: Schema) -> list[Finding]:
    """C.6: categories that stand with another group than theirs; group_faults() has all of them."""
    out = []
    for (category, group), mapping in s.groups.items():
        if category not in df.columns or group not in df.columns:
            continue
        rows = _most(group_faults(df, category, group, mapping), "category", "group").orderBy("category").collect()
        out += [Finding("C.6", s.table, "group", "warning", category, f"{r['category']}: {', '.join(sorted(x['name'] for x in r['top']))}", {"bad": r["n"], "kinds": r["kinds"]}, passed=0) for r in rows] or [Finding("C.6", s.table, "group", "pass", category)]
    return out


def unit_faults(df: DataFrame, category: str, unit: str, units: dict[str, list[str]]) -> DataFrame:
    """category, unit, n and fault of all units that are not the first accepted one: true where none accepts it, false for a variant of one that does."""
    plain = lambda u: u.lower().strip()
    t = F.broadcast(df.sparkSession.createDataFrame([(k.lower(), [plain(a) for a in us], us[0]) for k, us in units.items()], "category string, accepted array<string>, first string"))
    rows = df.groupBy(F.lower(category).alias("category"), F.col(unit).alias("unit")).agg(F.count("*").alias("n")).join(t, "category")
    known = F.array_contains("accepted", F.lower(F.trim(F.coalesce("unit", F.lit("(no units)")))))
    return rows.withColumn("fault", ~known).where(F.col("fault") | (F.col("unit").isNotNull() & (F.col("unit") != F.col("first")))).select("category", "unit", "n", "fault")


def reference_units(df: DataFrame, s: Schema) -> list[Finding]:
    """C.7: units that a category does not accept; "(no units)" accepts null.  unit_faults() has all of them."""
    if not s.units or not s.unit_columns:
        return []
    faults = unit_faults(df, *s.unit_columns, s.units)
    bad = {r["category"]: r for r in _most(faults.where("fault"), "category", "unit").collect()}
    variants = {r["category"]: r for r in _most(faults.where("NOT fault"), "category", "unit").collect()}
    out = []
    for k in s.units:
        b, v = bad.get(k.lower()), variants.get(k.lower())
        message = ", ".join(f"{x['name']} ({x['n']})" for x in b["top"]) if b else ""
        out.append(Finding("C.7", s.table, "unit", "warning" if b else "info" if v else "pass", k, message, {"variants": [x["name"] for x in v["top"]] if v else [], "bad": b["n"] if b else 0, "kinds": b["kinds"] if b else 0}, passed=int(not b)))
    return out


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(c.cast("boolean"), F.lit(False)).cast("long")), F.lit(0))


def one_pass(df: DataFrame, s: Schema, limits: Thresholds = DEFAULT) -> list[Finding]:
    """K.1 missing values, K.2 conditions, P.1 order of times, P.3 plausible fields, P.4 dose units: one aggregation."""
    have = set(df.columns)
    exprs: list[Column] = [F.count("*").alias("rows")]
    todo: list[tuple] = []

    def add(what: tuple, *cs: Column) -> None:
        for c in cs:
            exprs.append(c.alias(f"x{len(exprs)}"))
        todo.append((what, len(exprs) - len(cs), len(cs)))

    conditional = {c for _, _, c in s.conditions}
    for c in s.columns:
        if c.name in have and not c.nullable and c.name not in conditional:
            add(("K.1", c), _sum(F.col(c.name).isNull()))
    for name, when, column in s.conditions:
        if column in have:
            add(("K.2", name, column), _sum(F.expr(when)), _sum(F.expr(when) & F.col(column).isNull()))
    for a, b, strict in s.order:
        if {a, b} <= have:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            add(("P.1", a, b), _sum(both), _sum(F.col(a) >= F.col(b) if strict else F.col(a) > F.col(b)))
    for name, when, then in s.plausible:
        add(("P.3", name), _sum(F.expr(when)), _sum(F.expr(when) & ~F.expr(then)))
    if "med_dose_unit" in have:
        rate = F.lower("med_dose_unit").rlike("/(sec|min|hr|hour|day)")
        wrong = ~rate if s.table.endswith("continuous") else rate
        add(("P.4",), _sum(F.col("med_dose_unit").isNotNull()), _sum(wrong))
    row = df.agg(*exprs).first()
    out = []
    for what, at, n in todo:
        v = [row[at + i] for i in range(n)]
        if what[0] == "K.1":
            f = _grade("K.1", s.table, "missing", v[0], row["rows"], limits.missing, what[1].name, inclusive=True)
            if what[1].allow_missing and f.severity == "error":
                f.severity = "warning"
        elif what[0] == "K.2":
            f = _grade("K.2", s.table, what[1], v[1], v[0], ANY, what[2])
            f.passed = 1
        elif what[0] == "P.1":
            f = _grade("P.1", s.table, "order", v[1], v[0], limits.broken, f"{what[1]} - {what[2]}")
        elif what[0] == "P.3":
            f = _grade("P.3", s.table, what[1], v[1], v[0], ANY)
        else:
            f = _grade("P.4", s.table, "dose unit", v[1], v[0], ANY, "med_dose_unit")
        out.append(f)
    return out


def numeric_ranges(df: DataFrame, s: Schema, limits: Thresholds = DEFAULT) -> list[Finding]:
    """P.2: values outside their range, by category and unit."""
    out = []
    for value, keys, rules in s.ranges:
        if value not in df.columns or not set(keys) <= set(df.columns):
            continue
        plain = df.withColumns({k: scalars.for_validation(F.col(k)) for k in keys})
        for r in ranges.range_summary(plain, value, keys, rules).collect():
            out.append(_grade("P.2", s.table, "range", r["n_outside"], r["n"], limits.broken, ", ".join([value, *(str(r[k]) for k in keys)]), below=r["n_below"], above=r["n_above"]))
    return out or ([Finding("P.2", s.table, "range", "pass")] if s.ranges else [])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows and duplicates by composite key; null is a value, texts go trimmed in lower case."""
    kinds = dict(df.dtypes)
    key = [(scalars.for_validation(F.col(k)) if kinds[k] == "string" else F.col(k)).alias(k) for k in keys]
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def duplicate_keys(df: DataFrame, s: Schema, limits: Thresholds = DEFAULT) -> list[Finding]:
    """P.7."""
    if not s.keys or not set(s.keys) <= set(df.columns):
        return []
    r = duplicates(df, s.keys).first()
    return [_grade("P.7", s.table, "duplicate keys", r["duplicates"], r["rows"], limits.broken, ", ".join(s.keys))]


def overlapping(df: DataFrame, s: Schema) -> list[Finding]:
    """P.5."""
    if not s.periods:
        return []
    keys, start, end = s.periods
    r = intervals.overlaps(df.select(*keys, start, end), keys, start, end).agg(F.count("*").alias("n"), _sum(F.col("overlap")).alias("bad")).first()
    return [_grade("P.5", s.table, "overlap", r["bad"], r["n"], ANY, f"{start} - {end}")]


def yearly(df: DataFrame, category: str, time: str, entity: str) -> DataFrame:
    """category, year and distinct entities (P.6)."""
    return df.where(F.col(category).isNotNull() & F.col(time).isNotNull()).groupBy(category, F.year(time).alias("year")).agg(F.count_distinct(entity).alias("n"))


def monthly(df: DataFrame, category: str, time: str, entity: str, value: str | None = None) -> DataFrame:
    """The trend by month: distinct entities, and the mean of a value (P.6)."""
    more = [F.avg(value).alias("mean")] if value else []
    return df.where(F.col(category).isNotNull() & F.col(time).isNotNull()).groupBy(category, F.date_format(time, "yyyy-MM").alias("month")).agg(F.count_distinct(entity).alias("n"), *more)


def absent_years(df: DataFrame, category: str, time: str, entity: str) -> DataFrame:
    """category and years: for each category the years that the table covers without it, if there are any."""
    years = df.where(F.col(time).isNotNull()).agg(F.array_sort(F.collect_set(F.year(time))).alias("all"))  # years are few by nature
    seen = yearly(df, category, time, entity).groupBy(F.col(category).alias("category")).agg(F.collect_set("year").alias("seen"))
    return seen.join(F.broadcast(years)).select("category", F.array_except("all", "seen").alias("years")).where(F.size("years") > 0)


def temporal(df: DataFrame, s: Schema) -> list[Finding]:
    """P.6: categories that are absent in some year that the table covers; absent_years() has all of them."""
    if not s.time_column or not s.entity:
        return []
    out = []
    for c in s.columns:
        if not c.category or c.name not in df.columns:
            continue
        severity = "info" if c.name == "organism_category" else "warning"
        faults = absent_years(df, c.name, s.time_column, s.entity)
        rows = faults.orderBy("category").limit(LISTED + 1).collect()
        out += [Finding("P.6", s.table, "absent years", severity, c.name, f"{r['category']}: {', '.join(map(str, r['years']))}", passed=0) for r in rows[:LISTED]]
        if len(rows) > LISTED:
            more = faults.count() - LISTED
            out.append(Finding("P.6", s.table, "absent years", severity, c.name, f"{more} further categories", {"more": more}, more, 0))
    return out or [Finding("P.6", s.table, "absent years", "pass")]


def referential(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """child_ids, orphans (not in the parent), parent_ids, unused (not in the child): both ways in one join (K.4)."""
    a = child.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().withColumn("c", F.lit(1))
    b = parent.select(F.col(parent_key or key).alias("k")).where("k IS NOT NULL").distinct().withColumn("p", F.lit(1))
    return a.join(b, "k", "full").agg(F.count("c").alias("child_ids"), F.count_if(F.col("p").isNull()).alias("orphans"), F.count("p").alias("parent_ids"), F.count_if(F.col("c").isNull()).alias("unused"))


#: Tables whose ids share a number.
WIDTH = 62


def links_between(tables: dict[str, DataFrame], links: list[tuple[str, str, str]]) -> DataFrame:
    """child, parent, key, child_ids, orphans, parent_ids, unused of each (child, parent, key): all of them from one shuffle (K.4).

    Each table gives the ids of a key once, with a bit of its own; the bits of
    an id are united, and every pair of tables is counted from them.  Links of a
    table or column that is not there are left out; null ids are no ids.
    """
    links = [(c, p, k) for c, p, k in dict.fromkeys(links) if c in tables and p in tables and k in tables[c].columns and k in tables[p].columns]
    spark = next(iter(tables.values())).sparkSession
    kind = "child string, parent string, key string, child_ids long, orphans long, parent_ids long, unused long"
    if not links:
        return spark.createDataFrame([], kind)
    members = list(dict.fromkeys((t, k) for c, p, k in links for t in (c, p)))
    words = range(-(-len(members) // WIDTH))
    number = {m: i for i, m in enumerate(members)}
    rows = None
    for (t, k), i in number.items():
        mine = tables[t].where(F.col(k).isNotNull()).select(F.lit(k).alias("key"), F.col(k).cast("string").alias("id"), *(F.lit(1 << i % WIDTH if w == i // WIDTH else 0).cast("long").alias(f"b{w}") for w in words))
        rows = mine if rows is None else rows.union(mine)
    ids = rows.groupBy("key", "id").agg(*(F.bit_or(f"b{w}").alias(f"b{w}") for w in words))
    inside = lambda t, k: (F.col("key") == k) & (F.getbit(F.col(f"b{number[t, k] // WIDTH}"), F.lit(number[t, k] % WIDTH)) == 1)
    counts = []
    for i, (c, p, k) in enumerate(links):
        a, b = inside(c, k), inside(p, k)
        counts += [F.count_if(a).alias(f"c{i}"), F.count_if(a & ~b).alias(f"o{i}"), F.count_if(b).alias(f"p{i}"), F.count_if(b & ~a).alias(f"u{i}")]
    each = [F.struct(F.lit(c).alias("child"), F.lit(p).alias("parent"), F.lit(k).alias("key"), F.col(f"c{i}").alias("child_ids"), F.col(f"o{i}").alias("orphans"), F.col(f"p{i}").alias("parent_ids"), F.col(f"u{i}").alias("unused")) for i, (c, p, k) in enumerate(links)]
    return ids.agg(*counts).select(F.inline(F.array(*each)))


def relations(tables: dict[str, DataFrame], links: list[tuple[str, str, str]], limits: Thresholds = DEFAULT) -> list[Finding]:
    """K.4 for each (child, parent, key)."""
    out = []
    if not tables:
        return out
    found = {(r["child"], r["parent"], r["key"]): r for r in links_between(tables, links).collect()}
    for link in links:
        if r := found.get(tuple(link)):
            out.append(_grade("K.4", r["child"], f"in {r['parent']}", r["orphans"], r["child_ids"], limits.orphans, r["key"]))
            out.append(_grade("K.4", r["parent"], f"has {r['child']}", r["unused"], r["parent_ids"], ANY, r["key"]))
    return out


def across(tables: dict[str, DataFrame], rules: list[tuple[str, str, str, str, str]]) -> list[Finding]:
    """K.5: (table, SQL condition, other table, key, column): rows that meet the condition need a value in the other."""
    out = []
    for table, when, other, key, column in rules:
        if table in tables and other in tables:
            rows = tables[table].where(when).select(key).distinct()
            bad = rows.join(tables[other].where(F.col(column).isNotNull()).select(key), key, "left_anti").count()
            out.append(_grade("K.5", table, f"{column} in {other}", bad, rows.count(), ANY, key))
    return out


def within_stay(events: DataFrame, stays: DataFrame, key: str, times: list[str], start: str, end: str) -> DataFrame:
    """For each time column: rows, and how many lie before or after their stay (P.8); one join, one pass."""
    rows = events.select(key, *times).join(stays.select(key, start, end), key)
    parts = []
    for t in times:
        parts += [F.count(t).alias(f"{t}_n"), _sum(F.col(t) < F.col(start)).alias(f"{t}_before"), _sum(F.col(t) > F.col(end)).alias(f"{t}_after")]
    return rows.agg(*parts)


def stay_times(tables: dict[str, DataFrame], times: dict[str, list[str]], stays: str = "hospitalization", key: str = "hospitalization_id", start: str = "admission_dttm", end: str = "discharge_dttm", limits: Thresholds = DEFAULT) -> list[Finding]:
    out = []
    for table, columns in times.items():
        if table in tables and stays in tables:
            have = [c for c in columns if c in tables[table].columns]
            r = within_stay(tables[table], tables[stays], key, have, start, end).first()
            out += [_grade("P.8", table, "inside stay", r[f"{c}_before"] + r[f"{c}_after"], r[f"{c}_n"], limits.broken, c, before=r[f"{c}_before"], after=r[f"{c}_after"]) for c in have]
    return out


def full(df: DataFrame, s: Schema, tables: dict[str, DataFrame] | None = None, links: list[tuple[str, str, str]] = (), stay_columns: dict[str, list[str]] | None = None, limits: Thresholds = DEFAULT) -> dict[str, list[Finding]]:
    """Everything about one table, by part."""
    first = conformance(df, s)
    if first[0].severity == "error":
        return {"conformance": first, "completeness": [], "plausibility": []}
    counted, words = one_pass(df, s, limits), vocabulary(df, s)
    out = {
        "conformance": first + [f for f in words if f.code == "C.5"] + group_mapping(df, s) + reference_units(df, s),
        "completeness": [f for f in counted if f.code[0] == "K"] + [f for f in words if f.code == "K.3"],
        "plausibility": [f for f in counted if f.code[0] == "P"] + numeric_ranges(df, s, limits) + overlapping(df, s) + temporal(df, s) + duplicate_keys(df, s, limits),
    }
    if tables:
        out["completeness"] += relations(tables, list(links), limits)
        out["plausibility"] += stay_times(tables, stay_columns or {}, limits=limits)
    return out


def absent(s: Schema) -> dict[str, list[Finding]]:
    """What full() gives for a table that is not there."""
    return {"conformance": [Finding("C.1", s.table, "presence", "error", message="table absent", passed=0)], "completeness": [], "plausibility": []}


def as_table(spark: SparkSession, findings: list[Finding]) -> DataFrame:
    """Findings as rows: code, table, check, column, severity, message, bad and of (rows, where they were counted)."""
    rows = [(f.code, f.table, f.check, f.column, f.severity, f.message, f.metrics.get("bad"), f.metrics.get("of")) for f in findings]
    return spark.createDataFrame(rows, "code string, table string, check string, column string, severity string, message string, bad long, of long")


def status(findings: list[Finding]) -> str:
    """incomplete with errors of structure, partial with other errors, complete otherwise."""
    errors = [f for f in findings if f.severity == "error"]
    if any(f.code in ("C.1", "C.2", "C.3") for f in errors):
        return "incomplete"
    return "partial" if errors else "complete"


def score(findings: list[Finding]) -> float:
    """Share of atomic checks that pass, in per cent."""
    total = sum(f.total for f in findings)
    return 100.0 * sum(f.passed for f in findings) / total if total else 100.0
