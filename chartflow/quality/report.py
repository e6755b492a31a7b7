"""Reports of findings as text, CSV, HTML and JSON, and figures of a table; all small and on the driver."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates
from .checks import Finding, score, status
from .schema import Schema

COLUMNS = ["id", "table", "part", "code", "check", "column", "severity", "message", "metrics", "total", "passed", "score"]


def issue_id(f: Finding) -> str:
    return hashlib.md5(f"{f.table}|{f.code}|{f.check}|{f.column}|{f.message}".encode()).hexdigest()[:8]


def issues(results: dict[str, list[Finding]], *, passing: bool = False) -> list[dict]:
    """Findings as flat records; infos of one column become one."""
    out, seen = [], {}
    for part, found in results.items():
        for f in found:
            if f.severity == "pass" and not passing:
                continue
            if f.severity == "info" and (k := (f.table, f.code, f.column)) in seen:
                seen[k]["message"] += f"; {f.message}"
                continue
            r = {"id": issue_id(f), "part": part, **f.record()}
            out.append(r)
            if f.severity == "info":
                seen[(f.table, f.code, f.column)] = r
    return out


def table_figures(df: DataFrame) -> list[dict]:
    """Nulls, distinct values, least and greatest of each column."""
    cs = [c for c, k in df.dtypes if not k.startswith(("array", "map", "struct", "variant"))]
    if not cs:
        return []
    counts = aggregates.column_figures(df, cs).orderBy("i").collect()
    r = df.agg(*(f(f"`{c}`").cast("string").alias(f"{k}{i}") for i, c in enumerate(cs) for k, f in (("a", F.min), ("b", F.max)))).first()
    return [{"column": x["column"], "rows": x["n_rows"], "nulls": x["nulls"], "distinct": x["distinct"], "min": r[f"a{x['i']}"], "max": r[f"b{x['i']}"]} for x in counts]


def shortest(x: Column) -> Column:
    """A double in the fewest digits that give it back, with a point or an exponent, as reports print it."""
    plain = x.cast("string")
    whole = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa, exponent = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", ""), F.substring_index(plain, "E", -1).cast("int")
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    far = (F.abs(x) >= 1e16) | ((F.abs(x) < 1e-4) & (x != 0))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(far, scientific).when(plain.contains("E"), whole).otherwise(plain)


def table_statistics(df: DataFrame, s: Schema) -> DataFrame:
    """column, dtype, null_count, null_pct, unique, min and max, as text, of every column of the schema that is there.

    Least and greatest are of numbers, days and times alone, as reports print
    them.  The share of nulls has one digit, half to even.  An empty table has no rows.
    """
    rules = [c for c in s.columns if c.name in df.columns]
    spark = df.sparkSession
    counted = aggregates.column_figures(df, [c.name for c in rules]).where("n_rows > 0")
    parts = []
    for i, c in enumerate(rules):
        kind = c.kind.upper()
        if kind in ("DATETIME", "DATE"):
            shown = lambda x, form="yyyy-MM-dd HH:mm" if kind == "DATETIME" else "yyyy-MM-dd": F.date_format(x, form)
        elif kind in ("INT", "INTEGER"):
            shown = lambda x: F.bround(x.cast("double"), 0).cast("decimal(38,0)").cast("string")
        elif kind in ("DOUBLE", "FLOAT"):
            shown = lambda x: shortest(x.cast("double"))
        else:
            shown = lambda x: F.lit(None).cast("string")
        parts.append(F.struct(F.lit(i).alias("i"), F.lit(c.kind).alias("dtype"), shown(F.min(f"`{c.name}`")).alias("min"), shown(F.max(f"`{c.name}`")).alias("max")))
    if not parts:
        return spark.createDataFrame([], "column string, dtype string, null_count long, null_pct double, unique long, min string, max string")
    ends = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    pct = F.bround(F.col("nulls") * 100.0 / F.col("n_rows"), 1)
    return counted.join(F.broadcast(ends), "i").select("column", "dtype", F.col("nulls").alias("null_count"), pct.alias("null_pct"), F.col("distinct").alias("unique"), "min", "max")


def as_text(table: str, results: dict[str, list[Finding]]) -> str:
    every = [f for fs in results.values() for f in fs]
    lines = [f"Table {table}: {status(every)}, {text.percent(score(every))} of checks pass", ""]
    for part, fs in results.items():
        lines.append(f"{part} ({sum(f.passed for f in fs)} of {sum(f.total for f in fs)})")
        lines += [f"  {text.padded(f.code, 5)}{text.padded(f.severity, 9)}{f.check}{': ' + f.column if f.column else ''} {f.message}".rstrip() for f in fs if f.severity != "pass"]
    return "\n".join(lines) + "\n"


def as_csv(all_results: dict[str, dict[str, list[Finding]]]) -> str:
    """Twelve columns, lines ended by CR LF."""
    rows = [",".join(COLUMNS)]
    for results in all_results.values():
        total = text.percent(score([f for fs in results.values() for f in fs]))
        for r in issues(results, passing=True):
            rows.append(",".join(text.csv_field(json.dumps(r[c], default=str) if c == "metrics" else total if c == "score" else r[c]) for c in COLUMNS))
    return "\r\n".join(rows) + "\r\n"


def as_html(all_results: dict[str, dict[str, list[Finding]]], title: str = "Data quality") -> str:
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{text.html_escape(title)}</title></head><body><h1>{text.html_escape(title)}</h1>"]
    for table, results in all_results.items():
        every = [f for fs in results.values() for f in fs]
        parts.append(f"<h2>{text.html_escape(table)}</h2><p>{status(every)}, {text.percent(score(every))}</p><table><tr><th>code</th><th>severity</th><th>check</th><th>column</th><th>message</th></tr>")
        parts += ["<tr>" + "".join(f"<td>{text.html_escape(str(r[c] or ''))}</td>" for c in ("code", "severity", "check", "column", "message")) + "</tr>" for r in issues(results)]
        parts.append("</table>")
    return "".join(parts) + "</body></html>"


def as_json(results: dict[str, list[Finding]]) -> str:
    return json.dumps({part: [f.record() for f in fs] for part, fs in results.items()}, default=str, indent=2)


def from_json(content: str) -> dict[str, list[Finding]]:
    """What as_json() wrote, so reports of several tables can be made from saved ones: as_html({table: from_json(...)})."""
    return {part: [Finding(**r) for r in found] for part, found in json.loads(content).items()}


def save(path: str, content: str) -> None:
    with open(path, "w", newline="") as f:
        f.write(content)
