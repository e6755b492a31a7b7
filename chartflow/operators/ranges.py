"""Rules on numeric ranges (P4 to P8): values outside become null, or are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clamp(c: Column, low: float | None, high: float | None) -> Column:
    """c, or null below low or above high; both bounds are inside."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return F.when(ok, c)


def clamp_columns(df: DataFrame, rules: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Whole columns by one range each (P5); columns that are not numbers are left alone."""
    kinds = dict(df.dtypes)
    numeric = [c for c in rules if kinds.get(c, "").startswith(("double", "float", "int", "bigint", "decimal", "smallint"))]
    return df.withColumns({c: clamp(F.col(c), *rules[c]) for c in numeric})


def rule_table(spark: SparkSession, rules: list[tuple], keys: list[str]) -> DataFrame:
    """Rules (key values..., low, high) as a table; texts in lower case."""
    rows = [(*(str(k).lower() for k in r[:-2]), None if r[-2] is None else float(r[-2]), None if r[-1] is None else float(r[-1])) for r in rules]
    return spark.createDataFrame(rows, ", ".join([*(f"_k{i} string" for i in range(len(keys))), "_low double", "_high double"]))


def _with_rules(df: DataFrame, rules: list[tuple], keys: list[str]) -> DataFrame:
    """df with _low and _high of its row's rule.  The rules are a list in the program, so they are broadcast."""
    if not keys:  # one range for the whole column
        low, high = rules[0][-2:]
        return df.withColumns({"_low": F.lit(low).cast("double"), "_high": F.lit(high).cast("double")})
    t = rule_table(df.sparkSession, rules, keys)
    on = [F.lower(F.col(k)) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return df.join(F.broadcast(t), on, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def clean(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """All rules of a table (value column, key columns, rules), as an outlier file gives them; columns that are missing are left out."""
    for value, keys, of in rules:
        if value in df.columns and set(keys) <= set(df.columns):
            df = clamp_by_rule(df, value, keys, of)
    return df


def outside(value: str) -> Column:
    v = F.col(value)
    return F.coalesce((v < F.col("_low")) | (v > F.col("_high")), F.lit(False))


def clamp_by_rule(df: DataFrame, value: str, keys: list[str], rules: list[tuple]) -> DataFrame:
    """Values by the range of their category, or category and unit (P6, P7); what no rule names is left alone."""
    return _with_rules(df, rules, keys).withColumn(value, F.when(~outside(value), F.col(value))).select(*df.columns)


def range_summary(df: DataFrame, value: str, keys: list[str], rules: list[tuple]) -> DataFrame:
    """For each rule with values outside it: how many lie below, above, and of how many."""
    v = F.col(value)
    joined = _with_rules(df.where(v.isNotNull()), rules, keys).where("_low IS NOT NULL OR _high IS NOT NULL")
    out = joined.groupBy(*(F.lower(F.col(k)).alias(k) for k in keys), "_low", "_high").agg(F.count("*").alias("n"), F.count_if(v < F.col("_low")).alias("n_below"), F.count_if(v > F.col("_high")).alias("n_above"))
    out = out.withColumn("n_outside", F.col("n_below") + F.col("n_above")).where("n_outside > 0")
    return out.select(*keys, F.col("_low").alias("low"), F.col("_high").alias("high"), "n", "n_below", "n_above", "n_outside", (F.col("n_outside") * 100.0 / F.col("n")).alias("pct_outside"))
