"""Reshaping long event tables: pivots by minute, the wide table, fixed windows, melting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from .aggregates import first_by, last_by

AGGREGATIONS = ["max", "min", "mean", "median", "first", "last", "boolean", "one_hot"]


def minute_pivot(events: DataFrame, keys: list[str], time: str, category: str, value: str, categories: list[str], *, zone: str = "UTC", prefix: str = "") -> DataFrame:
    """One row for each minute of the keys, one column for each category.

    Of several values of a category in a minute the first by time, then the
    least, is taken.  The categories are given, so there is no job to find them.
    """
    rows = events.where(F.col(category).isin(categories)).withColumn("minute_key", scalars.minute_key(F.col(time), zone))
    one = [F.min(F.when((F.col(category) == c) & F.col(value).isNotNull(), F.struct(F.col(time), F.col(value))))[value].alias(prefix + c) for c in categories]
    return rows.groupBy(*keys, "minute_key").agg(*one)


def event_times(tables: list[tuple[DataFrame, str]], keys: list[str], name: str = "event_time") -> DataFrame:
    """The distinct times at which any table has a row."""
    out = None
    for df, time in tables:
        part = df.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias(name))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def wide_table(cohort: DataFrame, pivots: list[DataFrame], wides: list[tuple[DataFrame, str]], times: DataFrame, keys: list[str], *, zone: str = "UTC", windows: DataFrame | None = None, time: str = "event_time") -> DataFrame:
    """The cohort by all its event times, with every table that has something in the same minute (R2).

    Joins go by keys and minute, so several rows in a minute multiply.  Of
    columns with one name the first stays.  windows (keys, start_time, end_time)
    keep only times inside them.  day_number counts local days with events.
    """
    spine = cohort.join(times, keys)
    if windows is not None:
        w = windows.select(*keys, F.col("start_time").alias("_start"), F.col("end_time").alias("_end"))
        spine = spine.join(w, keys).where(F.col(time).between(F.col("_start"), F.col("_end"))).drop("_start", "_end")
    spine = spine.withColumn("minute_key", scalars.minute_key(F.col(time), zone))
    for p in [*pivots, *(df.withColumn("minute_key", scalars.minute_key(F.col(t), zone)).drop(t) for df, t in wides)]:
        new = [c for c in p.columns if c not in spine.columns]
        spine = spine.join(p.select(*keys, "minute_key", *new), [*keys, "minute_key"], "left")
    local = F.to_date(F.from_utc_timestamp(F.col(time), zone))
    spine = spine.withColumn("day_number", F.dense_rank().over(Window.partitionBy(*keys).orderBy(local)))
    return spine.withColumn("id_day_key", F.concat_ws("_day_", F.concat_ws("_", *(F.col(k).cast("string") for k in keys)), F.col("day_number").cast("string"))).drop("minute_key")


@dataclass(frozen=True)
class Long:
    """A long table and which of its categories become columns; text: values are texts."""

    df: DataFrame
    time: str
    category: str | None = None
    value: str | None = None
    categories: tuple[str, ...] = ()
    text: bool = False


def wide_from_long(cohort: DataFrame, longs: list[Long], keys: list[str], *, zone: str = "UTC", windows: DataFrame | None = None, wides: list[tuple[DataFrame, str]] = (), time: str = "event_time") -> DataFrame:
    """wide_table() of long tables with one shuffle by key for all of them.

    Rows of all tables are united and dealt by key once.  A minute of a key is
    one group, which holds its distinct times and the first value of each
    category; the times are then unfolded.  Everything that follows by key (the
    cohort, day numbers, fixed windows) finds the rows where they are.  Tables
    that are wide already are joined by minute.
    """
    parts = []
    for t in [*longs, *(Long(df, at) for df, at in wides)]:
        of, v = (F.col(t.category), F.col(t.value)) if t.category else (F.lit(None).cast("string"), F.lit(None).cast("double"))
        rows = t.df.where(F.col(t.time).isNotNull())
        number, text = (F.lit(None).cast("double"), v.cast("string")) if t.text else (v.cast("double"), F.lit(None).cast("string"))
        parts.append(rows.select(*keys, F.col(t.time).alias(time), of.alias("_of"), number.alias("_number"), text.alias("_text")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.repartition(*keys).withColumn("minute_key", scalars.minute_key(F.col(time), zone))
    columns = [F.min(F.when((F.col("_of") == c) & F.col(v).isNotNull(), F.struct(F.col(time), F.col(v))))[v].alias(c) for t in longs for v in ["_text" if t.text else "_number"] for c in t.categories]
    spine = both.groupBy(*keys, "minute_key").agg(F.collect_set(time).alias("_times"), *columns).withColumn(time, F.explode("_times")).drop("_times")
    names = [c for t in longs for c in t.categories]
    spine = cohort.join(spine, keys).select(*cohort.columns, time, *names, "minute_key")
    if windows is not None:
        w = windows.select(*keys, F.col("start_time").alias("_start"), F.col("end_time").alias("_end"))
        spine = spine.join(w, keys).where(F.col(time).between(F.col("_start"), F.col("_end"))).drop("_start", "_end")
    for df, at in wides:
        new = [c for c in df.columns if c not in spine.columns and c != at]
        spine = spine.join(df.select(*keys, scalars.minute_key(F.col(at), zone).alias("minute_key"), *new), [*keys, "minute_key"], "left")
    local = F.to_date(F.from_utc_timestamp(F.col(time), zone))
    spine = spine.withColumn("day_number", F.dense_rank().over(Window.partitionBy(*keys).orderBy(local)))
    return spine.withColumn("id_day_key", F.concat_ws("_day_", F.concat_ws("_", *(F.col(k).cast("string") for k in keys)), F.col("day_number").cast("string"))).drop("minute_key")


def with_columns(df: DataFrame, names: list[str], kind: str = "double") -> DataFrame:
    """df with a null column for each name that it lacks."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def coalesced_value(numeric: str, *texts: str) -> Column:
    """One text value from a number and texts."""
    return F.coalesce(F.col(numeric).cast("string"), *(F.col(t) for t in texts))


def numeric_columns(df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """Make text columns numbers where at least that share of their values are."""
    row = df.agg(*(F.avg(F.when(F.col(c).isNotNull(), F.col(c).try_cast("double").isNotNull().cast("double"))).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if row[c] is not None and row[c] >= share})


def fixed_windows(df: DataFrame, keys: list[str], time: str, hours: int) -> DataFrame:
    """window_number, window_start and window_end, counted from the first event of the keys."""
    if not 1 <= hours <= 72:
        raise ValueError("hours must be from 1 to 72")
    first = F.min(time).over(Window.partitionBy(*keys))
    us = hours * 3_600_000_000
    df = df.withColumn("_first", first).withColumn("window_number", F.floor((F.unix_micros(time) - F.unix_micros("_first")) / F.lit(us)).cast("long"))
    start = F.unix_micros("_first") + F.col("window_number") * us
    return df.withColumn("window_start", F.timestamp_micros(start)).withColumn("window_end", F.timestamp_micros(start + us)).drop("_first")


def aggregate_windows(df: DataFrame, keys: list[str], time: str, hours: int, config: dict[str, list[str]], *, hot_values: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each window of the keys (R8): config maps max, min, ... to columns.

    Columns that config does not name come as their first value, with the
    suffix _c.  All aggregations are one pass over one shuffle.  hot_values
    gives the values of one_hot columns; otherwise they are looked up.
    """
    unknown = set(config) - set(AGGREGATIONS)
    if unknown:
        raise ValueError(f"no such aggregation: {sorted(unknown)}")
    rows = fixed_windows(df, keys, time, hours)
    kinds = {"max": F.max, "min": F.min, "mean": F.mean, "median": F.median, "first": lambda c: first_by(c, time), "last": lambda c: last_by(c, time), "boolean": lambda c: (F.count(c) > 0).cast("int")}
    out = [kinds[k](c).alias(f"{c}_{k}") for k in AGGREGATIONS if k != "one_hot" for c in config.get(k, [])]
    for c in config.get("one_hot", []):
        values = (hot_values or {}).get(c)
        if values is None:
            values = [r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().orderBy(c).limit(101).collect()]
        if len(values) > 100:
            raise ValueError(f"{c} has more than 100 values")
        out += [F.max(F.when(F.col(c).cast("string") == v, 1).otherwise(0)).alias(f"{c}_" + "".join(x if x.isascii() and (x.isalnum() or x == "_") else "_" for x in v)) for v in values]
    named = {c for cs in config.values() for c in cs}
    rest = [c for c in df.columns if c not in named and c not in (*keys, time)]
    out += [first_by(c, time).alias(f"{c}_c") for c in rest]
    return rows.groupBy(*keys, "window_number", "window_start", "window_end").agg(*out)


def fill_windows(windows: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """A row for every window number between the first and the last of the keys; new ones hold nulls."""
    span = windows.groupBy(*keys).agg(F.min("window_number").alias("_a"), F.max("window_number").alias("_b"), F.min_by("window_start", "window_number").alias("_t"))
    each = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("window_number"), "_a", "_t")
    us = hours * 3_600_000_000
    start = F.unix_micros("_t") + (F.col("window_number") - F.col("_a")) * us
    each = each.select(*keys, "window_number", F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + us).alias("window_end"))
    return each.join(windows.drop("window_start", "window_end"), [*keys, "window_number"], "left")


def long_to_wide(df: DataFrame, keys: list[str], category: str, value: Column, categories: list[str], default=None) -> DataFrame:
    """One column for each category, by any value of it."""
    out = df.groupBy(*keys).agg(*(F.max(F.when(F.col(category) == c, value)).alias(c) for c in categories))
    return out if default is None else out.fillna(default, categories)


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row for each of the columns."""
    return df.unpivot(keys, columns, name, value)
