"""Windows over the rows of an entity: islands, fills, runs, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(keys: list[str], order: list[str | Column]):
    """Rows of the keys by order, nulls last unless a Column says otherwise."""
    return Window.partitionBy(*keys).orderBy(*(F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order))


def change_island(df: DataFrame, keys: list[str], order: list, value: str, name: str, missing: str = "missing") -> DataFrame:
    """Number the runs of equal values, from 1; null counts as a value of its own."""
    w = ordered(keys, order)
    now = F.coalesce(F.col(value).cast("string"), F.lit(missing))
    before = F.lag(now).over(w)
    df = df.withColumn("_new", F.when(before.isNull() | (before != now), 1).otherwise(0))
    return df.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_island(df: DataFrame, keys: list[str], order: list, gap: Column, name: str) -> DataFrame:
    """Number the runs that gap, a condition on this row and the one before (via lag), cuts apart."""
    w = ordered(keys, order)
    df = df.withColumn("_new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    return df.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def day_courses(days: DataFrame, keys: list[str], day: str, gap_days: int, name: str = "course") -> DataFrame:
    """Courses of days: a gap of more than gap_days begins the next one."""
    w = ordered(keys, [day])
    return gap_island(days, keys, [day], F.datediff(F.col(day), F.lag(day).over(w)) > gap_days, name)


def fill_forward(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """The last value that is not null."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_in_runs(df: DataFrame, keys: list[str], order: list, run: str, columns: list[str]) -> DataFrame:
    """fill_forward() inside each run, the numbers of which rise with the order, as change_island() gives them.

    The window is that of the keys, so rows that are in their order are not
    sorted by the run again.
    """
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    where = {c: F.last(F.when(F.col(c).isNotNull(), F.col(run)), ignorenulls=True).over(w) for c in columns}
    return df.withColumns({c: F.when(at == F.col(run), F.last(c, ignorenulls=True).over(w)) for c, at in where.items()})


def fill_both(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Forward, and what is left at the beginning backward."""
    w = ordered(keys, order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(on)) for c in columns})


def consecutive_run(days: DataFrame, keys: list[str], day: str, anchor: str, most: int | None = None) -> DataFrame:
    """keys and run: how many days in a row are covered from the anchor day on (W9).  days are distinct."""
    w = ordered(keys, [day])
    d = days.where(F.col(day) >= F.col(anchor)).withColumn("_off", F.datediff(F.col(day), F.col(anchor)) - (F.row_number().over(w) - 1))
    run = F.sum(F.when(F.col("_off") == 0, 1).otherwise(0))
    return d.groupBy(*keys).agg((F.least(run, F.lit(most)) if most is not None else run).cast("long").alias("run"))


def chain(df: DataFrame, keys: list[str], start: str, end: str, within_seconds: float, name: str = "block") -> DataFrame:
    """Number the chains of periods of which each starts within a span after the one before it ends."""
    w = ordered(keys, [start, end])
    gap = (F.unix_micros(F.col(start)) - F.unix_micros(F.lag(end).over(w))) > int(within_seconds * 1_000_000)
    return gap_island(df, keys, [start, end], gap, name)


def suppress_repeats(df: DataFrame, keys: list[str], time: str, days: int, subject: Column, tiebreak: str) -> DataFrame:
    """Drop rows of which fewer than days + 1 whole days have passed since the last row kept (W11): suppression.suppress_repeats."""
    from .suppression import suppress_repeats as by_links  # which builds on this module

    return by_links(df, keys, time, days, subject, tiebreak)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order (O3)."""
    return df.withColumn("_n", F.row_number().over(ordered(keys, order))).where("_n = 1").drop("_n")


def day_number(df: DataFrame, keys: list[str], time: str, zone: str = "UTC", name: str = "day_number") -> DataFrame:
    """Days of an entity on which anything happens, numbered from 1 by local date."""
    local = F.to_date(F.from_utc_timestamp(F.col(time), zone))
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(local.asc_nulls_last())))


def same_time_count(df: DataFrame, keys: list[str], name: str = "n_same") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
