"""Joins of events with intervals (J5 to J7), composite time keys (J8), overlaps, and expansion of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_join(events: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, *, closed: bool = True, how: str = "inner") -> DataFrame:
    """Events inside the windows of their keys; overlapping windows repeat an event.

    closed: both ends belong to the window; otherwise the end does not.  The
    join is on the keys, with the range as its condition, so a key is all that
    is shuffled.
    """
    e, w = events.alias("e"), windows.alias("w")
    on = F.col(f"e.{time}") >= F.col(f"w.{start}")
    on = on & ((F.col(f"e.{time}") <= F.col(f"w.{end}")) if closed else (F.col(f"e.{time}") < F.col(f"w.{end}")))
    for k in keys:
        on = on & (F.col(f"e.{k}") == F.col(f"w.{k}"))
    extra = [F.col(f"w.{c}") for c in windows.columns if c not in keys]
    return e.join(w, on, how).select(*(F.col(f"e.{c}") for c in events.columns), *extra)


def split_interval_join(events: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, *, bucket_seconds: int = 86_400, closed: bool = True) -> DataFrame:
    """interval_join for keys with very many rows: windows are cut into buckets of time, which are joined by number."""
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(bucket_seconds * 1_000_000))
    cut = windows.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    dealt = events.withColumn("_bucket", bucket(F.col(time)))
    return interval_join(dealt, cut, [*keys, "_bucket"], time, start, end, closed=closed).drop("_bucket")


def outside_intervals(events: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, kept: Column) -> DataFrame:
    """Half-open left join (J6): an event stays where no interval holds it, or once for each that does and meets kept."""
    e, w = events.alias("e"), intervals.alias("w")
    on = (F.col(f"e.{time}") >= F.col(f"w.{start}")) & (F.col(f"e.{time}") < F.col(f"w.{end}"))
    for k in keys:
        on = on & (F.col(f"e.{k}") == F.col(f"w.{k}"))
    return e.join(w, on, "left").where(F.col(f"w.{start}").isNull() | kept).select(*(F.col(f"e.{c}") for c in events.columns))


def around_days(events: DataFrame, anchors: DataFrame, keys: list[str], time: str, anchor: str, days: int, *, calendar: bool = True) -> DataFrame:
    """Events within so many days of an anchor: by calendar day, or by the clock."""
    e, a = events.alias("e"), anchors.alias("a")
    x, y = F.col(f"e.{time}"), F.col(f"a.{anchor}")
    near = F.abs(F.datediff(x, y)) <= days if calendar else F.abs(F.unix_micros(x) - F.unix_micros(y)) <= days * 86_400_000_000
    for k in keys:
        near = near & (F.col(f"e.{k}") == F.col(f"a.{k}"))
    return e.join(a, near).select(*(F.col(f"e.{c}") for c in events.columns), *(F.col(f"a.{c}") for c in anchors.columns if c not in keys))


def overlaps(periods: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """periods with previous_end and overlap: whether one starts before the one before it has ended."""
    w = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    return periods.withColumn("previous_end", F.lag(end).over(w)).withColumn("overlap", F.coalesce(F.col(start) < F.col("previous_end"), F.lit(False)))


def expand_days(periods: DataFrame, start: str, end: str, day: str = "day", most: int | None = None) -> DataFrame:
    """A row for each day from start to end, both included, and at most so many."""
    last = F.to_date(end)
    if most is not None:
        last = F.least(last, F.date_add(F.to_date(start), most - 1))
    return periods.withColumn(day, F.explode(F.when(F.to_date(start) <= last, F.sequence(F.to_date(start), last)).otherwise(F.array())))


def hour_scaffold(events: DataFrame, keys: list[str], time: str, name: str = "scaffold") -> DataFrame:
    """A row at hh:59:59 of every clock hour from the first event of the keys to the last."""
    span = events.groupBy(*keys).agg(F.date_trunc("hour", F.min(time)).alias("_a"), F.date_trunc("hour", F.max(time)).alias("_b")).where("_a IS NOT NULL")
    hours = F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 HOUR")))
    return span.select(*keys, hours.alias("_h")).select(*keys, (F.col("_h") + F.expr("INTERVAL '59:59' MINUTE TO SECOND")).alias(name))
