"""The least, greatest and latest values of categories inside windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import interval_join


EXTREMES = ("min", "max", "latest")


def extremal_lookup(events: DataFrame, windows: DataFrame, keys: list[str], time: str, category: str, value: str, wanted: dict[str, list[str]], *, extras: bool = False) -> DataFrame:
    """Per window, a column <category>_<min|max|latest> for each pair that is wanted.

    windows has the keys, start_time and end_time, both ends included.  Windows
    without any value are dropped.  Of values at the same latest time the mean
    is taken.  The range join shuffles by key; all extremes are one aggregation.
    extras adds the extremes that nobody asked for where their row is one that
    was asked for, and null elsewhere.
    """
    for ks in wanted.values():
        if bad := set(ks) - set(EXTREMES):
            raise ValueError(f"no such extreme: {sorted(bad)}")
    rows = events.where(F.col(category).isin(list(wanted)) & F.col(value).isNotNull()).select(*keys, time, category, F.col(value).cast("double").alias(value))
    inside = interval_join(rows, windows.select(*keys, "start_time", "end_time"), keys, time, "start_time", "end_time")
    same = inside.groupBy(*keys, "start_time", "end_time", category, time).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_mean"))
    low, high, last = F.struct(F.col("_lo").alias("v"), F.col(time).alias("t")), F.struct(F.col("_hi").alias("v"), F.col(time).alias("t")), F.struct(F.col(time).alias("t"), F.col("_mean").alias("v"))
    out = []
    for i, c in enumerate(wanted):
        of = F.col(category) == c
        out += [F.min(F.when(of, low)).alias(f"_{i}_min"), F.max(F.when(of, high)).alias(f"_{i}_max"), F.max(F.when(of, last)).alias(f"_{i}_latest")]
    found = same.groupBy(*keys, "start_time", "end_time").agg(*out)
    columns = []
    for i, (c, ks) in enumerate(wanted.items()):
        columns += [F.col(f"_{i}_{k}.v").alias(f"{c}_{k}") for k in ks]
        for k in EXTREMES if extras else ():
            if k not in ks:
                shared = F.lit(False)
                for a in ks:
                    shared = shared | (F.col(f"_{i}_{a}.t") == F.col(f"_{i}_{k}.t"))
                columns.append(F.when(shared, F.col(f"_{i}_{k}.v")).alias(f"{c}_{k}"))
    return found.select(*keys, "start_time", "end_time", *columns)
