"""Suppression of repeats by successor links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from . import asof, segments

#: Rounds after which even a chain of 2 ** 64 rows has been walked.
ROUNDS = 64


def suppress_repeats(df: DataFrame, keys: list[str], time: str, days: int, subject: Column, tiebreak: str, *, bucket_seconds: int = 86_400) -> DataFrame:
    """Drop rows of which fewer than days + 1 whole days have passed since the last row kept.

    Only rows that meet subject can be dropped; others are kept and set the
    clock.  Rows without a time are kept and do not set it.  Rows go by time and
    tiebreak; of rows that tie in both any one counts as the first.  A null key is a key.

    What is kept next after a row is its successor: the first later row that so
    many days have passed to, found for all rows by one as-of join.  An entity is
    cut where a row is kept whatever comes before it (its first row, one that
    comes so late after the row before it, one that cannot be dropped), and all
    that successors reach from these roots is kept.  Their pointers are doubled
    in each round, so a chain of n rows takes log n rounds; islands and the as-of
    join go by buckets of time.  No entity is collected, and none is one task.
    Jobs run while this is called, and df is written once.
    """
    rows = shared.written(df.withColumns({"__subject": F.coalesce(subject, F.lit(False)), "__row": F.monotonically_increasing_id()}), "rows")
    ks, far = [f"__k{i}" for i in range(len(keys))], (days + 1) * 86_400_000_000
    # A key in a struct is never null, so null keys are keys in joins too.
    timed = rows.where(F.col(time).isNotNull()).select(*(F.struct(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.col(time).alias("__t"), F.col(tiebreak).alias("__id"), "__subject", "__row")
    apart = lambda now, before: ~now["__subject"] | (F.unix_micros(now["__t"]) - F.unix_micros(before["__t"]) >= far)
    timed = segments.gap_island(timed, ks, ["__t", "__id", "__row"], F.struct("__t", "__subject"), apart, "__piece", bucket_seconds=bucket_seconds)
    timed = shared.written(timed, "timed")
    piece = [*ks, "__piece"]
    first = lambda: F.min(F.struct("__t", "__id", "__row"))["__row"]
    kept = shared.written(timed.groupBy(*piece).agg(first().alias("__row")).select("__row"), "kept")
    # The first row at or after a time: time runs backward, and the as-of join finds the latest one.
    back = lambda c: F.timestamp_micros(-c)
    probes = timed.select(*piece, F.col("__row").alias("__from"), back(F.unix_micros("__t") + far).alias("__at"))
    places = timed.groupBy(*piece, "__t").agg(first().alias("__to")).select(*piece, "__to", back(F.unix_micros("__t")).alias("__when"))
    jumps = asof.split_asof_join(probes, places, piece, "__at", "__when", ["__to"], bucket_seconds=bucket_seconds)
    jumps = shared.written(jumps.where("__to IS NOT NULL").select("__from", "__to"), "jumps")
    for _ in range(ROUNDS):
        # kept holds what is fewer than 2 ** k steps from a root, and jumps are 2 ** k steps long.
        reached = jumps.join(kept.withColumnRenamed("__row", "__from"), "__from", "left_semi").select(F.col("__to").alias("__row")).distinct()
        fresh = shared.written(reached.join(kept, "__row", "left_anti"), "reached")
        if not fresh.limit(1).count():
            break
        kept = shared.written(kept.union(fresh), "kept")
        onward = jumps.select(F.col("__from").alias("__to"), F.col("__to").alias("__next"))
        jumps = shared.written(jumps.join(onward, "__to").select("__from", F.col("__next").alias("__to")), "jumps")
    open_ = F.col("__subject") & F.col(time).isNotNull()
    return rows.where(open_).join(kept, "__row", "left_semi").unionByName(rows.where(~open_)).select(*df.columns)
