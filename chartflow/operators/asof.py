"""Backward as-of joins (J3, J4) with one shuffle: both sides in one ordered stream for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _union(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], skip_null: str | None) -> DataFrame:
    """Rows of both sides: _k0.., _at, _side (0 for right), _hit (time and values of a right row), _row (a left row)."""
    right = right.where(F.col(right_time).isNotNull())
    if skip_null:
        right = right.where(F.col(skip_null).isNotNull())
    payload = F.struct(F.col(right_time).alias("_t"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)))
    a = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    b = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(right_time).alias("_at"), F.lit(0).alias("_side"), payload.alias("_hit"))
    return b.unionByName(a, allowMissingColumns=True)


def _result(found: DataFrame, columns: list[str], keys: list[str], values: list[str], tolerance_seconds: float | None, matched_time: str | None) -> DataFrame:
    ok = F.col("_at").isNotNull() & F.col("_hit").isNotNull()
    for i in range(len(keys)):
        ok = ok & F.col(f"_k{i}").isNotNull()
    if tolerance_seconds is not None:
        ok = ok & (F.unix_micros("_at") - F.unix_micros("_hit._t") <= int(tolerance_seconds * 1_000_000))
    out = [F.col(f"_row.{c}").alias(c) for c in columns]
    out += [F.when(ok, F.col(f"_hit._v{i}")).alias(v) for i, v in enumerate(values)]
    if matched_time:
        out.append(F.when(ok, F.col("_hit._t")).alias(matched_time))
    return found.where("_side = 1").select(*out)


def _order():
    return F.col("_at").asc_nulls_first(), "_side", F.col("_hit").asc_nulls_first()


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], *, tolerance_seconds: float | None = None, skip_null: str | None = None, matched_time: str | None = None) -> DataFrame:
    """Every row of left with values of the latest right row of its keys at or before its time.

    Rows of right without a time are left out, and those without skip_null if it
    is given.  Of right rows at the same time the one with the greatest values
    counts.  A match older than the tolerance is no match.  Unmatched rows stay,
    with nulls.  matched_time names a column for the time of the match.
    """
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    both = _union(left, right, keys, left_time, right_time, values, skip_null)
    return _result(both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)), left.columns, keys, values, tolerance_seconds, matched_time)


def split_asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], *, bucket_seconds: int = 86_400, tolerance_seconds: float | None = None, skip_null: str | None = None, matched_time: str | None = None) -> DataFrame:
    """asof_join() for keys with very many rows: each key is cut into buckets of time, which are worked on apart.

    The last right row of each bucket, one row a bucket, is carried to the next
    one that has none before its own; so no task needs all rows of a key.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    both = _union(left, right, keys, left_time, right_time, values, skip_null)
    both = both.withColumn("_bucket", F.coalesce(F.floor(F.unix_micros("_at") / F.lit(bucket_seconds * 1_000_000)), F.lit(-(1 << 62))))
    last = both.groupBy(*ks, "_bucket").agg(F.max("_hit").alias("_last"))
    carry = F.last("_last", ignorenulls=True).over(Window.partitionBy(*ks).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*ks, "_bucket", carry.alias("_carry"))
    w = Window.partitionBy(*ks, "_bucket").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
    on = inside["_bucket"] == carried["_bucket"]
    for k in ks:
        on = on & inside[k].eqNullSafe(carried[k])
    found = inside.join(carried, on, "left").select(*(inside[k] for k in ks), "_at", "_side", "_row", F.coalesce("_hit", "_carry").alias("_hit"))
    return _result(found, left.columns, keys, values, tolerance_seconds, matched_time)
