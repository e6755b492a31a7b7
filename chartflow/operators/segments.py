"""Scans over the rows of an entity in pieces of time.

A window over an entity keeps all its rows in one task.  Here an entity is cut
into buckets of time.  Each bucket is scanned for itself, reduced to one row,
these are scanned over the entity, and what a bucket inherits is put in front
of it.  So the rows of an entity that has a third of the table are dealt to as
many tasks as it has buckets.  The results are those of the window forms in
``sequences``; rows without a time come last there and are the last bucket here.

What is carried between buckets is associative: the last (or first) known value
for fills, the value before and the number of islands so far for islands, and
the sum so far for running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranks
from .sequences import ordered

#: Seconds of a bucket.
BUCKET = 86_400
_LAST = (1 << 62) - 1


def _cut(df: DataFrame, time: str, bucket_seconds: float) -> DataFrame:
    number = F.floor(F.unix_micros(F.col(time)) / F.lit(int(bucket_seconds * 1_000_000)))
    return df.withColumn("__bucket", F.coalesce(number, F.lit(_LAST)))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], reduce: dict[str, Column], carry: Callable[..., dict[str, Column]], inside: dict[str, Column], bucket_seconds: float = BUCKET) -> DataFrame:
    """df with the columns of inside, worked out in each bucket, and of carry, worked out from the reduced rows of all buckets of the keys.

    reduce makes one row of a bucket (it may use the columns of inside); carry(before,
    after) gives columns from those rows, with windows over the buckets before
    and after one.  order begins with the time that buckets are cut by.
    """
    w = ordered([*keys, "__bucket"], list(order))
    rows = _cut(df, order[0], bucket_seconds)
    rows = rows.withColumns({n: c.over(w) for n, c in inside.items()}) if inside else rows
    each = rows.groupBy(*keys, "__bucket").agg(*(c.alias(n) for n, c in reduce.items()))
    of = Window.partitionBy(*keys).orderBy("__bucket")
    before, after = of.rowsBetween(Window.unboundedPreceding, -1), of.rowsBetween(1, Window.unboundedFollowing)
    each = each.select(*keys, "__bucket", *(c.alias(n) for n, c in carry(before, after).items()))
    return ranks.attach(rows, each, [*keys, "__bucket"])


def _filled(df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket_seconds: float, both: bool) -> DataFrame:
    """The last known values of each bucket are max_by of rows that have one; those before and after travel over the buckets."""
    at = F.struct(*(F.struct(F.col(o).isNull().alias("null"), F.col(o).alias("value")).alias(f"o{i}") for i, o in enumerate(order)))  # null goes last
    reduce, names = {}, list(enumerate(columns))
    for i, c in names:
        reduce[f"__l{i}"] = F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
        reduce[f"__f{i}"] = F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at))

    def carry(before, after):
        out = {f"__b{i}": F.last(f"__l{i}", ignorenulls=True).over(before) for i, _ in names}
        return out | ({f"__a{i}": F.first(f"__f{i}", ignorenulls=True).over(after) for i, _ in names} if both else {})

    rows = scan(df, keys, order, reduce, carry, {}, bucket_seconds)
    w = ordered([*keys, "__bucket"], list(order))
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    new = {}
    for i, c in names:
        parts = [F.last(c, ignorenulls=True).over(back), F.col(f"__b{i}")]
        new[c] = F.coalesce(*parts, *([F.first(c, ignorenulls=True).over(on), F.col(f"__a{i}")] if both else []))
    return rows.withColumns(new).select(*df.columns)


def fill_forward(df: DataFrame, keys: list[str], order: list[str], columns: list[str], *, bucket_seconds: float = BUCKET) -> DataFrame:
    """sequences.fill_forward in pieces: the last value that is not null.  Rows that tie in all of order may be taken in any order."""
    return _filled(df, keys, order, columns, bucket_seconds, False)


def fill_both(df: DataFrame, keys: list[str], order: list[str], columns: list[str], *, bucket_seconds: float = BUCKET) -> DataFrame:
    """sequences.fill_both in pieces: forward, and what is left at the beginning backward."""
    return _filled(df, keys, order, columns, bucket_seconds, True)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, *, bucket_seconds: float = BUCKET) -> DataFrame:
    """df with the sum of value over this row and all before it; a null value adds nothing."""
    df = df.withColumn("__v", F.coalesce(value, F.lit(0)))
    rows = scan(df, keys, order, {"__all": F.sum("__v")}, lambda before, after: {"__lead": F.coalesce(F.sum("__all").over(before), F.lit(0))}, {}, bucket_seconds)
    w = ordered([*keys, "__bucket"], list(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum("__v").over(w) + F.col("__lead")).select(*(c for c in df.columns if c not in ("__v", name)), name)


def change_island(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, missing: str = "missing", *, bucket_seconds: float = BUCKET) -> DataFrame:
    """sequences.change_island in pieces: number the runs of equal values, from 1; null counts as a value of its own."""
    return _islands(df, keys, order, F.coalesce(F.col(value).cast("string"), F.lit(missing)), lambda now, before: now != before, name, bucket_seconds)


def gap_island(df: DataFrame, keys: list[str], order: list[str], value: Column, apart: Callable[[Column, Column], Column], name: str, *, bucket_seconds: float = BUCKET) -> DataFrame:
    """Number the runs of rows: a row begins one where apart(its value, the value of the row before) does not say false, as sequences.gap_island does with lag."""
    return _islands(df, keys, order, value, lambda now, before: F.coalesce(apart(now, before), F.lit(True)), name, bucket_seconds)


def _islands(df: DataFrame, keys: list[str], order: list[str], value: Column, apart: Callable[[Column, Column], Column], name: str, bucket_seconds: float) -> DataFrame:
    """A bucket has its first and last value and how often they part inside; whether its first parts from the last before it is known by its neighbour."""
    rows = _cut(df, order[0], bucket_seconds).withColumn("__now", value)
    w = ordered([*keys, "__bucket"], list(order))
    rows = rows.withColumns({"__place": F.row_number().over(w), "__before": F.lag("__now").over(w)})
    rows = rows.withColumn("__new", F.when(F.col("__place") == 1, 0).when(apart(F.col("__now"), F.col("__before")), 1).otherwise(0))
    each = rows.groupBy(*keys, "__bucket").agg(F.min_by(F.struct("__now"), "__place").alias("__first"), F.max_by(F.struct("__now"), "__place").alias("__last"), F.sum("__new").alias("__inside"))
    of = Window.partitionBy(*keys).orderBy("__bucket")
    each = each.withColumn("__edge", F.when(F.lag("__last").over(of).isNull() | apart(F.col("__first.__now"), F.lag("__last").over(of)["__now"]), 1).otherwise(0))
    upto = of.rowsBetween(Window.unboundedPreceding, 0)
    each = each.select(*keys, "__bucket", (F.sum("__edge").over(upto) + F.sum("__inside").over(upto) - F.col("__inside")).alias("__lead"))
    rows = ranks.attach(rows, each, [*keys, "__bucket"])
    inside = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__island", inside + F.col("__lead")).select(*(c for c in df.columns if c != name), F.col("__island").alias(name))
