"""Aggregations (A1 to A25): worst values, descriptions, one-hot columns, residuals, step curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from . import ranks


def worst_values(df: DataFrame, keys: list[str], highest: list[str], lowest: list[str]) -> DataFrame:
    """The maximum of some columns and the minimum of others; a column that is missing gives null (A1)."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    return df.groupBy(*keys).agg(*(F.max(have(c)).alias(c) for c in highest), *(F.min(have(c)).alias(c) for c in lowest))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe(df: DataFrame, keys: list[str], value: str, digits: int | None = 2) -> DataFrame:
    """count, missing share, mean, sample deviation, minimum, quartiles by linear interpolation, maximum (A4, A5).

    Rounds half to even, as statistics packages do; None leaves figures as they
    are.  Quartiles are exact, by ranks.quantiles: no task holds the values of a
    group, and jobs run while this is called.
    """
    v = F.col(value).cast("double")
    out = {"mean": F.mean(v), "sd": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    plain = df.groupBy(*keys).agg(F.count(v).alias("count"), *(c.alias(n) for n, c in out.items()), (F.avg(v.isNull().cast("double")) * 100).alias("missing_pct"))
    parts = ranks.quantiles(df.where(v.isNotNull()), keys, value, QUARTILES)
    shown = lambda c: (F.bround(c, digits) if digits is not None else F.col(c)).alias(c)
    return ranks.attach(plain, parts, keys, "left").select(*keys, "count", *map(shown, ("mean", "sd", "min", "q1", "median", "q3", "max", "missing_pct")))


def distinct_with_null(column: str) -> Column:
    """Distinct values, null counted as one (A3)."""
    return F.count_distinct(F.col(column)) + F.max(F.col(column).isNull().cast("long"))


def column_figures(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_rows, nulls and distinct of each column: every (column, value) pair is counted, then every column.

    Pairs are counted where they are before anything is shuffled, so a column
    of few values costs next to nothing, and no row is copied for each distinct count that it takes part in.
    An empty table has a row of zeros for each column.
    """
    cs = columns if columns is not None else [c for c, k in df.dtypes if not k.startswith(("array", "map", "struct", "variant"))]
    pairs = F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cs))))
    values = df.select(pairs).groupBy("i", "value").agg(F.count("*").alias("n"))
    found = values.groupBy("i").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(cs)), "i int, column string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return F.broadcast(names).join(found, "i", "left").select("i", "column", zero("n_rows"), zero("nulls"), zero("distinct"))


def category_distribution(df: DataFrame, category: str, entity: str) -> DataFrame:
    """Entities of each category with their share of all entities; null is a category (A3)."""
    total = df.agg(distinct_with_null(entity).alias("_all"))
    counted = df.groupBy(category).agg(distinct_with_null(entity).alias("n"))
    return counted.join(F.broadcast(total)).select(category, "n", (F.col("n") * 100.0 / F.col("_all")).alias("pct"))


def value_counts(df: DataFrame, columns: list[str], order: Column | None = None, name: str = "n") -> DataFrame:
    """Counts, the largest first; ties by first appearance in an order, or by value."""
    extra = [F.min(order).alias("_first")] if order is not None else []
    out = df.groupBy(*columns).agg(F.count("*").alias(name), *extra)
    return out.orderBy(F.col(name).desc(), *(["_first"] if extra else [F.col(c).asc_nulls_first() for c in columns])).drop("_first")


def most_common(df: DataFrame, column: str, default: str) -> str:
    """The most frequent value, ties to the first in byte order."""
    row = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.col("count").desc(), column).first()
    return row[0] if row else default


def _cells(df: DataFrame, row: str, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the cells that occur (__row, __column, __o), the levels of rows (with how many columns they occur with) and of columns, each with its sum."""
    seen = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("__row"), F.col(column).alias("__column")).agg(F.count("*").alias("__o"))
    seen = shared.written(seen, "cells")
    rows = shared.written(seen.groupBy("__row").agg(F.sum("__o").alias("__r"), F.count("*").alias("__met")), "rows")
    return seen, rows, shared.written(seen.groupBy("__column").agg(F.sum("__o").alias("__c")), "columns")


def _levels(df: DataFrame) -> DataFrame:
    """Levels that are written, to be met with cells: broadcast if their rows, which are counted, are few.

    Spark would go by the size of the files, in which a few MB may stand for
    millions of rows, and these would pass through the driver.
    """
    return F.broadcast(df) if df.limit(shared.SMALL + 1).count() <= shared.SMALL else df.hint("merge")


def _unseen(seen: DataFrame, rows: DataFrame, columns: DataFrame, k: int | None, rising: bool) -> DataFrame:
    """Cells that do not occur, __o being 0: of each row the first k in order of the columns' sums (all, if k is None).

    A row that occurs with m columns has its first k others among the first
    m + k, so what is looked at grows with the cells that occur and with k for
    each row, not with the product of levels.
    """
    order = F.col("__c").asc() if rising else F.col("__c").desc()
    placed = ranks.number_rows(columns, [order, "__column"], "__place")
    many = columns.count()
    most = F.least(F.lit(many), F.col("__met") + k) if k is not None else F.lit(many)
    tried = rows.where(F.lit(many) > 0).withColumn("__place", F.explode(F.sequence(F.lit(1).cast("long"), most.cast("long"))))
    placed = F.broadcast(placed) if many <= shared.SMALL else placed.hint("merge")
    return tried.join(placed, "__place").join(seen.select("__row", "__column").hint("merge"), ["__row", "__column"], "left_anti").select("__row", "__column", F.lit(0).cast("long").alias("__o"), "__r", "__c")


def _residuals(cells: DataFrame, total: int, row: str, column: str) -> DataFrame:
    expected = F.col("__r") * F.col("__c") / F.lit(total)
    return cells.select(F.col("__row").alias(row), F.col("__column").alias(column), F.col("__o").alias("observed"), expected.alias("expected"), ((F.col("__o") - expected) / F.sqrt(expected)).alias("residual"))


def contingency_residuals(df: DataFrame, row: str, column: str) -> DataFrame:
    """observed, expected and (observed - expected) / sqrt(expected) of every pair of levels, those never seen included.

    What comes out is the product of both sides' levels; extreme_residuals()
    gives its ends without it.  Rows with a null in either column are left out.
    """
    seen, rows, columns = _cells(df, row, column)
    total = rows.agg(F.sum("__r")).first()[0] or 0
    known = seen.join(_levels(rows).drop("__met"), "__row").join(_levels(columns), "__column").select("__row", "__column", "__o", "__r", "__c")
    return _residuals(known.union(_unseen(seen, rows, columns, None, True)), total, row, column)


def extreme_residuals(df: DataFrame, row: str, column: str, k: int = 10, least: int = 0) -> DataFrame:
    """The k cells with the greatest residuals and the k with the least ones: side (positive, negative), place, both levels, observed, expected, residual.

    Cells that never occur count, unless least asks for a count.  Of equal
    residuals the first by row and column comes first.  Their residual is
    -sqrt(expected), so those of a row are in order of the columns' sums, and
    _unseen() finds what can be among the first k.
    """
    seen, rows, columns = _cells(df, row, column)
    total = rows.agg(F.sum("__r")).first()[0] or 0
    known = seen.where(F.col("__o") >= least).join(_levels(rows).drop("__met"), "__row").join(_levels(columns), "__column").select("__row", "__column", "__o", "__r", "__c")
    out = None
    for side, order in (("positive", F.col("residual").desc()), ("negative", F.col("residual").asc())):
        cells = known if least > 0 else known.union(_unseen(seen, rows, columns, k, side == "positive"))
        top = _residuals(cells, total, row, column).orderBy(order, row, column).limit(k)
        place = F.row_number().over(Window.partitionBy("side").orderBy(order, row, column))  # of k rows
        top = top.withColumn("side", F.lit(side)).withColumn("place", place).select("side", "place", row, column, "observed", "expected", "residual")
        out = top if out is None else out.union(top)
    return out


def step_curve(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sorted values with k / n for each row, so ties get rising shares (A20).  Values of a key are numbered by ranges, in many tasks."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    numbered = ranks.number_rows(known, [value], "__n", keys=keys, total="__all")
    return numbered.select(*keys, value, (F.col("__n") / F.col("__all")).alias("share"))


def one_hot(df: DataFrame, keys: list[str], column: str, most: int = 100) -> DataFrame:
    """A 0/1 column for each value of a category with at most so many values."""
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    clean = lambda v: "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in v)
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(column).cast("string") == v, 1).otherwise(0)).alias(f"{column}_{clean(v)}") for v in values))


def any_flag(*conditions: Column) -> list[Column]:
    return [F.coalesce(F.max(c.cast("int")), F.lit(0)) for c in conditions]


def listed(column: str, separator: str = ", ") -> Column:
    """Distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def earliest(value: str | Column, condition: Column) -> Column:
    """The least value among rows that meet a condition."""
    return F.min(F.when(condition, value if isinstance(value, Column) else F.col(value)))


def first_by(value: str, *order: str) -> Column:
    """The value of the first row by order, nulls kept."""
    return F.min_by(F.col(value), F.struct(*order, F.col(value)))


def last_by(value: str, *order: str) -> Column:
    return F.max_by(F.col(value), F.struct(*order, F.col(value)))
