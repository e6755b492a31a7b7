"""Row numbers and exact quantiles that no single task works out.

Numbers: rows are dealt to ranges of the order, each range is sorted for itself,
and the numbers of a range begin after the sum of the ranges before it.  Only
the counts of ranges, one row a range (and key), go through a window.  Rows that
tie in the order are dealt to several ranges too, so no value is hot.

Quantiles: a mergeable sketch gives for each wanted rank two values that it lies
between; rows below the lower one are counted, and what lies between, a few
thousandths of the rows, is numbered as above.  No task holds the values of a
category.  The counts show whether the sketch has kept its bound; where it has
not, all rows of the category are numbered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared

#: Groups of up to so many rows are numbered whole.
WHOLE = 100_000
#: Of the sketch; a rank is off by one in so many rows at most.
ACCURACY = 10_000

Order = str | Column


def attach(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the further columns of right where all these columns are equal, null being equal to null."""
    renamed = right.select(*(F.col(n).alias(f"__on{i}") for i, n in enumerate(names)), *(F.col(c) for c in right.columns if c not in names))
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"__on{i}")) for i, n in enumerate(names)), F.lit(True))
    return left.join(renamed, on, how).drop(*(f"__on{i}" for i in range(len(names))))


def number_rows(df: DataFrame, order: Sequence[Order], name: str = "n", *, keys: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """df with the place of each row, from 1, by order among all rows or among those of its keys; total names a column for how many these are.

    Nulls of order go last unless a Column says otherwise; rows that tie are
    numbered in any order.  A null key is a key.  df is written once, sorted.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order] + [F.col("__tie").asc()]
    rows = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    # The number of a partition, and of a row inside it, in one: partitions go by ranges.
    rows = shared.written(rows.withColumn("__at", F.monotonically_increasing_id()), "sorted").withColumn("__range", F.shiftright("__at", 33))
    of = Window.partitionBy(*keys)
    heads = rows.groupBy(*keys, "__range").agg(F.min("__at").alias("__head"), F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(of.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(*keys, "__range", "__head", before.alias("__before"), F.sum("__size").over(of).alias("__total"))
    # One row for each partition without keys; with keys their number is not known, and Spark decides.
    both = attach(rows, heads if keys else F.broadcast(heads), [*keys, "__range"])
    more = [] if total is None else [F.col("__total").alias(total)]
    return both.select(*df.columns, (F.col("__at") - F.col("__head") + F.col("__before") + 1).alias(name), *more)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], *, whole: int = WHOLE) -> DataFrame:
    """keys and a column for each share: exact quantiles by linear interpolation (type 7), nulls left out; a key without values has no row.

    Jobs run while this is called.  The keys and the value are written once.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    base = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(x) for k, x in zip(keys, ks, strict=True)), F.col(value).cast("double").alias("__v"))
    base = shared.written(base, "values")
    room = 3 / ACCURACY
    marks = [min(1.0, max(0.0, p + s * room)) for p in shares.values() for s in (-1, 1)]
    groups = base.groupBy(*ks).agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.percentile_approx("__v", marks, ACCURACY).alias("__marks"))
    groups = shared.written(groups, "groups")
    # A small group is one stretch, from its least to its most; of a large one each share has its own.
    few = F.col("__n") <= whole
    stretch = lambda i, low, high: F.struct(F.lit(i).alias("__i"), low.alias("__low"), high.alias("__high"))
    one = F.array(stretch(-1, F.col("__least"), F.col("__most")))
    each = F.array(*(stretch(i, F.col("__marks")[2 * i], F.col("__marks")[2 * i + 1]) for i in range(len(shares))))
    stretches = shared.written(groups.select(*ks, "__n", "__least", "__most", F.inline(F.when(few, one).otherwise(each))), "stretches")
    met = attach(base, shared.small(stretches.drop("__n", "__least", "__most")), ks)
    inside = F.col("__v").between(F.col("__low"), F.col("__high"))
    counts = met.groupBy(*ks, "__i").agg(F.count_if(F.col("__v") < F.col("__low")).alias("__below"), F.count_if(inside).alias("__size"))
    place = {i: (F.col("__n") - 1) * p for i, p in enumerate(shares.values())}
    wanted = F.array(*(F.struct(F.lit(i).alias("__q"), at.alias("__place")) for i, at in place.items()))
    wanted = F.filter(wanted, lambda w: (F.col("__i") == -1) | (F.col("__i") == w["__q"]))
    ranks = attach(stretches, counts, [*ks, "__i"]).select(*ks, "__i", "__below", "__size", F.inline(wanted))
    low, high = F.floor("__place"), F.ceil("__place")
    kept = (low >= F.col("__below")) & (high < F.col("__below") + F.col("__size"))
    ranks = shared.written(ranks.withColumn("__kept", kept), "ranks")
    todo = [met.where(inside).select(*ks, "__i", "__v")]
    if ranks.where("NOT __kept").limit(1).count():  # the sketch was off by more than it promises
        lost = ranks.where("NOT __kept").select(*ks, F.lit(-2).alias("__i")).distinct()
        todo.append(attach(base, lost, ks).select(*ks, "__i", "__v"))
        ranks = ranks.withColumn("__i", F.when(F.col("__kept"), F.col("__i")).otherwise(-2)).withColumn("__below", F.when(F.col("__kept"), F.col("__below")).otherwise(0))
    numbered = number_rows(reduce(DataFrame.union, todo), ["__v"], "__m", keys=[*ks, "__i"])
    found = attach(ranks, numbered, [*ks, "__i"]).withColumn("__rank", F.col("__m") - 1 + F.col("__below")).where((F.col("__rank") == low) | (F.col("__rank") == high))
    at = lambda i, rank: F.max(F.when((F.col("__q") == i) & (F.col("__rank") == rank), F.col("__v")))

    def figure(i: int) -> Column:
        lower, upper, part = at(i, low), at(i, high), F.max(F.when(F.col("__q") == i, F.col("__place") - low))
        return F.when(part == 0, lower).otherwise((1 - part) * lower + part * upper)

    return found.groupBy(*ks).agg(*(figure(i).alias(name) for i, name in enumerate(shares))).select(*(F.col(x).alias(k) for k, x in zip(keys, ks, strict=True)), *shares)
