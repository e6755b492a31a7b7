"""Scans in pieces and suppression by links against the window forms and a walk over the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartflow.operators import segments, sequences, suppression

T0 = dt.datetime(2024, 1, 1)


def rows(seed=1, n=900):
    """A third of all rows in one entity; a null entity, rows without a time, ties in time, values that are often null."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else r.choice(["a", "b", "c", None])
        t = None if r.random() < 0.03 else T0 + dt.timedelta(hours=r.choice([0, 1, 1, 2, 30, 500]) + r.randint(0, 300))
        out.append((k, i, t, r.choice([None, None, None, 1.0, 2.0]), r.choice(["x", "y", None])))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k string, id int, t timestamp, v double, s string").repartition(5)


def listed(df):
    return sorted(map(tuple, df.select("k", "id", "t", *sorted(set(df.columns) - {"k", "id", "t"})).collect()), key=str)


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_pieces_give_what_windows_give(spark, seconds):
    df, order = frame(spark, rows()), ["t", "id"]
    assert listed(segments.fill_forward(df, ["k"], order, ["v", "s"], bucket_seconds=seconds)) == listed(sequences.fill_forward(df, ["k"], order, ["v", "s"]))
    assert listed(segments.fill_both(df, ["k"], order, ["v"], bucket_seconds=seconds)) == listed(sequences.fill_both(df, ["k"], order, ["v"]))
    assert listed(segments.change_island(df, ["k"], order, "s", "island", bucket_seconds=seconds)) == listed(sequences.change_island(df, ["k"], order, "s", "island"))
    w = sequences.ordered(["k"], order)
    far = lambda now, before: F.unix_micros(now) - F.unix_micros(before) > 3_600_000_000
    assert listed(segments.gap_island(df, ["k"], order, F.col("t"), far, "g", bucket_seconds=seconds)) == listed(sequences.gap_island(df, ["k"], order, far(F.col("t"), F.lag("t").over(w)), "g"))
    want = df.withColumn("sum", F.sum(F.coalesce("v", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert listed(segments.running_sum(df, ["k"], order, F.col("v"), "sum", bucket_seconds=seconds)) == listed(want)


def test_an_island_column_is_replaced_and_nothing_gives_nothing(spark):
    df = frame(spark, rows(n=60))
    assert segments.change_island(df, ["k"], ["t", "id"], "s", "v").columns == ["k", "id", "t", "s", "v"]
    none = df.where("false")
    assert segments.fill_both(none, ["k"], ["t", "id"], ["v"]).count() == segments.change_island(none, ["k"], ["t", "id"], "s", "n").count() == 0


def test_a_hot_entity_is_many_tasks(spark):
    """The largest task of a scan holds the rows of a few buckets, not those of the entity."""
    df = spark.range(0, 24_000, numPartitions=4).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    filled = segments.fill_forward(df, ["k"], ["t"], ["v"], bucket_seconds=3600)
    sizes = filled.groupBy(F.floor(F.unix_seconds("t") / 3600)).count().toPandas()["count"]
    assert len(sizes) == 400 and sizes.max() == 60 and filled.where("v IS NULL").count() == 0
    plan = filled._jdf.queryExecution().analyzed().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "windowspec" in line and "_bucket" not in line.split("windowspecdefinition")[1].split("ASC")[0]]
    assert len(windows) <= 1  # that over one row for each bucket


def walk(data, days, subject):
    kept = []
    for k in {r[0] for r in data}:
        last = None
        for r in sorted((r for r in data if r[0] == k and r[2] is not None), key=lambda r: (r[2], r[1])):
            if not subject(r) or last is None or (r[2] - last).days > days:
                kept.append(r[1])
                last = r[2]
    return sorted(kept + [r[1] for r in data if r[2] is None])


@pytest.mark.parametrize("days", [0, 2, 14])
def test_suppression_is_the_walk(spark, days):
    data = rows(days + 5, 400)
    df = frame(spark, data)
    for subject, plain in ((F.lit(True), lambda r: True), (F.col("s") == "x", lambda r: r[4] == "x")):
        got = suppression.suppress_repeats(df, ["k"], "t", days, subject, "id", bucket_seconds=7 * 3600)
        assert sorted(r["id"] for r in got.collect()) == walk(data, days, plain) and got.columns == df.columns


def test_suppression_of_a_long_chain(spark):
    data = [("a", i, T0 + dt.timedelta(hours=7 * i), 0.0, "x") for i in range(700)]
    got = sequences.suppress_repeats(frame(spark, data), ["k"], "t", 1, F.lit(True), "id")
    assert sorted(r["id"] for r in got.collect()) == walk(data, 1, lambda r: True)
    assert "collect_list" not in got._jdf.queryExecution().analyzed().toString()
    assert sequences.suppress_repeats(frame(spark, data).where("false"), ["k"], "t", 1, F.lit(True), "id").count() == 0
