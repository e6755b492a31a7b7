"""Small cases for operators whose edges the queries do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chartflow.operators import aggregates, asof, intervals, predicates, reshape, sequences

T0 = dt.datetime(2024, 5, 1)


def at(hours=0.0, days=0):
    return T0 + dt.timedelta(hours=hours, days=days)


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(2)), (3, "b", at(1)), (4, None, at(1)), (5, "a", None)], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(1), 10.0), ("a", at(1), 12.0), ("a", at(1.5), None), (None, at(0), 9.0), ("a", None, 1.0)], "k string, r timestamp, v double")
    got = {x["id"]: (x["v"], x["m"]) for x in asof.asof_join(left, right, ["k"], "t", "r", ["v"], matched_time="m").collect()}
    assert got == {1: (12.0, at(1)), 2: (None, at(1.5)), 3: (None, None), 4: (None, None), 5: (None, None)}
    some = {x["id"]: x["v"] for x in asof.asof_join(left, right, ["k"], "t", "r", ["v"], skip_null="v", tolerance_seconds=1800).collect()}
    assert some == {1: 12.0, 2: None, 3: None, 4: None, 5: None}
    for seconds in (600, 3600, 10**6):
        split = {x["id"]: (x["v"], x["m"]) for x in asof.split_asof_join(left, right, ["k"], "t", "r", ["v"], matched_time="m", bucket_seconds=seconds).collect()}
        assert split == got
    plan = asof.asof_join(left, right, ["k"], "t", "r", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_suppression_of_rows_without_key_or_id(spark):
    rows = [(None, 1, at(), True), (None, 2, at(days=1), True), (None, 3, at(days=9), True), ("a", None, at(), False), ("a", 5, at(days=1), True), ("a", 6, None, True), ("a", None, at(days=9), True)]
    df = spark.createDataFrame(rows, "h string, id int, t timestamp, s boolean")
    got = sequences.suppress_repeats(df, ["h"], "t", 3, F.col("s"), "id").collect()
    assert {(x["h"], x["id"], x["t"]) for x in got} == {(None, 1, at()), (None, 3, at(days=9)), ("a", None, at()), ("a", 6, None), ("a", None, at(days=9))} and len(got) == 5


def test_suppression_with_rows_that_set_the_clock(spark):
    rows = [("h", 1, at(days=0), "hospital"), ("h", 2, at(days=5), "community"), ("h", 3, at(days=16), "hospital"), ("h", 4, at(days=25), "hospital"), ("h", 5, None, "hospital"), ("g", 6, at(days=16), "hospital"), ("h", 7, at(days=39, hours=23), "hospital")]
    df = spark.createDataFrame(rows, "h string, id int, t timestamp, kind string")
    got = {r["id"] for r in sequences.suppress_repeats(df, ["h"], "t", 14, F.col("kind") == "hospital", "id").collect()}
    assert got == {1, 2, 4, 5, 6}


def test_islands_and_fills_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", 1.0), (3, "x", None), (4, None, None), (5, None, 2.0), (6, "x", None)], "t int, c string, v double").withColumn("k", F.lit(1))
    got = [r["i"] for r in sequences.change_island(df, ["k"], ["t"], "c", "i").orderBy("t").collect()]
    assert got == [1, 2, 2, 3, 3, 4]
    assert [r["v"] for r in sequences.fill_forward(df, ["k"], ["t"], ["v"]).orderBy("t").collect()] == [None, 1.0, 1.0, 1.0, 2.0, 2.0]
    assert [r["v"] for r in sequences.fill_both(df, ["k"], ["t"], ["v"]).orderBy("t").collect()][0] == 1.0


def test_one_shuffle_for_a_chain_of_fills(spark):
    df = spark.createDataFrame([(1, 1, "x", "y", 1.0)], "k int, t int, a string, b string, v double")
    df = sequences.change_island(df, ["k"], ["t"], "a", "i")
    df = sequences.fill_forward(df, ["k", "i"], ["t"], ["b"])
    df = sequences.change_island(df, ["k"], ["t"], "b", "j")
    plan = sequences.fill_forward(df, ["k", "j"], ["t"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_interval_edges(spark):
    e = spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(6))], "k int, t timestamp")
    w = spark.createDataFrame([(1, at(0), at(5)), (1, at(5), at(6)), (1, at(9), at(8))], "k int, s timestamp, f timestamp")
    assert intervals.interval_join(e, w, ["k"], "t", "s", "f").count() == 4
    assert intervals.interval_join(e, w, ["k"], "t", "s", "f", closed=False).count() == 2
    days = spark.createDataFrame([(1, at(0), at(days=9)), (2, at(0), at(days=-1))], "k int, s timestamp, f timestamp")
    assert [r["k"] for r in intervals.expand_days(days, "s", "f", most=3).collect()] == [1, 1, 1]


def test_windows_and_gaps(spark):
    df = spark.createDataFrame([(1, at(0.5), 1.0, "a"), (1, at(1.4), 3.0, "b"), (1, at(4.6), None, "a")], "k int, t timestamp, v double, c string")
    out = reshape.aggregate_windows(df, ["k"], "t", 1, {"max": ["v"], "one_hot": ["c"]})
    rows = reshape.fill_windows(out, ["k"], 1).orderBy("window_number").collect()
    assert [(r["window_number"], r["v_max"], r["c_a"], r["c_b"]) for r in rows] == [(0, 3.0, 1, 1), (1, None, None, None), (2, None, None, None), (3, None, None, None), (4, None, 1, 0)]
    assert rows[1]["window_start"] == at(1.5) and rows[1]["window_end"] == at(2.5)
    for bad in ({"hours": 0}, {"hours": 73}):
        with pytest.raises(ValueError):
            reshape.fixed_windows(df, ["k"], "t", **bad)
    with pytest.raises(ValueError):
        reshape.aggregate_windows(df, ["k"], "t", 1, {"mode": ["v"]})


def test_both_wide_tables_agree(spark):
    e = spark.createDataFrame([(1, at(0), "a", 1.0), (1, at(0.001), "b", 2.0), (1, at(0.002), "b", 5.0), (1, at(30), "a", None), (2, at(3), "z", 1.0)], "k int, t timestamp, c string, v double")
    cohort = spark.createDataFrame([(1, 50), (2, 60), (3, 70)], "k int, age int")
    pivot = reshape.minute_pivot(e, ["k"], "t", "c", "v", ["a", "b"])
    a = reshape.wide_table(cohort, [pivot], [], reshape.event_times([(e, "t")], ["k"]), ["k"])
    b = reshape.wide_from_long(cohort, [reshape.Long(e, "t", "c", "v", ("a", "b"))], ["k"])
    assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert b.where("k = 1").agg(F.max("day_number"), F.max("b")).first()[:] == (2, 2.0)


def test_samples_and_one_hot(spark):
    df = spark.range(100).withColumn("c", F.format_string("v%d", F.col("id") % 3))
    assert [r[0] for r in predicates.sample_entities(df, "id", 5, 1).collect()] == [r[0] for r in predicates.sample_entities(df.repartition(7), "id", 5, 1).collect()]
    assert predicates.of_entities(df, [1, 2], "id").count() == predicates.of_entities(df, df.limit(2), "id").count() == 2
    assert aggregates.one_hot(df, ["id"], "c").columns == ["id", "c_v0", "c_v1", "c_v2"]
    with pytest.raises(ValueError):
        aggregates.one_hot(df, ["c"], "id", 50)
