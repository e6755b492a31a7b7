"""Streams over files, against the batch operators."""

import datetime as dt
import os

from pyspark.sql import functions as F

from chartflow import streaming
from chartflow.operators import sequences

T0 = dt.datetime(2024, 3, 1)


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def source(spark, path):
    rows = [("a", T0 + dt.timedelta(days=d), i, float(d)) for i, d in enumerate([0, 1, 3, 4, 8, 9])] + [("b", T0 + dt.timedelta(minutes=m), 100 + m, float(m)) for m in (0, 10, 70, 75)]
    batch = spark.createDataFrame(rows, "user string, ts timestamp, id long, value double")
    batch.coalesce(1).write.parquet(str(path))
    return batch, spark.readStream.schema(batch.schema).parquet(str(path))


def test_suppression_is_that_of_the_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path / "in")
    got = {r["id"] for r in run(streaming.suppress_repeats(stream, "user", "ts", 3), "kept", "append").collect()}
    want = {r["id"] for r in sequences.suppress_repeats(batch, ["user"], "ts", 3, F.lit(True), "id").collect()}
    assert got == want == {0, 3, 4, 100}


def test_windows_and_sessions(spark, tmp_path):
    _, stream = source(spark, tmp_path / "in")
    hours = run(streaming.hourly(stream, "user", "ts", "value"), "hours", "complete").where("user = 'b'").orderBy("window").collect()
    assert [(r["n"], r["min"], r["max"]) for r in hours] == [(2, 0.0, 10.0), (2, 70.0, 75.0)]
    runs = run(streaming.sessions(stream, "user", "ts"), "runs", "complete").where("user = 'b'").collect()
    assert sorted(r["n"] for r in runs) == [2, 2]


def batches(spark, path, parts):
    """Rows in files that come one after another, out of order; a last file moves the watermark on."""
    schema = "user string, ts timestamp, id long, value double"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / f"b{i}"))
    for i in range(len(parts)):  # files in the order of their times
        for f in sorted((path / f"b{i}").glob("*.parquet")):
            f.rename(path / f"{i:03d}.parquet")
            os.utime(path / f"{i:03d}.parquet", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    batch = spark.createDataFrame([r for rows in parts for r in rows], schema)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(path))


def parts():
    at = lambda d: T0 + dt.timedelta(days=d)
    a = [("a", at(d), i, float(i)) for i, d in enumerate([0.5, 0, 1, 4, 3, 4.2, 8, 7.9, 30, 31])]
    b = [("b", at(d), 50 + i, float(i)) for i, d in enumerate([2, 1.5, 6, 5.6])]
    return [a[:3] + b[:2], a[3:6] + b[2:], a[6:8], a[8:], [("z", at(400), 99, 0.0)], [("z", at(800), 100, 0.0)]]


def test_suppression_in_order_of_time(spark, tmp_path):
    """Rows that come late count where they belong; what is due comes out, and state goes after its time."""
    batch, stream = batches(spark, tmp_path, parts())
    q = streaming.suppress_repeats_in_order(stream, "user", "ts", 3, late="2 days").writeStream.outputMode("append").format("memory").queryName("in_order").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"] for r in spark.table("in_order").collect()}
    want = {r["id"] for r in sequences.suppress_repeats(batch, ["user"], "ts", 3, F.lit(True), "id").collect()}
    assert got == want - {100} and 99 in got  # the last one still waits
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_windows_from_the_first_event(spark, tmp_path):
    batch, stream = batches(spark, tmp_path, parts())
    q = streaming.windows_from_first(stream, "user", "ts", "value", 36, late="2 days", idle="200 days").writeStream.outputMode("append").format("memory").queryName("from_first").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["user"], r["window_number"]): (r["window_start"], r["n"], r["total"], r["least"], r["greatest"]) for r in spark.table("from_first").collect()}
    rows, want = batch.where("user <> 'z'").collect(), {}
    for u in ("a", "b"):
        mine = [r for r in rows if r["user"] == u]
        first = min(r["ts"] for r in mine)
        for r in mine:
            want.setdefault((u, int((r["ts"] - first).total_seconds() // (36 * 3600))), []).append(r["value"])
        for k in [k for k in want if k[0] == u]:
            v = want[k]
            want[k] = (first + dt.timedelta(hours=36 * k[1]), len(v), sum(v), min(v), max(v))
    assert {k: v for k, v in got.items() if k[0] != "z"} == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
