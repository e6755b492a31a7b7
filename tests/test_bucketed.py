"""Tables stored by entity: plans without a shuffle, the same rows, and reading by path."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartflow.operators import asof, sequences
from chartflow.sources import bucketed, shared


def rows(spark):
    return spark.range(0, 3000, numPartitions=5).select(F.when(F.col("id") % 97 > 0, F.col("id") % 13).alias("k"), F.timestamp_seconds(F.col("id") * 7919 % 5000).alias("t"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))


def plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange(spark):
    df = rows(spark)
    name = bucketed.store(df, ["k"], ["t", "id"], buckets=4)
    other = bucketed.store(df.select("k", F.col("t").alias("r"), F.col("id").alias("w")), ["k"], buckets=4)
    mine, theirs = bucketed.read(spark, name), bucketed.read(spark, other)
    filled = sequences.fill_forward(mine, ["k"], ["t", "id"], ["v"])
    counted = theirs.groupBy("k").agg(F.count("*").alias("n"))
    joined = filled.join(counted.hint("merge"), "k").withColumn("m", F.max("v").over(Window.partitionBy("k")))
    for out in (filled, counted, joined):
        assert "Exchange" not in plan(out)
    want = sequences.fill_forward(df, ["k"], ["t", "id"], ["v"])
    assert sorted(map(str, filled.select("id", "v").collect())) == sorted(map(str, want.select("id", "v").collect()))
    assert asof.asof_join(mine, theirs, ["k"], "t", "r", ["w"]).count() == 3000


def test_read_again_by_path(spark):
    df = rows(spark)
    path = shared.fresh_folder(spark, "stored")
    name = bucketed.store(df, ["k"], ["t"], buckets=4, path=path)
    spark.sql(f"DROP TABLE {name}")
    again = bucketed.attach(spark, f"{name}_again", path, df.schema, ["k"], ["t"], buckets=4)
    assert again.count() == 3000 and "Exchange" not in plan(again.groupBy("k").count())


def test_sizes():
    assert [bucketed.buckets_for(n) for n in (0, 8 * bucketed.BUCKET_BYTES, 9 * bucketed.BUCKET_BYTES)] == [8, 8, 16]
