"""Row numbers, quantiles and curves that no single task works out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartflow.operators import aggregates, ranks
from chartflow.sources import shared


def figures(spark, n=20_000):
    """A third of all rows in one key with one value a third of the time; a null key, null values, keys of one and two rows."""
    r = np.random.default_rng(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", float(5.0 if i % 9 == 0 else r.normal())) for i in range(n)]
    rows += [(None, 1.5), (None, 2.5), (None, None), ("one", 7.0), ("two", -1.0), ("two", 4.0), ("none", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(7)


def test_numbers_of_all_rows(spark):
    df = figures(spark).withColumn("n", F.lit("x"))  # a column of that name is replaced by another name
    got = ranks.number_rows(df, [F.col("v").desc_nulls_last()], "place", total="all").orderBy("place").toPandas()
    assert got.place.tolist() == list(range(1, len(got) + 1)) and set(got["all"]) == {len(got)}
    want = df.toPandas().v.sort_values(ascending=False).tolist()
    assert np.array_equal(got.v.to_numpy(), np.array(want), equal_nan=True) and got.columns.tolist() == ["k", "v", "n", "place", "all"]


def test_numbers_by_key(spark):
    df = figures(spark)
    got = ranks.number_rows(df, ["v"], "place", keys=["k"], total="all").toPandas()
    for k, g in got.groupby("k", dropna=False):
        g = g.sort_values("place")
        assert g.place.tolist() == list(range(1, len(g) + 1)) and set(g["all"]) == {len(g)}
        assert g.v.dropna().is_monotonic_increasing and g.v.isna().tolist() == sorted(g.v.isna())
    assert ranks.number_rows(df.where("false"), ["v"], "place", keys=["k"]).count() == 0


def test_no_task_numbers_a_hot_key(spark):
    """One value that all rows share is dealt to many ranges."""
    df = spark.range(0, 40_000, numPartitions=8).select(F.lit("a").alias("k"), F.lit(1).alias("v"))
    rows = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(8, "k", "v", "__tie").groupBy(F.spark_partition_id()).count().toPandas()
    assert len(rows) == 8 and rows["count"].max() < 10_000
    got = ranks.number_rows(df, ["v"], "place", keys=["k"])
    assert got.agg(F.count_distinct("place"), F.max("place")).first()[:] == (40_000, 40_000)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "row_number" not in plan


@pytest.mark.parametrize("whole", [1, 1000, 10**6])
def test_quantiles(spark, whole):
    df = figures(spark)
    shares = {"low": 0.0, "a": 0.25, "b": 0.5, "c": 0.9999, "high": 1.0}
    got = {r["k"]: [r[n] for n in shares] for r in ranks.quantiles(df, ["k"], "v", shares, whole=whole).collect()}
    want = {r["k"]: r["q"] for r in df.where("v IS NOT NULL").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares.values()))).alias("q")).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


def test_quantiles_where_the_sketch_is_wrong(spark, monkeypatch):
    """Marks that miss their rank are noticed by the counts, and all rows of the key are numbered."""
    true = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: true(c, [min(1.0, x + 0.1) for x in p], a))
    df = figures(spark)
    got = {r["k"]: r["m"] for r in ranks.quantiles(df, ["k"], "v", {"m": 0.5}, whole=1).collect()}
    want = {r["k"]: r["m"] for r in df.where("v IS NOT NULL").groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_describe_one_category(spark):
    df = figures(spark).withColumn("k", F.lit("all"))
    got, want = aggregates.describe(df, ["k"], "v", None).first(), df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), F.count("v"), F.avg(F.isnull("v").cast("int")) * 100).first()
    assert np.allclose([got["q1"], got["median"], got["q3"]], want[0], rtol=0, atol=1e-12) and got["count"] == want[1] and abs(got["missing_pct"] - want[2]) < 1e-9
    none = aggregates.describe(figures(spark), ["k"], "v").where("k = 'none'").first()
    assert (none["count"], none["median"], none["missing_pct"]) == (0, None, 100.0)


def test_written_tables_go(spark):
    since = len(shared._made)
    shared.written(spark.range(5), "x")
    assert shared.remove_written(spark, since) == 1 and len(shared._made) == since
