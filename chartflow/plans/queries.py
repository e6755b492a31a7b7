"""One query for each generic operator over the star-schema and event tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..clinical import comorbidity, sofa, stitching
from ..functions import scalars
from ..operators import aggregates, asof, extremal, intervals, prefix, ranges, ranks, reshape, segments, sequences, units
from ..quality import checks
from ..sources import bucketed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TYPES = ["click", "error", "purchase", "signup", "view"]
RULES = [("click", 5.0, 60.0), ("error", 1.0, 40.0), ("purchase", 10.0, 80.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps as instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_linestatus IN ('F', 'O')")
def scan_filter_project(spark, d):
    return table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45) & F.col("l_linestatus").isin("F", "O")).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def cohort_semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def orphan_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def inner_join_rollup(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_counts(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


def _sides(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views


_ASOF = """SELECT p.event_id, p.user_id, p.ts, {v} AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.view_ts"""


@query(_ASOF.format(v="v.view_value"))
def asof_backward(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_value"])


@query(_ASOF.format(v="CASE WHEN p.ts - v.view_ts <= INTERVAL 240 MINUTE THEN v.view_value END"))
def asof_tolerance(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_value"], tolerance_seconds=240 * 60)


@query(_ASOF.format(v="v.view_value"))
def asof_split(spark, d):
    left, right = _sides(spark, d)
    return asof.split_asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_value"], bucket_seconds=6 * 3600)


_WINDOWS = """(SELECT user_id, ts AS start_time, ts + INTERVAL 12 HOUR AS end_time FROM events WHERE event_type = 'error')"""


def _windows(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select("user_id", F.col("ts").alias("start_time"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("end_time"))


_INTERVAL = f"SELECT e.event_id, e.user_id, e.ts, w.start_time, w.end_time FROM events e JOIN {_WINDOWS} w ON e.user_id = w.user_id AND e.ts >= w.start_time AND e.ts <= w.end_time"


@query(_INTERVAL)
def interval_join_closed(spark, d):
    return intervals.interval_join(table(spark, d, "events").select("event_id", "user_id", "ts"), _windows(spark, d), ["user_id"], "ts", "start_time", "end_time")


@query(_INTERVAL)
def interval_join_bucketed(spark, d):
    return intervals.split_interval_join(table(spark, d, "events").select("event_id", "user_id", "ts"), _windows(spark, d), ["user_id"], "ts", "start_time", "end_time", bucket_seconds=6 * 3600)


@query(f"SELECT e.event_id, e.user_id FROM events e LEFT JOIN {_WINDOWS} w ON e.user_id = w.user_id AND e.ts >= w.start_time AND e.ts < w.end_time WHERE e.event_type = 'click' AND w.start_time IS NULL")
def interval_anti_join(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    return intervals.outside_intervals(e, _windows(spark, d), ["user_id"], "ts", "start_time", "end_time", F.lit(False)).select("event_id", "user_id")


@query("SELECT e.event_id, a.ts AS error_ts FROM events e JOIN events a ON e.user_id = a.user_id AND a.event_type = 'error' AND abs(datediff('day', a.ts, e.ts)) <= 2 WHERE e.event_type = 'purchase'")
def window_day_join(spark, d):
    e = table(spark, d, "events")
    near = intervals.around_days(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts")), ["user_id"], "ts", "error_ts", 2)
    return near.select("event_id", "error_ts")


_PIVOT = "SELECT user_id, strftime(ts, '%Y%m%d%H%M') AS minute_key, " + ", ".join(f"arg_min(value, (ts, value)) FILTER (event_type = '{t}' AND value IS NOT NULL) AS {t}" for t in TYPES) + " FROM events GROUP BY ALL"


def _pivot(spark, d):
    return reshape.minute_pivot(table(spark, d, "events"), ["user_id"], "ts", "event_type", "value", TYPES)


@query(_PIVOT)
def minute_pivot(spark, d):
    return _pivot(spark, d)


_WIDE = f"""SELECT t.user_id, t.event_time, {", ".join("p." + t for t in TYPES)},
    dense_rank() OVER (PARTITION BY t.user_id ORDER BY CAST(t.event_time AS DATE)) AS day_number
    FROM (SELECT DISTINCT user_id, ts AS event_time FROM events) t
    LEFT JOIN ({_PIVOT}) p ON t.user_id = p.user_id AND strftime(t.event_time, '%Y%m%d%H%M') = p.minute_key"""


def _wide(spark, d):
    e = table(spark, d, "events")
    users = e.select("user_id").distinct()
    return reshape.wide_from_long(users, [reshape.Long(e, "ts", "event_type", "value", tuple(TYPES))], ["user_id"])


@query(f"SELECT *, user_id || '_day_' || day_number AS id_day_key FROM ({_WIDE})")
def wide_dataset(spark, d):
    return _wide(spark, d)


_HOURLY = f"""WITH wide AS ({_WIDE}), f AS (SELECT *, min(event_time) OVER (PARTITION BY user_id) AS t0 FROM wide),
    w AS (SELECT *, CAST(floor((epoch_us(event_time) - epoch_us(t0)) / 3600000000) AS BIGINT) AS window_number FROM f)
    SELECT user_id, window_number, t0 + window_number * INTERVAL 1 HOUR AS window_start, t0 + (window_number + 1) * INTERVAL 1 HOUR AS window_end,
        max(click) AS click_max, min(error) AS error_min, round(avg(view), 6) AS view_mean, median(view) AS view_median,
        first(purchase ORDER BY event_time) AS purchase_first, last(view ORDER BY event_time) AS view_last,
        CAST(count(signup) > 0 AS INTEGER) AS signup_boolean, first(day_number ORDER BY event_time) AS day_number_c
    FROM w GROUP BY user_id, window_number, t0"""


def _hourly(spark, d):
    config = {"max": ["click"], "min": ["error"], "mean": ["view"], "median": ["view"], "first": ["purchase"], "last": ["view"], "boolean": ["signup"]}
    out = reshape.aggregate_windows(_wide(spark, d).drop("id_day_key"), ["user_id"], "event_time", 1, config)
    return out.withColumn("view_mean", F.round("view_mean", 6))


@query(f"SELECT *, user_id || '_day_' || day_number AS id_day_key FROM ({_WIDE})")
def wide_dataset_by_joins(spark, d):
    e = table(spark, d, "events")
    users = e.select("user_id").distinct()
    return reshape.wide_table(users, [_pivot(spark, d)], [], reshape.event_times([(e, "ts")], ["user_id"]), ["user_id"])


@query(_HOURLY)
def hourly_aggregate(spark, d):
    return _hourly(spark, d)


@query(f"""WITH h AS ({_HOURLY}), s AS (SELECT user_id, min(window_number) AS a, max(window_number) AS b, min(window_start) AS t FROM h GROUP BY user_id),
    g AS (SELECT user_id, t, a, unnest(range(a, b + 1)) AS window_number FROM s)
    SELECT g.user_id, g.window_number, g.t + (g.window_number - g.a) * INTERVAL 1 HOUR AS window_start, g.t + (g.window_number - g.a + 1) * INTERVAL 1 HOUR AS window_end, h.click_max, h.view_last
    FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.window_number = h.window_number""")
def hourly_gap_fill(spark, d):
    return reshape.fill_windows(_hourly(spark, d), ["user_id"], 1).select("user_id", "window_number", "window_start", "window_end", "click_max", "view_last")


@query("SELECT user_id, " + ", ".join(f"max(CAST(event_type = '{t}' AS INTEGER)) AS event_type_{t}" for t in TYPES) + " FROM events GROUP BY user_id")
def one_hot(spark, d):
    return aggregates.one_hot(table(spark, d, "events"), ["user_id"], "event_type")


@query("""SELECT user_id, h + INTERVAL 3599 SECOND AS scaffold FROM (SELECT user_id, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h FROM events GROUP BY user_id)""")
def hour_scaffold(spark, d):
    return intervals.hour_scaffold(table(spark, d, "events"), ["user_id"], "ts")


@query("""SELECT o_orderkey, CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS day FROM orders""")
def day_expand(spark, d):
    o = table(spark, d, "orders").withColumn("last", F.expr("date_add(to_date(o_orderdate), CAST(o_orderkey % 5 AS INT))"))
    return intervals.expand_days(o, "o_orderdate", "last").select("o_orderkey", "day")


@query(f"""SELECT w.user_id, w.start_time, w.end_time, min(value) FILTER (event_type = 'view') AS view_min, max(value) FILTER (event_type = 'view') AS view_max, arg_max(value, ts) FILTER (event_type = 'click') AS click_latest
    FROM (SELECT DISTINCT * FROM {_WINDOWS}) w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN w.start_time AND w.end_time
    WHERE event_type IN ('view', 'click') AND value IS NOT NULL GROUP BY ALL""")
def extremal_lookup(spark, d):
    return extremal.extremal_lookup(table(spark, d, "events"), _windows(spark, d).distinct(), ["user_id"], "ts", "event_type", "value", {"view": ["min", "max"], "click": ["latest"]})


_HOLES = "(SELECT user_id, event_id, ts, event_type, CASE WHEN value <= 50 THEN value END AS v FROM events)"


def _holes(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.when(F.col("value") <= 50, F.col("value")).alias("v"))


@query(f"SELECT user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM {_HOLES}")
def locf_fill(spark, d):
    return sequences.fill_forward(_holes(spark, d), ["user_id"], ["ts", "event_id"], ["v"]).select("user_id", "event_id", "v")


@query(f"""SELECT user_id, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id),
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM {_HOLES}""")
def bfill(spark, d):
    return sequences.fill_both(_holes(spark, d), ["user_id"], ["ts", "event_id"], ["v"]).select("user_id", "event_id", "v")


_ISLANDS = f"""SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {_HOLES})"""


@query(f"SELECT user_id, event_id, island FROM ({_ISLANDS})")
def change_point_islands(spark, d):
    return sequences.change_island(_holes(spark, d), ["user_id"], ["ts", "event_id"], "event_type", "island").select("user_id", "event_id", "island")


@query(f"SELECT user_id, event_id, island, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS v FROM ({_ISLANDS})")
def hierarchical_fill(spark, d):
    df = sequences.change_island(_holes(spark, d), ["user_id"], ["ts", "event_id"], "event_type", "island")
    return sequences.fill_forward(df, ["user_id", "island"], ["ts", "event_id"], ["v"]).select("user_id", "event_id", "island", "v")


_CUT = 6 * 3600


@query(SQL["locf_fill"])
def locf_fill_split(spark, d):
    return segments.fill_forward(_holes(spark, d), ["user_id"], ["ts", "event_id"], ["v"], bucket_seconds=_CUT).select("user_id", "event_id", "v")


@query(SQL["bfill"])
def bfill_split(spark, d):
    return segments.fill_both(_holes(spark, d), ["user_id"], ["ts", "event_id"], ["v"], bucket_seconds=_CUT).select("user_id", "event_id", "v")


@query(SQL["change_point_islands"])
def change_point_islands_split(spark, d):
    return segments.change_island(_holes(spark, d), ["user_id"], ["ts", "event_id"], "event_type", "island", bucket_seconds=_CUT).select("user_id", "event_id", "island")


@query("SELECT user_id, event_id, count(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM " + _HOLES)
def running_count_split(spark, d):
    known = F.col("v").isNotNull().cast("int")
    return segments.running_sum(_holes(spark, d), ["user_id"], ["ts", "event_id"], known, "seen", bucket_seconds=_CUT).select("user_id", "event_id", "seen")


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def sessions_split(spark, d):
    apart = lambda now, before: F.unix_micros(now) - F.unix_micros(before) > 8 * 3_600_000_000
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return segments.gap_island(e, ["user_id"], ["ts", "event_id"], F.col("ts"), apart, "session", bucket_seconds=_CUT).drop("ts")


@query(f"""SELECT h.user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY h.user_id ORDER BY ts, event_id) AS v, count(*) OVER (PARTITION BY h.user_id) AS n_events, coalesce(orders, 0) AS orders
    FROM {_HOLES} h LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) o ON h.user_id = o_custkey""")
def bucketed_windows(spark, d):
    """Events and orders stored by user: fills, counts and their join run on the buckets, without a shuffle."""
    events = bucketed.store(_holes(spark, d), ["user_id"], ["ts", "event_id"])
    orders = bucketed.store(table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey"), ["user_id"])
    filled = sequences.fill_forward(bucketed.read(spark, events), ["user_id"], ["ts", "event_id"], ["v"])
    filled = filled.withColumn("n_events", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    counted = bucketed.read(spark, orders).groupBy("user_id").agg(F.count("*").alias("orders"))
    return filled.join(counted.hint("merge"), "user_id", "left").select("user_id", "event_id", "v", "n_events", F.coalesce("orders", F.lit(0)).alias("orders"))


_DAYS = "(SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')"


def _days(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")).distinct()


@query(f"""SELECT user_id, course, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (
    SELECT *, CAST(sum(CASE WHEN p IS NULL OR datediff('day', p, day) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS course
    FROM (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS p FROM {_DAYS})) GROUP BY ALL""")
def gap_courses(spark, d):
    return sequences.day_courses(_days(spark, d), ["user_id"], "day", 2).groupBy("user_id", "course").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


@query(f"""SELECT user_id, CAST(least(sum(CASE WHEN off = 0 THEN 1 ELSE 0 END), 7) AS BIGINT) AS run FROM (
    SELECT user_id, datediff('day', min(day) OVER (PARTITION BY user_id), day) - (row_number() OVER (PARTITION BY user_id ORDER BY day) - 1) AS off FROM {_DAYS}) GROUP BY user_id""")
def qualifying_run(spark, d):
    days = _days(spark, d).withColumn("anchor", F.min("day").over(Window.partitionBy("user_id")))
    return sequences.consecutive_run(days, ["user_id"], "day", "anchor", 7)


@query("""SELECT o_custkey, block, count(*) AS orders, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM (
    SELECT *, CAST(sum(CASE WHEN p IS NULL OR o_orderdate - p > INTERVAL 60 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS block
    FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)) GROUP BY ALL""")
def stitch_sessions(spark, d):
    o = table(spark, d, "orders").withColumn("end", F.col("o_orderdate"))
    return sequences.chain(o, ["o_custkey"], "o_orderdate", "end", 60 * 86_400).groupBy("o_custkey", "block").agg(F.count("*").alias("orders"), F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
    k AS (SELECT user_id, event_id, n, ts AS last, TRUE AS keep FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN floor((epoch_us(e.ts) - epoch_us(k.last)) / 86400000000) > 3 THEN e.ts ELSE k.last END, floor((epoch_us(e.ts) - epoch_us(k.last)) / 86400000000) > 3
        FROM e JOIN k ON e.user_id = k.user_id AND e.n = k.n + 1)
    SELECT user_id, event_id FROM k WHERE keep""")
def repeat_suppression(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", "ts")
    return sequences.suppress_repeats(e, ["user_id"], "ts", 3, F.lit(True), "event_id").select("user_id", "event_id")


@query("SELECT event_id, event_type, CASE " + " ".join(f"WHEN event_type = '{t}' AND (value < {a} OR value > {b}) THEN NULL" for t, a, b in RULES) + " ELSE value END AS value FROM events")
def outlier_null(spark, d):
    return ranges.clamp_by_rule(table(spark, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"], RULES)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS event_type, CAST({a} AS DOUBLE) AS low, CAST({b} AS DOUBLE) AS high, count(*) AS n, count(*) FILTER (value < {a}) AS n_below, count(*) FILTER (value > {b}) AS n_above, count(*) FILTER (value < {a} OR value > {b}) AS n_outside, round(count(*) FILTER (value < {a} OR value > {b}) * 100.0 / count(*), 6) AS pct_outside FROM events WHERE event_type = '{t}' AND value IS NOT NULL" for t, a, b in RULES) + ") WHERE n_outside > 0")
def outlier_summary(spark, d):
    return ranges.range_summary(table(spark, d, "events"), "value", ["event_type"], RULES).withColumn("pct_outside", F.round("pct_outside", 6))


_RAW_UNIT = "CASE l_linenumber % 6 WHEN 0 THEN 'MG / hour' WHEN 1 THEN 'mcg/kg/min' WHEN 2 THEN 'Units/hr' WHEN 3 THEN 'milliliters' WHEN 4 THEN 'grams/kg/h' ELSE 'puffs' END"
_CLEAN = f"nullif(lower(regexp_replace({_RAW_UNIT}, '\\s+', '', 'g')), '')"
for _p, _r in scalars.UNIT_SPELLINGS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', 'g')"


def _doses(spark, d):
    raw = F.expr(_RAW_UNIT)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("med_dose"), raw.alias("med_dose_unit"), F.when(F.col("l_linenumber") < 5, F.col("l_discount") * 100 + 50).alias("weight_kg"), F.lit("x").alias("med_category"))


@query(f"SELECT DISTINCT {_RAW_UNIT} AS med_dose_unit, {_CLEAN} AS clean_unit FROM lineitem")
def unit_normalise(spark, d):
    return _doses(spark, d).select("med_dose_unit", scalars.clean_unit_name(scalars.clean_unit_format(F.col("med_dose_unit"))).alias("clean_unit")).distinct()


@query(f"""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS dose, CASE WHEN l_linenumber < 5 THEN l_discount * 100 + 50 END AS w, {_CLEAN} AS u FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE
        WHEN u = 'mg/hr' THEN 'mcg/min' WHEN u = 'mcg/kg/min' AND w IS NOT NULL THEN 'mcg/min' WHEN u = 'g/kg/hr' AND w IS NOT NULL THEN 'mcg/min' WHEN u = 'u/hr' THEN 'u/min' ELSE u END AS base_unit,
        round(CASE WHEN u = 'mg/hr' THEN dose * 1000.0 / 60 WHEN u = 'u/hr' THEN dose / 60 WHEN u = 'mcg/kg/min' AND w IS NOT NULL THEN dose * w WHEN u = 'g/kg/hr' AND w IS NOT NULL THEN dose * 1000000 / 60 * w ELSE dose END, 4) AS base_dose FROM s""")
def unit_convert(spark, d):
    return units.to_base(_doses(spark, d)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("_base_unit").alias("base_unit"), F.round("_base_dose", 4).alias("base_dose"))


_FLAGS = {"promo": ["pro"], "metal": ["standard", "sm"], "economy": ["eco", "med"]}
_FLAG_SQL = ", ".join(f"max(CAST({' OR '.join(f'starts_with(t, {chr(39)}{p}{chr(39)})' for p in ps)} AS INTEGER)) AS {c}" for c, ps in _FLAGS.items())
_PARTS = f"SELECT l_suppkey, {_FLAG_SQL} FROM (SELECT l_suppkey, lower(replace(trim(p_type), '.', '')) AS t FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_suppkey"


def _flags(spark, d, hierarchies=()):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return prefix.flags(rows, ["l_suppkey"], scalars.clean_code(F.col("p_type")), _FLAGS, hierarchies)


@query(_PARTS)
def prefix_flags(spark, d):
    return _flags(spark, d)


@query(f"SELECT l_suppkey, CASE WHEN promo = 1 THEN 0 ELSE metal END AS metal, promo FROM ({_PARTS})")
def hierarchy_zero(spark, d):
    return _flags(spark, d, [("promo", "metal")]).select("l_suppkey", "metal", "promo")


@query(f"SELECT l_suppkey, promo * 2 + metal * -1 + economy * 4 AS score FROM ({_PARTS})")
def weighted_index(spark, d):
    return _flags(spark, d).select("l_suppkey", prefix.weighted_sum({"promo": 2, "metal": -1, "economy": 4}).alias("score"))


@query("""SELECT user_id, click, error, CASE WHEN click > 90 OR error > 80 THEN 4 WHEN click > 60 THEN 3 WHEN click <= 60 THEN 2 END AS ladder
    FROM (SELECT user_id, max(value) FILTER (event_type = 'click') AS click, min(value) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id)""")
def worst_value_ladder(spark, d):
    wide = table(spark, d, "events").select("user_id", *(F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in ("click", "error")))
    worst = aggregates.worst_values(wide, ["user_id"], ["click"], ["error"])
    return worst.withColumn("ladder", F.when((F.col("click") > 90) | (F.col("error") > 80), 4).when(F.col("click") > 60, 3).when(F.col("click") <= 60, 2))


@query("SELECT user_id, min(ts) FILTER (event_type = 'click' AND value > 70) AS click_time, min(ts) FILTER (event_type = 'view' AND value > 80) AS view_time FROM events GROUP BY user_id")
def first_crossing(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(aggregates.earliest("ts", (F.col("event_type") == "click") & (F.col("value") > 70)).alias("click_time"), aggregates.earliest("ts", (F.col("event_type") == "view") & (F.col("value") > 80)).alias("view_time"))


@query("SELECT user_id, least(min(ts) FILTER (event_type = 'click' AND value > 70), min(ts) FILTER (event_type = 'view' AND value > 80)) AS onset FROM events GROUP BY user_id")
def least_onset(spark, d):
    return first_crossing(spark, d).select("user_id", F.least("click_time", "view_time").alias("onset"))


@query("SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) / count(*) OVER (PARTITION BY event_type) AS share FROM events WHERE value IS NOT NULL")
def ecdf_rowwise(spark, d):
    return aggregates.step_curve(table(spark, d, "events"), ["event_type"], "value")


@query("""SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q1, round(median(value), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS max, avg(CAST(value IS NULL AS INTEGER)) * 100 AS missing_pct FROM events GROUP BY event_type""")
def describe_by_category(spark, d):
    out = aggregates.describe(table(spark, d, "events"), ["event_type"], "value", None)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "q1", "median", "q3")})


@query("SELECT event_type, count(DISTINCT user_id) AS n, round(count(DISTINCT user_id) * 100.0 / (SELECT count(DISTINCT user_id) FROM events), 6) AS pct FROM events GROUP BY event_type")
def category_distribution(spark, d):
    return aggregates.category_distribution(table(spark, d, "events"), "event_type", "user_id").withColumn("pct", F.round("pct", 6))


@query("""WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS o FROM lineitem GROUP BY ALL), r AS (SELECT l_returnflag, sum(o) AS r FROM s GROUP BY ALL), c AS (SELECT l_linestatus, sum(o) AS c FROM s GROUP BY ALL), n AS (SELECT sum(o) AS n FROM s)
    SELECT l_returnflag, l_linestatus, coalesce(o, 0) AS observed, round(r * c / n, 4) AS expected, round((coalesce(o, 0) - r * c / n) / sqrt(r * c / n), 4) AS residual FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN s USING (l_returnflag, l_linestatus)""")
def contingency_residual(spark, d):
    out = aggregates.contingency_residuals(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.withColumns({c: F.round(c, 4) for c in ("expected", "residual")})


_NORMAL = "trim(regexp_replace(regexp_replace(replace(replace(lower(trim({c})), '&', '_and_'), '/', '_or_'), '[ \\-,()]', '_', 'g'), '_+', '_', 'g'), '_')"


@query(f"SELECT DISTINCT o_orderpriority, {_NORMAL.format(c='o_orderpriority')} AS normal FROM orders")
def normalize_category(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", scalars.normalize_category(F.col("o_orderpriority")).alias("normal")).distinct()


@query(f"SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN o_orderpriority ELSE {_NORMAL.format(c='o_orderpriority')} END AS priority FROM orders")
def crosswalk_values(spark, d):
    from ..clinical import crosswalk

    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    return crosswalk.apply_column(o, "priority", {"1-URGENT": "urgent"}, {"5-LOW"})


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedup_first_per_key(spark, d):
    return sequences.first_per_key(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("SELECT user_id, ts AS event_time FROM events WHERE event_type = 'click' UNION SELECT user_id, ts FROM events WHERE event_type IN ('click', 'view')")
def union_distinct_times(spark, d):
    e = table(spark, d, "events")
    return reshape.event_times([(e.where("event_type = 'click'"), "ts"), (e.where("event_type IN ('click', 'view')"), "ts")], ["user_id"])


@query("SELECT event_id, 'value' AS variable, value FROM events UNION ALL SELECT event_id, 'user', CAST(user_id AS DOUBLE) FROM events")
def melt_long(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user"))
    return reshape.melt(e, ["event_id"], ["value", "user"]).select("event_id", "variable", "value")


@query("SELECT user_id, ts, lag(value) OVER w AS before, lead(value) OVER w AS after, max(value) OVER (PARTITION BY user_id) AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead_max(spark, d):
    w = sequences.ordered(["user_id"], ["ts", "event_id"])
    return table(spark, d, "events").select("user_id", "ts", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.max("value").over(Window.partitionBy("user_id")).alias("most"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events WHERE value > 60 GROUP BY user_id")
def string_list(spark, d):
    return table(spark, d, "events").where("value > 60").groupBy("user_id").agg(aggregates.listed("event_type").alias("kinds"))


@query("SELECT event_type, spo2, round(CASE WHEN spo2 < 97 THEN pow(sqrt(125000.0 + pow(11700.0 / (1 / (spo2 / 100) - 1), 2)) + 11700.0 / (1 / (spo2 / 100) - 1), 1.0 / 3) - pow(sqrt(125000.0 + pow(11700.0 / (1 / (spo2 / 100) - 1), 2)) - 11700.0 / (1 / (spo2 / 100) - 1), 1.0 / 3) END, 4) AS pao2 FROM (SELECT event_type, 50 + (event_id % 50) AS spo2 FROM events)")
def imputed_pressure(spark, d):
    e = table(spark, d, "events").select("event_type", (F.lit(50) + F.col("event_id") % 50).alias("spo2"))
    return e.withColumn("pao2", F.round(scalars.pao2_from_spo2(F.col("spo2")), 4))


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS original, count(*) AS n, lower(trim(o_orderpriority)) AS value FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*), lower(trim(o_orderstatus)) FROM orders GROUP BY ALL")
def dqa_categorical(spark, d):
    return checks.category_counts(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)")
def dqa_duplicates(spark, d):
    return checks.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("rows", "n_rows")


@query("""SELECT count(c) AS child_ids, count(*) FILTER (p IS NULL) AS orphans, count(p) AS parent_ids, count(*) FILTER (c IS NULL) AS unused
    FROM (SELECT DISTINCT o_custkey AS c FROM orders) FULL JOIN (SELECT c_custkey AS p FROM customer) ON c = p""")
def dqa_referential(spark, d):
    return checks.referential(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")


@query(f"SELECT count(*) AS n, count(*) FILTER (start_time < p) AS overlapping FROM (SELECT *, lag(end_time) OVER (PARTITION BY user_id ORDER BY start_time, end_time) AS p FROM {_WINDOWS})")
def dqa_overlaps(spark, d):
    o = intervals.overlaps(_windows(spark, d), ["user_id"], "start_time", "end_time")
    return o.agg(F.count("*").alias("n"), F.count_if("overlap").alias("overlapping"))


@query("SELECT o_orderpriority, year(o_orderdate) AS year, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL")
def dqa_temporal(spark, d):
    return checks.yearly(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_custkey").withColumn("year", F.col("year").cast("long"))


@query("SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS n, round(avg(o_totalprice) / 1000, 1) AS mean FROM orders GROUP BY ALL")
def dqa_monthly_trend(spark, d):
    return checks.monthly(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_custkey", "o_totalprice").withColumn("mean", F.round(F.col("mean") / 1000, 1))


@query("SELECT count(*) AS ship_n, count(*) FILTER (l_shipdate < o_orderdate) AS ship_before, count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 90 DAY) AS ship_after FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL")
def dqa_within_stay(spark, d):
    stays = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("end"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("ship"))
    return checks.within_stay(e, stays, "k", ["ship"], "start", "end")


@query("""WITH w AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN value / 5 END) AS norepinephrine_mcg_kg_min, min(CASE WHEN event_type = 'view' THEN value END) AS map, min(CASE WHEN event_type = 'error' THEN value * 4 END) AS platelet_count, max(CASE WHEN event_type = 'purchase' THEN value / 10 END) AS creatinine FROM events GROUP BY user_id),
    s AS (SELECT user_id, coalesce(CASE WHEN norepinephrine_mcg_kg_min > 0.1 THEN 4 WHEN norepinephrine_mcg_kg_min <= 0.1 THEN 3 WHEN map < 70 THEN 1 WHEN map >= 70 THEN 0 END, 0) AS sofa_cv_97,
        coalesce(CASE WHEN platelet_count < 20 THEN 4 WHEN platelet_count < 50 THEN 3 WHEN platelet_count < 100 THEN 2 WHEN platelet_count < 150 THEN 1 ELSE 0 END, 0) AS sofa_coag,
        coalesce(CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.2 THEN 1 ELSE 0 END, 0) AS sofa_renal FROM w)
    SELECT *, sofa_cv_97 + sofa_coag + sofa_renal AS sofa_total FROM s""")
def organ_scores(spark, d):
    e, v, t = table(spark, d, "events"), F.col("value"), F.col("event_type")
    wide = e.select("user_id", F.col("ts").alias("event_time"), F.when(t == "click", v / 5).alias("norepinephrine_mcg_kg_min"), F.when(t == "view", v).alias("map"), F.when(t == "error", v * 4).alias("platelet_count"), F.when(t == "purchase", v / 10).alias("creatinine"))
    return sofa.from_wide(wide, id_col="user_id").select("user_id", "sofa_cv_97", "sofa_coag", "sofa_renal", "sofa_total")


_STITCHED = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 20 DAY AS b, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS place FROM orders),
    l AS (SELECT *, coalesce(lead(a) OVER w - b <= INTERVAL 240 HOUR, FALSE) AS linked FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY a, o_orderkey)),
    c AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) AS chain FROM (SELECT *, coalesce(lag(linked) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey), FALSE) AS p FROM l))
    SELECT CAST(o_orderkey AS VARCHAR) AS hospitalization_id, {block} AS encounter_block FROM c"""


def _stitched(spark, d, exact_ids):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.format_string("%012d", "o_orderkey").alias("hospitalization_id"), F.col("o_orderdate").alias("admission_dttm"), (F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS")).alias("discharge_dttm"))
    _, _, mapping = stitching.stitch(o, o.select("hospitalization_id"), 240, exact_ids=exact_ids)
    return mapping.withColumn("hospitalization_id", F.regexp_replace("hospitalization_id", "^0+(?=.)", ""))


@query(_STITCHED.format(block="last_value(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey, chain ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
def encounter_stitching(spark, d):
    return _stitched(spark, d, False).withColumn("encounter_block", F.regexp_replace("encounter_block", "^0+(?=.)", ""))


@query(_STITCHED.format(block="max(place) OVER (PARTITION BY o_custkey, chain)"))
def encounter_stitching_numbers(spark, d):
    return _stitched(spark, d, True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def global_row_numbers(spark, d):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ranks.number_rows(table(spark, d, "lineitem").select(*ids, "l_extendedprice"), [F.col("l_extendedprice").desc(), *ids], "place").drop("l_extendedprice")


@query("SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.01) AS p1, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.999) AS p999 FROM lineitem GROUP BY ALL")
def exact_quantiles(spark, d):
    lines = table(spark, d, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))
    return ranks.quantiles(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p1": 0.01, "p50": 0.5, "p999": 0.999}, whole=1000)


_CODES = ["I21.4", "E11.9", "E11.22", "C50.9", "C78.0", "K70.3", "K72.9", "N18.6", "B20", "J44.1", "Z00.0", "i50.2"]
_CODE = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"


def index_sql(c: comorbidity.Index, name: str) -> str:
    flag = lambda ps: " OR ".join(f"starts_with(code, '{p.lower()}')" for p in ps)
    flags = ", ".join(f"max(CAST({flag(ps)} AS INTEGER)) AS {n}" for n, ps in c.conditions.items())
    mild = {m: s for s, m in c.hierarchies}
    columns = ", ".join(f"CASE WHEN {mild[n]} = 1 THEN 0 ELSE {n} END AS {n}" if n in mild else n for n in c.conditions)
    score = " + ".join(f"{n} * {w}" for n, w in c.weights.items())
    return f"SELECT *, {score} AS {name} FROM (SELECT hospitalization_id, {columns} FROM (SELECT hospitalization_id, {flags} FROM (SELECT user_id AS hospitalization_id, lower(replace({_CODE}, '.', '')) AS code FROM events WHERE event_type <> 'view') GROUP BY hospitalization_id))"


@query(index_sql(comorbidity.CHARLSON, "cci_score"))
def charlson_index(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("hospitalization_id"), F.expr(_CODE).alias("diagnosis_code"), F.when(F.col("event_type") == "view", "ICD9CM").otherwise("ICD10CM").alias("diagnosis_code_format"))
    return comorbidity.charlson(rows)


@query(f"""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS dose, CASE WHEN l_linenumber < 5 THEN l_discount * 100 + 50 END AS w, {_CLEAN} AS u FROM lineitem),
    b AS (SELECT *, CASE WHEN u = 'mg/hr' THEN dose * 1000.0 / 60 WHEN u = 'u/hr' THEN dose / 60 WHEN u IN ('mcg/kg/min') AND w IS NOT NULL THEN dose * w WHEN u = 'g/kg/hr' AND w IS NOT NULL THEN dose * 1000000 / 60 * w ELSE dose END AS base,
        CASE WHEN u IN ('mg/hr', 'mcg/kg/min', 'g/kg/hr') THEN 'rate mass' WHEN u = 'u/hr' THEN 'rate unit' WHEN u = 'ml' THEN 'amount volume' ELSE u END AS kind FROM s),
    c AS (SELECT *, CASE WHEN kind = 'rate mass' THEN 'success' WHEN kind = 'rate unit' THEN 'cannot convert unit to mass' WHEN kind LIKE 'amount%' THEN 'cannot convert amount to rate' ELSE 'original unit ' || u || ' is not recognized' END AS status FROM b)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, status, CASE WHEN status = 'success' THEN 'mg/hr' ELSE u END AS unit, round(CASE WHEN status = 'success' THEN base / 1000 * 60 ELSE dose END, 4) AS converted FROM c""")
def dose_conversion(spark, d):
    base = units.to_base(_doses(spark, d)).withColumn("_preferred_unit", F.lit("mg/hr"))
    out = units.to_preferred(base)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("_convert_status").alias("status"), F.col("med_dose_unit_converted").alias("unit"), F.round("med_dose_converted", 4).alias("converted"))


@query("""WITH p AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, value / 100 AS fio2_set FROM events WHERE event_type = 'view' AND value >= 21)
    SELECT event_id, round(CASE WHEN p.ts - s.ts <= INTERVAL 240 MINUTE THEN p.value / s.fio2_set END, 6) AS p_f FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def concurrent_ratio(spark, d):
    e = table(spark, d, "events")
    oxygen = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("event_time"), F.col("value").alias("po2_arterial"), F.lit(None).cast("double").alias("pao2_imputed"))
    support = e.where("event_type = 'view' AND value >= 21").select("user_id", F.col("ts").alias("recorded_dttm"), (F.col("value") / 100).alias("fio2_set"), F.lit("IMV").alias("device_category"))
    return sofa.concurrent_ratios(oxygen, support, ["user_id"]).select("event_id", F.round("p_f", 6).alias("p_f"))
