"""Cleaning of respiratory-support records and filling in order of device and mode.

All steps keep the encounter as the first key of their windows, so the whole
chain is one shuffle by encounter, apart from two table-wide figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import intervals, sequences
from ..operators.aggregates import most_common

TEXTS = ["device_category", "device_name", "mode_category", "mode_name"]
NUMBERS = ["tracheostomy", "fio2_set", "lpm_set", "peep_set", "tidal_volume_set", "resp_rate_set", "resp_rate_obs", "pressure_support_set", "peak_inspiratory_pressure_set"]
VENTILATOR_MODES = "assist control-volume control|simv|pressure control"


def _above(column: str, x: float):
    return scalars.true(F.col(column) > x)


def waterfall(support: DataFrame, *, key: str = "hospitalization_id", time: str = "recorded_dttm", backward: bool = False, strict: bool = True) -> DataFrame:
    """Records and hourly scaffold rows with devices, modes and settings filled.

    strict keeps what the method does with a block of one mode that holds a
    trach collar: its settings are lost.  Without strict the collar begins a new
    block instead.  Records of equal time go by all their columns.
    """
    df = support
    for c in [c for c in TEXTS if c not in df.columns]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    for c in [c for c in NUMBERS if c not in df.columns]:
        df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumns({c: F.lower(c) for c in TEXTS}).withColumns({c: scalars.number(F.col(c).cast("string")) for c in NUMBERS})
    mean = df.agg(F.avg("fio2_set")).first()[0]
    if mean is not None and mean > 1:
        df = df.withColumn("fio2_set", F.when(F.col("fio2_set") > 1, F.col("fio2_set") / 100).otherwise(F.col("fio2_set")))
    scaffold = intervals.hour_scaffold(df, [key], time, time).withColumn("is_scaffold", F.lit(True))

    # Devices from modes, neighbours and settings.
    ventilator = most_common(df.where("device_category = 'imv'"), "device_name", "ventilator")
    mask = most_common(df.where("device_category = 'nippv'"), "device_name", "bipap")
    device, name = F.col("device_category"), F.col("device_name")
    guess = device.isNull() & name.isNull() & scalars.true(F.col("mode_category").rlike(VENTILATOR_MODES))
    df = df.withColumns({"device_name": F.when(guess, ventilator).otherwise(name), "device_category": F.when(guess, "imv").otherwise(device)})
    order = [time, *TEXTS, *NUMBERS]
    w = sequences.ordered([key], order)
    beside = lambda what: scalars.true(F.lag("device_category").over(w) == what) | scalars.true(F.lead("device_category").over(w) == what)
    df = df.withColumn("_like", device.isNull() & beside("imv") & _above("peep_set", 1) & _above("resp_rate_set", 1) & _above("tidal_volume_set", 1))
    df = df.withColumns({"device_name": F.when(F.col("_like"), ventilator).otherwise(name), "device_category": F.when(F.col("_like"), "imv").otherwise(device)})
    df = df.withColumn("_like", device.isNull() & beside("nippv") & _above("peak_inspiratory_pressure_set", 1) & _above("pressure_support_set", 1))
    df = df.withColumns({"device_name": F.when(F.col("_like") & name.isNull(), mask).otherwise(name), "device_category": F.when(F.col("_like"), "nippv").otherwise(device)}).drop("_like")

    # Of records at one time: without masks if there is another, then without those that name no device, then the first.
    same = Window.partitionBy(key, time)
    df = df.withColumn("_n", F.count(F.lit(1)).over(same)).where(~((F.col("_n") > 1) & scalars.true(device == "nippv")))
    df = df.withColumn("_n", F.count(F.lit(1)).over(same)).where(~((F.col("_n") > 1) & device.isNull())).drop("_n")
    df = df.withColumn("device_category", F.when(scalars.true(device == "nasal cannula") & _above("peep_set", 0), None).otherwise(device))
    df = df.where(scalars.any_present(*(F.col(c) for c in [*TEXTS, *NUMBERS])))
    df = sequences.first_per_key(df, [key, time], [*TEXTS, *NUMBERS]).withColumn("is_scaffold", F.lit(False))
    df = df.unionByName(scaffold, allowMissingColumns=True)

    # Runs of device and mode, each inside the one above; their numbers rise with time, so all windows forward share one order.
    order = [time, F.col("is_scaffold").asc()]
    fill = sequences.fill_both if backward else sequences.fill_forward
    df = sequences.fill_forward(df, [key], order, ["device_category", "tracheostomy"])
    above = []
    for column, number in (("device_category", "device_cat_id"), ("device_name", "device_id"), ("mode_category", "mode_cat_id"), ("mode_name", "mode_name_id")):
        if above:
            df = sequences.fill_both(df, [key, above[-1]], order, [column]) if backward else sequences.fill_in_runs(df, [key], order, above[-1], [column])
        df = sequences.change_island(df, [key], order, column, number)
        above.append(number)

    # Settings inside a run of one mode.
    df = df.withColumn("fio2_set", F.when(scalars.true(device == "room air") & F.col("fio2_set").isNull(), 0.21).otherwise(F.col("fio2_set")))
    pressure = scalars.true(F.col("mode_category") == "pressure support/cpap")
    trach = scalars.contains(name, "trach")
    odd = (pressure & F.col("pressure_support_set").isNotNull()) | (F.col("mode_category").isNull() & trach) | (pressure & trach)
    df = df.withColumn("tidal_volume_set", F.when(~odd, F.col("tidal_volume_set")))
    collar = scalars.true(device == "trach collar")
    settings = NUMBERS[1:]
    if strict:
        df = fill(df, [key, "mode_name_id"], order, settings)  # leaves rows in the order of runs, which the next window needs
        df = df.withColumn("_collar", F.max(collar.cast("int")).over(Window.partitionBy(key, "mode_name_id")))
        df = df.withColumns({c: F.when(F.col("_collar") == 0, F.col(c)) for c in settings}).drop("_collar")
    else:
        df = df.withColumn("_part", F.sum(collar.cast("int")).over(sequences.ordered([key, "mode_name_id"], order).rowsBetween(Window.unboundedPreceding, 0)))
        df = fill(df, [key, "mode_name_id", "_part"], order, settings).drop("_part")
    # A key and a time have one record and one scaffold row at most, so no two rows are alike.
    return df.withColumn("mode_category", F.when(F.col("mode_category").isNull() & scalars.contains(name, "t-piece"), "blow by").otherwise(F.col("mode_category")))
