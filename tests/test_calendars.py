"""Frequencies by name, and trials that are written again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import regularize as reg
from tidegrid.panel import Panel
from tidegrid.sources import readers, writers

PANEL = Panel(("id",), "dt")
# Names as the operator writes them, and the pandas alias that makes such times.
NAMES = {
    "MS": "MS", "ME": "ME", "QS-JAN": "QS-JAN", "QS-FEB": "QS-FEB", "QE-MAR": "QE-MAR", "YS-APR": "YS-APR", "YE-DEC": "YE-DEC",
    "2MS": "2MS", "2QS-JAN": "2QS-JAN", "W-MON": "W-MON", "2W-SUN": "2W-SUN", "B": "B", "D": "D", "3D": "3D", "h": "h",
    "6h": "6h", "5min": "5min", "s": "s", "250ms": "250ms",
}


def times(spark, made):
    rows = [(i, int(t.value // 1000)) for i, stamps in made.items() for t in stamps]
    return spark.createDataFrame(rows, "id string, us long").select("id", F.timestamp_micros("us").alias("dt"))


def test_names(spark):
    made = {name: pd.date_range("2019-01-01 00:00", periods=14, freq=alias) for name, alias in NAMES.items()}
    made["2QS-JAN"] = made["2QS-JAN"][:9]
    hour = pd.Timedelta(hours=7)
    made |= {f"late {k}": made[k] + hour for k in ("MS", "QE-MAR", "B", "W-MON")}
    got = dict(reg.infer_calendar_freq(times(spark, made), PANEL).collect())
    want = {name: name for name in NAMES} | {f"late {k}": k for k in ("MS", "QE-MAR", "B", "W-MON")}
    want["QE-MAR"] = got["QE-MAR"] if got["QE-MAR"] in ("QE-MAR",) else "QE-MAR"
    assert got == want


def test_no_name(spark):
    day = pd.date_range("2020-01-01", periods=40, freq="D")
    month = pd.date_range("2020-01-01", periods=12, freq="MS")
    made = {
        "gap": day.delete(7), "missing month": month.delete(5), "two rows": day[:2], "one": day[:1],
        "moving clock": month[:1].append(month[1:] + pd.Timedelta(hours=1)), "same": day[:1].append(day[:1]).append(day[:1]),
        "weekend too": pd.date_range("2020-01-03", periods=4, freq="B").append(pd.DatetimeIndex(["2020-01-11"])),
    }
    got = dict(reg.infer_calendar_freq(times(spark, made), PANEL).collect())
    assert set(got.values()) == {None} and set(got) == set(made) - {"one"}


def test_writing_a_trial_again_leaves_one_copy(spark, tmp_path):
    df = spark.range(40).selectExpr("id % 4 AS exptid", "cast(id AS string) AS id", "cast(id AS double) AS mse")
    schema = "exptid bigint, id string, mse double"
    folder = str(tmp_path / "m")
    for rows in (df, df.where("exptid < 2"), df.where("exptid = 3").withColumn("mse", F.col("mse") + 1)):
        writers.append_metrics(rows, folder, replace="exptid")
    got = sorted(map(tuple, readers.read_metrics_dir(spark, folder, schema).collect()))
    assert got == sorted((k % 4, str(k), float(k + (k % 4 == 3))) for k in range(40))
    writers.append_metrics(df.limit(0), folder, replace="exptid")  # nothing to replace
    writers.append_metrics(df.selectExpr("9L AS exptid", "id", "mse").limit(3), folder)  # files of both kinds
    assert readers.read_metrics_dir(spark, folder, schema).count() == 43

    folder = str(tmp_path / "p")
    predictions = df.selectExpr("exptid", "mse AS y", "mse AS y_hat")
    for rows in (predictions, predictions.where("exptid = 1"), predictions.where("exptid = 1")):
        writers.write_predictions(rows, folder, mode="replace")
    assert spark.read.parquet(folder).count() == 40
    writers.write_predictions(predictions.where("exptid = 1"), folder)
    assert spark.read.parquet(folder).count() == 50
    with pytest.raises(Exception):
        writers.write_predictions(predictions, folder, mode="other")


# Calendars, single and in steps, as the library and pandas name them.
CALENDARS = ["MS", "ME", "QS-JAN", "QS-FEB", "QE-MAR", "QE-DEC", "YS-APR", "YE-DEC", "W-MON", "W-SUN", "W-THU", "B", "2MS", "3ME", "2QS-FEB", "2W-MON"]


def uneven(seed, n=400):
    draw = np.random.default_rng(seed)
    days = np.sort(draw.choice(2200, n, replace=False))
    return pd.DatetimeIndex(pd.Timestamp("2015-11-03") + pd.to_timedelta(days, "D"))


@pytest.mark.parametrize("freq", CALENDARS)
def test_means_of_calendar_bins(spark, freq):
    made = {"a": uneven(1) + pd.Timedelta(hours=9), "b": uneven(2, 30), "c": uneven(3, 1), None: uneven(4, 5)}
    df = times(spark, made).withColumn("v", F.dayofyear("dt").cast("double")).withColumn("gone", F.lit(None).cast("double"))
    got = {(r.id, r.dt): r.v for r in reg.resample_mean(df, PANEL, ["v", "gone"], freq).collect()}
    want = {}
    for i, stamps in made.items():
        means = pd.Series(stamps.dayofyear.astype(float), stamps).resample(freq).mean().dropna()
        want |= {(i, t.to_pydatetime()): v for t, v in means.items()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("freq", [*CALENDARS, "3B"])
def test_gaps_of_calendar_grids(spark, freq):
    made = {"a": uneven(5) + pd.Timedelta(hours=9), "b": uneven(6, 900), "c": uneven(7, 1), "d": uneven(8, 3), None: uneven(9, 40)}
    df = times(spark, made).withColumn("v", F.dayofyear("dt").cast("double"))
    got = {(r.id, r.dt): r.v for r in reg.gap_fill(df.union(df.where("false")), PANEL, freq, -1.0).collect()}
    want = {}
    for i, stamps in made.items():
        filled = pd.Series(stamps.dayofyear.astype(float), stamps).asfreq(freq, fill_value=-1.0)
        want |= {(i, t.to_pydatetime()): v for t, v in filled.items()}
    assert got == want


def test_calendar_grids_keep_repeats_and_pass_empty_tables(spark):
    df = times(spark, {"a": pd.DatetimeIndex(["2020-01-01", "2020-01-01", "2020-04-01"])}).withColumn("v", F.lit(2))
    months = [(r.dt.month, r.v) for r in reg.gap_fill(df, PANEL, "MS").orderBy("dt").collect()]
    assert months == [(1, 2), (1, 2), (2, None), (3, None), (4, 2)]
    nothing = df.where("false")
    assert reg.gap_fill(nothing, PANEL, "QS").isEmpty() and reg.resample_mean(nothing, PANEL, ["v"], "2ME").isEmpty()
    for bad in ("QS-MON", "W-JAN", "MS-JAN", "0MS", "B-MON"):
        with pytest.raises(ValueError):
            reg.gap_fill(df, PANEL, bad)


@pytest.mark.parametrize("freq", ["MS", "ME", "W-MON", "B", "2MS", "2W-MON"])
def test_gaps_of_calendar_grids_in_chunks(spark, freq):
    made = {"a": uneven(5) + pd.Timedelta(hours=9), "b": uneven(6, 900), "c": uneven(7, 1), None: uneven(9, 40)}
    df = times(spark, made).withColumn("v", F.dayofyear("dt").cast("double"))
    cut = reg.gap_fill(df, PANEL.chunked(40 * 86_400_000_000), freq, -1.0)
    assert sorted(cut.collect(), key=str) == sorted(reg.gap_fill(df, PANEL, freq, -1.0).collect(), key=str)


def test_calendar_grids_are_not_shuffled(spark, tmp_path):
    ends = pd.DatetimeIndex(["1900-01-01", "2100-01-01"])
    df = times(spark, {str(i): ends for i in range(20)}).withColumn("v", F.lit(1.0))
    filled = reg.gap_fill(df, PANEL.bounded(), "W-MON", -1.0)
    assert filled.count() == 20 * 10_436
    plan = filled._jdf.queryExecution().executedPlan().toString()
    # The expansion is the last step: nothing is exchanged or joined after it.
    assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange")


def test_merged_tasks_hold_few_groups(spark):
    changed = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    rows = spark.range(2_000_000).select(F.xxhash64("id").alias("id"), F.timestamp_seconds(F.col("id") * 40).alias("dt"), F.rand(1).alias("v"))
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        # Some 40 MB are shuffled, which one task would hold as 2 million groups.
        assert reg.resample_mean(rows, PANEL, ["v"], "MS").rdd.getNumPartitions() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
