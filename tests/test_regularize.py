"""Gridding against worked examples and pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid import Panel
from tidegrid.functions.freq import freq_seconds, freq_to_interval
from tidegrid.functions.scalar import next_weekday
from tidegrid.operators import regularize as reg
from tidegrid.operators.clean import trim_partial_weeks

P = Panel()


@pytest.mark.parametrize(
    "freq,seconds",
    [("5T", 300), ("5min", 300), ("H", 3600), ("1h", 3600), ("30s", 30), ("D", 86400), (90, 90),
     (timedelta(minutes=2), 120)],
)
def test_freq_seconds(freq, seconds):
    assert freq_seconds(freq) == seconds


@pytest.mark.parametrize("bad", ["M", "5 parsecs", "0min", -1, 0.5])
def test_freq_rejects(bad):
    with pytest.raises(ValueError):
        freq_seconds(bad)


def test_interval_column(spark):
    df = spark.range(1).select(
        F.date_format(F.to_timestamp(F.lit("2024-01-01")) + freq_to_interval("30T"), "HH:mm").alias("t")
    )
    assert df.first().t == "00:30"


@pytest.mark.parametrize(
    "day,ahead,back",
    [("2024-01-01", "2024-01-01", "2023-12-31"), ("2024-01-03", "2024-01-08", "2023-12-31"),
     ("2024-01-07", "2024-01-08", "2024-01-07")],
)
def test_next_weekday(spark, day, ahead, back):
    d = F.to_timestamp(F.lit(f"{day} 10:30:00"))
    row = spark.range(1).select(
        next_weekday(d, 0).cast("string").alias("a"), next_weekday(d, 6, forward=False).cast("string").alias("b")
    ).first()
    assert (row.a, row.b) == (f"{ahead} 10:30:00", f"{back} 10:30:00")


def _readings(spark, points):
    rows = [("a", datetime(2024, 1, 1) + timedelta(minutes=m), v) for m, v in points]
    return spark.createDataFrame(rows, "id string, dt timestamp, v double")


def _values(df):
    return [r.v for r in df.orderBy("dt").collect()]


def test_interpolation_example(spark):
    df = _readings(spark, [(0, 1.0), (5, 2.0), (20, 8.0), (25, None)])
    assert _values(reg.interpolate_linear(df, P, ["v"], "5min")) == [1, 2, 4, 6, 8, 8]


def test_leading_cells_stay_missing_and_off_grid_readings_drop(spark):
    df = _readings(spark, [(2, 9.0), (10, 1.0), (13, 5.0), (20, 3.0)])
    assert _values(reg.interpolate_linear(df, P, ["v"], "5min")) == [None, None, 1, 2, 3]


def test_matches_pandas_on_random_grids(spark):
    rng = np.random.default_rng(0)
    minutes = np.sort(rng.choice(600, 150, replace=False))
    values = [float(v) if rng.random() > 0.2 else None for v in rng.integers(0, 99, 150)]
    df = _readings(spark, list(zip(minutes.tolist(), values)))
    index = pd.to_datetime("2024-01-01") + pd.to_timedelta(minutes, unit="min")
    s = pd.Series([np.nan if v is None else v for v in values], index=index)
    for freq, coarse in (("1min", "10min"), ("5min", "30min")):
        fine = s.resample(freq).asfreq().interpolate()
        got = [np.nan if v is None else v for v in _values(reg.interpolate_linear(df, P, ["v"], freq))]
        np.testing.assert_allclose(got, fine.to_numpy())
        mean = fine.resample(coarse).mean()
        got = _values(reg.interpolate_resample(df, P, ["v"], freq, coarse))
        np.testing.assert_allclose([np.nan if v is None else v for v in got], mean.to_numpy())
    filled = s.asfreq("1min", fill_value=-1)
    got = [np.nan if v is None else v for v in _values(reg.gap_fill(df, P, "1min", -1.0))]
    np.testing.assert_allclose(got, filled.to_numpy())


def test_gap_fill_anchors_at_the_first_row(spark):
    df = _readings(spark, [(2, 1.0), (7, 2.0), (15, 3.0), (17, 4.0), (21, 5.0)])
    out = reg.gap_fill(df, P, "5min")
    assert [(r.dt.minute, r.v) for r in out.orderBy("dt").collect()] == [(2, 1), (7, 2), (12, None), (17, 4)]


def test_gap_fill_at_each_series_own_frequency(spark):
    rows = [("a", datetime(2024, 1, 1, 0, m), 1.0) for m in (0, 1, 4)]
    rows += [("b", datetime(2024, 1, 1, 0, m), 1.0) for m in (0, 10, 40)]
    df = spark.createDataFrame(rows, "id string, dt timestamp, v double")
    counts = {r.id: r["count"] for r in reg.gap_fill_inferred(df, P).groupBy("id").count().collect()}
    assert counts == {"a": 5, "b": 5}


def test_a_long_gap_opens_in_blocks(spark):
    rows = [("a", datetime(1970, 1, 1), 1.0), ("a", datetime(1970, 2, 1), 2.0)]
    df = spark.createDataFrame(rows, "id string, dt timestamp, v double")
    made = reg.gap_fill(df, P, "1s")
    assert made.count() == 31 * 86400 + 1 == made.select("dt").distinct().count()
    assert reg.long_gaps(df, P, "1s", 1_000_000).count() == 1 and reg.long_gaps(df, P, "1s", 3_000_000).isEmpty()


def test_repeated_times_stay(spark):
    rows = [("a", datetime(2024, 1, 1, 0, m), float(v)) for v, m in enumerate((0, 0, 2, 2, 2, 4))]
    df = spark.createDataFrame(rows, "id string, dt timestamp, v double")
    for panel in (P, P.chunked(60_000_000)):
        made = reg.gap_fill(df, panel, "1min", fill_value=-1.0).groupBy("dt").agg(F.count("*").alias("n")).orderBy("dt")
        assert [r.n for r in made.collect()] == [2, 1, 3, 1, 1]
    single = reg.average_duplicates(df, P, ["v"])
    assert [r.v for r in reg.gap_fill(single, P, "1min").orderBy("dt").collect()] == [0.5, None, 3.0, None, 5.0]


def test_validation(spark, series):
    assert reg.validate_series(series(v=[1, 2]), P).count() == 1
    assert reg.validate_series(series(v=[1, 2, 3]), P).isEmpty()
    with pytest.raises(ValueError):
        reg.require_valid(None, P)
    with pytest.raises(ValueError):
        reg.require_valid(series(v=[1, 2]), P)
    assert reg.require_valid(series(v=[1, 2, 3]), P).count() == 3


def test_uniqueness_and_duplicates(spark):
    df = _readings(spark, [(0, 1.0), (0, 3.0), (1, 5.0)])
    assert reg.dt_is_unique(df, P).first().is_unique is False
    merged = reg.average_duplicates(df, P, ["v"])
    assert reg.dt_is_unique(merged, P).first().is_unique is True
    assert _values(merged) == [2.0, 5.0]


@pytest.mark.parametrize(
    "n,expected", [(0, list(range(10))), (1, [99, *range(9)]), (-1, [*range(1, 10), 99])]
)
def test_shift(series, n, expected):
    assert _values(reg.shift(series(v=list(range(10))), P, ["v"], n, 99.0)) == expected


def test_trim_keeps_whole_weeks_of_each_month(spark):
    start = datetime(2024, 1, 3, 6)
    rows = [("a", start + timedelta(hours=6 * i), 1.0) for i in range(4 * 40)]
    df = spark.createDataFrame(rows, "id string, dt timestamp, v double")
    kept = trim_partial_weeks(df, P).groupBy(F.month("dt").alias("m")).agg(
        F.min("dt").cast("string").alias("lo"), F.max("dt").cast("string").alias("hi")
    )
    bounds = {r.m: (r.lo, r.hi) for r in kept.collect()}
    assert bounds[1] == ("2024-01-08 06:00:00", "2024-01-28 18:00:00")
    assert bounds[2][0] == "2024-02-05 00:00:00"
