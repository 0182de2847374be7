"""Chunked series give the same rows as whole ones, also for one dominant series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tidegrid import Panel
from tidegrid.operators import regularize as reg
from tidegrid.operators import windows as win
from tidegrid.operators.chunks import POS, SIZE, fit_chunk, with_position
from tidegrid.operators.split import tail_rows, tvt_split


@pytest.fixture(scope="module")
def skewed(spark):
    """One series with most rows, in bursts, and several short ones."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = set()
    for _ in range(1500):
        burst = rng.choice([0, 0, 0, 30, 200])
        rows.add(("hot", start + timedelta(minutes=burst * 60 + rng.randrange(900))))
    for i in range(12):
        for _ in range(rng.randrange(1, 25)):
            rows.add((f"s{i}", start + timedelta(minutes=rng.randrange(20000))))
    data = [(i, t, float(rng.randrange(50)) if rng.random() > 0.3 else None) for i, t in sorted(rows)]
    return spark.createDataFrame(data, "id string, dt timestamp, v double").cache()


WHOLE = Panel().bounded()
PANELS = [WHOLE.chunked(w * 60_000_000) for w in (7, 60, 1440)]


def test_fit_chunk_bounds_every_group(skewed):
    assert fit_chunk(skewed, WHOLE).chunk_us is None
    panel = fit_chunk(skewed, WHOLE, max_rows=100)
    cell = F.floor(F.unix_micros("dt") / panel.chunk_us)
    assert skewed.groupBy("id", cell).count().agg(F.max("count")).first()[0] <= 100


def test_fit_chunk_keeps_rows_of_one_time_together(spark):
    rows = spark.range(50).select(F.lit("a").alias("id"), F.to_timestamp(F.lit("2024-01-01")).alias("dt"))
    assert fit_chunk(rows, WHOLE, max_rows=10).chunk_us == 1


@pytest.mark.parametrize("panel", PANELS)
def test_positions(skewed, panel):
    same_rows(with_position(skewed, WHOLE), with_position(skewed, panel))
    top = with_position(skewed, panel).groupBy("id").agg((F.max(POS) + 1 == F.max(SIZE)).alias("ok"))
    assert top.where(~F.col("ok")).isEmpty()


@pytest.mark.parametrize("panel", PANELS)
@pytest.mark.parametrize("n", [3, -2])
def test_shift(skewed, panel, n):
    same_rows(reg.shift(skewed, WHOLE, ["v"], n, 9.0), reg.shift(skewed, panel, ["v"], n, 9.0))


@pytest.mark.parametrize("panel", PANELS)
def test_gaps_split_tail_and_nth(skewed, panel):
    for op in (
        reg.gap_counts,
        reg.infer_freq,
        reg.min_gap_freq,
        tvt_split,
        lambda df, p: tail_rows(df, p, 40),
        lambda df, p: reg.every_nth(df, p, 7),
    ):
        same_rows(op(skewed, WHOLE), op(skewed, panel))


@pytest.mark.parametrize("panel", PANELS)
def test_filling(skewed, panel):
    same_rows(
        reg.gap_fill(skewed, WHOLE, "1min", 0.0), reg.gap_fill(skewed, panel, "1min", 0.0)
    )
    for snap, freq in (("exact", "5min"), ("mean", "30min")):
        same_rows(
            reg.interpolate_linear(skewed, WHOLE, ["v"], freq, snap),
            reg.interpolate_linear(skewed, panel, ["v"], freq, snap),
        )


@pytest.mark.parametrize("panel", PANELS)
def test_windows(skewed, panel):
    args = (["v"], ["v"], 5, 2, 2)
    same_rows(
        win.xy_windows_flat(skewed, WHOLE, *args), win.xy_windows_flat(skewed, panel, *args)
    )
    same_rows(
        win.xy_windows_nested(skewed, WHOLE, *args), win.xy_windows_nested(skewed, panel, *args)
    )


def test_operators_measure_by_themselves(skewed, monkeypatch):
    from tidegrid.operators import chunks

    monkeypatch.setattr(chunks.fit_chunk, "__defaults__", (100,))
    assert chunks.measured(skewed, Panel()).chunk_us > 0
    assert chunks.measured(skewed, WHOLE).chunk_us is None
    same_rows(reg.shift(skewed, WHOLE, ["v"], 2), reg.shift(skewed, Panel(), ["v"], 2))
    same_rows(reg.gap_counts(skewed, WHOLE), reg.gap_counts(skewed, Panel()))
    args = (["v"], ["v"], 3)
    same_rows(win.xy_windows_flat(skewed, WHOLE, *args), win.xy_windows_flat(skewed, Panel(), *args))


def test_fit_grid(skewed):
    assert reg.fit_grid(skewed, WHOLE, "1min").chunk_us is None
    assert reg.fit_grid(skewed, WHOLE, "1min", max_rows=1000).chunk_us == 1000 * 60_000_000
