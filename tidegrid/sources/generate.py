"""Synthetic series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.freq import freq_seconds


def _times(spark: SparkSession, start: datetime, rows: int, freq: str) -> DataFrame:
    """``rows`` grid times, made in parallel from a range."""
    base = int((start - datetime(1970, 1, 1)).total_seconds())
    at = F.timestamp_seconds(F.lit(base) + F.col("id") * F.lit(freq_seconds(freq)))
    return spark.range(rows).select(F.col("id").alias("i"), at.alias("dt"))


def generate_series(
    spark: SparkSession,
    start: datetime = datetime(2018, 1, 1),
    end: datetime = datetime(2018, 1, 8),
    freq: str = "H",
    low: int = 0,
    high: int = 100,
    seed: int | None = None,
) -> DataFrame:
    """Times from start to end, both included, with random whole values in [low, high)."""
    rows = int((end - start).total_seconds()) // freq_seconds(freq) + 1
    draw: Column = F.floor(F.lit(low) + F.rand(seed) * (high - low)).cast("int")
    return _times(spark, start, rows, freq).select("dt", draw.alias("values"))


def generate_ramp(
    spark: SparkSession,
    rows: int,
    columns: dict[str, tuple[float, float]],
    start: datetime = datetime(2020, 1, 1),
    freq: str = "5min",
) -> DataFrame:
    """Columns that run linearly from their first to their last value."""
    last = max(rows - 1, 1)
    ramps = [
        (F.lit(float(a)) + F.col("i") * F.lit((float(b) - float(a)) / last)).alias(name)
        for name, (a, b) in columns.items()
    ]
    return _times(spark, start, rows, freq).select("dt", *ramps)


def grid_of(bounds: DataFrame, ids: list[str], freq: str, low: str = "lo", high: str = "hi") -> DataFrame:
    """All grid times of each series between two bound columns."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(freq_seconds(freq)).cast("decimal(18,6)"))
    return bounds.select(*ids, F.explode(F.sequence(F.col(low), F.col(high), step)).alias("dt"))
