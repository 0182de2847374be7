"""Forecast error measures as column expressions, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Smallest denominator of the relative errors.
EPSILON = 1e-7


def _absolute_share(y: Column, p: Column) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPSILON))


def _symmetric_share(y: Column, p: Column) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y) + F.abs(p), F.lit(EPSILON))


def metric_mse(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def metric_mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def metric_mape(y: Column, p: Column) -> Column:
    return F.lit(100.0) * F.avg(_absolute_share(y, p))


def metric_smape(y: Column, p: Column) -> Column:
    """Symmetric error in the range 0 to 100."""
    return F.lit(100.0) * F.avg(_symmetric_share(y, p))


def metric_smape_rowwise(y: Column, p: Column) -> Column:
    """Symmetric error of one sample over its horizon (array columns)."""
    shares = F.zip_with(y, p, _symmetric_share)
    return F.lit(100.0) * F.aggregate(shares, F.lit(0.0), lambda a, s: a + s) / F.size(y)


Metric = Callable[[Column, Column], Column]

METRICS: dict[str, Metric] = {
    "mse": metric_mse,
    "mae": metric_mae,
    "mape": metric_mape,
    "smape": metric_smape,
}


def register_metric(name: str, build: Metric) -> None:
    METRICS[name] = build


def get_metric(metric: str | Metric) -> tuple[str, Metric]:
    if callable(metric):
        return getattr(metric, "__name__", "metric"), metric
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    return metric, METRICS[metric]


def evaluate_metrics(
    df: DataFrame,
    by: Sequence[str],
    y: str = "y",
    p: str = "y_hat",
    metrics: Sequence[str | Metric] = ("mse", "mae", "mape", "smape"),
) -> DataFrame:
    """All named metrics per group in one aggregate.  Array columns are scored over
    every step of the horizon."""
    chosen = [get_metric(m) for m in metrics]
    if dict(df.dtypes)[y].startswith("array"):
        df = df.select(*by, F.inline(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("y_hat"))))
        df = df.toDF(*by, "y", "y_hat")
        y, p = "y", "y_hat"
    return df.groupBy(*by).agg(*[build(F.col(y), F.col(p)).alias(name) for name, build in chosen])
