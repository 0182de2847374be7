"""Scaling, splitting and error measures on small arrays checked by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import Panel
from tidegrid.operators import metrics as m
from tidegrid.operators import scale
from tidegrid.operators.split import tail_rows, tvt_split

IDS = ["id"]
COLS = ["a", "b", "c", "d"]


@pytest.fixture
def matrix(series):
    rng = np.random.default_rng(1)
    data = {c: (rng.normal(size=10) * s + o).tolist() for c, s, o in zip(COLS, (1, 10, 100, 0.1), (0, 5, -50, 3))}
    data["b"][3] = None
    return series(**data)


def _column(df, c):
    return np.array([np.nan if r[c] is None else r[c] for r in df.orderBy("dt").collect()])


def test_standard_scaler(matrix):
    params = scale.standard_scaler_fit(matrix, IDS, COLS)
    out = scale.standard_scaler_transform(matrix, params, IDS, COLS)
    back = scale.standard_scaler_inverse(out, params, IDS, COLS)
    for c in COLS:
        np.testing.assert_allclose([np.nanmean(_column(out, c)), np.nanstd(_column(out, c))], [0, 1], atol=1e-9)
        np.testing.assert_allclose(_column(back, c), _column(matrix, c))


@pytest.mark.parametrize("span", [(0, 1), (1, 2), (-0.5, 0.6)])
def test_minmax_scaler(matrix, span):
    params = scale.minmax_scaler_fit(matrix, IDS, COLS, span)
    out = scale.minmax_scaler_transform(matrix, params, IDS, COLS)
    back = scale.minmax_scaler_inverse(out, params, IDS, COLS)
    for c in COLS:
        np.testing.assert_allclose([np.nanmin(_column(out, c)), np.nanmax(_column(out, c))], span, atol=1e-9)
        np.testing.assert_allclose(_column(back, c), _column(matrix, c))


def test_constant_columns_become_zero(series):
    df = series(a=[4, 4, 4])
    assert set(_column(scale.scale_per_series(df, IDS, ["a"], "standard"), "a")) == {0.0}
    assert set(_column(scale.scale_per_series(df, IDS, ["a"], "minmax"), "a")) == {0.0}


@pytest.mark.parametrize("kind", ["minmax", "standard"])
def test_grid_scaling_equals_fit_and_transform(matrix, kind):
    a = scale.scale_per_series(matrix, IDS, COLS, kind)
    b = scale.scale_grid(matrix, IDS, COLS, kind)
    for c in COLS:
        np.testing.assert_allclose(_column(a, c), _column(b, c), atol=1e-12)


def test_nan_is_ignored_in_fitting(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan"))], "id string, v double")
    row = scale.standard_scaler_fit(df, IDS, ["v"]).first()
    assert (row.v_mean, row.v_sd) == (2.0, 1.0)


def test_unfitted_and_unknown_scalers_raise(matrix):
    params = scale.standard_scaler_fit(matrix, IDS, ["a"])
    with pytest.raises(ValueError):
        scale.standard_scaler_transform(matrix, params, IDS, ["a", "b"])
    with pytest.raises(ValueError):
        scale.scale_per_series(matrix, IDS, ["a"], "robust")


def test_fit_on_training_rows(series):
    df = series(v=[0, 1, 2, 3, 100])
    out = scale.scale_per_series(df, IDS, ["v"], fit_on=df.where("v < 4"))
    assert _column(out, "v").tolist() == pytest.approx([0, 1 / 3, 2 / 3, 1, 100 / 3])


@pytest.mark.parametrize("n,counts", [(10, (8, 1, 1)), (7, (5, 0, 2)), (25, (20, 2, 3))])
def test_split_sizes(series, n, counts):
    rows = tvt_split(series(v=list(range(n))), Panel()).orderBy("dt").collect()
    labels = [r.split for r in rows]
    assert tuple(labels.count(x) for x in ("train", "valid", "test")) == counts
    assert labels == sorted(labels, key=["train", "valid", "test"].index)


@pytest.mark.parametrize("sizes", [(0, 0.1), (1.1, 0), (0.8, -0.1), (0.8, 0.3)])
def test_split_rejects(series, sizes):
    with pytest.raises(ValueError):
        tvt_split(series(v=[1, 2, 3]), Panel(), *sizes)


def test_tail(series):
    assert sorted(_column(tail_rows(series(v=list(range(9))), Panel(), 4), "v")) == [5, 6, 7, 8]


def test_metrics(spark):
    y, p = np.array([1.0, 0.0, -2.0, 4.0]), np.array([2.0, 0.5, -2.0, 3.0])
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(y, p)], "id string, y double, y_hat double")
    row = m.evaluate_metrics(df, ["id"]).first()
    assert row.mse == pytest.approx(np.mean((p - y) ** 2))
    assert row.mae == pytest.approx(np.mean(np.abs(p - y)))
    assert row.mape == pytest.approx(100 * np.mean(np.abs(y - p) / np.maximum(np.abs(y), 1e-7)))
    assert row.smape == pytest.approx(100 * np.mean(np.abs(y - p) / np.maximum(np.abs(y) + np.abs(p), 1e-7)))


def test_metrics_over_horizons_and_registry(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0], [2.0, 3.0])], "id string, y array<double>, y_hat array<double>")
    assert m.evaluate_metrics(df, ["id"], metrics=["mae"]).first().mae == 0.5
    row = df.select(m.metric_smape_rowwise(F.col("y"), F.col("y_hat")).alias("s")).first()
    assert row.s == pytest.approx(100 * (1 / 3) / 2)
    m.register_metric("bias", lambda y, p: F.avg(p - y))
    assert m.evaluate_metrics(df, ["id"], metrics=["bias"]).first().bias == 0.5
    with pytest.raises(ValueError):
        m.evaluate_metrics(df, ["id"], metrics=["no_such"])
