"""Models and preparation jobs against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid import Panel
from tidegrid.operators import forecast
from tidegrid.operators.split import tvt_split
from tidegrid.operators.trials import run_trials
from tidegrid.operators.windows import xy_windows_flat
from tidegrid.plans.datasets import DatasetConf, build_dataset_dual_rate, build_dataset_single_rate
from tidegrid.sources.generate import generate_ramp

P = Panel()


def _wave(n, seed):
    rng = np.random.default_rng(seed)
    return (np.sin(np.arange(n) / 3) * 5 + rng.normal(size=n) + 20).round(3).tolist()


def _lags(v, p):
    x = np.column_stack([np.ones(len(v) - p)] + [v[i : len(v) - p + i] for i in range(p)])
    return x, np.asarray(v[p:])


@pytest.mark.parametrize("p", [1, 3])
@pytest.mark.parametrize("chunk", [None, 900_000_000])
def test_autoregression(series, p, chunk):
    v = _wave(80, 2)
    out = forecast.forecast_per_series(series(v=v), P.chunked(chunk), "v", p, 4).orderBy("step").collect()
    x, y = _lags(v, p)
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    state = list(v)
    for _ in range(4):
        state.append(coef[0] + float(np.dot(coef[1:], state[-p:])))
    assert [r.step for r in out] == [1, 2, 3, 4]
    np.testing.assert_allclose([r.y_hat for r in out], state[-4:], rtol=1e-7)


def _split_windows(series, v, **kw):
    return tvt_split(xy_windows_flat(series(v=v), P, ["v"], ["v"], **kw), P)


X = ["v_t-2", "v_t-1", "v_t-0"]
Y = ["v_t+1", "v_t+2"]


def test_direct_forecast_equals_least_squares(series):
    windows = _split_windows(series, _wave(100, 3), n_tx=3, n_ty=2)
    out = forecast.forecast_fit_predict(windows, X, Y).orderBy("dt").toPandas()
    rows = windows.orderBy("dt").toPandas()
    train, test = rows[rows.split == "train"], rows[rows.split == "test"]
    design = lambda t: np.column_stack([np.ones(len(t)), t[X]])
    for y in Y:
        coef = np.linalg.lstsq(design(train), train[y], rcond=None)[0]
        np.testing.assert_allclose(out[f"{y}_hat"], design(test) @ coef, rtol=1e-6)


def test_grouped_models_equal_separate_ones(spark, series):
    a = series(ids=("a",), v=_wave(60, 4))
    b = series(ids=("b",), v=_wave(60, 5))
    windows = xy_windows_flat(a.unionByName(b), P, ["v"], ["v"], n_tx=3, n_ty=2)
    together = {r.id: r.coef for r in forecast.grouped_ols(windows, ["id"], X, Y).collect()}
    for i in "ab":
        rows = windows.where(F.col("id") == i).toPandas()
        x = np.column_stack([np.ones(len(rows)), rows[X]])
        expected = np.linalg.lstsq(x, rows[Y], rcond=None)[0].T
        np.testing.assert_allclose(together[i], expected, rtol=1e-6)


def test_wide_grouped_models(spark, monkeypatch):
    """Inputs of the study's own shape (24 steps of 3 columns), with one group in many parts."""
    monkeypatch.setattr(forecast, "GROUP_ROWS", 20)
    monkeypatch.setattr(forecast, "ADDED", 3)
    rng = np.random.default_rng(3)
    n, width = 400, 72
    x = rng.normal(size=(n, width))
    y = x @ rng.normal(size=(width, 2)) + rng.normal(size=(n, 2)) * 0.1
    names = [f"x{i}" for i in range(width)]
    ids = np.where(np.arange(n) < 250, "a", np.where(np.arange(n) < 390, "b", None))
    frame = pd.DataFrame(np.hstack([x, y]), columns=[*names, "y0", "y1"]).assign(id=ids)
    models = forecast.grouped_ols(spark.createDataFrame(frame), ["id"], names, ["y0", "y1"])
    rows = {r.id: r for r in models.collect()}
    assert {k: r.n_rows for k, r in rows.items()} == {"a": 250, "b": 140, None: 10}
    for key in "ab":
        part = frame[frame.id == key]
        design = np.column_stack([np.ones(len(part)), part[names]])
        expected = np.linalg.lstsq(design, part[["y0", "y1"]], rcond=None)[0].T
        np.testing.assert_allclose(rows[key].coef, expected, rtol=1e-5, atol=1e-6)


def test_every_candidate_is_scored(series):
    windows = _split_windows(series, _wave(60, 6), n_tx=3, n_ty=2)
    result = forecast.tune_search(windows, X, Y[:1], [{"regParam": i / 10} for i in range(25)])
    assert result.runs.count() == 25


def test_search_picks_the_least_validation_loss(series):
    windows = _split_windows(series, _wave(100, 6), n_tx=3, n_ty=2)
    candidates = [{"regParam": 100.0}, {"regParam": 0.0}, {"regParam": 10.0}]
    result = forecast.tune_search(windows, X, Y, candidates)
    runs = {r.run: r for r in result.runs.collect()}
    assert len(runs) == 3
    assert result.best == {"regParam": 0.0}
    assert runs[1].is_best and runs[1].loss == min(r.loss for r in runs.values())
    assert result.predictions.count() == windows.where("split = 'test'").count()
    worst = forecast.tune_search(windows, X, Y, candidates[:2], score=lambda d: -d.agg(F.stddev("v_t+1_hat")).first()[0])
    assert worst.best == {"regParam": 0.0}
    with pytest.raises(ValueError):
        forecast.tune_search(windows, X, Y, [])
    with pytest.raises(ValueError):
        forecast.forecast_fit_predict(windows, X, Y, "oracle")


def test_trials_share_one_job(spark, series):
    windows = _split_windows(series, _wave(100, 7), n_tx=3, n_ty=2).withColumn("n_agg", F.lit(5))
    trials = spark.createDataFrame([(1, "linear", 5), (2, "persistence", 5), (3, "average", 5), (4, "linear", 10)],
                                   "exptid int, mclass string, n_agg int")
    scored, predictions = run_trials(windows, trials, ["n_agg"], X, Y)
    test = windows.where("split = 'test'").orderBy("dt").toPandas()
    rows = {r.exptid: r for r in scored.collect()}
    assert sorted(rows) == [1, 2, 3]
    error = test[Y].to_numpy() - test[["v_t-0"]].to_numpy()
    assert rows[2].mse == pytest.approx((error**2).mean())
    error = test[Y].to_numpy() - test[X].mean(axis=1).to_numpy()[:, None]
    assert rows[3].mae == pytest.approx(np.abs(error).mean())
    fitted = forecast.forecast_fit_predict(windows, X, Y).toPandas()
    error = np.column_stack([fitted[y] - fitted[f"{y}_hat"] for y in Y])
    assert rows[1].mse == pytest.approx((error**2).mean(), rel=1e-6)
    assert predictions.count() == 3 * len(test)
    bad = trials.withColumn("mclass", F.lit("nope"))
    with pytest.raises(Exception, match="no such model"):
        run_trials(windows, bad, ["n_agg"], X, Y)[0].collect()


# ------------------------------------------------------------ preparation jobs


@pytest.fixture(scope="module")
def detectors(spark):
    """Four detectors on one road, two on another, three weeks of 5-minute readings."""
    meta = spark.createDataFrame(
        [(f"d{i}", "r1" if i < 4 else "r2", "N", i) for i in range(6)],
        "id string, road string, direction string, ord int")
    ramp = generate_ramp(spark, 288 * 21, {"speed": (0, 288 * 21 - 1), "volume": (10, 20)})
    return meta, meta.select("id").join(ramp).withColumn("speed", F.col("speed") + F.substring("id", 2, 1).cast("int"))


def test_single_rate_dataset(detectors):
    conf = DatasetConf(n_tx=4, n_ty=2, n_aggs=(10,), column_sets=(("speed",), ("speed", "volume")))
    out = build_dataset_single_rate(*detectors, conf)
    shapes = out.groupBy("features", "n_vx", "n_agg").agg(
        F.max(F.size(F.col("x")[0])).alias("width"), F.min(F.size("x")).alias("n_tx"),
        F.min(F.size("y")).alias("n_ty"), F.count_distinct("id").alias("ids"))
    widths = {(r.features, r.n_vx): (r.width, r.n_tx, r.n_ty, r.ids) for r in shapes.collect()}
    assert widths == {
        ("f", 1): (1, 4, 2, 2), ("f", 2): (2, 4, 2, 2), ("tf", 1): (3, 4, 2, 2), ("tf", 2): (4, 4, 2, 2),
        ("sf", 1): (3, 4, 2, 2), ("sf", 2): (6, 4, 2, 2), ("stf", 1): (5, 4, 2, 2), ("stf", 2): (8, 4, 2, 2),
    }
    assert {r.id for r in out.select("id").distinct().collect()} == {"d1", "d2"}
    # Only working days, and inputs scaled to [0, 1].
    assert out.where(F.weekday("dt") > 4).isEmpty()
    ends = out.where("features = 'f' AND n_vx = 1").select(F.explode(F.flatten("x")).alias("v"))
    assert tuple(ends.agg(F.min("v"), F.max("v")).first()) == pytest.approx((0, 1), abs=0.02)
    # A ramp's next value is one step ahead of the last input.
    row = out.where("features = 'f' AND n_vx = 1 AND id = 'd1'").orderBy("dt").first()
    step = row.x[1][0] - row.x[0][0]
    assert row.y[0][0] == pytest.approx(row.x[3][0] + step)
    # Columns of the narrow combinations are those of the wide ones.
    wide = out.where("features = 'stf' AND n_vx = 2 AND id = 'd1'").orderBy("dt").first()
    narrow = out.where("features = 'sf' AND n_vx = 1 AND id = 'd1'").orderBy("dt").first()
    assert narrow.x[0] == [wide.x[0][0], wide.x[0][2], wide.x[0][4]]


def test_dual_rate_dataset(detectors):
    conf = DatasetConf(n_tx=6, n_ty=2, n_aggs=(5, 15), column_sets=(("speed",),), features=("f", "sf"))
    out = build_dataset_dual_rate(*detectors, conf)
    # Inputs start on target bins; targets keep their unit and follow the input.
    assert out.where(F.minute("dt") % 30 != 0).isEmpty()
    row = out.where("features = 'f' AND n_agg = 5 AND id = 'd2'").orderBy("dt").first()
    first = (row.dt.day - 1) * 288 + row.dt.hour * 12 + row.dt.minute // 5 + 2
    assert [y[0] for y in row.y] == pytest.approx([first + 6 + 2.5, first + 12 + 2.5])
    later = out.where("features = 'f' AND n_agg = 15 AND id = 'd2'").orderBy("dt").first()
    assert [y[0] for y in later.y] == pytest.approx([first + 18 + 2.5, first + 24 + 2.5])
    same = DatasetConf(n_tx_duration=12, n_aggs=(5, 15), column_sets=(("speed",),), features=("f",))
    assert [same.input_length(n) for n in (5, 10, 15)] == [12, 6, 4]
