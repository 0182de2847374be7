"""Automatic orders, trials with random features, and the search with a budget, against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import forecast
from tidegrid.operators.trials import RandomFeatures, run_trials, trial_grid
from tidegrid.panel import Panel

PANEL = Panel(("id",), "dt").bounded()


def by_hand(values, max_p, max_d, max_q, long):
    """Order and one-step forecast of one series, system by system."""
    levels = [np.array(values, float)]
    for _ in range(max_d):
        levels.append(np.append(np.nan, levels[-1][1:] - levels[-1][:-1]))
    levels = [v[max_d:] for v in levels]
    noise = [np.zeros(len(levels[0]))] * (max_d + 1)

    def system(v, e, p, q, from_):
        rows = range(from_, len(v))
        x = np.array([[1, *[v[t - 1 - k] for k in range(p)], *[e[t - 1 - k] for k in range(q)]] for t in rows])
        return x, v[from_:]

    if max_q:
        for d, v in enumerate(levels):
            x, y = system(v, v, long, 0, long)
            coef = np.linalg.lstsq(x, y, rcond=None)[0]
            noise[d] = y - x @ coef
        noise = list(noise)
        levels = [v[long:] for v in levels]
    best = None
    for d in range(max_d + 1):
        for p in range(1, max_p + 1):
            for q in range(max_q + 1):
                v, e = levels[d], noise[d]
                x, y = system(v, e, p, q, max(max_p, max_q))
                coef = np.linalg.lstsq(x, y, rcond=None)[0]
                rss = max(((y - x @ coef) ** 2).sum(), 1e-9 * (y @ y))
                score = len(y) * math.log(rss / len(y)) + 2 * (p + q + 1)
                if best is None or score < best[0] - 1e-6:
                    hat = coef[0] + sum(coef[1 + k] * v[-1 - k] for k in range(p)) + sum(coef[1 + p + k] * e[-1 - k] for k in range(q))
                    for below in range(d - 1, -1, -1):
                        hat += levels[below][-1]
                    best = (score, p, d, q, hat)
    return best[1:]


def drawn(draw, n, phi, theta, walk=False):
    out, e, level = [], 0.0, 0.0
    for _ in range(n):
        new = draw.gauss(0, 1)
        level = phi * level + new + theta * e
        e = new
        out.append(level + (out[-1] if walk and out else 5.0))
    return out


@pytest.mark.parametrize("max_p,max_d,max_q,long", [(1, 1, 0, None), (3, 1, 0, None), (1, 0, 1, 1), (2, 1, 2, 4)])
def test_orders_and_forecasts(spark, series, max_p, max_d, max_q, long):
    draw = random.Random(9)
    made = {"a": drawn(draw, 120, 0.6, 0.0), "b": drawn(draw, 150, 0.2, 0.9), "c": drawn(draw, 90, 0.3, 0.0, True), "d": drawn(draw, 14, 0.5, 0)}
    parts = [series(ids=(i,), v=v) for i, v in made.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    got = {r["id"]: r for r in forecast.forecast_auto(rows, PANEL, "v", max_p, max_d, 1, max_q, long).collect()}
    assert set(got) == set(made)
    for i, values in made.items():
        p, d, q, hat = by_hand(values, max_p, max_d, max_q, long)
        r = got[i]
        assert (r["p"], r["d"], r["q"] if max_q else 0) == (p, d, q)
        assert r["y_hat"] == pytest.approx(hat, rel=1e-6, abs=1e-6)


def test_short_constant_and_exact_series(series):
    rows = series(ids=("flat",), v=[3.0] * 12).unionByName(series(ids=("line",), v=[1.0 * k for k in range(12)]))
    rows = rows.unionByName(series(ids=("short",), v=[1.0, 2.0, 4.0])).unionByName(series(ids=("none",), v=[None] * 8))
    got = {(r["id"], r["step"]): r["y_hat"] for r in forecast.forecast_auto(rows, PANEL, "v", 1, 1, 2).collect()}
    assert {i for i, _ in got} == {"flat", "line"}
    assert got["flat", 2] == pytest.approx(3) and got["line", 2] == pytest.approx(13)
    assert forecast.forecast_auto(rows.where("id = 'x'"), PANEL, "v", 1, 1).collect() == []


def windows(spark, n=400):
    draw = random.Random(4)
    start = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    made = []
    for i in "ab":
        for k in range(n):
            x0, x1 = draw.uniform(-50, 50), draw.uniform(-50, 50)
            y = 10 * math.sin(x1 / 12) + (3 if i == "a" else -1) * x0 / 50 + draw.gauss(0, 0.3)
            made.append((i, k, x0, x1, y, "train" if k < n * 0.7 else "valid" if k < n * 0.85 else "test"))
    df = spark.createDataFrame(made, "id string, k int, x0 double, x1 double, y double, split string")
    return df.withColumn("dt", start + F.expr("interval 1 hour") * F.col("k")), made


def test_random_features_against_ridge(spark):
    df, made = windows(spark)
    features = RandomFeatures(count=30, ridge=0.5, width=60.0, seed=5)
    plan = trial_grid(spark, {"mclass": ["linear", "random_features"]}).withColumn("of", F.lit(1))
    scored, _ = run_trials(df.withColumn("of", F.lit(1)), plan, ["of"], ["x0", "x1"], ["y"], metrics=["mse"], features=features)
    got = {(r["exptid"], r["id"]): r["mse"] for r in scored.collect()}
    for i in "ab":
        z = lambda rows: np.array([[1, *[math.cos(b + sum(w * x for w, x in zip(ws, r[2:4]))) for ws, b in features.mixtures(2)]] for r in rows])
        train, test = ([r for r in made if r[0] == i and r[5] == s] for s in ("train", "test"))
        a, y = z(train), np.array([r[4] for r in train])
        coef = np.linalg.solve(a.T @ a + 0.5 * np.diag([0] + [1] * 30), a.T @ y)
        want = np.mean((np.array([r[4] for r in test]) - z(test) @ coef) ** 2)
        assert got[1, i] == pytest.approx(want, rel=1e-6)
        assert got[1, i] < 0.5 * got[0, i]  # the linear model cannot follow the sine
    with pytest.raises(Exception, match="no such model"):
        run_trials(df.withColumn("of", F.lit(1)), plan, ["of"], ["x0", "x1"], ["y"], metrics=["mse"])[0].collect()


def test_halving_against_single_fits(spark):
    df, made = windows(spark)
    space = {"ridge": [0.0, 1e3, 1e5, 1e7], "inputs": [1, 2], "intercept": [True, False]}
    found = forecast.halving_search(df, ["x0", "x1"], ["y"], space, runcount=20, rungs=3)
    runs = {r["candidate"]: r for r in found.runs.collect()}
    assert len(runs) == 16 and sum(r["rungs"] for r in runs.values()) <= 20
    assert sum(r["status"] == "best" for r in runs.values()) == 1
    assert all((r["loss"] is None) == (r["status"] == "not run") == (r["rungs"] == 0) for r in runs.values())
    drawn_, rows = forecast._candidates(space, 0), {s: np.array([r[1:5] for r in made if r[5] == s]) for s in ("train", "valid")}
    hi = rows["train"][:, 0].max()

    def loss(params, rung):
        train = rows["train"][rows["train"][:, 0] >= hi - hi // 2 ** (2 - rung)]

        def inputs(r):
            cols = [np.ones(len(r))] if params["intercept"] else []
            return np.column_stack([*cols, *r[:, 3 - params["inputs"] : 3].T])

        x = inputs(train)
        penalty = np.diag([0.0] * params["intercept"] + [params["ridge"]] * params["inputs"])
        coef = np.linalg.lstsq(x.T @ x + penalty, x.T @ train[:, 3], rcond=None)[0]
        return np.mean((rows["valid"][:, 3] - inputs(rows["valid"]) @ coef) ** 2)

    for k, r in runs.items():
        if r["rungs"]:
            assert r["loss"] == pytest.approx(loss(drawn_[k], r["rungs"] - 1), rel=1e-6)
    first = sum(r["rungs"] > 0 for r in runs.values())
    alive = sorted(range(first), key=lambda k: (loss(drawn_[k], 0), k))[: first // 2]
    assert {k for k, r in runs.items() if r["rungs"] > 1} == set(alive)
    assert found.predictions.count() == sum(r[5] == "test" for r in made)
    for bad in ({"depth": [1]}, {"ridge": []}):
        with pytest.raises(ValueError):
            forecast.halving_search(df, ["x0"], ["y"], bad, 5)
    with pytest.raises(ValueError, match="take at least"):
        forecast.halving_search(df, ["x0"], ["y"], space, 2, rungs=3)
