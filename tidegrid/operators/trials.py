"""Grids of forecasting trials."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.forecast import grouped_ols, grouped_predict, grouped_sums, unpacked_sums
from tidegrid.operators.metrics import evaluate_metrics
from tidegrid.session import stage


def trial_grid(
    spark: SparkSession, lists: Mapping[str, Sequence], key: str = "exptid", first: int = 0, repeats: int = 1
) -> DataFrame:
    """One row per combination, ``repeats`` times; the trial number's lowest digit runs
    over the first list (mixed radix)."""
    total = repeats
    for choices in lists.values():
        total *= len(choices)
    grid = spark.range(first, first + total).withColumnRenamed("id", key)
    return decode_trial(grid, lists, key)


def decode_trial(df: DataFrame, lists: Mapping[str, Sequence], key: str = "exptid") -> DataFrame:
    """Add the choice of each list that a trial number stands for."""
    base = 1
    for name, choices in lists.items():
        digit = F.pmod(F.floor(F.col(key) / base), F.lit(len(choices)))
        options = F.array(*[F.lit(c) for c in choices])
        df = df.withColumn(name, F.element_at(options, (digit + 1).cast("int")))
        base *= len(choices)
    return df


def sample_config(grid: DataFrame, seed: int = 0) -> DataFrame:
    """One configuration chosen by seed.

    The choice is the least seeded digest, so it depends on the grid alone and
    not on how its rows are spread over tasks.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in grid.columns])
    return grid.orderBy(F.md5(text)).limit(1)


# Models a trial can name besides "linear": a fixed function of the inputs.
BASELINES = {
    "persistence": lambda xs: xs[-1],
    "average": lambda xs: sum(xs[1:], xs[0]) / len(xs),
}


@dataclass(frozen=True)
class RandomFeatures:
    """Ridge regression on ``count`` cosines of random mixtures of the inputs.

    ``width`` is the range of the inputs over which a feature goes through about one period.
    The mixtures follow from ``seed`` alone.
    """

    count: int = 8
    ridge: float = 1.0
    width: float = 100.0
    seed: int = 0

    def _draw(self, *place: int) -> float:
        """A number from 0 to 1 for a place."""
        name = "|".join(map(str, (self.seed, *place)))
        return int(hashlib.sha256(name.encode()).hexdigest()[:12], 16) / 16**12

    def mixtures(self, n_inputs: int) -> list[tuple[list[float], float]]:
        """Weights of the inputs and phase of each feature."""
        return [
            (
                [(2 * self._draw(k, i) - 1) * 2 * math.pi / self.width for i in range(n_inputs)],
                2 * math.pi * self._draw(k, n_inputs),
            )
            for k in range(self.count)
        ]

    def columns(self, inputs: Sequence[Column]) -> list[Column]:
        out = []
        for weights, phase in self.mixtures(len(inputs)):
            angle = F.lit(phase)
            for weight, x in zip(weights, inputs):
                angle = angle + F.lit(weight) * x
            out.append(F.cos(angle))
        return out


def _fitted(sums: DataFrame, by: list[str], n_x: int, n_z: int, n_y: int, ridge: float) -> DataFrame:
    """Both kinds of model from the products of (1, x…, z…): ``coef`` and ``coef_z``."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 1 + n_x + n_z
        plain, mixed = list(range(1 + n_x)), [0, *range(1 + n_x, size)]
        for batch in batches:
            a, b = unpacked_sums(batch, size, n_y)
            found = {}
            for name, at, penalty in (("coef", plain, 0.0), ("coef_z", mixed, ridge)):
                part = a[:, at][:, :, at] + penalty * np.diag([0.0] + [1.0] * (len(at) - 1))
                solved = b[:, :, at] @ np.linalg.pinv(part, rcond=np.finfo(float).eps * len(at), hermitian=True)
                found[name] = [c.tolist() for c in solved]
            yield batch.drop(columns=["n_rows", "_gram", "_cross"]).assign(**found)

    none = F.lit(None).cast("array<array<double>>")
    return sums.mapInPandas(solve, sums.select(*by, none.alias("coef"), none.alias("coef_z")).schema)


def run_trials(
    windows: DataFrame,
    trials: DataFrame,
    on: Sequence[str],
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    ids: Sequence[str] = ("id",),
    dt: str = "dt",
    split: str = "split",
    model: str = "mclass",
    metrics: Sequence[str] = ("mse", "mae", "mape", "smape"),
    key: str = "exptid",
    features: RandomFeatures | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All trials in one job: (metrics per trial and series, test predictions).

    ``trials`` picks its windows by the ``on`` columns and names its model in
    ``model``: ``linear``, ``random_features`` (with ``features``) or a baseline.  Models of
    both kinds, of all trials and series, are fitted together from one grouped aggregate of
    products; the baselines are projections.
    """
    ids, on = list(ids), list(on)
    y_cols, x_cols = list(y_cols), list(x_cols)
    windows = stage(windows)  # the fit and the test rows both read them
    # A fit depends on its windows and series only, whatever trials share it.
    fit_by = [*on, *ids]
    train = windows.where(F.col(split) == "train")
    inputs = [F.col(f"`{c}`") for c in x_cols]
    if features is None:
        models = grouped_ols(train, fit_by, x_cols, y_cols).withColumn("coef_z", F.lit(None).cast("array<array<double>>"))
        mixed = []
    else:
        mixed = features.columns([x.cast("double") for x in inputs])
        named = {f"_z{k}": z for k, z in enumerate(mixed)}
        sums = grouped_sums(train.withColumns(named), fit_by, [*x_cols, *named], y_cols)
        models = _fitted(sums, fit_by, len(x_cols), len(mixed), len(y_cols), features.ridge)
    if features is not None:
        models = stage(models)  # joined for each kind
    test = windows.where(F.col(split) == "test").join(trials.select(key, model, *on), on)
    # Which trials share a series' models does not matter: both kinds lie in its row.
    kept = models.select(*fit_by, F.col("coef_z").alias("_coef_z"))
    rows = grouped_predict(test, models, fit_by, x_cols, len(y_cols), how="left")
    if mixed:
        rows = rows.join(kept, fit_by, "left")
    hats = []
    for step in range(len(y_cols)):
        hat = F.when(F.col(model) == "linear", F.col(f"y_hat_{step}"))
        if mixed:
            coef = F.col("_coef_z")[step]
            hat = hat.when(F.col(model) == "random_features", sum((coef[k + 1] * z for k, z in enumerate(mixed)), coef[0]))
        for name, build in BASELINES.items():
            hat = hat.when(F.col(model) == name, build(inputs))
        unknown = F.concat(F.lit("no such model: "), F.col(model))
        hats.append(hat.otherwise(F.raise_error(unknown).cast("double")))
    predictions = rows.select(
        key,
        *ids,
        dt,
        F.array(*[F.col(f"`{c}`") for c in y_cols]).alias("y"),
        F.array(*hats).alias("y_hat"),
    )
    scored = evaluate_metrics(predictions, [key, *ids], "y", "y_hat", metrics)
    return scored, predictions
