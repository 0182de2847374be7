"""Forecasting as Spark jobs: regressors on windows, one model per horizon step.

Small linear models, one per series or trial, come from one grouped aggregate:
the sums of products of their inputs.  Those sums combine on the map side, so a
series of any length costs a task a few dozen numbers; the tiny systems are then
solved in Arrow batches.  Larger models use Spark ML.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.chunks import measured
from tidegrid.operators.metrics import get_metric
from tidegrid.operators.regularize import shift
from tidegrid.operators.split import tail_rows
from tidegrid.operators.windows import xy_windows_flat
from tidegrid.panel import Panel
from tidegrid.session import stage

# Registry of estimators by name; add your own factories.
ESTIMATORS: dict[str, Callable] = {
    "linear": LinearRegression,
    "gbt": GBTRegressor,
    "forest": RandomForestRegressor,
}

# Up to this many inputs the sums of products are one aggregate of columns, about n*n/2
# of them; wider systems add up matrices.  Both give the same sums.
COLUMN_SUMS = 40
# Rows of a group that one task turns into a matrix, and matrices that one task adds up.
GROUP_ROWS = 200_000
ADDED = 64


# ----------------------------------------------------- grouped linear models


def grouped_ols(
    df: DataFrame, by: Sequence[str], x_cols: Sequence[str], y_cols: Sequence[str], centered: bool = False
) -> DataFrame:
    """Least squares with intercept per group: ``coef[y][1 + x]`` and row count.

    Without keys all rows are one group.  Of singular systems, the least coefficients are
    taken, with ``centered`` the least slopes (see :func:`centered_slopes`).
    """
    sums = grouped_sums(df, by, x_cols, y_cols)
    return _solved(sums, list(by), len(x_cols) + 1, len(y_cols), centered)


def grouped_sums(
    df: DataFrame, by: Sequence[str], x_cols: Sequence[str], y_cols: Sequence[str]
) -> DataFrame:
    """Per group ``n_rows``, the upper triangle ``_gram`` of the products of (1, x…), and
    ``_cross``, each target's products with (1, x…).  Rows with a missing value are left out."""
    by, x_cols, y_cols = list(by), list(x_cols), list(y_cols)
    used = [*x_cols, *y_cols]
    rows = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(used)])
    rows = rows.na.drop(subset=[f"_{i}" for i in range(len(used))])
    if len(x_cols) > COLUMN_SUMS:
        return _matrix_sums(rows, by, len(x_cols), len(y_cols))
    inputs = [F.lit(1.0)] + [F.col(f"_{i}") for i in range(len(x_cols))]
    targets = [F.col(f"_{i}") for i in range(len(x_cols), len(used))]
    size = len(inputs)
    upper = [F.sum(inputs[i] * inputs[j]) for i in range(size) for j in range(i, size)]
    cross = [F.sum(a * t) for t in targets for a in inputs]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(*upper).alias("_gram"),
        F.array(*cross).alias("_cross"),
    )


def unpacked_sums(batch: pd.DataFrame, size: int, n_y: int) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric matrices and cross products of a batch of groups."""
    row, col = np.triu_indices(size)
    a = np.zeros((len(batch), size, size))
    b = np.zeros((len(batch), n_y, size))
    if len(batch):
        a[:, row, col] = a[:, col, row] = np.stack(batch["_gram"].to_numpy())
        b[:] = np.stack(batch["_cross"].to_numpy()).reshape(len(batch), n_y, size)
    return a, b


# Part of the inputs' sum of squares below which a direction counts as constant.
CONSTANT = 1e-9


def centered_slopes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coefficients (constant first) of a batch of systems, slopes of least length.

    Means are taken out first, so that an input without variation gets a slope of zero and
    the constant is free.
    """
    n = np.maximum(a[:, :1, 0], 1)
    mean = a[:, 0, 1:] / n
    inner = a[:, 1:, 1:] - n[..., None] * mean[:, :, None] * mean[:, None, :]
    raw = np.trace(a[:, 1:, 1:], axis1=1, axis2=2)
    level = b[:, :, 0] / n
    values, vectors = np.linalg.eigh(inner)
    use = values > CONSTANT * raw[:, None]
    inverse = np.where(use, 1 / np.where(use, values, 1), 0)
    across = (b[:, :, 1:] - level[:, :, None] * (n * mean)[:, None, :]) @ vectors
    slopes = (across * inverse[:, None, :]) @ vectors.transpose(0, 2, 1)
    return np.concatenate([(level - (slopes * mean[:, None, :]).sum(axis=2))[..., None], slopes], axis=2)


def _solved(sums: DataFrame, by: list[str], size: int, n_y: int, centered: bool = False) -> DataFrame:
    """Coefficients from the upper triangles and cross products of the groups."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = unpacked_sums(batch, size, n_y)
            # The whole batch at a time; the pseudo-inverse takes singular systems too.
            found = centered_slopes(a, b) if centered else b @ np.linalg.pinv(a, rcond=np.finfo(float).eps * size, hermitian=True)
            yield batch.drop(columns=["_gram", "_cross"]).assign(coef=[c.tolist() for c in found])

    schema = sums.select(*by, "n_rows", F.lit(None).cast("array<array<double>>").alias("coef")).schema
    return sums.mapInPandas(solve, schema)


def _matrix_sums(rows: DataFrame, by: list[str], n_x: int, n_y: int) -> DataFrame:
    """Upper triangles and cross products as arrays, for any number of inputs.

    A group's rows are dealt to parts of bounded size, each part becomes one matrix in a
    task, and the matrices of a group are added up a few at a time, so that no task holds
    a long group or all matrices of one.
    """
    size = n_x + 1
    upper = np.triu_indices(size)
    group = [f"_g{i}" for i in range(len(by))]
    keyed = rows.select(*[F.col(c).alias(g) for c, g in zip(by, group)], *[f"_{i}" for i in range(n_x + n_y)])
    large = (
        keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS)
        .select(*[F.col(g).alias(f"{g}l") for g in group], F.ceil(F.col("_n") / GROUP_ROWS).alias("_parts"))
    )
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}l"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = keyed.join(large, on, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*[f"_{i}" for i in range(n_x + n_y)]), parts)
    ).drop("_parts", *[f"{g}l" for g in group])
    kept = dealt.select(*group, "_part").schema
    made = T.StructType([
        *kept.fields, T.StructField("n_rows", T.LongType()), T.StructField("_gram", T.ArrayType(T.DoubleType())),
        T.StructField("_cross", T.ArrayType(T.DoubleType())),
    ])

    def row_of(table: pa.Table, n: int, gram: np.ndarray, cross: np.ndarray) -> pa.Table:
        first = table.slice(0, 1)
        columns = {f.name: first.column(f.name) for f in kept.fields}
        return pa.table({
            **columns, "n_rows": pa.array([n]), "_gram": pa.array([gram], pa.list_(pa.float64())),
            "_cross": pa.array([cross], pa.list_(pa.float64())),
        })

    def matrix(table: pa.Table) -> pa.Table:
        values = np.column_stack([table.column(f"_{i}").to_numpy() for i in range(n_x + n_y)])
        x = np.column_stack([np.ones(len(values)), values[:, :n_x]])
        return row_of(table, len(x), (x.T @ x)[upper], (values[:, n_x:].T @ x).ravel())

    def added(table: pa.Table) -> pa.Table:
        gram, cross = (np.add.reduce([np.asarray(v) for v in table.column(c).to_pylist()]) for c in ("_gram", "_cross"))
        return row_of(table, int(np.sum(table.column("n_rows").to_numpy())), gram, cross)

    sums = dealt.groupBy(*group, "_part").applyInArrow(matrix, made)
    most = large.agg(F.max("_parts")).first()[0] or 1
    while most > 1:
        most = -(-most // ADDED)
        sums = sums.withColumn("_part", F.floor(F.col("_part") / ADDED)).groupBy(*group, "_part").applyInArrow(added, made)
    return sums.select(*[F.col(g).alias(c) for c, g in zip(by, group)], "n_rows", "_gram", "_cross")


def grouped_predict(
    df: DataFrame,
    models: DataFrame,
    by: Sequence[str],
    x_cols: Sequence[str],
    n_y: int,
    how: str = "inner",
) -> DataFrame:
    """Add ``y_hat_0..``: intercept plus the inputs times their coefficients."""
    joined = df.join(models.select(*by, "coef"), list(by), how)
    hats = {}
    for step in range(n_y):
        terms = F.col("coef")[step][0]
        for i, c in enumerate(x_cols):
            terms = terms + F.col("coef")[step][i + 1] * F.col(f"`{c}`")
        hats[f"y_hat_{step}"] = terms
    return joined.withColumns(hats).drop("coef")


def forecast_per_series(
    df: DataFrame, panel: Panel, value: str, p: int = 1, steps: int = 1
) -> DataFrame:
    """Autoregression of order ``p`` per series, iterated ``steps`` ahead.

    Rows ``(ids…, step, y_hat)``.  Only the last ``p`` values and the coefficients
    of a series meet in one row.
    """
    ids = list(panel.ids)
    panel = measured(df, panel)
    lagged = xy_windows_flat(df, panel, [value], [value], n_tx=p, n_ty=1)
    x_cols = [f"{value}_t-{back}" for back in range(p - 1, -1, -1)]
    models = grouped_ols(lagged, ids, x_cols, [f"{value}_t+1"])
    recent = tail_rows(df.select(*ids, panel.dt, value), panel, p).groupBy(*ids).agg(
        F.array_sort(F.collect_list(F.struct(panel.dt, value))).alias("_last")
    )
    start = models.join(recent, ids).where(F.size("_last") == p)
    coef = F.col("coef")[0]

    def ahead(state, _):
        window = F.slice(state, -p, p)
        dot = F.aggregate(
            F.zip_with(window, F.slice(coef, 2, p), lambda a, b: a * b),
            F.lit(0.0),
            lambda a, v: a + v,
        )
        return F.concat(state, F.array(coef[0] + dot))

    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.col(f"_last.{value}").cast("array<double>"),
        ahead,
    )
    made = F.posexplode(F.slice(grown, p + 1, steps)).alias("step", "y_hat")
    return start.select(*ids, made).withColumn("step", F.col("step") + 1)


# A model that fits to this part of its target's sum of squares fits exactly; of equal scores
# the simplest model stays.
EXACT, TIE = 1e-9, 1e-6


def _with_residuals(rows: DataFrame, panel: Panel, levels: list[str], long: int) -> DataFrame:
    """Rows with the residual ``e{d}`` of each level's autoregression of order ``long``."""
    ids = list(panel.ids)
    at = rows.withColumn("_at", F.col(panel.dt))
    windows = stage(xy_windows_flat(at, panel, levels, [*levels, "_at"], n_tx=long, n_ty=1))
    made = windows
    for d, v in enumerate(levels):
        x_cols = [f"{v}_t-{back}" for back in range(long)]
        models = grouped_ols(windows, ids, x_cols, [f"{v}_t+1"], centered=True)
        made = grouped_predict(made, models, ids, x_cols, 1, how="left")
        made = made.withColumn(f"e{d}", F.col(f"`{v}_t+1`") - F.col("y_hat_0")).drop("y_hat_0")
    return made.select(
        *ids, F.col("`_at_t+1`").alias(panel.dt), *[F.col(f"`{v}_t+1`").alias(v) for v in levels],
        *[f"e{d}" for d in range(len(levels))],
    )


def forecast_auto(
    df: DataFrame, panel: Panel, value: str, max_p: int = 3, max_d: int = 1, steps: int = 1, max_q: int = 0,
    long: int | None = None,
) -> DataFrame:
    """The order of autoregression ``p``, of differences ``d`` and of moving averages ``q``
    that suits each series best.

    Rows ``(ids…, p, d, step, y_hat)``, with ``max_q`` also ``q``.  Moving averages are fitted
    in two stages: an autoregression of order ``long`` (``max_p + max_q`` if not given) leaves
    residuals, and those of the ``q`` steps before are inputs of the second system.  All orders
    are solved from one aggregate of products per series and compared by Akaike's criterion on
    the same rows: the error of a step is the same in differences and in levels.  Models that
    fit exactly count as equally good up to the size of their target; ties go to the smaller d,
    then p, then q.  Series with too few rows for the largest model have no row.
    """
    ids = list(panel.ids)
    panel = measured(df, panel)
    levels = [f"v{d}" for d in range(max_d + 1)]
    errors = [f"e{d}" for d in range(max_d + 1)] if max_q else []
    rows = df.select(*ids, panel.dt, F.col(value).cast("double").alias("v0"))
    for before, name in zip(levels, levels[1:]):
        moved = shift(rows.withColumn(name, F.col(before)), panel, [name], 1)
        rows = moved.withColumn(name, F.col(before) - F.col(name))
    rows = rows.where(F.col(levels[-1]).isNotNull())
    if max_q:
        rows = stage(_with_residuals(rows, panel, levels, long or max_p + max_q))
    width = max(max_p, max_q)
    windows = xy_windows_flat(rows, panel, [*levels, *errors], levels, n_tx=width, n_ty=1)
    # The constant, the lags and the residuals from the newest on, the target.
    columns = [
        [f"v{d}_t-{back}" for back in range(max_p)] + [f"e{d}_t-{back}" for back in range(max_q)] + [f"v{d}_t+1"]
        for d in range(max_d + 1)
    ]
    size = max_p + max_q + 2
    sums = []
    for d, names in enumerate(columns):
        terms = [F.lit(1.0)] + [F.col(f"`{c}`") for c in names]
        upper = [F.sum(terms[i] * terms[j]) for i in range(size) for j in range(i, size)]
        sums.append(F.array(*upper).alias(f"_gram{d}"))
    whole = windows.na.drop(subset=[c for names in columns for c in names])
    fitted = whole.groupBy(*ids).agg(F.count(F.lit(1)).cast("double").alias("_n"), *sums)
    recent = tail_rows(rows, panel, width).groupBy(*ids).agg(
        F.array_sort(F.collect_list(F.struct(panel.dt, *levels, *errors))).alias("_last")
    )
    ready = fitted.join(recent, ids).where((F.size("_last") == width) & (F.col("_n") > max_p + max_q + 1)).select(
        *ids, F.col("_n").alias("N"), *[F.col(f"_gram{d}").alias(f"X{d}") for d in range(max_d + 1)],
        *[F.col(f"_last.{v}").alias(f"L{d}") for d, v in enumerate(levels)],
        *[F.col(f"_last.{e}").alias(f"E{d}") for d, e in enumerate(errors)],
    )
    orders = [(d, p, q) for d in range(max_d + 1) for p in range(1, max_p + 1) for q in range(max_q + 1)]
    row, col = np.triu_indices(size)

    def choose(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """For every series the place of its order and the coefficients at their full places."""
        n = batch["N"].to_numpy(float)
        best, chosen = np.full(len(batch), np.inf), np.zeros(len(batch), int)
        coefs = np.zeros((len(batch), size - 1))
        for k, (d, p, q) in enumerate(orders):
            gram = np.zeros((len(batch), size, size))
            gram[:, row, col] = gram[:, col, row] = np.stack(batch[f"X{d}"].to_numpy())
            at = [0, *range(1, p + 1), *range(max_p + 1, max_p + 1 + q)]
            a, b, square = gram[:, at][:, :, at], gram[:, at, -1], gram[:, -1, -1]
            coef = centered_slopes(a, b[:, None, :])[:, 0]
            mean = b[:, :1] / n[:, None]
            within = b - mean * a[:, 0]
            rss = square - n * mean[:, 0] ** 2 - (coef[:, 1:] * within[:, 1:]).sum(axis=1)
            rss = np.maximum(rss, np.maximum(EXACT * square, 1e-300))
            score = n * np.log(rss / n) + 2 * (p + q + 1)
            better = score < best - TIE
            best[better], chosen[better] = score[better], k
            coefs[better] = 0
            coefs[np.ix_(better, at)] = coef[better]
        return chosen, coefs

    def ahead(batch: pd.DataFrame, chosen: np.ndarray, coefs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(batch), steps))
        of = np.array([d for d, _, _ in orders])[chosen]
        for d in range(max_d + 1):
            mine = of == d
            if not mine.any():
                continue
            last = [np.stack(batch[f"L{k}"].to_numpy()[mine]) for k in range(d + 1)]
            state = last[d][:, ::-1][:, :max_p]
            noise = np.stack(batch[f"E{d}"].to_numpy()[mine])[:, ::-1][:, :max_q] if max_q else np.zeros((mine.sum(), 0))
            ends, c = [v[:, -1].copy() for v in last[:d]], coefs[mine]
            for step in range(steps):
                new = c[:, 0] + (c[:, 1 : max_p + 1] * state).sum(axis=1) + (c[:, max_p + 1 :] * noise).sum(axis=1)
                state = np.column_stack([new, state[:, :-1]])
                noise = np.column_stack([np.zeros(len(new)), noise])[:, :max_q]
                for k in range(d - 1, -1, -1):  # from differences back to levels
                    ends[k] += new
                    new = ends[k]
                out[mine, step] = new
        return out

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = batch.iloc[:, : len(ids)].copy()
            if len(batch):
                chosen, coefs = choose(batch)
                kept["p"], kept["d"], kept["q"] = (np.array([o[i] for o in orders])[chosen] for i in (1, 0, 2))
                kept["made"] = list(ahead(batch, chosen, coefs))
            else:
                kept = kept.assign(p=[], d=[], q=[], made=[])
            yield kept

    schema = T.StructType([
        *[ready.schema[c] for c in ids], *[T.StructField(c, T.IntegerType()) for c in "pdq"],
        T.StructField("made", T.ArrayType(T.DoubleType())),
    ])
    found = ready.mapInPandas(predict, schema)
    kept = [*ids, "p", "d", *(["q"] if max_q else [])]
    return found.select(*kept, F.posexplode("made").alias("step", "y_hat")).withColumn("step", F.col("step") + 1)


# ----------------------------------------------------------------- Spark ML


def _features(df: DataFrame, x_cols: Sequence[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(x_cols), outputCol="_features", handleInvalid="skip")
    return assembler.transform(df)


def _estimator(model: str, target: str, params: dict):
    if model not in ESTIMATORS:
        raise ValueError(f"no such model: {model}")
    return ESTIMATORS[model](
        featuresCol="_features", labelCol=target, predictionCol=f"{target}_hat", **params
    )


def _linear_predict(rows: DataFrame, train: DataFrame, x_cols: Sequence[str], y_cols: Sequence[str]) -> DataFrame:
    """Least squares of all targets from one aggregate; only the coefficients reach the driver."""
    fitted = grouped_ols(train, [], x_cols, y_cols).first()
    usable = F.lit(True)
    for c in x_cols:
        usable = usable & F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))
    hats = {}
    for target, coef in zip(y_cols, fitted["coef"]):
        terms = F.lit(coef[0])
        for c, weight in zip(x_cols, coef[1:]):
            terms = terms + F.lit(weight) * F.col(f"`{c}`")
        hats[f"{target}_hat"] = terms
    return rows.where(usable).withColumns(hats)


def _fit_predict(ready, train, y_cols, model, params) -> DataFrame:
    for target in y_cols:
        ready = _estimator(model, target, params).fit(train).transform(ready)
    return ready.drop("_features")


def forecast_fit_predict(
    df: DataFrame,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    model: str = "linear",
    split: str = "split",
    predict_on: str | None = "test",
    **params,
) -> DataFrame:
    """Fit one regressor per horizon step on the training rows and predict.

    The windows are written once, since every fit reads them again; plain linear
    models of all steps come from a single pass.  Returns the rows of ``predict_on`` (all
    rows when ``None``) with a ``{target}_hat`` each.
    """
    if model == "linear" and not params:
        windows = stage(df)
        rows = windows if predict_on is None else windows.where(F.col(split) == predict_on)
        return _linear_predict(rows, windows.where(F.col(split) == "train"), x_cols, y_cols)
    ready = stage(_features(df, x_cols))
    train = ready.where(F.col(split) == "train")
    target_rows = ready if predict_on is None else ready.where(F.col(split) == predict_on)
    return _fit_predict(target_rows, train, y_cols, model, params)


@dataclass(frozen=True)
class TuneResult:
    """Outcome of a search: one row per run, the best setting, its test predictions."""

    runs: DataFrame
    best: dict
    predictions: DataFrame


def tune_search(
    df: DataFrame,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    candidates: Sequence[dict],
    model: str = "linear",
    split: str = "split",
    loss: str = "mse",
    score: Callable[[DataFrame], float] | None = None,
) -> TuneResult:
    """Fit each candidate on the training rows, score it on the validation rows,
    keep the best and predict the test rows with it.

    ``score`` replaces the loss by a callable over the validation predictions.
    Every candidate is scored; a budget of runs belongs to whoever makes the list.
    The loop runs over settings; each fit is a distributed job, and one number
    per run comes back.
    """
    ready = stage(_features(df, x_cols))
    train = ready.where(F.col(split) == "train")
    valid = ready.where(F.col(split) == "valid")
    name, build = get_metric(loss)

    def mean_loss(predicted: DataFrame) -> float:
        values = predicted.agg(*[build(F.col(f"`{y}`"), F.col(f"`{y}_hat`")) for y in y_cols]).first()
        return sum(values) / len(values)

    runs = []
    for run, params in enumerate(candidates):
        value = (score or mean_loss)(_fit_predict(valid, train, y_cols, model, params))
        runs.append((run, json.dumps(params, sort_keys=True), float(value)))
    if not runs:
        raise ValueError("no candidate settings")
    best_run = min(runs, key=lambda r: (r[2], r[0]))
    best = candidates[best_run[0]]
    table = df.sparkSession.createDataFrame(runs, "run int, params string, loss double")
    table = table.withColumn("is_best", F.col("run") == best_run[0])
    test = ready.where(F.col(split) == "test")
    return TuneResult(table, best, _fit_predict(test, train, y_cols, model, best))


# ------------------------------------------------------- search with a budget


def _candidates(space: Mapping[str, Sequence], seed: int) -> list[dict]:
    """Every combination of the space, in an order drawn by seed."""
    made = [dict(zip(space, choice)) for choice in itertools.product(*space.values())]
    return sorted(made, key=lambda c: hashlib.md5(f"{seed}|{json.dumps(c, sort_keys=True)}".encode()).hexdigest())


def halving_search(
    df: DataFrame,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    space: Mapping[str, Sequence],
    runcount: int,
    rungs: int = 2,
    eta: int = 2,
    dt: str = "dt",
    split: str = "split",
    seed: int = 0,
) -> TuneResult:
    """Successive halving of ridge models over chronological shares of the training rows.

    ``space`` lists choices of ``ridge`` (the penalty of the slopes), ``inputs`` (how many of
    ``x_cols``, from the last on) and ``intercept``.  At most ``runcount`` fits are made: in the
    first rung as many candidates as leave room for the later ones, trained on the latest
    ``eta ** (1 - rungs)`` of the training time; each further rung keeps the best ``1 / eta`` of
    them (one at least) and trains on ``eta`` times that time.  The loss is the mean squared
    error on the validation rows; ties go to the candidate drawn first.

    ``runs`` has a row for every candidate of the space: ``candidate`` (its place in the drawn
    order), ``params``, ``rungs`` passed through, last ``loss``, and ``status``: best, stopped or not run.
    All fits and losses come from one aggregate of products, a matrix for each share and one
    for the validation rows; there is no job for a candidate.
    """
    unknown = set(space) - {"ridge", "inputs", "intercept"}
    if unknown or not all(space.values()):
        raise ValueError(f"not a search space: {dict(space)}")
    drawn = _candidates(space, seed)
    sizes = []
    for first in range(len(drawn), 0, -1):
        sizes = [max(1, first // eta**r) for r in range(rungs)]
        if sum(sizes) <= runcount:
            break
    if sum(sizes) > runcount:
        raise ValueError(f"{rungs} rungs take at least {rungs} runs")
    ready = stage(df)
    time = F.unix_micros(dt)
    ends = ready.where(F.col(split) == "train").agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("no training rows")
    part = F.lit(None).cast("int")
    for r in range(rungs - 1, -1, -1):
        inside = time >= ends["hi"] - (ends["hi"] - ends["lo"]) // eta ** (rungs - 1 - r)
        part = F.when(inside, F.lit(r)).otherwise(part)
    part = F.when(F.col(split) == "train", part).when(F.col(split) == "valid", F.lit(rungs))
    used = [*x_cols, *y_cols]
    sums = grouped_sums(ready.withColumn("_part", part).where("_part IS NOT NULL"), ["_part"], used, used[-1:])
    size = len(used) + 1
    grams = {r["_part"]: r for r in sums.select("_part", "_gram").collect()}  # rungs + 1 matrices
    row, col = np.triu_indices(size)

    def matrix(k: int) -> np.ndarray:
        out = np.zeros((size, size))
        if k in grams:
            out[row, col] = out[col, row] = grams[k]["_gram"]
        return out

    trained = np.cumsum([matrix(r) for r in range(rungs)], axis=0)
    valid, targets = matrix(rungs), range(len(x_cols) + 1, size)

    def fit(params: dict, a: np.ndarray) -> np.ndarray:
        """Coefficients of every target at their full places."""
        n_in = int(params.get("inputs", len(x_cols)))
        at = ([0] if params.get("intercept", True) else []) + list(range(len(x_cols) + 1 - n_in, len(x_cols) + 1))
        penalty = np.diag([0.0 if i == 0 else float(params.get("ridge", 0.0)) for i in at])
        coef = np.zeros((len(targets), len(x_cols) + 1))
        coef[:, at] = a[np.ix_(targets, at)] @ np.linalg.pinv(a[np.ix_(at, at)] + penalty, hermitian=True)
        return coef

    def loss(coef: np.ndarray) -> float:
        inner, n = valid[: len(x_cols) + 1, : len(x_cols) + 1], max(valid[0, 0], 1.0)
        each = [valid[t, t] - 2 * c @ valid[: len(x_cols) + 1, t] + c @ inner @ c for t, c in zip(targets, coef)]
        return float(np.mean(each) / n)

    passed, losses = [0] * len(drawn), [None] * len(drawn)
    alive = list(range(len(drawn)))
    for r in range(rungs):
        alive = alive[: sizes[r]]
        for k in alive:
            losses[k], passed[k] = loss(fit(drawn[k], trained[r])), r + 1
        alive.sort(key=lambda k: (losses[k], k))
    best = alive[0]
    runs = [
        (k, json.dumps(c, sort_keys=True), passed[k], losses[k], "best" if k == best else "stopped" if passed[k] else "not run")
        for k, c in enumerate(drawn)
    ]
    table = df.sparkSession.createDataFrame(runs, "candidate int, params string, rungs int, loss double, status string")
    hats = {}
    for y, coef in zip(y_cols, fit(drawn[best], trained[-1])):
        terms = F.lit(float(coef[0]))
        for c, weight in zip(x_cols, coef[1:]):
            if weight:
                terms = terms + F.lit(float(weight)) * F.col(f"`{c}`")
        hats[f"{y}_hat"] = terms
    return TuneResult(table, drawn[best], ready.where(F.col(split) == "test").withColumns(hats))
