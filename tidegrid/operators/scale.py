"""Per-series scaling.  Fitting is one aggregate, transforming one projection.

Parameters are a table with one row per series; it joins without a hint, so it is
broadcast only when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import missing_to_null, zero_to_one
from tidegrid.session import stage


def _valid(df: DataFrame, c: str) -> Column:
    return missing_to_null(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)


# What a scaler measures of a column, and how that gives its two parameters.
MEASURES = {
    "standard": {"mean": F.avg, "sd": F.stddev_pop},
    "minmax": {"least": F.min, "most": F.max},
}


def _standard_params(c: str) -> dict[str, Column]:
    return {f"{c}_mean": F.col(f"{c}_mean"), f"{c}_sd": zero_to_one(F.col(f"{c}_sd"))}


def _minmax_params(c: str, x_range: tuple[float, float] = (0.0, 1.0)) -> dict[str, Column]:
    low, high = map(float, x_range)
    least, most = F.col(f"{c}_least"), F.col(f"{c}_most")
    scale = F.lit(high - low) / zero_to_one((most - least).cast("double"))
    return {f"{c}_scale": scale, f"{c}_add": F.lit(low) - least * scale}


def _measures(df: DataFrame, cols: Sequence[str], kind: str) -> dict[str, Column]:
    return {f"{c}_{m}": f(_valid(df, c)) for c in cols for m, f in MEASURES[kind].items()}


def _fit(df: DataFrame, ids: Sequence[str], cols: Sequence[str], kind: str, params) -> DataFrame:
    measured = df.groupBy(*ids).agg(*[m.alias(n) for n, m in _measures(df, cols, kind).items()])
    made = {name: column for c in cols for name, column in params(c).items()}
    return measured.select(*ids, *[column.alias(name) for name, column in made.items()])


def standard_scaler_fit(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, missing values ignored; a
    deviation of zero becomes one."""
    return _fit(df, ids, cols, "standard", _standard_params)


def minmax_scaler_fit(
    df: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str],
    x_range: tuple[float, float] = (0.0, 1.0),
) -> DataFrame:
    """``scale`` and ``add`` per column so that ``x * scale + add`` spans ``x_range``."""
    return _fit(df, ids, cols, "minmax", lambda c: _minmax_params(c, x_range))


def _apply(df: DataFrame, params: DataFrame, ids, cols, suffixes, formula) -> DataFrame:
    needed = [f"{c}_{s}" for c in cols for s in suffixes]
    lacking = [c for c in needed if c not in params.columns]
    if lacking:
        raise ValueError(f"scaler not fitted for: {lacking}")
    joined = df.join(params.select(*ids, *needed), list(ids))
    changed = {c: formula(F.col(c), *[F.col(f"{c}_{s}") for s in suffixes]) for c in cols}
    return joined.withColumns(changed).select(*df.columns)


def standard_scaler_transform(df, params, ids, cols) -> DataFrame:
    return _apply(df, params, ids, cols, ("mean", "sd"), lambda x, mean, sd: (x - mean) / sd)


def standard_scaler_inverse(df, params, ids, cols) -> DataFrame:
    return _apply(df, params, ids, cols, ("mean", "sd"), lambda x, mean, sd: x * sd + mean)


def minmax_scaler_transform(df, params, ids, cols) -> DataFrame:
    return _apply(df, params, ids, cols, ("scale", "add"), lambda x, scale, add: x * scale + add)


def minmax_scaler_inverse(df, params, ids, cols) -> DataFrame:
    return _apply(df, params, ids, cols, ("scale", "add"), lambda x, scale, add: (x - add) / scale)


# Kinds a caller can name: how to fit, and how to apply.
SCALERS = {
    "minmax": (minmax_scaler_fit, minmax_scaler_transform),
    "standard": (standard_scaler_fit, standard_scaler_transform),
}


def scale_per_series(
    df: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str],
    kind: str = "minmax",
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Fit and transform per series.  All rows are fitted unless ``fit_on`` names
    others, for example the training rows.

    Reads its input twice and gathers no series, whatever its length.
    """
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler: {kind}")
    fit, transform = SCALERS[kind]
    return transform(df, fit(df if fit_on is None else fit_on, ids, cols), ids, cols)


def scale_grid(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], kind: str = "minmax"
) -> DataFrame:
    """:func:`scale_per_series` with the table written once before it is read twice."""
    return scale_per_series(stage(df), ids, cols, kind)
