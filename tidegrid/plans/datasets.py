"""From detector tables to training windows: the two preparation jobs.

Both restrict ids, trim months to whole weeks and interpolate each (series, month) once on
the base grid.  Every grid row is then sent to the series it serves, as own, previous or
next one, and the assembled grid is written bucketed by series: the one exchange of the
grid.  Rates, neighbourhoods, scaling and windows all read that layout as it lies.

A study asks for every combination of value columns and feature sets.  Adding
columns never changes the rows of a window, so one pass per rate cuts the windows of
all its combinations out of the same weeks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.freq import freq_seconds
from tidegrid.operators.clean import filter_months, filter_weekdays, trim_partial_weeks
from tidegrid.operators.joins import filter_by_common_id, neighbor_ids, union_all
from tidegrid.operators.quality import group_filter_min
from tidegrid.operators.ranks import group_head
from tidegrid.operators.regularize import interpolate_linear, resample_mean, time_features
from tidegrid.operators.scale import scale_per_series
from tidegrid.operators.week_arrays import (
    Variant, View, dual_rate_windows, single_rate_windows, week_arrays, week_views,
)
from tidegrid.panel import Panel
from tidegrid.session import buckets, stage, stage_bucketed

ROAD_KEYS = ("road", "direction")
TIME_COLS = ("dow", "hod")


@dataclass(frozen=True)
class DatasetConf:
    """Settings of a preparation job.

    ``n_aggs`` are input rates in minutes.  ``n_tx_duration`` (base steps) keeps
    the duration of the input constant over rates instead of its length.
    """

    n_tx: int = 24
    n_ty: int = 2
    h: int = 1
    base_freq: str = "5min"
    y_freq: str = "30min"
    n_aggs: Sequence[int] = (5, 10, 15)
    column_sets: Sequence[Sequence[str]] = (("speed",), ("speed", "volume", "occupancy"))
    y_col: str = "speed"
    features: Sequence[str] = ("f", "tf", "sf", "stf")
    months: Sequence[int] = ()
    weekdays: Sequence[int] = (0, 1, 2, 3, 4)
    trim_weeks: bool = True
    n_adj: int = 0
    n_tx_duration: int | None = None
    min_windows: int = 10
    scaler: str = "minmax"
    snap: str = "exact"
    tail: str = "drop"

    @property
    def value_cols(self) -> list[str]:
        return list(dict.fromkeys([c for cols in self.column_sets for c in cols] + [self.y_col]))

    def input_length(self, n_agg: int) -> int:
        if self.n_tx_duration is None:
            return self.n_tx
        return self.n_tx_duration // (n_agg * 60 // freq_seconds(self.base_freq))


SIDES = (0, 1, 2)


@dataclass(frozen=True)
class Prepared:
    """Shared part of both jobs: the interpolated rows of every interior id beside those of
    its neighbours, bucketed by id, keyed by (id, road, direction, year, month).

    ``{side}_{column}`` are values of the previous, own and next series, ``has_{side}``
    is positive where that series has a row."""

    grid: DataFrame
    panel: Panel


def prepare(meta: DataFrame, readings: DataFrame, conf: DatasetConf) -> Prepared:
    tables = filter_by_common_id({"meta": meta, "zone": readings})
    meta = group_filter_min(tables["meta"], ROAD_KEYS, conf.n_adj)
    if conf.n_adj:
        meta = group_head(meta, ROAD_KEYS, ["ord", "id"], conf.n_adj + 2)
    neighbors = neighbor_ids(meta, ROAD_KEYS)
    series = Panel(("id",), "dt")
    rows = tables["zone"].select("id", "dt", *conf.value_cols)
    # The road travels with the readings, so nothing is joined to finished windows.
    rows = filter_months(rows.join(meta.select("id", *ROAD_KEYS), "id"), conf.months)
    if conf.trim_weeks:
        rows = trim_partial_weeks(rows, series)
    # A month of grid rows fits one task.
    monthly = series.bounded().within(*ROAD_KEYS, "year", "month")
    rows = rows.withColumns({"year": F.year("dt"), "month": F.month("dt")})
    grid = interpolate_linear(rows, monthly, conf.value_cols, conf.base_freq, conf.snap)
    return Prepared(_assembled(grid, neighbors, conf, monthly), monthly)


def _assembled(grid: DataFrame, neighbors: DataFrame, conf: DatasetConf, panel: Panel) -> DataFrame:
    neighbors = stage(neighbors)
    roles = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(source).alias("source"))
        for side, source in zip(SIDES, ("id_prev", "id", "id_next"))
    ])
    served = neighbors.select(F.col("id").alias("_for"), F.explode(roles).alias("_r")).select(
        F.col("_r.source").alias("id"), F.col("_r.side").alias("_side"), "_for"
    )
    # The road follows from the id, so it need not travel with every row.
    keys = ["id", "year", "month", panel.dt]
    sent = grid.drop(*ROAD_KEYS).join(served, "id").withColumn("id", F.col("_for"))
    sent = sent.repartition(buckets(grid.sparkSession), "id")
    values = [F.max(F.when(F.col("_side") == side, F.col(c))).alias(f"{side}_{c}") for side in SIDES for c in conf.value_cols]
    there = [F.max((F.col("_side") == side).cast("double")).alias(f"has_{side}") for side in SIDES]
    made = sent.groupBy(*keys).agg(*values, *there).join(neighbors.select("id", *ROAD_KEYS), "id")
    return stage_bucketed(made, ["id"], [panel.dt], dealt=True)


def _at_rate(prepared: Prepared, sides: Sequence[int], cols: Sequence[str], freq: str, conf: DatasetConf) -> DataFrame:
    """Rows of a rate where the own series has one; ``_all`` where all the sides have one."""
    grid = prepared.grid
    wanted = [f"{side}_{c}" for side in sides for c in cols]
    if freq_seconds(freq) != freq_seconds(conf.base_freq):
        grid = resample_mean(grid, prepared.panel, [*wanted, *[f"has_{s}" for s in sides]], freq)
    there = F.lit(True)
    for side in sides:
        there = there & (F.col(f"has_{side}") > 0)
    grid = grid.where(F.col("has_1") > 0).select(*prepared.panel.ids, "dt", *wanted, there.alias("_all"))
    return filter_weekdays(grid, conf.weekdays)


# Neighbourhoods: the series alone, and with the series beside it.
OWN, SPATIAL = "own", "spatial"


def _neighbourhoods(conf: DatasetConf) -> dict[str, Sequence[int]]:
    """Sides of the neighbourhoods that any feature set needs."""
    found = {OWN: (1,), SPATIAL: SIDES}
    return {n: sides for n, sides in found.items() if any(("s" in f) == (n == SPATIAL) for f in conf.features)}


def _wide(conf: DatasetConf, sides: Sequence[int]) -> list[str]:
    """Every column that any combination of a neighbourhood needs."""
    return [f"{side}_{c}" for side in sides for c in conf.value_cols] + list(TIME_COLS)


def _variants(conf: DatasetConf, name: str, n_agg: int) -> list[Variant]:
    """The column sets of a neighbourhood."""
    sides = SIDES if name == SPATIAL else (1,)
    wide, out = _wide(conf, sides), []
    for features in conf.features:
        if ("s" in features) != (name == SPATIAL):
            continue
        for cols in conf.column_sets:
            names = [f"{side}_{c}" for side in sides for c in cols]
            names += list(TIME_COLS) if "t" in features else []
            labels = {"n_agg": n_agg, "features": features, "n_vx": len(cols)}
            out.append((labels, [wide.index(n) for n in names], name))
    return out


def _build(prepared: Prepared, conf: DatasetConf, windows) -> DataFrame:
    """Windows of all combinations, one pass per rate: the rows of every neighbourhood lie
    side by side, null where a row is not part of it, so each is scaled by its own rows."""
    hoods = _neighbourhoods(conf)
    sides = SIDES if SPATIAL in hoods else (1,)
    parts = []
    for n_agg in conf.n_aggs if hoods and conf.column_sets else ():
        rows = time_features(_at_rate(prepared, sides, conf.value_cols, f"{n_agg}min", conf))
        part = {OWN: F.lit(True), SPATIAL: F.col("_all")}
        cells = {f"{n}_{c}": F.when(part[n], F.col(c)) for n in hoods for c in _wide(conf, hoods[n])}
        rows = rows.select(*prepared.panel.ids, "dt", "_all", *[c.alias(n) for n, c in cells.items()])
        # Both reads of the rows start at the bucketed grid.
        rows = scale_per_series(rows, ["id"], list(cells), conf.scaler)
        views = {
            n: (None if n == OWN else part[n], [f"{n}_{c}" for c in _wide(conf, hoods[n])], [f"{n}_1_{conf.y_col}"])
            for n in hoods
        }
        variants = [v for n in hoods for v in _variants(conf, n, n_agg)]
        parts.append(windows(rows, views, variants, n_agg))
    keys = [*prepared.panel.ids, "week", "dt"]
    out = union_all(*parts)
    return out.select(*keys, "n_agg", "y", "features", "n_vx", "x")


def build_dataset_single_rate(
    meta: DataFrame, readings: DataFrame, conf: DatasetConf = DatasetConf()
) -> DataFrame:
    """Inputs and targets at the same rate, both scaled.

    ``meta`` has (id, road, direction, ord), ``readings`` (id, dt, values…).
    """
    prepared = prepare(meta, readings, conf)

    def windows(rows: DataFrame, views: dict[str, View], variants: list[Variant], n_agg: int) -> DataFrame:
        return single_rate_windows(
            week_views(rows, prepared.panel, views), prepared.panel, {n: len(x) for n, (_, x, _) in views.items()},
            variants, conf.input_length(n_agg), conf.n_ty, conf.h, conf.min_windows,
        )

    return _build(prepared, conf, windows)


def build_dataset_dual_rate(
    meta: DataFrame, readings: DataFrame, conf: DatasetConf = DatasetConf()
) -> DataFrame:
    """Inputs at each rate of ``n_aggs``, scaled; targets at ``y_freq``, as measured."""
    prepared = prepare(meta, readings, conf)

    def windows(rows: DataFrame, views: dict[str, View], variants: list[Variant], n_agg: int) -> DataFrame:
        y = _at_rate(prepared, (1,), [conf.y_col], conf.y_freq, conf)
        views = {n: (where, x, ()) for n, (where, x, _) in views.items()}
        return dual_rate_windows(
            week_views(rows, prepared.panel, views), week_arrays(y, prepared.panel, [], [f"1_{conf.y_col}"]),
            prepared.panel, {n: len(x) for n, (_, x, _) in views.items()}, variants, f"{n_agg}min", conf.y_freq,
            conf.input_length(n_agg), conf.n_ty, conf.h, conf.tail, conf.min_windows,
        )

    return _build(prepared, conf, windows)
