"""Supervised sliding windows: inputs at t-(n_tx-1)..t, targets from t+h on.

A window is labelled with its first row.  Inputs and targets of one rate come
from one ordered pass per group; two rates are windowed separately and joined on
the bin both start at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.freq import freq_seconds
from tidegrid.functions.scalar import on_grid
from tidegrid.operators.chunks import in_order, measured, own_rows, with_halo
from tidegrid.panel import Panel
from tidegrid.session import stage

# Past this many columns the flat form is read off the nested one: same table, and
# one expression per step instead of one per cell in the window.
WIDE = 500


@dataclass(frozen=True)
class WindowSpecXY:
    """Shape of the windows: ``n_tx`` input rows, ``n_ty`` targets ``n_ty_step``
    rows apart, the first of them ``h`` steps ahead."""

    n_tx: int = 1
    n_ty: int = 1
    h: int = 1
    n_ty_step: int = 1

    def __post_init__(self):
        if min(self.n_tx, self.n_ty, self.h, self.n_ty_step) < 1:
            raise ValueError(f"window sizes must be at least 1: {self}")

    @property
    def leads(self) -> list[int]:
        """Steps from the last input row to each target."""
        return [(i + 1) * self.n_ty_step + self.h - 1 for i in range(self.n_ty)]

    @property
    def reach(self) -> int:
        """Rows from the first input to the last target."""
        return self.n_tx - 1 + self.leads[-1]

    def x_names(self, cols: Sequence[str]) -> list[str]:
        return [f"{c}_t-{back}" for back in range(self.n_tx - 1, -1, -1) for c in cols]

    def y_names(self, cols: Sequence[str]) -> list[str]:
        return [f"{c}_t+{lead}" for lead in self.leads for c in cols]


def _lead(c: str, rows: int, w) -> Column:
    return F.lead(c, rows).over(w) if rows else F.col(c)


def _flat_inputs(cols: Sequence[str], n_tx: int, w) -> list[Column]:
    return [
        _lead(c, i, w).alias(f"{c}_t-{n_tx - 1 - i}") for i in range(n_tx) for c in cols
    ]


def xy_windows_flat(
    df: DataFrame,
    panel: Panel,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    n_tx: int = 1,
    n_ty: int = 1,
    h: int = 1,
    n_ty_step: int = 1,
    min_windows: int = 0,
) -> DataFrame:
    """One column per lag and lead, complete windows only.

    All offsets share one window specification: one shuffle and one sort.  Groups
    that yield fewer than ``min_windows`` windows are left out.
    """
    shape = WindowSpecXY(n_tx, n_ty, h, n_ty_step)
    if n_tx * len(x_cols) + n_ty * len(y_cols) > WIDE:
        nested = xy_windows_nested(df, panel, x_cols, y_cols, n_tx, n_ty, h, n_ty_step, min_windows)
        return _flattened(nested, panel, shape, x_cols, y_cols)
    cols = list(dict.fromkeys([*x_cols, *y_cols]))
    panel = measured(df, panel)
    w = in_order(panel)
    rows = with_halo(df.select(*panel.ids, panel.dt, *cols), panel, ahead=shape.reach)
    targets = [
        _lead(c, n_tx - 1 + lead, w).alias(f"{c}_t+{lead}") for lead in shape.leads for c in y_cols
    ]
    helpers = [c for c in rows.columns if c not in (*panel.ids, panel.dt, *cols)]
    wide = rows.select(
        *panel.ids,
        panel.dt,
        *helpers,
        *_flat_inputs(x_cols, n_tx, w),
        *targets,
        F.lead(F.lit(True), shape.reach).over(w).alias("_full"),
        *_group_windows(panel, shape.reach, min_windows),
    )
    return _complete(wide, df, panel, shape.reach, min_windows)


def _flattened(nested: DataFrame, panel: Panel, shape: WindowSpecXY, x_cols, y_cols) -> DataFrame:
    """One column per element of ``x`` and ``y``."""
    xs = [F.col("x")[i][j] for i in range(shape.n_tx) for j in range(len(x_cols))]
    ys = [F.col("y")[i][j] for i in range(shape.n_ty) for j in range(len(y_cols))]
    names = [*shape.x_names(x_cols), *shape.y_names(y_cols)]
    return nested.select(*panel.ids, panel.dt, *[c.alias(n) for c, n in zip([*xs, *ys], names)])


def xy_windows_nested(
    df: DataFrame,
    panel: Panel,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    n_tx: int = 1,
    n_ty: int = 1,
    h: int = 1,
    n_ty_step: int = 1,
    min_windows: int = 0,
) -> DataFrame:
    """The same windows as arrays: ``x[n_tx][n_vx]`` and ``y[n_ty][n_vy]``."""
    shape = WindowSpecXY(n_tx, n_ty, h, n_ty_step)
    cols = list(dict.fromkeys([*x_cols, *y_cols]))
    panel = measured(df, panel)
    w = in_order(panel)
    rows = with_halo(df.select(*panel.ids, panel.dt, *cols), panel, ahead=shape.reach)
    helpers = [c for c in rows.columns if c not in (*panel.ids, panel.dt, *cols)]
    after = F.collect_list(F.array(*y_cols)).over(w.rowsBetween(n_tx + h - 1, shape.reach))
    if n_ty_step > 1:
        after = F.filter(after, lambda _, i: (i + 1) % n_ty_step == 0)
    nested = rows.select(
        *panel.ids,
        panel.dt,
        *helpers,
        F.collect_list(F.array(*x_cols)).over(w.rowsBetween(0, n_tx - 1)).alias("x"),
        after.alias("y"),
        F.lead(F.lit(True), shape.reach).over(w).alias("_full"),
        *_group_windows(panel, shape.reach, min_windows),
    )
    return _complete(nested, df, panel, shape.reach, min_windows)


def _group_windows(panel: Panel, reach: int, min_windows: int) -> list[Column]:
    """Number of complete windows in the row's group, where a window can count them."""
    if not min_windows or panel.chunk_us is not None:
        return []
    return [(F.count(F.lit(1)).over(Window.partitionBy(*panel.ids)) - reach).alias("_windows")]


def _complete(made: DataFrame, df: DataFrame, panel: Panel, reach: int, min_windows: int) -> DataFrame:
    kept = own_rows(made).where(F.col("_full")).drop("_full")
    if not min_windows:
        return kept
    if panel.chunk_us is None:
        return kept.where(F.col("_windows") >= min_windows).drop("_windows")
    return _large_groups(kept, df, panel, min_windows + reach)


def _large_groups(kept: DataFrame, counted: DataFrame, panel: Panel, least: int) -> DataFrame:
    """Rows of the groups that have ``least`` rows in ``counted``.

    For series cut into chunks: sizes are combined on the map side, and no group is
    gathered.
    """
    names = [f"_{c}" for c in panel.ids]
    large = counted.groupBy(*[F.col(c).alias(n) for c, n in zip(panel.ids, names)]).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(panel.ids, names)]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return kept.join(large.where(F.col("_n") >= least).drop("_n"), on, "left_semi")


def xy_windows_strided(df: DataFrame, panel: Panel, *args, n_ty_step: int, **kw) -> DataFrame:
    """Flat windows whose targets are ``n_ty_step`` rows apart."""
    return xy_windows_flat(df, panel, *args, n_ty_step=n_ty_step, **kw)


# -------------------------------------------------------------- two rates


def _dual(
    df_x: DataFrame,
    df_y: DataFrame,
    panel: Panel,
    x_freq: str | int,
    y_freq: str | int,
    n_tx: int,
    n_ty: int,
    h: int,
    x_part: list[Column],
    y_part: list[Column],
    tail: str,
    min_windows: int,
) -> DataFrame:
    fine, coarse = freq_seconds(x_freq), freq_seconds(y_freq)
    if coarse % fine:
        raise ValueError("the target rate must be a multiple of the input rate")
    ratio = coarse // fine
    skip = n_tx // ratio + h - 1
    if skip < 1:
        raise ValueError("the input must span at least one target bin")
    if tail not in ("drop", "repeat"):
        raise ValueError(f"unknown tail: {tail}")
    w = in_order(panel)
    # The stride keeps windows that start on a target bin edge.
    x = with_halo(df_x, panel, ahead=n_tx - 1)
    x = x.withColumns({"_full": F.lead(F.lit(True), n_tx - 1).over(w)} if n_tx > 1 else {"_full": F.lit(True)})
    x = x.select("*", *x_part)
    x = own_rows(x).where(F.col("_full") & on_grid(F.col(panel.dt), coarse))
    need = skip if tail == "repeat" else skip + n_ty - 1
    y = with_halo(df_y, panel, ahead=skip + n_ty - 1)
    y = own_rows(
        y.select("*", F.lead(F.lit(True), need).over(w).alias("_full"), *y_part)
    ).where(F.col("_full"))
    if tail == "repeat" and n_ty > 1:
        y = y.where(F.col("_y_rows").isin(1, n_ty))
    x_names = [c for c in x.columns if c not in df_x.columns and c != "_full"]
    y_names = [c for c in y.columns if c not in df_y.columns and c not in ("_full", "_y_rows")]
    keys = [*panel.ids, panel.dt]
    out = x.select(*keys, *x_names).join(y.select(*keys, *y_names), keys)
    if min_windows and panel.chunk_us is not None:
        out = stage(out)  # read twice: for the counts and for the rows
        out = _large_groups(out, out, panel, min_windows)
    elif min_windows:
        group = Window.partitionBy(*panel.ids)
        out = (
            out.withColumn("_windows", F.count(F.lit(1)).over(group))
            .where(F.col("_windows") >= min_windows)
            .drop("_windows")
        )
    return out


def xy_windows_dual_flat(
    df_x: DataFrame,
    df_y: DataFrame,
    panel: Panel,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    x_freq: str | int,
    y_freq: str | int,
    n_tx: int = 1,
    n_ty: int = 1,
    h: int = 1,
    tail: str = "drop",
    min_windows: int = 0,
) -> DataFrame:
    """Inputs at a fine rate, targets at a coarse one, one column per step.

    Window j starts at target bin j; its targets start ``n_tx // ratio + h - 1``
    bins later.  Complete windows only; ``tail='repeat'`` also keeps the last
    window when a single target row is left and repeats that row.
    """
    panel = measured(df_x, panel)
    w = in_order(panel)
    skip = n_tx // max(freq_seconds(y_freq) // freq_seconds(x_freq), 1) + h - 1
    targets = []
    for i in range(n_ty):
        for c in y_cols:
            value = F.lead(c, skip + i).over(w)
            if tail == "repeat" and i:
                there = F.lead(F.lit(True), skip + i).over(w)
                value = F.when(there, value).otherwise(F.lead(c, skip).over(w))
            targets.append(value.alias(f"{c}_t+{h + i}"))
    return _dual(
        df_x.select(*panel.ids, panel.dt, *x_cols),
        df_y.select(*panel.ids, panel.dt, *y_cols),
        panel, x_freq, y_freq, n_tx, n_ty, h,
        _flat_inputs(x_cols, n_tx, w),
        targets + _tail_rows(w, skip, n_ty, tail),
        tail, min_windows,
    )


def xy_windows_dual_nested(
    df_x: DataFrame,
    df_y: DataFrame,
    panel: Panel,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    x_freq: str | int,
    y_freq: str | int,
    n_tx: int = 1,
    n_ty: int = 1,
    h: int = 1,
    tail: str = "drop",
    min_windows: int = 0,
) -> DataFrame:
    """:func:`xy_windows_dual_flat` as arrays ``x[n_tx][n_vx]``, ``y[n_ty][n_vy]``."""
    panel = measured(df_x, panel)
    w = in_order(panel)
    skip = n_tx // max(freq_seconds(y_freq) // freq_seconds(x_freq), 1) + h - 1
    targets = F.collect_list(F.array(*y_cols)).over(w.rowsBetween(skip, skip + n_ty - 1))
    if tail == "repeat":
        targets = F.concat(
            targets, F.array_repeat(F.element_at(targets, 1), F.lit(n_ty) - F.size(targets))
        )
    return _dual(
        df_x.select(*panel.ids, panel.dt, *x_cols),
        df_y.select(*panel.ids, panel.dt, *y_cols),
        panel, x_freq, y_freq, n_tx, n_ty, h,
        [F.collect_list(F.array(*x_cols)).over(w.rowsBetween(0, n_tx - 1)).alias("x")],
        [targets.alias("y")] + _tail_rows(w, skip, n_ty, tail),
        tail, min_windows,
    )


def _tail_rows(w, skip: int, n_ty: int, tail: str) -> list[Column]:
    """Target rows a window really has, needed to tell a repeatable tail."""
    if tail != "repeat":
        return []
    return [F.count(F.lit(1)).over(w.rowsBetween(skip, skip + n_ty - 1)).alias("_y_rows")]


# ----------------------------------------------------------- weekly restart

WEEK_KEYS = ("year", "month", "week")


def with_week(df: DataFrame, panel: Panel) -> DataFrame:
    """Calendar year, month and ISO week; a week across a month end is two groups."""
    keys = {"year": F.year(panel.dt), "month": F.month(panel.dt), "week": F.weekofyear(panel.dt)}
    # Keys the panel already has stay as they are, and so does its partitioning.
    return df.withColumns({k: v for k, v in keys.items() if k not in panel.ids})


def xy_windows_weekly(
    df: DataFrame, panel: Panel, *args, nested: bool = False, min_windows: int = 10, **kw
) -> DataFrame:
    """Windows restarted in every (year, month, ISO week); short weeks are skipped.

    A week holds a bounded number of grid rows, so groups stay small however long
    the series is.
    """
    build = xy_windows_nested if nested else xy_windows_flat
    weekly = panel.bounded().within(*[k for k in WEEK_KEYS if k not in panel.ids])
    return build(with_week(df, panel), weekly, *args, min_windows=min_windows, **kw)


def xy_windows_dual_weekly(
    df_x: DataFrame,
    df_y: DataFrame,
    panel: Panel,
    *args,
    nested: bool = False,
    min_windows: int = 10,
    **kw,
) -> DataFrame:
    """Two-rate windows restarted in every (year, month, ISO week)."""
    build = xy_windows_dual_nested if nested else xy_windows_dual_flat
    weekly = panel.bounded().within(*[k for k in WEEK_KEYS if k not in panel.ids])
    return build(
        with_week(df_x, panel), with_week(df_y, panel), weekly, *args,
        min_windows=min_windows, **kw,
    )
