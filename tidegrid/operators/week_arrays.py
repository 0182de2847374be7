"""Windows cut out of weeks: every (series, week) becomes one ordered array of rows.

For jobs that want several column sets of the same windows.  A week of grid rows is
bounded, so it fits an array; a column set is picked once per row of the week, not once per
window and step, and windows are slices of that array.  Weeks open into one row per column
set and these into one row per window, so that windows are made by compiled code: functions
over array elements are interpreted and serve single rows of a week only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.freq import freq_seconds
from tidegrid.functions.scalar import on_grid
from tidegrid.operators.windows import WEEK_KEYS, WindowSpecXY, with_week
from tidegrid.panel import Panel

ROWS = "rows"
# A column set: constants that label its windows, the places of its columns, and the rows
# of the week they are taken from where a week has several.
Variant = tuple[dict[str, object], Sequence[int]] | tuple[dict[str, object], Sequence[int], str]
# Rows of a week: which ones (``None``: all), their input and their target columns.
View = tuple[Column | None, Sequence[str], Sequence[str]]


def week_keys(panel: Panel) -> list[str]:
    return [*panel.ids, *[k for k in WEEK_KEYS if k not in panel.ids]]


def week_arrays(df: DataFrame, panel: Panel, x_cols: Sequence[str], y_cols: Sequence[str] = ()) -> DataFrame:
    """One row per series and calendar week: its keys, and ``rows`` of (dt, x, y) in order of time."""
    return week_views(df, panel, {ROWS: (None, x_cols, y_cols)})


def week_views(df: DataFrame, panel: Panel, views: dict[str, View]) -> DataFrame:
    """:func:`week_arrays` with one array of rows per view, all from one pass over the table."""
    lists = []
    for name, (where, x_cols, y_cols) in views.items():
        doubles = [F.array(*[F.col(f"`{c}`").cast("double") for c in cols]) if cols else F.lit(None) for cols in (x_cols, y_cols)]
        row = F.struct(F.col(panel.dt).alias("dt"), doubles[0].alias("x"), doubles[1].cast("array<double>").alias("y"))
        # Rows that are null are not collected.
        lists.append(F.collect_list(row if where is None else F.when(where, row)).alias(name))
    weeks = with_week(df, panel).groupBy(*week_keys(panel)).agg(*lists)
    # Times are unique within a series, so the order is that of time alone.
    return weeks.withColumns({name: F.sort_array(name) for name in views})


def _picked(rows: Column, width: int, places: Sequence[int]) -> Column:
    if list(places) == list(range(width)):
        return F.transform(rows, lambda r: r["x"])
    return F.transform(rows, lambda r: F.array(*[r["x"][i] for i in places]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, not once for every element inside it."""
    return F.transform(F.array(value), body)[0]


def _source(variant: Variant) -> str:
    return variant[2] if len(variant) > 2 else ROWS


def _opened(
    weeks: DataFrame, keys: Sequence[str], width: int | dict[str, int], variants: Sequence[Variant],
    carried: Callable[[str], dict[str, Column]],
) -> DataFrame:
    """One row per week and column set: keys, labels, ``_x`` with the picked columns of every
    row, ``_dt``, and what is carried along with the rows of a name."""

    def opened(variant: Variant) -> Column:
        labels, places, name = *variant[:2], _source(variant)
        wide = width[name] if isinstance(width, dict) else width
        columns = {**{k: F.lit(v) for k, v in labels.items()}, "_x": _picked(F.col(name), wide, places),
                   "_dt": F.col(f"{name}.dt"), **carried(name)}
        return F.struct(*[c.alias(k) for k, c in columns.items()])

    return weeks.select(*keys, F.inline(F.array(*[opened(v) for v in variants])))


def single_rate_windows(
    weeks: DataFrame,
    panel: Panel,
    width: int | dict[str, int],
    variants: Sequence[Variant],
    n_tx: int = 1,
    n_ty: int = 1,
    h: int = 1,
    min_windows: int = 10,
) -> DataFrame:
    """Complete windows of every week and column set: keys, labels, ``dt``, ``x[n_tx][n_vx]``,
    ``y[n_ty][n_vy]``.  Weeks with fewer than ``min_windows`` are left out."""
    shape = WindowSpecXY(n_tx, n_ty, h)
    keys, labels = week_keys(panel), list(variants[0][0])
    count = F.size("_x") - shape.reach
    ready = _opened(weeks, keys, width, variants, lambda name: {"_y": F.col(f"{name}.y")})
    made = ready.where(count >= max(min_windows, 1)).select("*", F.explode(F.sequence(F.lit(1), count)).alias("_i"))
    return made.select(
        *keys, *labels, F.col("_dt")[F.col("_i") - 1].alias(panel.dt),
        F.slice("_x", F.col("_i"), n_tx).alias("x"), F.slice("_y", F.col("_i") + (n_tx + h - 1), n_ty).alias("y"),
    )


def dual_rate_windows(
    weeks_x: DataFrame,
    weeks_y: DataFrame,
    panel: Panel,
    width: int | dict[str, int],
    variants: Sequence[Variant],
    x_freq: str | int,
    y_freq: str | int,
    n_tx: int = 1,
    n_ty: int = 1,
    h: int = 1,
    tail: str = "drop",
    min_windows: int = 10,
) -> DataFrame:
    """The same with targets of a coarser rate, weeks meeting weeks.

    A window starts where both rates have a row; its targets start ``n_tx // ratio + h - 1``
    target rows later.  ``tail='repeat'`` also keeps windows with a single target row left.
    """
    fine, coarse = freq_seconds(x_freq), freq_seconds(y_freq)
    if coarse % fine:
        raise ValueError("the target rate must be a multiple of the input rate")
    skip = n_tx // (coarse // fine) + h - 1
    if skip < 1:
        raise ValueError("the input must span at least one target bin")
    if tail not in ("drop", "repeat"):
        raise ValueError(f"unknown tail: {tail}")
    keys = week_keys(panel)
    both = weeks_x.join(weeks_y.select(*keys, F.col(ROWS).alias("targets")), keys)

    def left(at: Column) -> Column:
        """Target rows from the first target of a window that starts at target row ``at`` on."""
        return F.size("targets") - at - skip + 1

    def kept(at: Column) -> Column:
        whole = left(at) >= n_ty
        return (at > 0) & (whole if tail == "drop" or n_ty == 1 else whole | (left(at) == 1))

    def placed(rows: Column) -> Column:
        """Row and target row that each window starts at."""
        enough = F.size(rows) >= n_tx
        starts = F.when(enough, F.sequence(F.lit(1), F.size(rows) - n_tx + 1)).otherwise(F.array().cast("array<int>"))
        pairs = _let(F.col("targets.dt"), lambda times: F.transform(
            F.filter(starts, lambda i: on_grid(rows[i - 1]["dt"], coarse)),
            lambda i: F.struct(i.alias("i"), F.array_position(times, rows[i - 1]["dt"]).cast("int").alias("at")),
        ))
        return F.filter(pairs, lambda s: kept(s["at"]))

    sources = list(dict.fromkeys(map(_source, variants)))
    both = both.withColumns({f"_starts_{name}": placed(F.col(name)) for name in sources})

    def target(y: Column, at: Column) -> Column:
        found = F.slice(y, at + skip, n_ty)
        if tail == "drop" or n_ty == 1:
            return found
        return F.concat(found, F.array_repeat(found[0], F.lit(n_ty) - F.size(found)))

    labels = list(variants[0][0])
    ready = _opened(both, keys, width, variants, lambda name: {"_y": F.col("targets.y"), "_s": F.col(f"_starts_{name}")})
    made = ready.where(F.size("_s") >= max(min_windows, 1)).select("*", F.inline("_s"))
    return made.select(
        *keys, *labels, F.col("_dt")[F.col("i") - 1].alias(panel.dt),
        F.slice("_x", F.col("i"), n_tx).alias("x"), target(F.col("_y"), F.col("at")).alias("y"),
    )
