"""From irregular readings to a regular grid, and simple time features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.calendars import MONTHS, WEEKDAYS, Calendar, calendar_of
from tidegrid.functions.freq import freq_seconds
from tidegrid.functions.scalar import floor_time, on_grid
from tidegrid.operators.chunks import (
    POS,
    SIZE,
    group_keys,
    in_order,
    measured,
    own_rows,
    with_chunk,
    with_halo,
    with_position,
)
from tidegrid.panel import MEASURE, Panel
from tidegrid.session import spread

# Grid times that one array holds while gaps are opened.
BLOCK_SLOTS = 10_000


# ---------------------------------------------------------------- inspection


def validate_series(df: DataFrame, panel: Panel, min_rows: int = 3) -> DataFrame:
    """Series that are too short to work with, with their row counts."""
    return df.groupBy(*panel.ids).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") < min_rows)


def require_valid(df: DataFrame | None, panel: Panel, min_rows: int = 3) -> DataFrame:
    """The frame itself, or an error when it is missing or holds a short series."""
    if df is None:
        raise ValueError("no data frame given")
    short = validate_series(df, panel, min_rows).first()
    if short is not None or df.isEmpty():
        raise ValueError(f"every series needs at least {min_rows} rows: {short}")
    return df


def dt_is_unique(df: DataFrame, panel: Panel) -> DataFrame:
    """Whether the timestamps of each series are unique.

    Two-step counting: (series, dt) first, so a long series spreads over many
    tasks instead of building one distinct set.
    """
    per_time = df.groupBy(*panel.ids, panel.dt).agg(F.count("*").alias("_n"))
    return per_time.groupBy(*panel.ids).agg((F.max("_n") == 1).alias("is_unique"))


def _gaps(df: DataFrame, panel: Panel) -> DataFrame:
    timed = df.select(*panel.ids, panel.dt)
    panel = measured(timed, panel)
    haloed = with_halo(timed, panel, behind=1)
    gap = F.unix_micros(panel.dt) - F.unix_micros(F.lag(panel.dt).over(in_order(panel)))
    rows = own_rows(haloed.withColumn("gap_us", gap))
    return rows.where(F.col("gap_us").isNotNull())


def gap_counts(df: DataFrame, panel: Panel) -> DataFrame:
    """How often each difference between consecutive timestamps occurs (microseconds)."""
    return _gaps(df, panel).groupBy(*panel.ids, "gap_us").agg(F.count("*").alias("n"))


def infer_freq(df: DataFrame, panel: Panel) -> DataFrame:
    """The one gap of a perfectly regular series, else NULL."""
    low, high = F.min("gap_us"), F.max("gap_us")
    return _gaps(df, panel).groupBy(*panel.ids).agg(F.when(low == high, low).alias("freq_us"))


# Names of fixed steps, the longest first, in microseconds.
STEPS = (("D", 86_400_000_000), ("h", 3_600_000_000), ("min", 60_000_000), ("s", 1_000_000), ("ms", 1000), ("us", 1))


def infer_calendar_freq(df: DataFrame, panel: Panel, min_gaps: int = 2) -> DataFrame:
    """The frequency of each series by name, calendars included; NULL if it has none.

    Fixed steps are ``5min``, ``h``, ``2D``; whole weeks have their weekday (``W-MON``).  Steps
    of whole months at one time of day are ``MS`` or ``ME`` (all on the first or the last day
    of a month), three months ``QS``/``QE`` with the first month of the year that is an
    anchor (``QS-JAN``, ``QE-MAR``), years ``YS``/``YE`` with their month; other numbers of
    months are ``2MS``.  Weekdays without a gap but the weekend are ``B``.  Series with fewer than
    ``min_gaps`` gaps have no name.

    One ordered pass for the gaps; the pattern comes from least and largest residues, which
    combine on the map side.
    """
    now = F.col(panel.dt)
    before = F.timestamp_micros(F.unix_micros(now) - F.col("gap_us"))
    day_us, week_us = STEPS[0][1], 7 * STEPS[0][1]
    clock = lambda t: F.pmod(F.unix_micros(t), F.lit(day_us))
    month = lambda t: F.year(t) * 12 + F.month(t)
    last = lambda t: F.to_date(t) == F.last_day(t)
    weekend = lambda t: F.weekday(t) > 4
    next_weekday = F.when(F.weekday(before) == 4, F.lit(3 * day_us)).otherwise(F.lit(day_us))
    facts = _gaps(df, panel).groupBy(*panel.ids).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("gap_us").alias("least"), F.max("gap_us").alias("most"),
        (F.max(clock(now) != clock(before)) == F.lit(False)).alias("clocked"),
        F.min(month(now) - month(before)).alias("months"), F.max(month(now) - month(before)).alias("most_months"),
        F.min((F.day(now) == 1) & (F.day(before) == 1)).alias("starts"),
        F.min(last(now) & last(before)).alias("ends"),
        F.min(~weekend(now) & ~weekend(before) & (F.col("gap_us") == next_weekday)).alias("business"),
        F.max(F.month(now)).alias("month"), F.min(F.month(now)).alias("any_month"), F.max(F.weekday(now)).alias("weekday"),
    )
    steps, gap = F.col("months"), F.col("least")

    def times(k: Column, unit: Column) -> Column:
        return F.concat(F.when(k > 1, k.cast("string")).otherwise(F.lit("")), unit)

    def anchored(kind: str) -> Column:
        names = F.array(*[F.lit(m) for m in MONTHS])
        # Quarters go by the anchor that is first (of starts) or comes first (of ends) in a year.
        quarter = F.element_at(names, F.pmod(F.col("any_month") - 1, F.lit(3)) + 1)
        year = F.element_at(names, F.col("month"))
        return (
            F.when(steps % 12 == 0, times((steps / 12).cast("int"), F.concat(F.lit(f"Y{kind}-"), year)))
            .when(steps % 3 == 0, times((steps / 3).cast("int"), F.concat(F.lit(f"Q{kind}-"), quarter)))
            .otherwise(times(steps, F.lit(f"M{kind}")))
        )

    weekly = F.concat(F.lit("W-"), F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday") + 1))
    fixed = F.when(gap % week_us == 0, times((gap / week_us).cast("long"), weekly))
    for name, us in STEPS:
        fixed = fixed.when(gap % us == 0, times((gap / us).cast("long"), F.lit(name)))
    by_month = F.col("clocked") & (steps >= 1) & (steps == F.col("most_months"))
    found = (
        F.when(by_month & F.col("starts"), anchored("S")).when(by_month & F.col("ends"), anchored("E"))
        .when((gap == F.col("most")) & (gap > 0), fixed).when(F.col("business"), F.lit("B"))
    )
    return facts.select(*panel.ids, F.when(F.col("n") >= min_gaps, found).alias("freq"))


def min_gap_freq(df: DataFrame, panel: Panel) -> DataFrame:
    """The smallest gap of each series."""
    return _gaps(df, panel).groupBy(*panel.ids).agg(F.min("gap_us").alias("freq_us"))


# ------------------------------------------------------------------ gridding


def average_duplicates(df: DataFrame, panel: Panel, cols: Sequence[str]) -> DataFrame:
    """One row per (series, dt)."""
    return df.groupBy(*panel.ids, panel.dt).agg(*[F.avg(c).alias(c) for c in cols])


def fit_grid(df: DataFrame, panel: Panel, freq: str | int, max_rows: int = 4_000_000) -> Panel:
    """Settle the chunking of series that will lie on a regular grid.

    A grid has at most span / freq rows per series whatever the readings' volume,
    so the panel is only cut when one series' span exceeds ``max_rows`` slots.
    """
    width = freq_seconds(freq) * 1_000_000
    span = (
        df.groupBy(*panel.ids)
        .agg((F.max(F.unix_micros(panel.dt)) - F.min(F.unix_micros(panel.dt))).alias("s"))
        .agg(F.max("s"))
        .first()[0]
    )
    if (span or 0) // width <= max_rows:
        return panel.chunked(None)
    return panel.chunked(width * max_rows)


def _interval(us: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / 1_000_000).cast("decimal(18,6)"))


def _steps(start: Column, stop: Column, step_us: Column) -> Column:
    """Grid times from start to stop inclusive; none if stop is before start."""
    return F.when(stop >= start, F.sequence(start, stop, _interval(step_us))).otherwise(
        F.array().cast("array<timestamp>")
    )


def _stop(panel: Panel, step_us: Column, last: Column) -> Column:
    """Last grid time a row stands for: just before the next row, or ``last``."""
    following = F.lead(panel.dt).over(in_order(panel))
    return F.greatest(F.coalesce(following - _interval(step_us), last), F.col(panel.dt))


def _open_gaps(df: DataFrame, panel: Panel, step_us: Column) -> DataFrame:
    """Each row becomes itself plus the grid times up to its ``_stop``, in ``_t``.

    No grid table is built or joined; the expansion is a projection.  It opens blocks of
    times first and each block then, so that no row ever holds a long gap as one array.
    """
    step_us = step_us.cast("long")
    block_us = step_us * BLOCK_SLOTS
    blocks = df.withColumn("_block", F.explode(_steps(F.col(panel.dt), F.col("_stop"), block_us)))
    end = F.least(F.col("_stop"), F.col("_block") + _interval(block_us - step_us))
    return blocks.withColumn("_t", F.explode(_steps(F.col("_block"), end, step_us))).drop("_stop", "_block")


def long_gaps(df: DataFrame, panel: Panel, freq: str | int, slots: int) -> DataFrame:
    """Rows after a gap of more than ``slots`` grid times: where a wrong timestamp would show."""
    width = freq_seconds(freq) * 1_000_000
    return _gaps(df, panel).where(F.col("gap_us") > F.lit(slots * width))


def gap_fill(
    df: DataFrame, panel: Panel, freq: str | int, fill_value=None
) -> DataFrame:
    """Rows at every grid time from each series' first to its last timestamp.

    The grid is anchored at the first timestamp; rows off the grid are dropped and
    inserted rows carry ``fill_value``.  Rows that share a timestamp all stay; only the
    last of them opens the gap that follows (see :func:`average_duplicates`).

    ``freq`` may be a calendar (``MS``, ``QS-FEB``, ``ME``, ``W-MON``, ``B``, ``2MS``): the grid then has the
    naming days from the first to the last timestamp, at the first one's time of day.
    """
    calendar = calendar_of(freq)
    if calendar is not None:
        return _fill_calendar(df, panel, calendar, fill_value)
    step = F.lit(freq_seconds(freq) * 1_000_000)
    panel = measured(df, panel)
    return _fill(_with_bounds(df, panel), panel, df.columns, step, fill_value)


def _fill_calendar(df: DataFrame, panel: Panel, calendar: Calendar, fill_value) -> DataFrame:
    """Every row becomes the naming days from its own time up to the next row's.

    The grid is opened from the ordered rows by a projection, as in :func:`_open_gaps`, so
    only rows are shuffled and never the grid.  Rows off the grid open gaps too, and add
    nothing else.  A grid has at most a time a day, so a gap fits an array.
    """
    now, times = F.col(panel.dt), F.lit(calendar.times)
    at = lambda period: F.timestamp_micros(F.unix_micros(calendar.date(period).cast("timestamp")) + F.col("_clock"))

    def upward(t: Column) -> Column:
        """First period whose grid time is not before ``t``."""
        period = calendar.period(t)
        return F.when(at(period) < t, period + 1).otherwise(period)

    timed = df.where(now.isNotNull())
    panel = measured(timed, panel)
    bounded = _with_first(timed, panel).withColumn("_clock", F.pmod(F.unix_micros("_first"), F.lit(STEPS[0][1])))
    rows = bounded.withColumn("_from", upward(now))
    if calendar.times > 1:
        since = F.col("_from") - upward(F.col("_first"))
        rows = rows.withColumn("_from", F.col("_from") + F.pmod(-since, times))
    rows = rows.drop("_first").withColumn("_here", at(F.col("_from")) == now)
    if panel.chunk_us is not None:
        rows = with_halo(rows, panel, ahead=1)
    rows = own_rows(rows.withColumn("_to", F.lead("_from").over(in_order(panel)) - times))
    # A row on the grid stands at least for itself; the last row for nothing else.
    end = F.when(F.col("_here"), F.greatest("_to", "_from")).otherwise(F.col("_to"))
    periods = F.when(end >= F.col("_from"), F.sequence(F.col("_from"), end, times.cast("bigint")))
    opened = rows.withColumn("_p", F.explode(periods))
    present = F.col("_here") & (F.col("_p") == F.col("_from"))
    fill = F.lit(fill_value)

    def value(c: str) -> Column:
        return F.when(present, F.col(c)).otherwise(fill.cast(df.schema[c].dataType)).alias(c)

    values = [value(c) for c in df.columns if c not in (*panel.ids, panel.dt)]
    return opened.select(*panel.ids, at(F.col("_p")).alias(panel.dt), *values)


def _with_first(df: DataFrame, panel: Panel) -> DataFrame:
    """Add each series' first timestamp (``_first``), as :func:`_with_bounds` does; null ids are a series too."""
    if panel.chunk_us is None:
        return df.withColumn("_first", F.min(panel.dt).over(Window.partitionBy(*panel.ids)))
    names = [f"_of_{c}" for c in panel.ids]
    first = df.groupBy(*[F.col(c).alias(n) for c, n in zip(panel.ids, names)]).agg(F.min(panel.dt).alias("_first"))
    same = F.lit(True)
    for c, n in zip(panel.ids, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return df.join(first, same).drop(*names)


def gap_fill_inferred(df: DataFrame, panel: Panel, fill_value=None) -> DataFrame:
    """:func:`gap_fill` at each series' own smallest gap."""
    panel = measured(df, panel)
    if panel.chunk_us is None:
        bounded = _with_bounds(df, panel)
        gap = F.unix_micros(panel.dt) - F.unix_micros(F.lag(panel.dt).over(in_order(panel)))
        least = F.min(F.when(F.col("_gap") > 0, F.col("_gap"))).over(Window.partitionBy(*panel.ids))
        bounded = bounded.withColumn("_gap", gap).withColumn("_step", least).drop("_gap")
    else:
        positive = _gaps(df, panel).where(F.col("gap_us") > 0)
        freq = positive.groupBy(*panel.ids).agg(F.min("gap_us").alias("_step"))
        bounded = _with_bounds(df, panel).join(freq, list(panel.ids), "left")
    # A series of one row has no gap and nothing to fill.
    step = F.coalesce(F.col("_step"), F.lit(1_000_000))
    return _fill(bounded, panel, df.columns, step, fill_value)


def _with_bounds(df: DataFrame, panel: Panel) -> DataFrame:
    """Add each series' first and last timestamp (``_first``, ``_last``).

    From a window while a series fits one task, which costs no shuffle beyond the
    one that orders it; else from an aggregate that is joined back.
    """
    if panel.chunk_us is None:
        series = Window.partitionBy(*panel.ids)
        return spread(df, *panel.ids).withColumns(
            {"_first": F.min(panel.dt).over(series), "_last": F.max(panel.dt).over(series)}
        )
    bounds = df.groupBy(*panel.ids).agg(
        F.min(panel.dt).alias("_first"), F.max(panel.dt).alias("_last")
    )
    return df.join(bounds, list(panel.ids))


def _fill(
    bounded: DataFrame, panel: Panel, columns: Sequence[str], step: Column, fill_value
) -> DataFrame:
    since = F.unix_micros(panel.dt) - F.unix_micros("_first")
    rows = bounded.withColumn("_step", step).where(F.pmod(since, F.col("_step")) == 0)
    rows = rows.drop("_first")
    if panel.chunk_us is not None:
        rows = spread(with_halo(rows, panel, ahead=1), *group_keys(panel))
    rows = own_rows(rows.withColumn("_stop", _stop(panel, F.col("_step"), F.col("_last"))))
    opened = _open_gaps(rows, panel, F.col("_step"))
    present = F.col("_t") == F.col(panel.dt)
    fill = F.lit(fill_value)

    def value(c: str) -> Column:
        return F.when(present, F.col(c)).otherwise(fill.cast(bounded.schema[c].dataType)).alias(c)

    values = [value(c) for c in columns if c not in (*panel.ids, panel.dt)]
    return opened.select(*panel.ids, F.col("_t").alias(panel.dt), *values)


def _slots(
    df: DataFrame, panel: Panel, cols: Sequence[str], freq: str | int, snap: str
) -> DataFrame:
    """One row per occupied grid cell.

    ``snap='exact'`` keeps only readings that fall exactly on the grid, the other
    cells stay open (NULL); ``snap='mean'`` averages the cell.  The aggregate
    combines on the map side, so a dense series shrinks before it is shuffled.
    """
    if snap not in ("exact", "mean"):
        raise ValueError(f"unknown snap: {snap}")
    here = F.col(panel.dt)
    pick = (lambda c: F.when(on_grid(here, freq), F.col(c))) if snap == "exact" else F.col
    return df.groupBy(*panel.ids, floor_time(here, freq).alias(panel.dt)).agg(
        *[F.avg(pick(c)).alias(c) for c in cols]
    )


def interpolate_linear(
    df: DataFrame,
    panel: Panel,
    cols: Sequence[str],
    freq: str | int,
    snap: str = "exact",
) -> DataFrame:
    """Series on the ``freq`` grid with interior gaps filled linearly.

    Leading cells stay NULL, trailing cells take the last known value.
    """
    if panel.chunk_us == MEASURE:
        panel = fit_grid(df, panel, freq)
    slots = _slots(df, panel, cols, freq, snap)
    step_us = F.lit(freq_seconds(freq) * 1_000_000)
    opened = _open_gaps(_known_neighbours(slots, panel, cols, step_us), panel, step_us)
    at = F.col("_t")
    return opened.select(
        *panel.ids, at.alias(panel.dt), *[_between(c, at).alias(c) for c in cols]
    )


def _between(c: str, at: Column) -> Column:
    """Value at time ``at`` between the last known and the next known reading."""
    t, left_t, right_t = (F.unix_micros(x) for x in (at, F.col(f"_pt_{c}"), F.col(f"_nt_{c}")))
    left, right = F.col(f"_pv_{c}"), F.col(f"_nv_{c}")
    return (
        F.when(t == left_t, left)
        .when(left.isNull() | right.isNull(), left)
        .otherwise(left + (right - left) * (t - left_t) / (right_t - left_t))
    )


def _known_neighbours(
    slots: DataFrame, panel: Panel, cols: Sequence[str], step_us: Column
) -> DataFrame:
    """Per column: time and value of the last reading at or before each row
    (``_pt_``, ``_pv_``) and of the first one after it (``_nt_``, ``_nv_``).

    Both directions are running frames (the forward one over the reversed order),
    linear in the rows.  With chunks, each chunk's first and last reading travel
    to its neighbours through a table of one row per chunk.
    """
    reading = {
        c: F.when(
            F.col(c).isNotNull(), F.struct(F.col(panel.dt).alias("t"), F.col(c).alias("v"))
        )
        for c in cols
    }
    running = (Window.unboundedPreceding, Window.currentRow)
    earlier = (Window.unboundedPreceding, -1)
    past = in_order(panel).rowsBetween(*running)
    ahead = in_order(panel, descending=True).rowsBetween(*earlier)
    rows = spread(with_halo(slots, panel, ahead=1), *group_keys(panel))
    rows = rows.withColumns(
        {f"_n_{c}": F.last(reading[c], ignorenulls=True).over(ahead) for c in cols}
    ).withColumns(
        {f"_p_{c}": F.last(reading[c], ignorenulls=True).over(past) for c in cols}
        | {"_stop": _stop(panel, step_us, F.col(panel.dt))}
    )
    if panel.chunk_us is not None:
        keys = group_keys(panel)
        series = Window.partitionBy(*panel.ids)
        before = series.orderBy(keys[-1]).rowsBetween(*earlier)
        after = series.orderBy(F.desc(keys[-1])).rowsBetween(*earlier)
        ends = (
            with_chunk(slots, panel)
            .groupBy(*keys)
            .agg(
                *[F.max(reading[c]).alias(f"_hi_{c}") for c in cols],
                *[F.min(reading[c]).alias(f"_lo_{c}") for c in cols],
            )
        )
        carried = [
            F.last(f"_{end}_{c}", ignorenulls=True).over(w).alias(f"_{side}_{c}")
            for c in cols
            for end, w, side in (("hi", before, "before"), ("lo", after, "after"))
        ]
        rows = rows.join(ends.select(*keys, *carried), keys).withColumns(
            {f"_p_{c}": F.coalesce(f"_p_{c}", f"_before_{c}") for c in cols}
            | {f"_n_{c}": F.coalesce(f"_n_{c}", f"_after_{c}") for c in cols}
        )
    return own_rows(rows).select(
        *panel.ids,
        panel.dt,
        "_stop",
        *[
            F.col(f"_{side}_{c}.{part}").alias(f"_{side}{part}_{c}")
            for c in cols
            for side in "pn"
            for part in "tv"
        ],
    )


def resample_mean(df: DataFrame, panel: Panel, cols: Sequence[str], freq: str | int) -> DataFrame:
    """Mean per bin, closed and labelled on the left.

    Bins of a calendar (see :func:`calendar_of`) bear the day that names them: the first of
    ``MS``, ``QS``, ``YS`` and ``B`` (which takes the weekend after a Friday), the last of ``ME``, ``QE``,
    ``YE`` and ``W``.  Bins of several periods count from a series' first one.  Bins without
    rows are left out.
    """
    calendar = calendar_of(freq)
    if calendar is not None:
        return _calendar_means(df, panel, cols, calendar)
    start = floor_time(F.col(panel.dt), freq).alias(panel.dt)
    return df.groupBy(*panel.ids, start).agg(*[F.avg(c).alias(c) for c in cols])


def _calendar_means(df: DataFrame, panel: Panel, cols: Sequence[str], calendar: Calendar) -> DataFrame:
    period = calendar.period(F.col(panel.dt)).alias("_p")
    keys = [*panel.ids, "_p"]
    timed = df.where(F.col(panel.dt).isNotNull())
    if calendar.times == 1:
        bins = timed.groupBy(*panel.ids, period).agg(*[F.avg(c).alias(c) for c in cols])
    else:
        # Single periods first: their sums are few, whatever the readings' volume.
        parts = [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("sum", F.sum), ("n", F.count))]
        single = timed.groupBy(*panel.ids, period).agg(*parts)
        since = F.col("_p") - F.min("_p").over(Window.partitionBy(*panel.ids))
        # A step that ends a bin names it, a step that begins one likewise.
        behind = F.pmod(since, F.lit(calendar.times))
        named = F.when(behind > 0, F.col("_p") + calendar.times - behind).otherwise(F.col("_p")) if calendar.ends else F.col("_p") - behind
        total = [(F.sum(f"_sum_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(c) for c in cols]
        bins = single.withColumn("_p", named).groupBy(*keys).agg(*total)
    return bins.select(*panel.ids, calendar.date(F.col("_p")).cast("timestamp").alias(panel.dt), *cols)


def interpolate_resample(
    df: DataFrame,
    panel: Panel,
    cols: Sequence[str],
    freq: str | int,
    new_freq: str | int,
    snap: str = "exact",
) -> DataFrame:
    """Interpolate on ``freq``, then average to ``new_freq`` unless they are equal."""
    grid = interpolate_linear(df, panel, cols, freq, snap)
    if calendar_of(new_freq) is None and freq_seconds(freq) == freq_seconds(new_freq):
        return grid
    return resample_mean(grid, panel, cols, new_freq)


def resample_multi(
    df: DataFrame,
    panel: Panel,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    freq: str | int,
    x_freq: str | int,
    y_freq: str | int,
    snap: str = "exact",
) -> tuple[DataFrame, DataFrame]:
    """The same interpolated series at an input rate and a target rate.

    Both results hang off one interpolation; in one job Spark reuses its shuffle.
    """
    grid = interpolate_linear(df, panel, sorted({*x_cols, *y_cols}), freq, snap)

    def at(rate, cols):
        if calendar_of(rate) is None and freq_seconds(rate) == freq_seconds(freq):
            return grid.select(*panel.ids, panel.dt, *cols)
        return resample_mean(grid, panel, cols, rate)

    return at(x_freq, list(x_cols)), at(y_freq, list(y_cols))


# ------------------------------------------------------------- row features


def time_features(df: DataFrame, dt: str = "dt") -> DataFrame:
    """Day of week (Monday = 0) and hour of day."""
    return df.withColumns({"dow": F.weekday(dt), "hod": F.hour(dt)})


def shift(df: DataFrame, panel: Panel, cols: Sequence[str], n: int, fill_value=None) -> DataFrame:
    """Move values ``n`` rows down (up when negative) within each series."""
    if n == 0:
        return df
    panel = measured(df, panel)
    haloed = with_halo(df, panel, behind=max(n, 0), ahead=max(-n, 0))
    w = in_order(panel)
    exists = F.lag(F.lit(True), n).over(w)
    fill = F.lit(fill_value)
    moved = {
        c: F.when(exists, F.lag(c, n).over(w)).otherwise(fill.cast(df.schema[c].dataType))
        for c in cols
    }
    return own_rows(haloed.withColumns(moved))


def every_nth(df: DataFrame, panel: Panel, n: int) -> DataFrame:
    """Rows 0, n, 2n, … of each series."""
    return with_position(df, panel).where(F.col(POS) % n == 0).drop(POS, SIZE)

