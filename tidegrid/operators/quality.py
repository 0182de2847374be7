"""Counts, pivots, completeness and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.joins import common_ids
from tidegrid.operators.ranks import global_order
from tidegrid.panel import Panel


# ------------------------------------------------------------------- groups


def group_count(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def group_filter_min(df: DataFrame, by: Sequence[str], n_adj: int = 0) -> DataFrame:
    """Keep groups with more than ``max(n_adj + 1, 2)`` rows.

    A counted group list and a semi join, so no group is gathered in one task.
    """
    large = group_count(df, by, "_n").where(F.col("_n") > max(n_adj + 1, 2))
    return df.join(large, list(by), "left_semi")


def get_group(df: DataFrame, **key) -> DataFrame:
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def dataset_profile(
    tables: Mapping[str, DataFrame | None],
    id_col: str = "id",
    dt: str = "dt",
    meta: str = "meta",
    approx: bool = False,
) -> DataFrame:
    """One row per table: rows, unique ids, duplicate-id flag, time range, unique
    times, ids shared with meta.

    Ids and times are counted apart, each from rows that map tasks have combined, so
    that no row is doubled for a second distinct count.  ``approx`` sketches both counts
    in one pass; see :func:`profile_sketches` for counts that grow by parts.
    """
    rows = None
    for name, df in tables.items():
        if df is None:
            continue
        cut = df.select(
            F.col(id_col).alias("_id"), (F.col(dt) if dt in df.columns else F.lit(None).cast("timestamp")).alias("_dt")
        )
        span = [F.min("_dt").alias("min_dt"), F.max("_dt").alias("max_dt")]
        if approx:
            row = cut.agg(
                F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("_id").alias("n_ids"), *span,
                F.approx_count_distinct("_dt").alias("n_dt"),
            )
        else:
            row = cut.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), *span).agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("_id").alias("n_ids"),
                F.min("min_dt").alias("min_dt"), F.max("max_dt").alias("max_dt"),
            )
            times = cut.select("_dt").distinct().agg(F.count("_dt")).scalar() if dt in df.columns else F.lit(0).cast("bigint")
            row = row.withColumn("n_dt", times)
        row = row.select(F.lit(name).alias("table_name"), "*", (F.col("n_rows") > F.col("n_ids")).alias("has_dup_ids"))
        if name != meta and tables.get(meta) is not None:
            shared = common_ids(tables[meta], [df], id_col).agg(F.count(F.lit(1))).scalar()
            row = row.withColumn("n_common", shared)
        else:
            row = row.withColumn("n_common", F.lit(None).cast("bigint"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def profile_sketches(df: DataFrame, by: Sequence[str] = (), id_col: str = "id", dt: str = "dt", lg: int = 14) -> DataFrame:
    """Profiles of parts (months, say) that can be stored and merged: one row a part.

    Holds the rows, the time range and theta sketches of ids and times, at most
    ``8 * 2**lg`` bytes each whatever the part's size.  A new part is profiled alone and
    put beside the stored ones; :func:`merge_profiles` joins any of them without reading
    their rows again.  A table without ``dt`` has no times.
    """
    timed = F.col(dt) if dt in df.columns else F.lit(None).cast("timestamp")
    cut = df.select(*by, F.col(id_col).alias("_id"), timed.alias("_dt"))
    return cut.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("_dt").alias("min_dt"), F.max("_dt").alias("max_dt"),
        F.theta_sketch_agg("_id", lg).alias("ids"), F.theta_sketch_agg(F.unix_micros("_dt"), lg).alias("times"),
    )


def merge_profiles(profiles: DataFrame, by: Sequence[str] = (), lg: int = 14) -> DataFrame:
    """One profile for each value of ``by`` (or one in all) of the parts' profiles."""
    return profiles.groupBy(*by).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.min("min_dt").alias("min_dt"), F.max("max_dt").alias("max_dt"),
        F.theta_union_agg("ids", lg).alias("ids"), F.theta_union_agg("times", lg).alias("times"),
    )


def profile_counts(profiles: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Profiles with their counts in place of the sketches, as :func:`dataset_profile` has them.

    Counts of up to ``2**lg`` distinct values are exact; larger ones have a standard error
    of ``2**(-lg / 2)`` of the count (0.8 % by default).  ``meta``, one row of
    :func:`merge_profiles`, adds the number of ids that it shares; its error is that
    share of the ids of both together.
    """
    out = profiles
    if meta is not None:
        both = F.theta_intersection("ids", meta.select("ids").scalar())
        out = out.withColumn("n_common", F.theta_sketch_estimate(both))
    counts = {"n_ids": F.theta_sketch_estimate("ids"), "n_dt": F.theta_sketch_estimate("times")}
    out = out.withColumns(counts).withColumn("has_dup_ids", F.col("n_rows") > F.col("n_ids"))
    return out.drop("ids", "times")


# ------------------------------------------------------------ long and wide


def pivot_series(
    df: DataFrame, values: Sequence[str], ids: Sequence, index: str = "dt", column: str = "id"
) -> DataFrame:
    """Long to wide: one column ``{id}_{value}`` per listed id, duplicates averaged.

    The ids are named by the caller: a wide table has as many columns as ids, and
    naming them saves the job that would look them up.
    """
    named = [F.avg(v).alias(v) for v in values]
    wide = df.groupBy(index).pivot(column, list(ids)).agg(*named)
    if len(values) == 1:
        wide = wide.withColumnsRenamed({str(i): f"{i}_{values[0]}" for i in ids})
    return wide


def unpivot_series(
    df: DataFrame,
    values: Sequence[str],
    ids: Sequence,
    index: str = "dt",
    column: str = "id",
) -> DataFrame:
    """Wide (:func:`pivot_series`) back to long with one column per variable.

    Each wide row becomes one row per id by a projection; combinations without
    any value are left out.
    """
    per_id = F.array(
        *[
            F.struct(F.lit(i).alias(column), *[F.col(f"`{i}_{v}`").alias(v) for v in values])
            for i in ids
        ]
    )
    long = df.select(index, F.inline(per_id))
    return long.where(F.coalesce(*[F.col(v) for v in values]).isNotNull())


# ------------------------------------------------------------- completeness


def completeness_by_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-missing count and ratio of each column, from one aggregate."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.count(c).alias("n_present")) for c in cols]
    )
    counted = df.agg(pairs.alias("_c"), F.count(F.lit(1)).alias("_n"))
    return counted.select(F.inline("_c"), "_n").select(
        "column", "n_present", (F.col("n_present") / F.col("_n")).alias("ratio")
    )


def completeness_by_series(
    df: DataFrame, panel: Panel, value: str, grid_rows: int | None = None
) -> DataFrame:
    """Long form: readings per series against the number of timestamps of the table."""
    if grid_rows is None:
        total = df.select(panel.dt).distinct().agg(F.count(F.lit(1))).scalar()
    else:
        total = F.lit(grid_rows)
    counted = df.groupBy(*panel.ids).agg(F.count(value).alias("n_present"))
    return counted.withColumn("ratio", F.col("n_present") / total)


def completeness_by_row(df: DataFrame, cols: Sequence[str], index: str = "dt") -> DataFrame:
    """Non-missing columns per row, with the table's least and most."""
    present = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    rows = df.select(index, present.alias("n_present"))
    ends = rows.agg(F.struct(F.min("n_present").alias("lo"), F.max("n_present").alias("hi"))).scalar()
    return rows.withColumns({"min_present": ends["lo"], "max_present": ends["hi"]})


def nullity_mask(df: DataFrame, cols: Sequence[str], index: str = "dt") -> DataFrame:
    return df.select(index, *[F.col(c).isNotNull().alias(c) for c in cols])


def nullity_sort_columns(completeness: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Number series (or columns) by completeness; ties by name."""
    sign = 1 if ascending else -1
    ordered = global_order(completeness.withColumn("_s", F.col("n_present") * sign), "_s", key)
    return ordered.drop("_s")


def nullity_sort_rows(rows: DataFrame, index: str = "dt", ascending: bool = True) -> DataFrame:
    """Timestamps ordered by how complete they are."""
    order = F.asc("n_present") if ascending else F.desc("n_present")
    return rows.orderBy(order, index)


def nullity_filter(
    completeness: DataFrame, key: str, keep: str = "top", p: float = 0, n: int = 0
) -> DataFrame:
    """Series with ratio >= p (top) or <= p (bottom), and of those the n most or
    least complete.  Zero switches a limit off.  Works on columns or rows alike:
    the input is the table of their completeness."""
    if keep not in ("top", "bottom"):
        raise ValueError(f"unknown filter: {keep}")
    top = keep == "top"
    out = completeness
    if p:
        out = out.where(F.col("ratio") >= p if top else F.col("ratio") <= p)
    if n:
        out = out.orderBy(F.desc("n_present") if top else F.asc("n_present"), key).limit(n)
    return out


def nullity_select(
    df: DataFrame,
    cols: Sequence[str],
    keep: str = "top",
    p: float = 0,
    n: int = 0,
    ascending: bool | None = None,
    index: str = "dt",
) -> DataFrame:
    """Wide form: the chosen columns, in table order or ordered by completeness.

    Only one count per column reaches the driver, to name the columns.
    """
    found = nullity_filter(completeness_by_column(df, cols), "column", keep, p, n).collect()
    counts = {r["column"]: r["n_present"] for r in found}
    chosen = [c for c in cols if c in counts]
    if ascending is not None:
        chosen.sort(key=counts.get, reverse=not ascending)
    return df.select(index, *chosen)


def nullity_filter_rows(
    df: DataFrame, cols: Sequence[str], keep: str = "top", p: float = 0, n: int = 0, index: str = "dt"
) -> DataFrame:
    """The same over rows: keep timestamps by their share of non-missing columns."""
    present = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    rows = df.withColumn("n_present", present).withColumn("ratio", present / F.lit(len(cols)))
    return nullity_filter(rows, index, keep, p, n).drop("n_present", "ratio")


def window_shape_report(
    windows: DataFrame, by: Sequence[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Rows and array shapes of saved windows per data set."""
    return windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size(x)).alias("n_tx"),
        F.max(F.size(F.element_at(x, 1))).alias("n_vx"),
        F.max(F.size(y)).alias("n_ty"),
        F.max(F.size(F.element_at(y, 1))).alias("n_vy"),
    )


# ----------------------------------------------------------- result tables


def append_average_row(
    df: DataFrame, cols: Sequence[str], key: str = "id", label: str = "avg"
) -> DataFrame:
    """The table plus a last row of column means."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).select(F.lit(label).alias(key), *cols)
    return df.select(F.col(key).cast("string").alias(key), *cols).unionByName(means)


def metrics_pivot(
    df: DataFrame,
    metrics: Sequence[str],
    levels: Sequence,
    key: str = "id",
    column: str = "n_agg",
) -> DataFrame:
    """One row per id, one column per level and metric; incomplete rows dropped."""
    wide = df.groupBy(key).pivot(column, list(levels)).agg(*[F.first(m).alias(m) for m in metrics])
    if len(metrics) == 1:
        wide = wide.withColumnsRenamed({str(v): f"{v}_{metrics[0]}" for v in levels})
    return wide.na.drop()


def mark_extreme(
    df: DataFrame, value: str, by: Sequence[str], out: str, largest: bool = False
) -> DataFrame:
    """Flag the cells that hold the least (or largest) value of their line.

    A group is one line of a result table, so it has as many rows as the table
    has columns.  The value is computed once and compared with itself, which a
    join to a second computation of it would not do.
    """
    pick = F.max if largest else F.min
    extreme = pick(value).over(Window.partitionBy(*by))
    return df.withColumn(out, F.coalesce(F.col(value) == extreme, F.lit(False)))


def mark_min(df: DataFrame, value: str, by: Sequence[str] = ("id",), out: str = "is_min") -> DataFrame:
    return mark_extreme(df, value, by, out)


def mark_max(df: DataFrame, value: str, by: Sequence[str] = ("id",), out: str = "is_max") -> DataFrame:
    return mark_extreme(df, value, by, out, largest=True)


def mark_min_grouped(
    df: DataFrame, value: str, by: Sequence[str] = ("id", "metric"), out: str = "is_min"
) -> DataFrame:
    return mark_extreme(df, value, by, out)
