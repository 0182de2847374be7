"""Projection, recoding, filters and explicit orderings of ids."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalar import next_weekday, recode
from tidegrid.operators.ranks import global_order
from tidegrid.panel import Panel

# Standard column names of detector tables.
STANDARD_NAMES = {
    "measurement_start": "dt",
    "zone_id": "id",
    "latitude": "lat",
    "longitude": "lon",
    "freeway": "road",
}

# Direction names and their codes.
DIRECTION_CODES = {"North": "N", "East": "E", "West": "W", "South": "S"}

STANDARD_CODES = {"direction": DIRECTION_CODES}


def std_colnames(df: DataFrame, names: Mapping[str, str] = STANDARD_NAMES) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def std_colcodes(
    df: DataFrame, codes: Mapping[str, Mapping[str, str]] = STANDARD_CODES
) -> DataFrame:
    return df.withColumns({c: recode(F.col(c), m) for c, m in codes.items() if c in df.columns})


def decode_codes(
    df: DataFrame, codes: Mapping[str, Mapping[str, str]] = STANDARD_CODES
) -> DataFrame:
    """Inverse of :func:`std_colcodes`; the maps must be one to one."""
    inverse = {}
    for column, mapping in codes.items():
        inverse[column] = {code: name for name, code in mapping.items()}
        if len(inverse[column]) != len(mapping):
            raise ValueError(f"codes of {column} are not unique")
    return std_colcodes(df, inverse)


def replace_chars(df: DataFrame, column: str, old: str = "-", new: str = "_") -> DataFrame:
    return df.withColumn(column, F.translate(column, old, new))


def drop_unnamed_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search("Unname", c)])


def select_ids_cols(
    df: DataFrame, ids: DataFrame, columns: Sequence[str], key: str = "id"
) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi").select(*columns)


def filter_months(df: DataFrame, months: Sequence[int], dt: str = "dt") -> DataFrame:
    """Keep the listed months; an empty list keeps all."""
    return df.where(F.month(dt).isin(list(months))) if months else df


def distinct_months(df: DataFrame, dt: str = "dt") -> DataFrame:
    return df.select(F.month(dt).alias("month")).distinct()


def filter_weekdays(df: DataFrame, days: Sequence[int], dt: str = "dt") -> DataFrame:
    """Keep the listed weekdays, Monday = 0; an empty list keeps all."""
    return df.where(F.weekday(dt).isin(list(days))) if days else df


def trim_partial_weeks(df: DataFrame, panel: Panel) -> DataFrame:
    """Per series and month, keep the rows from the first Monday to the last Sunday.

    The bounds carry the time of day of the month's first and last row.  They are
    one row per (series, month), aggregated before the shuffle and joined back.
    """
    keys = [*panel.ids, "_year", "_month"]
    dated = df.withColumns({"_year": F.year(panel.dt), "_month": F.month(panel.dt)})
    bounds = dated.groupBy(*keys).agg(
        next_weekday(F.min(panel.dt), 0).alias("_from"),
        next_weekday(F.max(panel.dt), 6, forward=False).alias("_to"),
    )
    return (
        dated.join(bounds, keys)
        .where(F.col(panel.dt).between(F.col("_from"), F.col("_to")))
        .select(*df.columns)
    )


def first_datetime_col(df: DataFrame) -> str | None:
    """Name of the first date or timestamp column."""
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return next((f.name for f in df.schema.fields if isinstance(f.dataType, kinds)), None)


def filter_expr(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.where(condition)


def label_append_if(
    df: DataFrame, label: str, columns: str, part: str = "volume", suffix: str = "3"
) -> DataFrame:
    """Append a suffix to the label where any listed column name contains ``part``."""
    hit = F.exists(columns, lambda c: F.contains(c, F.lit(part)))
    return df.withColumn(
        label, F.when(hit, F.concat(label, F.lit(suffix))).otherwise(F.col(label))
    )


def dropna_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def ordered_category_list(
    df: DataFrame, column: str, categories: Sequence | DataFrame, out: str = "ord"
) -> DataFrame:
    """Position of the value in an explicit order; values outside it get NULL.

    ``categories`` is a list, or a table that already holds (column, out).
    """
    if not isinstance(categories, DataFrame):
        levels = df.sparkSession.range(1).select(
            F.posexplode(F.array(*[F.lit(c) for c in categories])).alias(out, column)
        )
        categories = levels.withColumn(out, F.col(out) + 1)
    return df.join(categories.select(column, out), column, "left")


def ordered_category_typed(
    df: DataFrame, column: str, as_type: str = "int", ascending: bool = True, out: str = "ord"
) -> DataFrame:
    """Distinct values numbered by their order after a cast."""
    values = df.select(column).distinct().where(F.col(column).isNotNull())
    typed = values.withColumn("_typed", F.col(column).cast(as_type))
    ranked = global_order(typed, "_typed", column, out=out)
    if not ascending:
        last = ranked.agg(F.max(out)).scalar()
        ranked = ranked.withColumn(out, last + 1 - F.col(out))
    return ranked.select(column, out)


def ordered_category_geo(
    df: DataFrame,
    column: str = "id",
    lon: str = "lon",
    lat: str = "lat",
    ascending: bool = True,
    out: str = "ord",
) -> DataFrame:
    """Order points by planar distance from the point nearest a corner of the
    bounding box: the lower left corner (ascending) or the upper right one.

    The corner and the starting point are one-row subqueries.
    """
    pick = F.min if ascending else F.max
    corner = df.agg(F.struct(pick(lon).alias("x"), pick(lat).alias("y"))).scalar()
    to_corner = F.hypot(F.col(lon) - corner["x"], F.col(lat) - corner["y"])
    start = (
        df.withColumn("_d", to_corner)
        .agg(
            F.min_by(
                F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")), F.struct("_d", column)
            )
        )
        .scalar()
    )
    away = F.hypot(F.col(lon) - start["x"], F.col(lat) - start["y"])
    return global_order(df.withColumn("dist", away), "dist", column, out=out)


def order_used(df: DataFrame, column: str, levels: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Number the values of ``column`` that occur in ``df`` by their order in ``levels``.

    Equal to :func:`ordered_category_list` and then :func:`remove_unused_categories`, but
    only distinct values are numbered, and the table is joined once.
    """
    used = df.select(column).distinct().join(levels.select(column, ord_col), column)
    numbered = global_order(used, ord_col, out="_new").select(column, F.col("_new").alias(ord_col))
    return df.drop(ord_col).join(numbered, column, "left")


def remove_unused_categories(df: DataFrame, column: str = "id", ord_col: str = "ord") -> DataFrame:
    """Renumber the order over the ids that are left."""
    left = df.select(column, ord_col).distinct().where(F.col(ord_col).isNotNull())
    renumbered = global_order(left, ord_col, out="_new").select(column, "_new")
    return (
        df.join(renumbered, column, "left")
        .withColumn(ord_col, F.col("_new"))
        .drop("_new")
    )

