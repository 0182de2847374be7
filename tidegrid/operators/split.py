"""Chronological split and tail of each series, by row position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunks import CHUNK, POS, SIZE, group_keys, measured, with_chunk, with_position
from tidegrid.panel import Panel


def tvt_split(
    df: DataFrame,
    panel: Panel,
    train_size: float = 0.8,
    valid_size: float = 0.1,
    out: str = "split",
) -> DataFrame:
    """Label rows train / valid / test: the first ``floor(N * train_size)`` rows of a
    series, the next ``floor(N * valid_size)``, and the rest."""
    if not 0 < train_size <= 1:
        raise ValueError("train_size must be in (0, 1]")
    if not 0 <= valid_size < 1:
        raise ValueError("valid_size must be in [0, 1)")
    if train_size + valid_size > 1:
        raise ValueError("train_size + valid_size must not exceed 1")
    train = F.floor(F.col(SIZE) * F.lit(train_size))
    valid = F.floor(F.col(SIZE) * F.lit(valid_size))
    label = (
        F.when(F.col(POS) < train, "train").when(F.col(POS) < train + valid, "valid").otherwise("test")
    )
    return with_position(df, panel).withColumn(out, label).drop(POS, SIZE)


def tail_rows(df: DataFrame, panel: Panel, n_rows: int) -> DataFrame:
    """The last ``n_rows`` rows of each series.

    Of a chunked series only the chunks that can hold such rows are read on: those
    with fewer than ``n_rows`` rows after them, known from the chunk sizes.
    """
    rows, panel = df, measured(df, panel)
    if panel.chunk_us is not None:
        rows = with_chunk(df, panel)
        later = (
            Window.partitionBy(*panel.ids)
            .orderBy(F.desc(CHUNK))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        sizes = rows.groupBy(*group_keys(panel)).agg(F.count(F.lit(1)).alias("_rows"))
        needed = sizes.withColumn("_later", F.coalesce(F.sum("_rows").over(later), F.lit(0)))
        needed = needed.where(F.col("_later") < n_rows).select(*group_keys(panel))
        rows = rows.join(needed, group_keys(panel), "left_semi").drop(CHUNK)
    newest = Window.partitionBy(*panel.ids).orderBy(F.desc(panel.dt))
    return (
        rows.withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= n_rows)
        .drop("_rn")
    )
