"""Completeness of every series and variable on the table's common grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.freq import freq_seconds
from tidegrid.operators.ranks import smallest_step
from tidegrid.panel import Panel


def nullity_report(
    readings: DataFrame, panel: Panel, values: Sequence[str], freq: str | int | None = None
) -> DataFrame:
    """Cells with a value per series and variable, and their share of the grid.

    The grid runs from the table's first to its last timestamp at ``freq``, or at
    the smallest gap between any two timestamps; readings off it do not count.
    This is the pivoted, gap-filled table's completeness, without the wide table.
    """
    if freq is None:
        step = smallest_step(readings, panel.dt).scalar()
    else:
        step = F.lit(freq_seconds(freq) * 1_000_000)
    first, last = F.min(F.unix_micros(panel.dt)), F.max(F.unix_micros(panel.dt))
    ends = readings.agg(F.struct(first.alias("lo"), last.alias("hi"))).scalar()
    on_grid = F.pmod(F.unix_micros(panel.dt) - ends["lo"], step) == 0
    # Duplicate readings of a cell count once.
    cells = readings.where(on_grid).groupBy(*panel.ids, panel.dt).agg(
        *[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in values]
    )
    counts = cells.groupBy(*panel.ids).agg(*[F.sum(c).alias(c) for c in values])
    long = counts.unpivot(list(panel.ids), list(values), "var", "n_present")
    grid_rows = F.floor((ends["hi"] - ends["lo"]) / step) + 1
    return long.withColumn("ratio", F.col("n_present") / grid_rows)
