"""Id restriction, neighbours along a road, and trial joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunks import MAX_ROWS
from tidegrid.operators.ranks import in_ranges
from tidegrid.panel import Panel


def common_ids(
    meta: DataFrame | None, readings: Sequence[DataFrame | None], key: str = "id"
) -> DataFrame | None:
    """Ids present in meta and in every reading table that was loaded.

    Each table is reduced to its distinct ids before they meet, so the result has
    at most as many rows as meta.  ``None`` when meta or all readings are missing.
    """
    loaded = [r for r in readings if r is not None]
    if meta is None or not loaded:
        return None
    out = meta.select(key)
    for table in loaded:
        out = out.intersect(table.select(key))
    return out


def filter_by_common_id(
    tables: dict[str, DataFrame | None], meta: str = "meta", key: str = "id"
) -> dict[str, DataFrame | None]:
    """Keep only common ids in every table.

    The semi joins carry no broadcast hint: adaptive execution broadcasts the id
    list when its measured size allows and shuffles otherwise.
    """
    ids = common_ids(tables.get(meta), [t for n, t in tables.items() if n != meta], key)
    if ids is None:
        return {n: t.limit(0) if t is not None else None for n, t in tables.items()}
    return {
        n: t.join(ids, key, "left_semi") if t is not None else None for n, t in tables.items()
    }


def neighbor_ids(
    meta: DataFrame, by: Sequence[str] = ("road", "direction"), key: str = "id", ord_col: str = "ord",
    max_rows: int = MAX_ROWS, ranges: int | None = None,
) -> DataFrame:
    """Previous and next id along each road; the two ends have no pair and drop out.

    A plain window while the longest road has at most ``max_rows`` ids, which is measured
    first.  Longer roads have no time to be cut by: all rows are range-partitioned in
    their order, look beside themselves inside a range, and only the first and last row
    of a road's part in a range take their neighbour from the parts before and after it.
    """
    by = list(by)
    places = meta.select(*dict.fromkeys([*by, key, ord_col]))
    longest = places.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if longest <= max_rows:
        w = Window.partitionBy(*by).orderBy(ord_col, key)
        beside = places.select(*by, key, F.lag(key).over(w).alias("id_prev"), F.lead(key).over(w).alias("id_next"))
    else:
        beside = _beside_in_ranges(places, by, key, ord_col, ranges)
    return beside.where(F.col("id_prev").isNotNull() & F.col("id_next").isNotNull())


def _beside_in_ranges(places: DataFrame, by: list[str], key: str, ord_col: str, ranges: int | None) -> DataFrame:
    cut = in_ranges(places, list(dict.fromkeys([*by, ord_col, key])), ranges)
    inside = Window.partitionBy(*by, "_b").orderBy("_rn")
    along = Window.partitionBy(*by).orderBy("_b")  # one row for a road and range
    parts = cut.groupBy(*by, "_b").agg(
        F.min("_rn").alias("_lo"), F.max("_rn").alias("_hi"),
        F.min_by(key, "_rn").alias("_head"), F.max_by(key, "_rn").alias("_tail"),
    )
    edges = parts.select(
        *[F.col(c).alias(f"_of_{c}") for c in by], F.col("_b").alias("_of_b"), "_lo", "_hi",
        F.lag("_tail").over(along).alias("_before"), F.lead("_head").over(along).alias("_after"),
    )
    same = F.col("_b") == F.col("_of_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rows = cut.withColumns({"_prev": F.lag(key).over(inside), "_next": F.lead(key).over(inside)})
    return rows.join(edges, same).select(
        *by, key,
        F.when(F.col("_rn") == F.col("_lo"), F.col("_before")).otherwise(F.col("_prev")).alias("id_prev"),
        F.when(F.col("_rn") == F.col("_hi"), F.col("_after")).otherwise(F.col("_next")).alias("id_next"),
    )


def neighbor_features(
    readings: DataFrame,
    neighbors: DataFrame,
    cols: Sequence[str],
    panel: Panel,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Previous, own and next series side by side at shared timestamps.

    Columns are prefixed ``0_``, ``1_``, ``2_``.  Every reading is sent once to
    each series it serves (at most three copies: as previous, own and next) and
    one aggregate on (id, dt) puts them together, so there is a single shuffle of
    the readings instead of one per side, and map tasks combine first.  ``extra``
    columns come from the own series.
    """
    key, dt = panel.ids[0], panel.dt
    roles = F.array(
        F.struct(F.lit(0).alias("role"), F.col("id_prev").alias("source")),
        F.struct(F.lit(1).alias("role"), F.col(key).alias("source")),
        F.struct(F.lit(2).alias("role"), F.col("id_next").alias("source")),
    )
    served = neighbors.select(F.col(key).alias("_for"), F.explode(roles).alias("_r")).select(
        F.col("_r.source").alias(key), F.col("_r.role").alias("_role"), "_for"
    )
    sent = readings.join(served, key)
    side = [
        F.max(F.when(F.col("_role") == role, F.col(c))).alias(f"{role}_{c}")
        for role in (0, 1, 2)
        for c in cols
    ]
    own = [F.max(F.when(F.col("_role") == 1, F.col(c))).alias(c) for c in extra]
    return (
        sent.groupBy(F.col("_for").alias(key), *panel.ids[1:], dt)
        .agg(F.bit_or(F.expr("shiftleft(1, _role)")).alias("_sides"), *side, *own)
        .where(F.col("_sides") == 0b111)
        .drop("_sides")
    )


def align_inner(left: DataFrame, right: DataFrame, on: Sequence[str] = ("dt",)) -> DataFrame:
    """Columns of both at shared timestamps."""
    return left.join(right, list(on))


def join_inner(metrics: DataFrame, confs: DataFrame, on: str = "exptid") -> DataFrame:
    return metrics.join(confs, on)


def join_left_wide(
    metrics: DataFrame,
    variant: str,
    variants: Sequence[str],
    metric: str,
    key: str = "id",
) -> DataFrame:
    """One row per id of the first variant, one metric column per variant.

    Equal to left joining the variants one after another, with a single shuffle.
    """
    wide = (
        metrics.groupBy(key)
        .pivot(variant, list(variants))
        .agg(F.struct(F.first(metric).alias("v"), F.count(F.lit(1)).alias("n")))
    )
    base = F.col(f"`{variants[0]}`.n") > 0
    return wide.where(base).select(key, *[F.col(f"`{v}`.v").alias(v) for v in variants])


def missing_trials(metrics: DataFrame, last: int, key: str = "exptid") -> DataFrame:
    """Trial numbers 1..last-1 without a result."""
    expected = metrics.sparkSession.range(1, last).withColumnRenamed("id", key)
    return expected.join(metrics.select(key), key, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    """Append frames by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
