"""Ranks over whole tables without a single-task window.

One plan for every size: rows are range-partitioned on the whole order, sorted inside
their range, and the totals of the ranges below, one row a range, are added.  The number
of ranges follows the session's shuffle partitions, so it grows with the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import stage

# Positions inside a range, as monotonically_increasing_id numbers them.
_RANGE_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The table written once in order, with ``_b``, the number of a row's range, which
    grows with the order, and ``_rn``, its place in the range from 0 on.

    Every later read sees the same bits, which a recomputed floating value does not
    promise.  Rows that tie in the whole order are spread by a hash of all columns.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keys = [*[F.col(c) for c in order], F.col("_tie")]
    tied = df.withColumn("_tie", tie)
    placed = tied.repartitionByRange(ranges, *keys) if ranges else tied.repartitionByRange(*keys)
    placed = placed.sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    settled = stage(placed.drop("_tie"))
    return settled.withColumn("_b", F.shiftright("_m", _RANGE_BITS)).withColumn(
        "_rn", F.col("_m").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
    ).drop("_m")


def _below(sizes: DataFrame, by: list[str]) -> DataFrame:
    """Totals of all lower ranges; ``sizes`` has one row per range (and group)."""
    lower = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b")
    lower = lower.rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*by, "_b", F.coalesce(F.sum("_total").over(lower), F.lit(0)).alias("_below"))


def rank_counts(
    counts: DataFrame,
    value: str,
    count: str = "n",
    by: Sequence[str] = (),
    out: str = "rank",
    ranges: int | None = None,
) -> DataFrame:
    """Average rank of each distinct value, given one row per value and its count.

    A running count inside each range plus the total of the ranges below gives the last
    rank of a tie; the tie shares the mean of its ranks.
    """
    by = list(by)
    cut = in_ranges(counts, [*by, value], ranges).drop("_rn")
    totals = _below(cut.groupBy(*by, "_b").agg(F.sum(count).alias("_total")), by)
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("_below") + F.col("_cum")
    return (
        cut.withColumn("_cum", F.sum(count).over(inside))
        .join(totals, [*by, "_b"])
        .withColumn(out, last - (F.col(count) - 1) / 2.0)
        .drop("_b", "_cum", "_below")
    )


def rank_average(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    out: str = "rank",
    ranges: int | None = None,
) -> DataFrame:
    """Rank with ties sharing the mean rank, per group or over the whole table.

    Equal values collapse to one counted row before anything is sorted, so a
    value or a group that fills a large part of the table costs one row per map
    task and distinct value.  Rows without a value get no rank.  The table is written
    once, so that the counts and the rows they are joined to hold the same bits.
    """
    by = list(by)
    df = stage(df)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = rank_counts(counts, value, "_n", by, out, ranges).select(*by, value, out)
    return df.join(ranked, [*by, value], "left")


def rank_average_global(df: DataFrame, value: str, out: str = "rank", **kw) -> DataFrame:
    return rank_average(df, value, (), out, **kw)


def global_order(df: DataFrame, *order: str, out: str = "ord", ranges: int | None = None) -> DataFrame:
    """Number all rows 1..n by the order columns, without a window over the whole table."""
    cut = in_ranges(df, order, ranges)
    below = _below(cut.groupBy("_b").agg(F.count("*").alias("_total")), [])
    return (
        cut.join(F.broadcast(below), "_b")  # one row for each shuffle partition
        .withColumn(out, (F.col("_below") + F.col("_rn") + 1).cast("bigint"))
        .drop("_b", "_rn", "_below")
    )


def smallest_step(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """One row, ``step_us``: the smallest difference between distinct timestamps of the table."""
    times = df.select(F.unix_micros(column).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    cut = in_ranges(times, ["_t"], ranges)
    inside = Window.partitionBy("_b").orderBy("_t")
    gaps = cut.select((F.col("_t") - F.lag("_t").over(inside)).alias("gap"))
    ends = cut.groupBy("_b").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    between = ends.select((F.col("lo") - F.lag("hi").over(Window.orderBy("_b"))).alias("gap"))  # one row a range
    return gaps.unionByName(between).agg(F.min("gap").alias("step_us"))


def group_head(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of each group.  Spark cuts every map task's share of a
    group to ``n`` rows before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
