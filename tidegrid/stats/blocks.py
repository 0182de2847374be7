"""Blocks by groups: the shape all paired tests share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Samples:
    """Names the columns of a long sample table."""

    block: str = "block"
    grp: str = "grp"
    value: str = "v"


def group_names(df: DataFrame, samples: Samples = Samples()) -> list[str]:
    """The groups in name order: one name for each treatment that is compared.

    Name them yourself where the column may hold something else than treatments.
    """
    return sorted(r[0] for r in df.select(samples.grp).distinct().collect())


def block_rows(
    df: DataFrame,
    groups: Sequence[str],
    samples: Samples = Samples(),
    incomplete: str = "raise",
) -> DataFrame:
    """One row per block with ``vs``, its values in group order.

    The aggregate keeps one number per (block, group) on the map side, however
    many rows a block has.  A block that lacks a group, or holds one twice, stops
    the job or, with ``incomplete='drop'``, is left out.
    """
    if len(groups) < 2:
        raise ValueError("a test needs at least two groups")
    if incomplete not in ("raise", "drop"):
        raise ValueError(f"unknown choice: {incomplete}")
    is_group = [F.col(samples.grp) == F.lit(g) for g in groups]
    known = df.where(F.col(samples.grp).isin(list(groups)) & F.col(samples.value).isNotNull())
    blocks = known.groupBy(samples.block).agg(
        F.array(
            *[F.max(F.when(hit, F.col(samples.value).cast("double"))) for hit in is_group]
        ).alias("vs"),
        F.count(F.lit(1)).alias("_n"),
    )
    k = len(groups)
    whole = (F.col("_n") == k) & ~F.exists("vs", lambda v: v.isNull())
    if incomplete == "drop":
        return blocks.where(whole).drop("_n")
    checked = F.when(whole, F.col("vs")).otherwise(
        F.raise_error(F.lit("Unequal number of samples")).cast("array<double>")
    )
    return blocks.select(samples.block, checked.alias("vs"))


def ranks_within(vs: Column) -> Column:
    """Average ranks of the values of one block."""

    def rank(v: Column) -> Column:
        lower = F.size(F.filter(vs, lambda w: w < v))
        ties = F.size(F.filter(vs, lambda w: w == v))
        return lower + (ties + 1) / 2.0

    return F.transform(vs, rank)


def mean_of(vs: Column) -> Column:
    return total_of(vs) / F.size(vs)


def total_of(vs: Column) -> Column:
    return F.aggregate(vs, F.lit(0.0), lambda a, v: a + v)


def squares_of(vs: Column) -> Column:
    return F.aggregate(vs, F.lit(0.0), lambda a, v: a + v * v)


def sum_each(array: str, k: int, weight: Column | None = None) -> Column:
    """Aggregate an array column position by position."""
    parts = [F.col(array)[j] if weight is None else F.col(array)[j] * weight for j in range(k)]
    return F.array(*[F.sum(p) for p in parts])


def by_group(summary: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group from one row of arrays (named in ``columns``); the other
    columns, the statistic and its p-value, repeat."""
    rest = [c for c in summary.columns if c not in columns]
    names = F.array(*[F.lit(g) for g in groups]).alias("grp")
    zipped = F.arrays_zip(names, *[F.col(c) for c in columns])
    return summary.select(F.inline(zipped), *rest).toDF("grp", *columns, *rest)
