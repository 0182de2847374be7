"""Tests of equality over k samples.

Each returns one row per group (mean rank or mean, and the pivot the post-hoc
tests take) with the test's statistic and p-value repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import ratio
from tidegrid.functions.special import p_chi2, p_f
from tidegrid.operators.ranks import rank_counts
from tidegrid.session import stage
from tidegrid.stats.blocks import (
    Samples,
    block_rows,
    by_group,
    group_names,
    mean_of,
    ranks_within,
    squares_of,
    sum_each,
    total_of,
)


def _start(df, groups, samples, incomplete) -> tuple[list[str], DataFrame]:
    names = list(groups) if groups is not None else group_names(df, samples)
    return names, block_rows(df, names, samples, incomplete)


def _scaled(array: str, factor: Column) -> Column:
    return F.transform(array, lambda v: v * factor)


def _over(array: str, divisor: Column) -> Column:
    return F.transform(array, lambda v: ratio(v, divisor))


# --------------------------------------------------------------- parametric


def _variances(blocks: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Between, within and block sums of squares, from one pass.

    Deviations are combined from per-group moments (the aggregate merges means
    and squared deviations), which keeps digits that raw sums of squares lose.
    """
    k = len(groups)
    moments = blocks.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.avg(F.col("vs")[j]) for j in range(k)]).alias("mean_value"),
        F.array(*[F.var_pop(F.col("vs")[j]) for j in range(k)]).alias("_var"),
        F.var_pop(mean_of(F.col("vs"))).alias("_block_var"),
    )
    centre = mean_of(F.col("mean_value"))
    apart = F.aggregate(
        "mean_value", F.lit(0.0), lambda a, m: a + (m - centre) * (m - centre)
    )
    return moments.withColumns(
        {
            "ss_bg": F.col("n") * apart,
            "ss_wg": F.col("n") * total_of(F.col("_var")),
            "ss_bs": F.col("n") * k * F.col("_block_var"),
        }
    )


def _anova_rows(squares: DataFrame, groups, error: Column, df2: Column) -> DataFrame:
    k = len(groups)
    within = ratio(F.col("ss_wg"), F.col("n") * k - k)
    out = squares.select(
        "n",
        "mean_value",
        _over("mean_value", F.sqrt(ratio(F.lit(2.0) * within, F.col("n")))).alias("pivot"),
        ratio(F.col("ss_bg") / (k - 1), error).alias("statistic"),
        df2.alias("_df2"),
    ).withColumn("p_value", p_f(F.col("statistic"), F.lit(float(k - 1)), F.col("_df2")))
    return by_group(out.drop("_df2"), groups, ["mean_value", "pivot"])


def anova_test(
    df: DataFrame,
    groups: Sequence[str] | None = None,
    samples: Samples = Samples(),
    incomplete: str = "raise",
) -> DataFrame:
    """One-way analysis of variance of equally long samples."""
    names, blocks = _start(df, groups, samples, incomplete)
    k = len(names)
    squares = _variances(blocks, names)
    free = F.col("n") * k - k
    return _anova_rows(squares, names, ratio(F.col("ss_wg"), free), free)


def anova_within_test(
    df: DataFrame,
    groups: Sequence[str] | None = None,
    samples: Samples = Samples(),
    incomplete: str = "raise",
) -> DataFrame:
    """Repeated-measures analysis of variance; pivots use the within mean square."""
    names, blocks = _start(df, groups, samples, incomplete)
    squares = _variances(blocks, names)
    free = (F.col("n") - 1) * (len(names) - 1)
    return _anova_rows(squares, names, ratio(F.col("ss_wg") - F.col("ss_bs"), free), free)


# --------------------------------------------------------------- rank based


def friedman_test(
    df: DataFrame,
    groups: Sequence[str] | None = None,
    samples: Samples = Samples(),
    incomplete: str = "raise",
) -> DataFrame:
    """Mean ranks within blocks; Iman and Davenport's F of the chi-square."""
    names, blocks = _start(df, groups, samples, incomplete)
    k = float(len(names))
    n = F.col("n")
    ranked = blocks.select(ranks_within(F.col("vs")).alias("r"))
    means = ranked.agg(F.count(F.lit(1)).cast("double").alias("n"), sum_each("r", len(names)).alias("_s"))
    means = means.select("n", _over("_s", n).alias("mean_rank"))
    chi2 = 12 * n / (k * (k + 1)) * (squares_of(F.col("mean_rank")) - k * (k + 1) ** 2 / 4)
    out = means.select(
        "n",
        "mean_rank",
        _scaled("mean_rank", F.sqrt(6 * n / (k * (k + 1)))).alias("pivot"),
        chi2.alias("chi2"),
        ratio((n - 1) * chi2, n * (k - 1) - chi2).alias("statistic"),
    )
    p = p_f(F.col("statistic"), F.lit(k - 1), (k - 1) * (n - 1))
    return by_group(out.withColumn("p_value", p), names, ["mean_rank", "pivot"])


def friedman_aligned_ranks_test(
    df: DataFrame,
    groups: Sequence[str] | None = None,
    samples: Samples = Samples(),
    incomplete: str = "raise",
    digits: int = 12,
) -> DataFrame:
    """Values minus their block's mean, ranked over the whole table.

    Aligned values are rounded to ``digits`` so that equal differences tie whatever
    order a mean was summed in.  Each distinct value is ranked once and its rank
    joined back to the blocks that hold it.
    """
    names, blocks = _start(df, groups, samples, incomplete)
    k = float(len(names))
    # Ranks are joined back by value: both reads must see the same bits.
    blocks = stage(blocks)
    aligned = blocks.select(
        samples.block,
        F.posexplode(
            F.transform("vs", lambda v: F.round(v - mean_of(F.col("vs")), digits))
        ).alias("_j", "a"),
    ).withColumn("a", F.col("a") + F.lit(0.0))
    ranks = rank_counts(aligned.groupBy("a").agg(F.count("*").alias("n")), "a")
    ranked = aligned.join(ranks.select("a", "rank"), "a")
    per_block = ranked.groupBy(samples.block).agg(
        F.sum("rank").alias("_ri"),
        F.array(
            *[F.sum(F.when(F.col("_j") == j, F.col("rank"))) for j in range(len(names))]
        ).alias("r"),
    )
    sums = per_block.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        sum_each("r", len(names)).alias("_rj"),
        F.sum(F.col("_ri") * F.col("_ri")).alias("_ri2"),
    )
    n = F.col("n")
    kn = k * n
    top = squares_of(F.col("_rj")) - k * n * n / 4 * (kn + 1) * (kn + 1)
    bottom = kn * (kn + 1) * (2 * kn + 1) / 6 - F.col("_ri2") / k
    out = sums.select(
        "n",
        _over("_rj", n).alias("mean_rank"),
        _over("_rj", n * F.sqrt(k * (kn + 1) / 6)).alias("pivot"),
        ratio((k - 1) * top, bottom).alias("statistic"),
    )
    p = p_chi2(F.col("statistic"), F.lit(k - 1))
    return by_group(out.withColumn("p_value", p), names, ["mean_rank", "pivot"])


def quade_test(
    df: DataFrame,
    groups: Sequence[str] | None = None,
    samples: Samples = Samples(),
    incomplete: str = "raise",
) -> DataFrame:
    """Ranks within blocks weighted by the rank of the block's range.

    Blocks with the same range share a weight, so they are summed per range
    before the ranges are ranked; nothing is joined back to the blocks.
    """
    names, blocks = _start(df, groups, samples, incomplete)
    size = len(names)
    k = float(size)
    centred = F.transform("r", lambda r: r - (k + 1) / 2)
    spans = blocks.select(
        (F.array_max("vs") - F.array_min("vs")).alias("span"), ranks_within(F.col("vs")).alias("r")
    )
    per_span = spans.groupBy("span").agg(
        F.count("*").alias("n"),
        sum_each("r", size).alias("_r"),
        F.sum(squares_of(centred)).alias("_c2"),
    )
    weighted = rank_counts(per_span, "span", out="q")
    sums = weighted.agg(
        F.sum("n").cast("double").alias("n"),
        sum_each("_r", size, F.col("q")).alias("_w"),
        F.sum(F.col("q") * F.col("n")).alias("_q"),
        F.sum(F.col("_c2") * F.col("q") * F.col("q")).alias("_a"),
    )
    n = F.col("n")
    s = F.transform("_w", lambda w: w - F.col("_q") * (k + 1) / 2)
    b = ratio(squares_of(s), n)
    blocks_sum = n * (n + 1) / 2
    scale = F.sqrt(ratio(k * (k + 1) * (2 * n + 1) * (k - 1), 18 * n * (n + 1)))
    out = sums.select(
        "n",
        _over("_w", blocks_sum).alias("mean_rank"),
        _over("_w", blocks_sum * scale).alias("pivot"),
        ratio((n - 1) * b, F.col("_a") - b).alias("statistic"),
    )
    p = p_f(F.col("statistic"), F.lit(k - 1), (k - 1) * (n - 1))
    return by_group(out.withColumn("p_value", p), names, ["mean_rank", "pivot"])
