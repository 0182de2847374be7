"""Tests of two samples, each one row of result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import ratio
from tidegrid.functions.special import p_normal, p_sign, p_t_two_sided
from tidegrid.operators.ranks import rank_counts
from tidegrid.session import stage
from tidegrid.stats.blocks import Samples, block_rows


def _pairs(df: DataFrame, a: str, b: str, samples: Samples, incomplete: str) -> DataFrame:
    blocks = block_rows(df, [a, b], samples, incomplete)
    return blocks.select(F.col("vs")[0].alias("a"), F.col("vs")[1].alias("b"))


def binomial_sign_test(
    df: DataFrame, a: str, b: str, samples: Samples = Samples(), incomplete: str = "raise"
) -> DataFrame:
    """Larger count of signs; p = 2 P(X > x) with ties dropped."""
    signs = _pairs(df, a, b, samples, incomplete).agg(
        F.count_if(F.col("a") < F.col("b")).alias("n_plus"),
        F.count_if(F.col("a") > F.col("b")).alias("n_minus"),
    )
    x = F.greatest("n_plus", "n_minus")
    out = signs.withColumn("statistic", x.cast("double"))
    return out.withColumn("p_value", p_sign(F.col("statistic"), F.col("n_plus") + F.col("n_minus")))


def ttest_ind(df: DataFrame, a: str, b: str, samples: Samples = Samples()) -> DataFrame:
    """Two independent samples, pooled variance."""
    rows = df.where(F.col(samples.grp).isin(a, b))
    value = F.col(samples.value).cast("double")
    parts = {}
    for side, name in (("a", a), ("b", b)):
        own = F.when(F.col(samples.grp) == name, value)
        parts[side] = [
            F.count(own).cast("double").alias(f"n_{side}"),
            F.avg(own).alias(f"mean_{side}"),
            F.var_samp(own).alias(f"_var_{side}"),
        ]
    m = rows.agg(*parts["a"], *parts["b"])
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = ratio((na - 1) * F.col("_var_a") + (nb - 1) * F.col("_var_b"), na + nb - 2)
    each = ratio(na + nb, na * nb)
    t = ratio(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled * each))
    out = m.select("n_a", "n_b", "mean_a", "mean_b", t.alias("statistic"))
    return out.withColumn("p_value", p_t_two_sided(F.col("statistic"), na + nb - 2))


def ttest_rel(
    df: DataFrame, a: str, b: str, samples: Samples = Samples(), incomplete: str = "raise"
) -> DataFrame:
    """Paired samples."""
    d = _pairs(df, a, b, samples, incomplete).select((F.col("a") - F.col("b")).alias("d"))
    m = d.agg(
        F.count("d").cast("double").alias("n"),
        F.avg("d").alias("mean_diff"),
        F.stddev_samp("d").alias("_sd"),
    )
    out = m.select(
        "n", "mean_diff", ratio(F.col("mean_diff") * F.sqrt("n"), F.col("_sd")).alias("statistic")
    )
    return out.withColumn("p_value", p_t_two_sided(F.col("statistic"), F.col("n") - 1))


# ``method="auto"`` is exact up to these sizes, if no values are tied.
EXACT_PAIRS = 50
EXACT_SMALLER, EXACT_PRODUCT = 8, 4000


def _padded(counts: Column, before: Column, after: Column) -> Column:
    zeros = F.array(F.lit(0.0))
    return F.concat(F.array_repeat(zeros[0], before.cast("int")), counts, F.array_repeat(zeros[0], after.cast("int")))


def _added(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda total, n: total + n)


def signed_rank_counts(n: Column) -> Column:
    """How many of the 2^n choices of signs give each sum 0, 1, … of positive ranks:
    c(n, w) = c(n - 1, w) + c(n - 1, w - n)."""
    none = F.lit(0)
    steps = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps, F.array(F.lit(1.0)), lambda counts, i: _added(_padded(counts, none, i), _padded(counts, i, none))
    )


def rank_sum_counts(n_a: Column, n_b: Column) -> Column:
    """How many choices of ``n_a`` of ``n_a + n_b`` ranks give each U = 0, 1, …:
    c(a, b, u) = c(a - 1, b, u - b) + c(a, b - 1, u).

    One pass per b over the lists of a = 0, 1, …, each list made from the one before it and
    from its own of b - 1.
    """
    none = F.lit(0)
    start = F.array_repeat(F.array(F.lit(1.0)), n_a.cast("int") + 1)

    def larger(lists: Column, b: Column) -> Column:
        def longer(made: Column, a: Column) -> Column:
            new = _added(_padded(F.element_at(made, -1), b, none), _padded(lists[a], none, a))
            return F.concat(made, F.array(new))

        return F.aggregate(F.sequence(F.lit(1), n_a.cast("int")), F.slice(lists, 1, 1), longer)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n_b.cast("int")), start, larger), -1)


def _method(method: str, small: Column, tied: Column, exact: Column, approx: Column) -> Column:
    """The p-value of the method asked for; an exact one is missing where values are tied."""
    if method == "approx":
        return approx
    if method == "exact":
        return F.when(~tied, exact)
    if method != "auto":
        raise ValueError(f"no such method: {method}")
    return F.when(small & ~tied, exact).otherwise(approx)


def wilcoxon(
    df: DataFrame,
    a: str,
    b: str,
    samples: Samples = Samples(),
    incomplete: str = "raise",
    digits: int = 12,
    method: str = "auto",
) -> DataFrame:
    """Signed ranks, zero differences dropped.

    ``method``: ``approx``, the normal approximation with ties; ``exact``, from the number of
    sign choices for each sum, missing where sizes are tied; ``auto``, exact for up to 50 pairs
    without ties or zeros.  Differences are counted per size and sign before they are ranked.
    """
    d = _pairs(df, a, b, samples, incomplete).select(
        F.round(F.col("a") - F.col("b"), digits).alias("d")
    )
    sizes = d.where(F.col("d").isNotNull()).groupBy(F.abs("d").alias("size")).agg(
        F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("_up")
    )
    if method == "auto":
        sizes = stage(sizes)  # read twice: for its zeros and for the ranks
    zeros = sizes.where(F.col("size") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_zeros"))
    ranked = rank_counts(sizes.where(F.col("size") != 0), "size")
    t = F.col("n").cast("double")
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"),
        F.sum(F.col("rank") * F.col("_up")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("n") - F.col("_up"))).alias("w_minus"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    w = F.least("w_plus", "w_minus")
    out = sums.select(
        "n", "w_plus", "w_minus", w.alias("statistic"), ratio(w - n * (n + 1) / 4, spread).alias("z"), "_ties"
    )
    if method == "auto":  # one row each
        out = out.join(zeros).withColumn("_tied", (F.col("_ties") > 0) | (F.col("_zeros") > 0)).drop("_zeros")
    else:
        out = out.withColumn("_tied", F.coalesce(F.col("_ties") > 0, F.lit(False)))
    counts = signed_rank_counts(n)
    below = _total(F.slice(counts, 1, F.floor(F.col("statistic")).cast("int") + 1))
    exact = F.when(n >= 1, F.least(2 * below / F.pow(F.lit(2.0), n), F.lit(1.0)))
    p = _method(method, n <= EXACT_PAIRS, F.col("_tied"), exact, p_normal(F.col("z")))
    return out.withColumn("p_value", p).drop("_ties", "_tied")


def mannwhitneyu(
    df: DataFrame, a: str, b: str, samples: Samples = Samples(), method: str = "auto"
) -> DataFrame:
    """U of the first sample, two-sided.

    ``method``: ``approx``, the normal approximation with tie and continuity correction;
    ``exact``, from the number of choices of ranks for each U, missing where values are tied;
    ``auto``, exact without ties where one sample has at most 8 values and the product of
    both sizes is at most 4000.
    """
    rows = df.where(F.col(samples.grp).isin(a, b) & F.col(samples.value).isNotNull())
    counts = rows.groupBy(F.col(samples.value).cast("double").alias("v")).agg(
        F.count("*").alias("n"), F.count_if(F.col(samples.grp) == a).alias("_a")
    )
    ranked = rank_counts(counts, "v")
    t = F.col("n").cast("double")
    sums = ranked.agg(
        F.sum("_a").cast("double").alias("n_a"),
        F.sum(F.col("n") - F.col("_a")).cast("double").alias("n_b"),
        F.sum(F.col("rank") * F.col("_a")).alias("_ra"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    na, nb = F.col("n_a"), F.col("n_b")
    n = na + nb
    u = F.col("_ra") - na * (na + 1) / 2
    spread = F.sqrt(na * nb / 12 * (n + 1 - ratio(F.col("_ties"), n * (n - 1))))
    larger = F.greatest(u, na * nb - u)
    z = ratio(larger - na * nb / 2 - 0.5, spread)
    out = sums.select("n_a", "n_b", u.alias("statistic"), z.alias("z"), "_ties")
    counts = rank_sum_counts(na, nb)
    far = F.greatest(F.col("statistic"), na * nb - F.col("statistic")).cast("int")
    above = _total(F.slice(counts, far + 1, F.size(counts)))
    both = (na >= 1) & (nb >= 1)
    exact = F.when(both, F.least(2 * above / _total(counts), F.lit(1.0)))
    approx = F.least(p_normal(F.greatest(F.col("z"), F.lit(0.0))), F.lit(1.0))
    small = (F.least(na, nb) <= EXACT_SMALLER) & (na * nb <= EXACT_PRODUCT)
    tied = F.coalesce(F.col("_ties") > 0, F.lit(False))
    return out.withColumn("p_value", _method(method, small, tied, exact, approx)).drop("_ties")
