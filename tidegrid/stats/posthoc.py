"""Pairwise comparisons of pivots with corrections for multiple testing.

Input: one row per group (``grp``, ``pivot``), as the omnibus tests return.  The
comparison table has at most k(k-1)/2 rows for k treatments.  It is built from a
single row of arrays, and the step-down and step-up rules are running maxima over
the comparisons in order of their p-values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.special import p_normal, p_t


def _pivots(ranks: DataFrame) -> DataFrame:
    """One row: the groups in name order with their pivots."""
    entries = F.collect_list(F.struct(F.col("grp").cast("string").alias("grp"), "pivot"))
    return ranks.agg(F.array_sort(entries).alias("g"))


def _versus(first: Column, second: Column) -> Column:
    return F.struct(
        F.concat(first["grp"], F.lit(" vs "), second["grp"]).alias("comparison"),
        F.abs(first["pivot"] - second["pivot"]).alias("statistic"),
    )


def _against_control(ranks: DataFrame, control: str | None) -> DataFrame:
    """Control (the smallest pivot unless named) against each other group."""
    row = _pivots(ranks)
    if control is None:
        least = F.array_min(F.transform("g", lambda g: g["pivot"]))
        chosen = F.filter("g", lambda g: g["pivot"] == least)
    else:
        chosen = F.filter("g", lambda g: g["grp"] == control)
    row = row.withColumn("c", F.element_at(chosen, 1))
    rest = F.filter("g", lambda g: g["grp"] != F.col("c.grp"))
    return row.select(F.inline(F.transform(rest, lambda g: _versus(F.col("c"), g))))


def _all_pairs(ranks: DataFrame) -> DataFrame:
    later = lambda i: F.slice("g", i + 2, F.greatest(F.size("g") - i - 1, F.lit(0)))
    nested = F.transform("g", lambda a, i: F.transform(later(i), lambda b: _versus(a, b)))
    return _pivots(ranks).select(F.inline(F.flatten(nested)))


def _by_p(descending: bool = False):
    """Running frame over the comparisons in order of p-value.

    The larger the statistic, the smaller p; statistics equal to nine digits are ties,
    settled by name, so that rounding errors do not order them.
    """
    size, name = F.round("statistic", 9), F.col("comparison")
    order = [size.asc(), name.desc()] if descending else [size.desc(), name.asc()]
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _all():
    return Window.partitionBy(F.lit(0))


def _capped(p: Column) -> Column:
    return F.least(p, F.lit(1.0))


# position: 1-based place of the comparison in order of p; m: number of comparisons.
Adjust = Callable[[Column, Column, Column], Column]


def _adjusted(pairs: DataFrame, adjust: Adjust, p: Column | None = None) -> DataFrame:
    scored = pairs.withColumn("p_value", p_normal(F.col("statistic")) if p is None else p)
    placed = scored.withColumns(
        {
            "position": F.row_number().over(_by_p()),
            "_m": F.count(F.lit(1)).over(_all()).cast("double"),
        }
    )
    adj = adjust(F.col("p_value"), F.col("position").cast("double"), F.col("_m"))
    return placed.withColumn("p_adjusted", adj).drop("_m")


def _bonferroni(p, j, m):
    return _capped(m * p)


def _holm(p, j, m):
    return _capped(F.max((m + 1 - j) * p).over(_by_p()))


def _hochberg(method: str, cap: bool) -> Adjust:
    if method not in ("reference", "textbook"):
        raise ValueError(f"unknown method: {method}")
    step = F.max if method == "reference" else F.min

    def adjust(p, j, m):
        stepped = step((m + 1 - j) * p).over(_by_p(descending=True))
        return _capped(stepped) if cap or method == "textbook" else stepped

    return adjust


def _li(p, j, m):
    return p / (p + 1 - F.max(p).over(_all()))


def _finner(p, j, m):
    return _capped(F.max(1 - F.pow(1 - p, m / j)).over(_by_p()))


# ------------------------------------------------------------ against control


def bonferroni_dunn_test(ranks: DataFrame, control: str | None = None) -> DataFrame:
    return _adjusted(_against_control(ranks, control), _bonferroni)


def holm_test(ranks: DataFrame, control: str | None = None) -> DataFrame:
    return _adjusted(_against_control(ranks, control), _holm)


def hochberg_test(
    ranks: DataFrame, control: str | None = None, method: str = "reference"
) -> DataFrame:
    """``reference`` takes the largest of the remaining products, ``textbook`` the
    smallest, as the published step-up procedure does."""
    return _adjusted(_against_control(ranks, control), _hochberg(method, cap=True))


def li_test(ranks: DataFrame, control: str | None = None) -> DataFrame:
    return _adjusted(_against_control(ranks, control), _li)


def finner_test(ranks: DataFrame, control: str | None = None) -> DataFrame:
    return _adjusted(_against_control(ranks, control), _finner)


# ------------------------------------------------------------------ all pairs


def bonferroni_test(pivots: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """All pairs of parametric pivots, one-tailed t with ``nk - k`` degrees.

    ``n``, the length of the samples, is read from the pivots' ``n`` column unless
    it is given.
    """
    length = F.lit(n) if n is not None else pivots.agg(F.max("n")).scalar()
    degrees = length * k - k
    return _adjusted(_all_pairs(pivots), _bonferroni, p_t(F.col("statistic"), degrees))


def nemenyi_multitest(ranks: DataFrame) -> DataFrame:
    return _adjusted(_all_pairs(ranks), _bonferroni)


def holm_multitest(ranks: DataFrame) -> DataFrame:
    return _adjusted(_all_pairs(ranks), _holm)


def hochberg_multitest(ranks: DataFrame, method: str = "reference") -> DataFrame:
    return _adjusted(_all_pairs(ranks), _hochberg(method, cap=False))


def finner_multitest(ranks: DataFrame) -> DataFrame:
    return _adjusted(_all_pairs(ranks), _finner)


def true_hypotheses(k: int) -> list[int]:
    """Numbers of pairwise hypotheses that can be true together for k groups: the
    sums of s(s-1)/2 over the ways to split k groups into sets of equal means."""
    reachable = [{0}]
    for size in range(1, k + 1):
        reachable.append(
            {s * (s - 1) // 2 + rest for s in range(1, size + 1) for rest in reachable[size - s]}
        )
    return sorted(reachable[k])


def shaffer_multitest(ranks: DataFrame, k: int) -> DataFrame:
    """Holm's rule with the attainable number of true hypotheses as factor."""
    m = k * (k - 1) // 2
    counts = true_hypotheses(k)
    factors = F.array(*[F.lit(float(max(c for c in counts if c <= m - i))) for i in range(m)])

    def adjust(p, j, _):
        factor = F.element_at(factors, j.cast("int"))
        return _capped(F.max(factor * p).over(_by_p()))

    return _adjusted(_all_pairs(ranks), adjust)
