"""Hypothesis tests over calendar quarters (blocks) by order priority (groups).

The SQL side gets its tail probabilities independently: closed forms where the
degrees of freedom allow, exact sums, or Simpson integration of the density.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.tables import GROUPS, SAMPLES, samples, table
from tidegrid.functions.scalar import hypothesis_decision
from tidegrid.stats import omnibus, posthoc, twosample

K = len(GROUPS)
A, B = GROUPS[0], GROUPS[1]
DIGITS = 6

# P(F > f) for 4 and d2 degrees, and P(X > x) for 4 degrees, in closed form.
F4 = "pow({d2} / ({d2} + 4 * {f}), {d2} / 2) * (1 + {d2} / 2 * (1 - {d2} / ({d2} + 4 * {f})))"
CHI4 = "exp(-{x} / 2) * (1 + {x} / 2)"


def simpson(density: str, upper: str) -> str:
    """Integral of a density over u from 0 to ``upper``."""
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    u = f"(least({upper}, 40.0::DOUBLE) * i / 4000.0::DOUBLE)"
    return (
        f"(SELECT sum({weight} * {density.format(u=u)}) FROM generate_series(0, 4000) t(i))"
        f" * least({upper}, 40.0::DOUBLE) / 12000"
    )


NORMAL = "exp(-0.5::DOUBLE * pow({u}, 2)) / sqrt(2 * pi())"


def normal_p(z: str) -> str:
    return f"(1 - 2 * {simpson(NORMAL, f'abs({z})')})"


def t_p(t: str, df: str) -> str:
    """One-tailed, for t >= 0."""
    density = (
        f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
        f" * pow(1 + pow({{u}}, 2) / {df}, -({df} + 1) / 2)"
    )
    return f"(0.5::DOUBLE - {simpson(density, t)})"


def _run(test, spark, sf, **kw):
    return test(samples(spark, sf), GROUPS, **kw)


# ---------------------------------------------------------------- omnibus tests

RANKED = f"""
    SELECT block, grp, v, rank() OVER (PARTITION BY block ORDER BY v)
           + (count(*) OVER (PARTITION BY block, v) - 1) / 2.0::DOUBLE AS r FROM ({SAMPLES})"""

FRIEDMAN = f"""
    WITH g AS (SELECT grp, avg(r) AS mean_rank, count(*)::DOUBLE AS n FROM ({RANKED}) GROUP BY 1),
    c AS (SELECT max(n) AS n, 12 * max(n) / 30 * (sum(mean_rank * mean_rank) - 5 * 36 / 4) AS chi2 FROM g),
    s AS (SELECT n, chi2, (n - 1) * chi2 / (n * 4 - chi2) AS statistic FROM c)
    SELECT grp, mean_rank, mean_rank / sqrt(30 / (6 * s.n)) AS pivot, s.n, chi2, statistic,
           {F4.format(d2="(4 * (s.n - 1))", f="statistic")} AS p_value FROM g, s"""

RESULT = ["mean_rank", "pivot", "n", "statistic", "p_value"]


@query("friedman_test", rounded(FRIEDMAN, RESULT + ["chi2"], DIGITS))
def friedman_test(spark, sf):
    return finish(_run(omnibus.friedman_test, spark, sf), DIGITS)


@query("friedman_aligned_ranks_test", rounded(f"""
    WITH a AS (SELECT block, grp, round(v - avg(v) OVER (PARTITION BY block), 12) + 0.0 AS a FROM ({SAMPLES})),
    r AS (SELECT block, grp, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS r FROM a),
    g AS (SELECT grp, sum(r) AS rj, count(*)::DOUBLE AS n FROM r GROUP BY 1),
    b AS (SELECT sum(ri * ri) AS ri2 FROM (SELECT sum(r) AS ri FROM r GROUP BY block)),
    s AS (SELECT max(n) AS n, 4 * (sum(rj * rj) - 5 * pow(max(n), 2) / 4 * pow(5 * max(n) + 1, 2))
          / (5 * max(n) * (5 * max(n) + 1) * (10 * max(n) + 1) / 6 - max(ri2) / 5) AS statistic FROM g, b)
    SELECT grp, rj / s.n AS mean_rank, rj / s.n / sqrt(5 * (5 * s.n + 1) / 6) AS pivot, s.n, statistic,
           {CHI4.format(x="statistic")} AS p_value FROM g, s""", RESULT, DIGITS))
def friedman_aligned_ranks_test(spark, sf):
    return finish(_run(omnibus.friedman_aligned_ranks_test, spark, sf), DIGITS)


@query("quade_test", rounded(f"""
    WITH r AS (SELECT * FROM ({RANKED})),
    spans AS (SELECT block, max(v) - min(v) AS span FROM r GROUP BY 1),
    q AS (SELECT block, rank() OVER (ORDER BY span) + (count(*) OVER (PARTITION BY span) - 1) / 2.0::DOUBLE AS q FROM spans),
    j AS (SELECT grp, sum(q * (r - 3)) AS s, sum(q * r) AS w, sum(pow(q * (r - 3), 2)) AS a, count(*)::DOUBLE AS n
          FROM r JOIN q USING (block) GROUP BY 1),
    ab AS (SELECT max(n) AS n, sum(a) AS a, sum(s * s) / max(n) AS b FROM j),
    s AS (SELECT n, (n - 1) * b / (a - b) AS statistic FROM ab)
    SELECT grp, w / (s.n * (s.n + 1) / 2) AS mean_rank,
           w / (s.n * (s.n + 1) / 2) / sqrt(30 * (2 * s.n + 1) * 4 / (18 * s.n * (s.n + 1))) AS pivot,
           s.n, statistic, {F4.format(d2="(4 * (s.n - 1))", f="statistic")} AS p_value FROM j, s""", RESULT, DIGITS))
def quade_test(spark, sf):
    return finish(_run(omnibus.quade_test, spark, sf), DIGITS)


def _anova_sql(error: str, d2: str) -> str:
    return f"""
    WITH s AS ({SAMPLES}),
    g AS (SELECT grp, avg(v) AS mean_value, var_pop(v) AS var, count(*)::DOUBLE AS n FROM s GROUP BY 1),
    b AS (SELECT var_pop(m) AS block_var FROM (SELECT avg(v) AS m FROM s GROUP BY block)),
    ss AS (SELECT max(n) AS n, max(n) * 5 * var_pop(mean_value) AS bg, max(n) * sum(var) AS wg,
                  max(n) * 5 * max(block_var) AS bs FROM g, b),
    t AS (SELECT n, wg, (bg / 4) / ({error} / ({d2})) AS statistic, ({d2}) AS d2 FROM ss)
    SELECT grp, mean_value, mean_value / sqrt(2 * (wg / (t.n * 5 - 5)) / t.n) AS pivot, t.n, statistic,
           {F4.format(d2="d2", f="statistic")} AS p_value FROM g, t"""


ANOVA = _anova_sql("wg", "n * 5 - 5")
MEANS = ["mean_value", "pivot", "n", "statistic", "p_value"]


@query("anova_test", rounded(ANOVA, MEANS, DIGITS))
def anova_test(spark, sf):
    return finish(_run(omnibus.anova_test, spark, sf), DIGITS)


@query("anova_within_test", rounded(_anova_sql("(wg - bs)", "(n - 1) * 4"), MEANS, DIGITS))
def anova_within_test(spark, sf):
    return finish(_run(omnibus.anova_within_test, spark, sf), DIGITS)


# --------------------------------------------------------------------- post-hoc


def _posthoc_sql(pairs: str, p: str, adjusted: str) -> str:
    return rounded(f"""
    WITH pivots AS ({pairs}),
    p AS (SELECT comparison, statistic, {p} AS p_value FROM pivots),
    o AS (SELECT *, row_number() OVER (ORDER BY round(statistic, 9) DESC, comparison)::INT AS position, count(*) OVER () AS m FROM p)
    SELECT comparison, statistic, p_value, position, {adjusted} AS p_adjusted FROM o""",
        ["statistic", "p_value", "p_adjusted"], DIGITS)


CONTROL_PAIRS = f"""
    SELECT c.grp || ' vs ' || r.grp AS comparison, abs(c.pivot - r.pivot) AS statistic
    FROM (SELECT * FROM ({FRIEDMAN}) c0 ORDER BY c0.pivot, c0.grp LIMIT 1) c, ({FRIEDMAN}) r WHERE r.grp <> c.grp"""


def _all_pairs_sql(source):
    return f"""
    SELECT a.grp || ' vs ' || b.grp AS comparison, abs(a.pivot - b.pivot) AS statistic, a.n AS n
    FROM ({source}) a JOIN ({source}) b ON a.grp < b.grp"""


ALL_PAIRS = _all_pairs_sql(FRIEDMAN)
DOWN = "OVER (ORDER BY position ROWS UNBOUNDED PRECEDING)"
UP = "OVER (ORDER BY position DESC ROWS UNBOUNDED PRECEDING)"
ADJUST = {
    "bonferroni": "least(m * p_value, 1)",
    "holm": f"least(max((m + 1 - position) * p_value) {DOWN}, 1)",
    "hochberg": f"least(max((m + 1 - position) * p_value) {UP}, 1)",
    "hochberg_textbook": f"least(min((m + 1 - position) * p_value) {UP}, 1)",
    "hochberg_open": f"max((m + 1 - position) * p_value) {UP}",
    "li": "p_value / (p_value + 1 - max(p_value) OVER ())",
    "finner": f"least(max(1 - pow(1 - p_value, m / position::DOUBLE)) {DOWN}, 1)",
    # Attainable numbers of true hypotheses for five groups: 0, 1, 2, 3, 4, 6, 10.
    "shaffer": f"least(max(([10, 6, 6, 6, 6, 4, 4, 3, 2, 1])[position] * p_value) {DOWN}, 1)",
}


def _posthoc(name, pairs, adjust, run):
    @query(name, _posthoc_sql(pairs, normal_p("statistic"), ADJUST[adjust]))
    def build(spark, sf):
        return finish(run(_run(omnibus.friedman_test, spark, sf).select("grp", "pivot")), DIGITS)

    return build


_posthoc("bonferroni_dunn_test", CONTROL_PAIRS, "bonferroni", posthoc.bonferroni_dunn_test)
_posthoc("holm_test", CONTROL_PAIRS, "holm", posthoc.holm_test)
_posthoc("hochberg_test", CONTROL_PAIRS, "hochberg", posthoc.hochberg_test)
_posthoc("hochberg_textbook_test", CONTROL_PAIRS, "hochberg_textbook", lambda r: posthoc.hochberg_test(r, method="textbook"))
_posthoc("li_test", CONTROL_PAIRS, "li", posthoc.li_test)
_posthoc("finner_test", CONTROL_PAIRS, "finner", posthoc.finner_test)
_posthoc("nemenyi_multitest", ALL_PAIRS, "bonferroni", posthoc.nemenyi_multitest)
_posthoc("holm_multitest", ALL_PAIRS, "holm", posthoc.holm_multitest)
_posthoc("hochberg_multitest", ALL_PAIRS, "hochberg_open", posthoc.hochberg_multitest)
_posthoc("finner_multitest", ALL_PAIRS, "finner", posthoc.finner_multitest)
_posthoc("shaffer_multitest", ALL_PAIRS, "shaffer", lambda r: posthoc.shaffer_multitest(r, K))


@query("bonferroni_test", rounded(f"""
    WITH pairs AS ({_all_pairs_sql(ANOVA)}),
    p AS (SELECT comparison, statistic, {t_p("statistic", "(n * 5 - 5)")} AS p_value FROM pairs)
    SELECT comparison, statistic, p_value, row_number() OVER (ORDER BY round(statistic, 9) DESC, comparison)::INT AS position,
           least(10 * p_value, 1) AS p_adjusted FROM p""", ["statistic", "p_value", "p_adjusted"], DIGITS))
def bonferroni_test(spark, sf):
    return finish(posthoc.bonferroni_test(_run(omnibus.anova_test, spark, sf), K), DIGITS)


@query("hypothesis_decision", f"""
    SELECT comparison, p_value <= 0.05 AS rejected,
           CASE WHEN p_value > 0.05 THEN 'not enough evidence for: a difference (fail to reject H0)'
                ELSE 'significant evidence for: a difference (reject H0)' END AS decision
    FROM (SELECT comparison, {normal_p("statistic")} AS p_value FROM ({ALL_PAIRS}))""")
def hypothesis_decision_(spark, sf):
    pairs = posthoc.nemenyi_multitest(_run(omnibus.friedman_test, spark, sf).select("grp", "pivot"))
    return pairs.select("comparison", hypothesis_decision(F.col("p_value"), "a difference").alias("h")).select(
        "comparison", "h.rejected", "h.decision"
    )


# ------------------------------------------------------------------- two samples

PAIRS = f"""
    SELECT * FROM (SELECT block, max(CASE WHEN grp = '{A}' THEN v END) AS a, max(CASE WHEN grp = '{B}' THEN v END) AS b
                   FROM ({SAMPLES}) GROUP BY 1)"""


@query("binomial_sign_test", rounded(f"""
    WITH s AS (SELECT count(*) FILTER (a < b) AS n_plus, count(*) FILTER (a > b) AS n_minus FROM ({PAIRS})),
    x AS (SELECT *, greatest(n_plus, n_minus)::DOUBLE AS statistic, (n_plus + n_minus)::DOUBLE AS n FROM s)
    SELECT n_plus, n_minus, statistic, 2 * (SELECT coalesce(sum(exp(
        lgamma(n + 1) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))), 0)
        FROM generate_series((statistic + 1)::BIGINT, n::BIGINT) t(i)) AS p_value FROM x""",
    ["statistic", "p_value"], DIGITS))
def binomial_sign_test(spark, sf):
    return finish(twosample.binomial_sign_test(samples(spark, sf), A, B), DIGITS)


@query("ttest_ind", rounded(f"""
    WITH m AS (SELECT count(*) FILTER (grp = '{A}')::DOUBLE AS n_a, count(*) FILTER (grp = '{B}')::DOUBLE AS n_b,
                      avg(v) FILTER (grp = '{A}') AS mean_a, avg(v) FILTER (grp = '{B}') AS mean_b,
                      var_samp(v) FILTER (grp = '{A}') AS va, var_samp(v) FILTER (grp = '{B}') AS vb FROM ({SAMPLES})),
    t AS (SELECT n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(
              ((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)) AS statistic FROM m)
    SELECT *, 2 * {t_p("abs(statistic)", "(n_a + n_b - 2)")} AS p_value FROM t""",
    ["n_a", "n_b", "mean_a", "mean_b", "statistic", "p_value"], DIGITS))
def ttest_ind(spark, sf):
    return finish(twosample.ttest_ind(samples(spark, sf), A, B), DIGITS)


@query("ttest_rel", rounded(f"""
    WITH m AS (SELECT count(*)::DOUBLE AS n, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd FROM ({PAIRS})),
    t AS (SELECT n, mean_diff, mean_diff / (sd / sqrt(n)) AS statistic FROM m)
    SELECT *, 2 * {t_p("abs(statistic)", "(n - 1)")} AS p_value FROM t""",
    ["n", "mean_diff", "statistic", "p_value"], DIGITS))
def ttest_rel(spark, sf):
    return finish(twosample.ttest_rel(samples(spark, sf), A, B), DIGITS)


# The same means without the rounding that ties them: a test from counts needs distinct values.
UNTIED = SAMPLES.replace("floor(avg(o_totalprice) / 1000)", "avg(o_totalprice)")


def untied(spark, sf):
    means = table(spark, sf, "orders").groupBy(
        (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("block"), F.col("o_orderpriority").alias("grp")
    )
    return means.agg(F.avg("o_totalprice").alias("v"))


SIGNED_RANKS = f"""
    WITH d AS (SELECT a - b AS d FROM ({PAIRS}) WHERE a <> b),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r,
                 count(*) OVER (PARTITION BY abs(d)) AS t FROM d),
    s AS (SELECT count(*)::DOUBLE AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus,
                 sum(t * t - 1)::DOUBLE AS ties FROM r),
    z AS (SELECT n, w_plus, w_minus, least(w_plus, w_minus) AS statistic,
                 (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)"""
SIGNED = ["n", "w_plus", "w_minus", "statistic", "z", "p_value"]


@query("wilcoxon", rounded(f"{SIGNED_RANKS} SELECT *, {normal_p('z')} AS p_value FROM z", SIGNED, DIGITS))
def wilcoxon(spark, sf):
    return finish(twosample.wilcoxon(samples(spark, sf), A, B, method="approx"), DIGITS)


# Ways to reach each sum of positive ranks, rank after rank.
@query("wilcoxon_exact", rounded(f"""
    WITH RECURSIVE {SIGNED_RANKS.replace(SAMPLES, UNTIED).strip().removeprefix("WITH")},
    c AS (SELECT 0 AS i, [1.0::DOUBLE] AS ways
          UNION ALL SELECT i + 1, list_transform(generate_series(1, len(ways) + i + 1),
              lambda k: coalesce(ways[k], 0) + CASE WHEN k > i + 1 THEN ways[k - i - 1] ELSE 0 END)
          FROM c WHERE i < (SELECT n FROM z))
    SELECT z.*, least(2 * list_sum(ways[1:statistic::INT + 1]) / pow(2, n), 1.0) AS p_value
    FROM z JOIN c ON c.i = z.n""", SIGNED, DIGITS))
def wilcoxon_exact(spark, sf):
    return finish(twosample.wilcoxon(untied(spark, sf), A, B, method="exact"), DIGITS)


RANK_SUMS = f"""
    WITH r AS (SELECT grp, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r,
                      count(*) OVER (PARTITION BY v) AS t FROM ({SAMPLES}) WHERE grp IN ('{A}', '{B}')),
    s AS (SELECT count(*) FILTER (grp = '{A}')::DOUBLE AS n_a, count(*) FILTER (grp = '{B}')::DOUBLE AS n_b,
                 sum(r) FILTER (grp = '{A}') AS ra, sum(t * t - 1)::DOUBLE AS ties, count(*)::DOUBLE AS n FROM r),
    u AS (SELECT *, ra - n_a * (n_a + 1) / 2 AS u FROM s),
    z AS (SELECT n_a, n_b, u AS statistic, (greatest(u, n_a * n_b - u) - n_a * n_b / 2 - 0.5)
                 / sqrt(n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)"""
SUMMED = ["n_a", "n_b", "statistic", "z", "p_value"]


@query("mannwhitneyu", rounded(f"{RANK_SUMS} SELECT *, least({normal_p('greatest(z, 0)')}, 1) AS p_value FROM z", SUMMED, DIGITS))
def mannwhitneyu(spark, sf):
    return finish(twosample.mannwhitneyu(samples(spark, sf), A, B, method="approx"), DIGITS)


# The counts are the coefficients of a product of (1 - q^(n_b + i)) / (1 - q^i), factor by factor.
@query("mannwhitneyu_exact", rounded(f"""
    WITH RECURSIVE {RANK_SUMS.replace(SAMPLES, UNTIED).strip().removeprefix("WITH")},
    size AS (SELECT n_a::INT AS a, n_b::INT AS b, (n_a * n_b)::INT AS top FROM z),
    c AS (SELECT 0 AS i, list_transform(generate_series(0, top), lambda k: (k = 0)::INT::DOUBLE) AS ways FROM size
          UNION ALL SELECT i + 1, list_transform(generate_series(1, top + 1), lambda k: list_sum(list_transform(
              generate_series(0, ((k - 1) // (i + 1))::INT), lambda t: ways[k - t * (i + 1)]
                  - CASE WHEN k - t * (i + 1) > b + i + 1 THEN ways[k - t * (i + 1) - b - i - 1] ELSE 0 END)))
          FROM c, size WHERE i < a)
    SELECT z.*, least(2 * list_sum(ways[greatest(statistic, n_a * n_b - statistic)::INT + 1:]) / list_sum(ways), 1.0) AS p_value
    FROM z JOIN c ON c.i = z.n_a""", SUMMED, DIGITS))
def mannwhitneyu_exact(spark, sf):
    return finish(twosample.mannwhitneyu(untied(spark, sf), A, B, method="exact"), DIGITS)
