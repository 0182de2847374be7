"""Hypothesis tests against published results and direct computation."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import special as sp
from tidegrid.stats import omnibus, posthoc, twosample
from tidegrid.stats.blocks import group_names

DATA = {"A": [3, 4, 5, 6, 1, 5], "B": [4, 3, 2, 1, 2, 6], "C": [4, 3, 5, 6, 3, 7]}


def long(spark, data):
    rows = [(b, g, float(v)) for g, vs in data.items() for b, v in enumerate(vs)]
    return spark.createDataFrame(rows, "block int, grp string, v double")


@pytest.fixture(scope="module")
def df(spark):
    return long(spark, DATA).cache()


def table(result):
    return {r.grp: r for r in result.collect()}


@pytest.mark.parametrize(
    "test,ranks,statistic,p",
    [
        (omnibus.friedman_test, (1.8333, 1.6667, 2.5), 1.2068965517, 0.3392),
        (omnibus.friedman_aligned_ranks_test, (9.3333, 6.1667, 13.0), 3.7024551118, 0.1570),
        (omnibus.quade_test, (1.9286, 1.4762, 2.5952), 2.3137417219, 0.1493),
    ],
)
def test_rank_tests(df, test, ranks, statistic, p):
    out = table(test(df))
    assert tuple(round(out[g].mean_rank, 4) for g in "ABC") == ranks
    assert out["A"].statistic == pytest.approx(statistic)
    assert out["A"].p_value == pytest.approx(p, abs=1e-4)


def test_friedman_pivots(df):
    out = table(omnibus.friedman_test(df))
    assert [out[g].pivot for g in "ABC"] == pytest.approx([3.1754264805, 2.8867513459, 4.3301270189])


def test_anova(df):
    out = table(omnibus.anova_test(df))
    assert out["A"].statistic == pytest.approx(1.3970588235)
    assert [out[g].pivot for g in "ABC"] == pytest.approx([3.9852669849, 2.9889502387, 4.6494781491])
    assert table(omnibus.anova_within_test(df))["A"].statistic == pytest.approx(2.1590909091)


CONTROL = {"B vs C": 0.1489146732, "B vs A": 0.7728299927}
PAIRS = {"B vs C": 0.1489146732, "A vs C": 0.2482130790, "A vs B": 0.7728299927}


@pytest.mark.parametrize(
    "run,p,adjusted",
    [
        (posthoc.bonferroni_dunn_test, CONTROL, (0.2978293464, 1)),
        (posthoc.holm_test, CONTROL, (0.2978293464, 0.7728299927)),
        (posthoc.hochberg_test, CONTROL, (0.7728299927, 0.7728299927)),
        (lambda r: posthoc.hochberg_test(r, method="textbook"), CONTROL, (0.2978293464, 0.7728299927)),
        (posthoc.li_test, CONTROL, (0.3959604868, 0.7728299927)),
        (posthoc.finner_test, CONTROL, (0.2756537665, 0.7728299927)),
        (posthoc.nemenyi_multitest, PAIRS, (0.4467440195, 0.7446392370, 1)),
        (posthoc.holm_multitest, PAIRS, (0.4467440195, 0.4964261580, 0.7728299927)),
        (posthoc.hochberg_multitest, PAIRS, (0.7728299927,) * 3),
        (posthoc.finner_multitest, PAIRS, (0.3835195491, 0.3835195491, 0.7728299927)),
        (lambda r: posthoc.shaffer_multitest(r, 3), PAIRS, (0.4467440195, 0.4467440195, 0.7728299927)),
    ],
)
def test_posthoc(df, run, p, adjusted):
    rows = run(omnibus.friedman_test(df).select("grp", "pivot")).orderBy("position").collect()
    assert [r.comparison for r in rows] == list(p)
    assert [r.p_value for r in rows] == pytest.approx(list(p.values()))
    assert [r.p_adjusted for r in rows] == pytest.approx(adjusted)


def test_named_control_and_unknown_method(df):
    ranks = omnibus.friedman_test(df).select("grp", "pivot")
    rows = posthoc.holm_test(ranks, control="A").collect()
    assert {r.comparison for r in rows} == {"A vs B", "A vs C"}
    with pytest.raises(ValueError):
        posthoc.hochberg_test(ranks, method="other")


def test_bonferroni_pairs(df):
    rows = posthoc.bonferroni_test(omnibus.anova_test(df), 3).orderBy("position").collect()
    again = posthoc.bonferroni_test(omnibus.anova_test(df), 3, n=6).orderBy("position").collect()
    assert rows == again
    for r in rows:
        assert r.p_value == pytest.approx(sp.t_upper(r.statistic, 15))
        assert r.p_adjusted == pytest.approx(min(3 * r.p_value, 1))


def test_true_hypotheses():
    assert posthoc.true_hypotheses(3) == [0, 1, 3]
    assert posthoc.true_hypotheses(5) == [0, 1, 2, 3, 4, 6, 10]


def test_unequal_samples(spark):
    data = long(spark, {"A": [1, 2, 3], "B": [2, 3], "C": [3, 4, 5]})
    with pytest.raises(Exception, match="Unequal number of samples"):
        omnibus.friedman_test(data).collect()
    # Two blocks in perfect agreement: the statistic has no bound.
    kept = omnibus.friedman_test(data, incomplete="drop").first()
    assert (kept.n, kept.statistic, kept.p_value) == (2, math.inf, 0)
    with pytest.raises(ValueError):
        omnibus.friedman_test(data, groups=["A"])
    twice = data.unionByName(data.where("grp = 'A'"))
    with pytest.raises(Exception, match="Unequal number of samples"):
        omnibus.quade_test(twice, groups=["A", "C"]).collect()


def test_degenerate_samples_have_no_statistic(spark):
    flat = long(spark, {"A": [2, 2], "B": [2, 2]})
    for test in (omnibus.quade_test, omnibus.anova_test, omnibus.anova_within_test):
        assert test(flat).first().p_value is None
    for test in (twosample.ttest_ind, twosample.ttest_rel, twosample.wilcoxon, twosample.mannwhitneyu):
        test(flat, "A", "B").collect()


def test_any_number_of_groups(spark):
    df = spark.range(1200).select(F.lit(1).alias("block"), F.format_string("g%04d", "id").alias("grp"), F.lit(1.0).alias("v"))
    assert group_names(df) == [f"g{i:04d}" for i in range(1200)]


# ---------------------------------------------------------------- two samples


def test_sign_test(df):
    row = twosample.binomial_sign_test(df, "A", "B").first()
    assert (row.n_plus, row.n_minus, row.statistic, row.p_value) == (3, 3, 3, pytest.approx(0.6875))


@pytest.fixture(scope="module")
def two():
    rng = random.Random(11)
    a = [float(rng.randrange(20)) for _ in range(60)]
    return a, [x + rng.choice([-2, -1, 0, 1, 2, 3]) for x in a]


def ranks(values):
    ordered = sorted(values)
    return [ordered.index(v) + (ordered.count(v) + 1) / 2 for v in values]


def ties(values):
    return sum(values.count(v) ** 3 - values.count(v) for v in set(values))


def test_t_tests(spark, two):
    a, b = two
    data = long(spark, {"A": a, "B": b})
    n = len(a)
    mean = lambda x: sum(x) / n
    var = lambda x: sum((v - mean(x)) ** 2 for v in x) / (n - 1)
    t = (mean(a) - mean(b)) / math.sqrt((var(a) + var(b)) / 2 * 2 / n)
    row = twosample.ttest_ind(data, "A", "B").first()
    assert (row.statistic, row.p_value) == pytest.approx((t, 2 * sp.t_upper(abs(t), 2 * n - 2)))
    d = [x - y for x, y in zip(a, b)]
    t = mean(d) / math.sqrt(var(d) / n)
    row = twosample.ttest_rel(data, "A", "B").first()
    assert (row.statistic, row.p_value) == pytest.approx((t, 2 * sp.t_upper(abs(t), n - 1)))


def test_wilcoxon(spark, two):
    a, b = two
    d = [x - y for x, y in zip(a, b) if x != y]
    size = [abs(v) for v in d]
    r, n = ranks(size), len(d)
    plus = sum(x for x, v in zip(r, d) if v > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties(size) / 48)
    row = twosample.wilcoxon(long(spark, {"A": a, "B": b}), "A", "B").first()
    assert (row.statistic, row.z) == pytest.approx((w, z))
    assert row.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_mannwhitney(spark, two):
    a, b = two
    b = b[:40]
    r, n1, n2 = ranks(a + b), len(a), len(b)
    n = n1 + n2
    u = sum(r[:n1]) - n1 * (n1 + 1) / 2
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - ties(a + b) / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread
    row = twosample.mannwhitneyu(long(spark, {"A": a, "B": b}), "A", "B").first()
    assert (row.statistic, row.z) == pytest.approx((u, z))


# ---------------------------------------------------------- tail probabilities


@pytest.mark.parametrize("x", [0.1, 1.0, 4.0, 30.0, 90.0])
def test_chi2(x):
    assert sp.chi2_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert sp.chi2_upper(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)
    assert sp.chi2_upper(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)


@pytest.mark.parametrize("f", [0.2, 1.0, 5.0, 80.0])
@pytest.mark.parametrize("d2", [3, 40, 5000])
def test_f(f, d2):
    x = d2 / (d2 + 4 * f)
    exact = x ** (d2 / 2) * (1 + d2 / 2 * (1 - x))
    assert sp.f_upper(f, 4, d2) == pytest.approx(exact, rel=1e-8)


@pytest.mark.parametrize("t", [-2.0, 0.0, 0.5, 3.0, 12.0])
def test_t(t):
    assert sp.t_upper(t, 1) == pytest.approx(0.5 - math.atan(t) / math.pi, rel=1e-9)
    assert sp.t_upper(t, 2) == pytest.approx(0.5 - t / (2 * math.sqrt(2 + t * t)), rel=1e-8)


@pytest.mark.parametrize("n", [1, 6, 25, 200])
def test_binomial(n):
    for x in range((n + 1) // 2, n + 1, max(n // 9, 1)):
        exact = 2 * sum(math.comb(n, i) for i in range(x + 1, n + 1)) / 2**n
        assert sp.sign_p(x, n) == pytest.approx(exact, rel=1e-8)


def test_small_p_values_keep_their_digits():
    assert sp.normal_two_sided(12.0) == pytest.approx(3.5529642e-33, rel=1e-6)
    assert 0 < sp.f_upper(400.0, 4, 300) < 1e-100


# ----------------------------------------------------- exact two-sample tests


def _samples(spark, a, b):
    rows = [(i, "a", float(v)) for i, v in enumerate(a)] + [(i, "b", float(v)) for i, v in enumerate(b)]
    return spark.createDataFrame(rows, "block int, grp string, v double")


def test_signed_rank_counts_against_all_signs(spark):
    for n in (0, 1, 2, 5, 9):
        sums = [sum(i for i, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)]
        want = [sums.count(w) for w in range(n * (n + 1) // 2 + 1)]
        assert spark.range(1).select(twosample.signed_rank_counts(F.lit(float(n)))).first()[0] == want


def test_rank_sum_counts_against_all_choices(spark):
    for m, n in ((1, 1), (2, 3), (4, 4), (3, 6)):
        sums = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        want = [sums.count(u) for u in range(m * n + 1)]
        assert spark.range(1).select(twosample.rank_sum_counts(F.lit(float(m)), F.lit(float(n)))).first()[0] == want


# Published two-tailed critical values of the signed-rank statistic at 5 %: (pairs, largest W).
SIGNED_RANK_TABLE = [(6, 0), (7, 2), (8, 3), (9, 5), (10, 8), (12, 13), (15, 25), (20, 52), (25, 89)]
# And of U at 5 %: (sizes, largest U).
RANK_SUM_TABLE = [((4, 4), 0), ((5, 5), 2), ((6, 6), 5), ((7, 7), 8), ((8, 8), 13), ((5, 8), 6), ((8, 20), 41)]


def test_published_critical_values(spark):
    for n, w in SIGNED_RANK_TABLE:
        counts = spark.range(1).select(twosample.signed_rank_counts(F.lit(float(n)))).first()[0]
        p = [2 * sum(counts[: k + 1]) / 2**n for k in (w, w + 1)]
        assert p[0] <= 0.05 < p[1], n
    for (m, n), u in RANK_SUM_TABLE:
        counts = spark.range(1).select(twosample.rank_sum_counts(F.lit(float(m)), F.lit(float(n)))).first()[0]
        p = [2 * sum(counts[: k + 1]) / sum(counts) for k in (u, u + 1)]
        assert p[0] <= 0.05 < p[1], (m, n)


def test_methods_of_the_two_sample_tests(spark):
    small = _samples(spark, [1, 2, 3, 4, 5, 6], [2.1, 2.9, 4.5, 3.2, 7.7, 9.1])
    signed = {m: twosample.wilcoxon(small, "a", "b", method=m).first() for m in ("auto", "exact", "approx")}
    assert signed["auto"] == signed["exact"] and signed["exact"]["p_value"] != signed["approx"]["p_value"]
    ranks = {m: twosample.mannwhitneyu(small, "a", "b", method=m).first() for m in ("auto", "exact", "approx")}
    assert ranks["auto"] == ranks["exact"] and ranks["exact"]["p_value"] != ranks["approx"]["p_value"]
    tied = _samples(spark, [1, 2, 3, 4], [2, 3, 4, 4])
    assert twosample.wilcoxon(tied, "a", "b", method="exact").first()["p_value"] is None
    for test in (twosample.wilcoxon, twosample.mannwhitneyu):
        assert test(tied, "a", "b").first() == test(tied, "a", "b", method="approx").first()
    with pytest.raises(ValueError):
        twosample.wilcoxon(small, "a", "b", method="other")
    nothing = twosample.wilcoxon(_samples(spark, [1, 2], [1, 2]), "a", "b", method="exact").first()
    assert nothing["n"] == 0 and nothing["p_value"] is None
