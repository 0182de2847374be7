"""Tail probabilities, applied to the few rows of a test's result table.

Survival forms are evaluated directly, so small p-values keep their digits.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_EPS = 1e-16
_STEPS = 500


def _clear_of_zero(x: float) -> float:
    return x if abs(x) > _TINY else _TINY


def beta_upper(a: float, b: float, x: float) -> float:
    """1 - I_x(a, b), the upper regularised incomplete beta function."""
    return beta_lower(b, a, 1.0 - x)


def beta_lower(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction (modified Lentz evaluation)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_lower(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 / _clear_of_zero(1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = value
        for term in (even, odd):
            d = 1.0 / _clear_of_zero(1.0 + term * d)
            c = _clear_of_zero(1.0 + term / c)
            value *= c * d
        if abs(value - before) <= _EPS * abs(value):
            break
    return math.exp(log_front) * value / a


def gamma_upper(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while term > total * _EPS:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for i in range(1, _STEPS):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / _clear_of_zero(b + step * d)
        c = _clear_of_zero(b + step / c)
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return front * value


def normal_two_sided(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if math.isinf(f):
        return 0.0
    return beta_lower(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    """P(X > x)."""
    return 0.0 if math.isinf(x) else gamma_upper(df / 2.0, x / 2.0)


def t_upper(t: float, df: float) -> float:
    """P(T > t)."""
    half = 0.5 * beta_lower(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def sign_p(x: float, n: float) -> float:
    """2 P(X > x) for X ~ Binomial(n, 1/2)."""
    return 2.0 * beta_lower(x + 1.0, n - x, 0.5) if x < n else 0.0


def _over_rows(fn, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def apply(table: pd.DataFrame) -> pd.Series:
        return pd.Series(
            [
                None if any(pd.isna(v) for v in row) else fn(*row)
                for row in table.itertuples(index=False)
            ],
            dtype="float64",
        )

    named = [c.cast("double").alias(f"a{i}") for i, c in enumerate(columns)]
    return apply(F.struct(*named))


def p_normal(z: Column) -> Column:
    return _over_rows(normal_two_sided, z)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _over_rows(f_upper, f, d1, d2)


def p_chi2(x: Column, df: Column) -> Column:
    return _over_rows(chi2_upper, x, df)


def p_t(t: Column, df: Column) -> Column:
    return _over_rows(t_upper, t, df)


def p_t_two_sided(t: Column, df: Column) -> Column:
    return F.lit(2.0) * p_t(F.abs(t), df)


def p_sign(x: Column, n: Column) -> Column:
    return _over_rows(sign_p, x, n)
