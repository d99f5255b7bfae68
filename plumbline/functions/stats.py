"""Statistics as Column expressions; two scalar p-values as vectorised helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import kernels


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def sample_skewness(n: Column, population_skewness: Column) -> Column:
    """Bias-corrected skewness from the population form."""
    count = n.cast("double")
    return F.when(n > 2, population_skewness * F.sqrt(count * (count - 1)) / (count - 2))


def entropy(total: Column, sum_n_ln_n: Column) -> Column:
    """Shannon entropy (natural log) from count totals.

    ``-sum(p ln p)`` equals ``ln N - sum(n ln n) / N``, so one aggregate over
    the value counts is enough: no join or window to get the shares first.
    """
    return F.ln(total) - sum_n_ln_n / total


def n_ln_n(n: Column) -> Column:
    return F.sum(n * F.ln(n))


def psi_term(b: Column, c: Column, zero_share: float) -> Column:
    base = F.when(b == 0, F.lit(zero_share)).otherwise(b)
    cur = F.when(c == 0, F.lit(zero_share)).otherwise(c)
    return (cur - base) * F.ln(cur / base)


def js_term(b: Column, c: Column) -> Column:
    """One category's part of the squared Jensen-Shannon distance."""
    m = (b + c) / 2
    left = F.when(b > 0, b * F.ln(b / m)).otherwise(F.lit(0.0))
    right = F.when(c > 0, c * F.ln(c / m)).otherwise(F.lit(0.0))
    return 0.5 * left + 0.5 * right


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    root = F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    lam = (root + 0.12 + 0.11 / root) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    )


@F.pandas_udf(T.DoubleType())
def exact_ks_p_value(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([kernels.exact_ks_p(x, int(a), int(b)) for x, a, b in zip(d, n1, n2)])


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([kernels.chi_square_tail(float(v), int(k)) for v, k in zip(x, dof)])
