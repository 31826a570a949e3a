"""Tail probabilities of test statistics, for result rows.

Spark has no distribution functions. These run on aggregated results (one row per model, group or
variable), never on observations.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# The functions travel to the executors by value; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral, evaluated from the tail inwards."""
    value = 0.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = odd / (1 + even / (1 + value))
    return 1 / (1 + value)


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return scale * _beta_fraction(a, b, x) / a
    return 1 - scale * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_cdf(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    scale = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= h / k
            total += term
        return 1 - scale * total
    value = 0.0
    for m in range(400, 0, -1):
        value = m * (a - m) / (2 * m + 1 + h - a + value)
    return scale / (1 + h - a + value)


def _rowwise(fn, *columns: pd.Series) -> pd.Series:
    def one(*args):
        if any(pd.isna(a) for a in args):
            return None
        return float(fn(*args))

    return pd.Series([one(*row) for row in zip(*columns)], dtype="float64")


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _rowwise(normal_two_sided, z)


@pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided, t, df)


@pandas_udf(DoubleType())
def f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _rowwise(f_upper, f, df1, df2)


@pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi2_upper, x, df)
