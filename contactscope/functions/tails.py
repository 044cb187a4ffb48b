"""Tail probabilities, applied to already aggregated rows only.

Spark SQL has no error function, so these two run as Arrow-batched functions on
the handful of rows that a test reduces to.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(v - top) for v in logs))


def log_erfc(x: float) -> float:
    """log(erfc(x)) for x >= 0, also where erfc itself underflows."""
    if x < 25.0:
        return math.log(math.erfc(x))
    inverse = 1.0 / (2.0 * x * x)
    series = 1.0 - inverse + 3.0 * inverse**2 - 15.0 * inverse**3
    return -x * x - math.log(x * math.sqrt(math.pi)) + math.log(series)


def chi2_tail(x: float, dof: float) -> float:
    """P(X >= x) for a chi-square variable, by its finite sum, in log space."""
    if x is None or dof is None or math.isnan(x) or math.isnan(dof):
        return math.nan
    dof = int(dof)
    if dof <= 0 or x <= 0.0:
        return 1.0
    half = x / 2.0
    if dof % 2 == 0:
        logs = [-half + i * math.log(half) - math.lgamma(i + 1.0) for i in range(dof // 2)]
    else:
        logs = [log_erfc(math.sqrt(half))]
        term = 0.5 * math.log(2.0 * x / math.pi) - half
        for i in range((dof - 1) // 2):
            logs.append(term)
            term += math.log(x / (2.0 * i + 3.0))
    return min(1.0, math.exp(_log_sum(logs)))


def normal_tail(z: float) -> float:
    """P(Z >= z) for a standard normal variable."""
    if z is None or math.isnan(z):
        return math.nan
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf(stat: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(a, b) for a, b in zip(x, k)], dtype="float64")

    return tail(stat.cast("double"), dof.cast("double"))


def normal_sf(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series([normal_tail(a) for a in x], dtype="float64")

    return tail(z.cast("double"))
