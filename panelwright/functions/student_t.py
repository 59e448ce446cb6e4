"""F8. Two-sided p-value of a correlation under Student's t with n - 2 degrees.

The tail is the regularised incomplete beta function, evaluated by the usual
continued fraction. It is one Arrow batch per call and sees one row per test,
after all aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import ship_package

_TINY = 1e-300
_CLOSE = 1e-15


def _log_beta(a: np.ndarray, b: float) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + math.lgamma(b) - lg(a + b)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    total = d.copy()
    # The fraction converges in about sqrt(max(a, b)) steps; what has not by far more than that is no number.
    for m in range(1, 300 + 20 * math.isqrt(int(np.max(np.maximum(a, b))))):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + top / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            total = total * d * c
        if np.all(np.abs(d * c - 1.0) < _CLOSE):
            break
    return np.where(np.abs(d * c - 1.0) < 1e3 * _CLOSE, total, np.nan)


def two_sided_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(|T| >= t) = I_x(df/2, 1/2) with x = df / (df + t^2) = 1 - r^2."""
    r = np.asarray(r, dtype=float)
    df = np.asarray(n, dtype=float) - 2.0
    out = np.full(r.shape, np.nan)
    ok = np.isfinite(r) & (df > 0)
    if not ok.any():
        return out
    rr, aa = np.clip(np.abs(r[ok]), 0.0, 1.0), df[ok] / 2.0
    x = (1.0 - rr) * (1.0 + rr)
    half = np.full_like(x, 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(aa * np.log(x) + np.log(rr) - _log_beta(aa, 0.5))
    direct = x < (aa + 1.0) / (aa + 2.5)
    a = np.where(direct, aa, half)
    b = np.where(direct, half, aa)
    z = np.where(direct, x, rr * rr)
    part = front * _beta_fraction(a, b, z) / a
    p = np.where(direct, part, 1.0 - part)
    p = np.where(rr >= 1.0, 0.0, np.where(rr == 0.0, 1.0, p))
    out[ok] = np.clip(p, 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    p = two_sided_p(r.to_numpy(dtype=float, na_value=np.nan), n.to_numpy(dtype=float, na_value=np.nan))
    return pd.Series(p).astype("Float64").where(~np.isnan(p), other=pd.NA)


def correlation_p_value(r: Column, n: Column) -> Column:
    """NULL in, NULL out; a perfect correlation gives 0. The workers need this module, so the package is sent to them."""
    if (session := SparkSession.getActiveSession()) is not None:
        ship_package(session)
    return F.when(r.isNotNull() & (n > 2), F.nanvl(_p_value(r, n), F.lit(None).cast("double")))
