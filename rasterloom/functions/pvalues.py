"""Two-sided Student-t probabilities of correlation coefficients, by Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import ship


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def log_gamma_step(a: float) -> float:
    """log of gamma(a + 1/2) / gamma(a); by its series where the two logarithms would cancel."""
    if a < 20:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    b = 1 / (a * a)
    return 0.5 * math.log(a) - (1 / 8 - b * (1 / 192 - b * (1 / 640 - b * (17 / 14336 - b * 31 / 18432)))) / a


def log_beta_part(a: float, y: float) -> float:
    """log of the regularised incomplete beta function of 1 - y, with parameters a and 1/2. y is given, as 1 - y would lose its digits."""
    if y >= 1:
        return -math.inf
    if y <= 0:
        return 0.0
    x, b = 1 - y, 0.5
    front = log_gamma_step(a) - math.log(math.pi) / 2 + a * math.log1p(-y) + b * math.log(y)
    if x < (a + 1) / (a + b + 2):
        return front + math.log(_fraction(a, b, x)) - math.log(a)
    return math.log1p(-math.exp(front) * _fraction(b, a, y) / b)


def p_value(r: float | None, n: int | None) -> float:
    """P of |t| for coefficient r over n pairs; NaN where it has none."""
    if r is None or n is None or n < 3 or not math.isfinite(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return math.exp(max(log_beta_part((n - 2) / 2, r * r), -745.2))


def p_text(p: float) -> str:
    """Eight significant digits; the smallest as ``<1e-300``; none as the empty text."""
    if p is None or not math.isfinite(p):
        return ""
    return "<1e-300" if p < 1e-300 else f"{p:.8g}"


def p_value_text(r: Column, n: Column) -> Column:
    def batch(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_text(p_value(None if pd.isna(a) else a, None if pd.isna(b) else int(b))) for a, b in zip(r, n, strict=True)], dtype=object)

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return F.pandas_udf(batch, "string")(r.cast("double"), n.cast("long"))
