from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions import indices as M
from rasterloom.functions.pvalues import p_text, p_value


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in values.items())).select(column).first()[0]


def test_normalized_difference_and_zero_denominator(spark):
    nd = M.normalized_difference(F.col("a"), F.col("b"))
    assert one(spark, nd, a=0.6, b=0.2) == pytest.approx(0.5)
    assert one(spark, nd, a=0.0, b=0.0) is None
    assert one(spark, nd, a=1.0, b=-1.0) is None


def test_nan_becomes_null(spark):
    assert one(spark, M.number(F.col("a")), a=float("nan")) is None


@pytest.mark.parametrize("x,want", [(0.0, 4.071), (0.1, 4.071 + 1.9 - 1.7643 + 0.82657)])
def test_chlorophyll(spark, x, want):
    assert one(spark, M.chlorophyll(F.col("x")), x=x) == pytest.approx(want)


def python_water(r, g, b, n, s1, s2):
    """The decision with plain floats: NaN never meets a threshold, zero denominators give infinities."""

    def div(x, y):
        return x / y if y else (math.copysign(math.inf, x) if x and not math.isnan(x) else math.nan)

    v, m, w, l = div(n - r, n + r), div(g - s1, g + s1), div(g - n, g + n), div(n - s1, n + s1)  # noqa: E741
    sh, br = b + 2.5 * g - 1.5 * (n + s1) - 0.25 * s2, 4 * (g - s1) - (0.25 * n + 2.75 * s1)
    so = div(s1 - g, s1 + g) - v
    wet = m > 0.42 or w > 0.4 or br > 0.1879 or sh > 0.1112 or v < -0.2 or l > 1
    return wet and not (br <= -0.03 or so > 0)


def test_water_body_against_plain_floats(spark):
    nan = float("nan")
    values = [0.0, 0.02, 0.1, 0.3, nan]
    rows = [(r, g, 0.05, n, s, 0.01) for r in values for g in values for n in values for s in values]
    df = spark.createDataFrame(rows, "r double, g double, b double, n double, s double, t double")
    c = {k: M.number(F.col(k)) for k in "rgbnst"}
    got = df.select(M.water_body(c["r"], c["g"], c["b"], c["n"], c["s"], c["t"])).collect()
    assert [x[0] for x in got] == [python_water(*r) for r in rows]


def test_class_table(spark):
    got = spark.range(12).select(M.class_valid(F.col("id")), M.class_water(F.col("id"))).collect()
    assert [k for k, (v, _) in enumerate(got) if v] == [4, 5, 6, 7]
    assert [k for k, (_, w) in enumerate(got) if w] == [6]


def test_flags_and_labels(spark):
    flag = M.quality_flag(F.col("p") == 1, F.col("f"))
    assert [one(spark, flag, p=p, f=f) for p, f in ((1, 0.5), (0, 0.5), (0, 0.1))] == [S.PARTIAL, S.OUTLIERS, S.COMPUTED]
    labels = [(one(spark, M.correlation_direction(F.col("r")), r=r), one(spark, M.correlation_magnitude(F.col("r")), r=r)) for r in (-0.42, 0.75, 0.02, float("nan"))]
    assert labels == [("negativa", "moderada"), ("positiva", "muy_fuerte"), ("positiva", "muy_debil"), ("indeterminada", "indeterminada")]
    trend = M.trend_label(F.col("a"), F.col("b"))
    assert [one(spark, trend, a=1, b=b) for b in (1.4, 1.6, 0.0)] == ["estable", "creciente", "decreciente"]


def test_season(spark):
    df = spark.createDataFrame([(f"2025-{m:02d}-01",) for m in range(1, 13)], "d string").select(M.season(F.to_date("d")))
    assert [r[0] for r in df.collect()] == ["seca"] * 4 + ["lluviosa"] * 6 + ["seca"] * 2


def test_request_size_is_scaled(spark):
    west, east, south, north = S.ZONES["atitlan"]
    got = spark.range(1).select(M.request_size(*map(F.lit, (west, east, south, north)))).first()[0]
    assert max(got) == S.REQUEST_LIMIT and min(got) > 1000


def test_colour_classes(spark):
    got = spark.createDataFrame([(0.2, 0.0), (9.9, 0.0), (1e4, 0.0), (5.0, 0.2), (None, 0.0)], "c double, f double").select(M.colour(M.colour_class(F.col("c"), F.col("f")))).collect()
    assert [r[0] for r in got] == [[0, 0, 255], [30, 226, 28], [233, 72, 21], [233, 72, 21], None]


def test_p_values():
    assert p_value(0.5, 10) == pytest.approx(0.14111328125, rel=1e-6)
    assert p_value(0.0, 12) == pytest.approx(1.0)
    assert p_text(p_value(0.99, 10_000)) == "<1e-300"
    assert p_text(p_value(None, 5)) == "" and math.isnan(p_value(0.3, 2))
    # degrees of freedom 1: P = 1 - 2 asin(r) / pi
    assert p_value(0.8, 3) == pytest.approx(1 - 2 * math.asin(0.8) / math.pi)


def test_relative_path(spark):
    got = spark.createDataFrame([("/a/b/c.tif",), ("/z/c.tif",)], "p string").select(M.relative_path(F.col("p"), "/a/b")).collect()
    assert [r[0] for r in got] == ["c.tif", "/z/c.tif"]


@pytest.mark.parametrize(("r", "n"), [(0.3, 4), (0.02, 5_000), (0.0005, 13_300_000), (0.0001, 100_000_000), (0.002, 13_300_000)])
def test_p_values_to_eight_digits(r, n):
    """Against the integral of cos(a)^(v - 1), both parts by Simpson's rule; no gamma function is used."""
    v, m = n - 2, 20_000

    def integral(a, b):
        x = np.linspace(a, b, m + 1)
        y = np.exp((v - 1) / 2 * np.log1p(-np.minimum(np.sin(x) ** 2, 1 - 1e-16)))
        return (b - a) / m / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    top = min(math.pi / 2, math.asin(r) + 12 / math.sqrt(v))
    want = integral(math.asin(r), top) / integral(0, min(math.pi / 2, 12 / math.sqrt(v)))
    assert p_value(r, n) == pytest.approx(want, rel=2e-9 if n > 10 else 1e-6)


def test_general_text_is_that_of_c(spark):
    ties = [1234565.0, 1234575.0, 12345650.0, 123456.5, 123457.5, 1.234565, 0.0001234565]
    values = [*ties, -1234565.0, 0.0, -0.0, 5e-324, 1.7976931348623157e308, 0.0001, 0.00009999995, 999999.5, 999998.5, 1e16, float("inf"), float("-inf"), float("nan"), None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").select("k", M.general_text(F.col("x"))).collect()
    assert dict(rows) == {k: "" if v is None else f"{v:g}" for k, v in enumerate(values)}
