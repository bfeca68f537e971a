"""Row numbers, average ranks and quantiles over ranges: the same as by sorting whole groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import ordering, series


def plain_ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    for v in np.unique(x):
        at = np.flatnonzero(x[order] == v)
        out[order[at]] = at.mean() + 1
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_ranks_with_ties(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        r = np.random.default_rng(1)
        x = np.round(r.normal(size=2000), 1)
        x[:700] = 0.5  # a third of all rows are equal
        g = r.choice(["a", "b"], 2000, p=[0.9, 0.1])
        df = spark.createDataFrame([(int(k), str(z), float(v)) for k, (z, v) in enumerate(zip(g, x, strict=True))], "id long, g string, v double")
        got = {row.id: row.rank for row in ordering.average_ranks(df, ["g"], "v", "rank").collect()}
        for z in "ab":
            at = np.flatnonzero(g == z)
            assert [got[int(k)] for k in at] == plain_ranks(x[at]).tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        ordering.release()


def test_numbers_over_ranges(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).alias("g"), ((F.col("id") * 7919) % 3001).alias("o"), F.lit(None).cast("string").alias("h"))
    got = ordering.numbered(df, ["g", "h"], ["o"]).collect()
    for g in (True, False):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.o)
        assert [r._k for r in own] == list(range(len(own))) and {r._n for r in own} == {len(own)}
    assert ordering.numbered(df.limit(0), ["g"], ["o"]).count() == 0
    ordering.release()


def test_no_task_sorts_a_group(spark):
    df = spark.range(1000).select("id", F.lit("a").alias("g"), F.rand(1).alias("v"))
    for out in (ordering.numbered(df, ["g"], ["id"]), series.systematic_sample(df, ["g"], ["id"], 10)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" in plan and "row_number" not in plan
    plan = ordering.average_ranks(df, ["g"], "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "rank(" not in plan
    ordering.release()


@pytest.mark.parametrize("bins", [2, 256, 65_536])
def test_quantiles(spark, bins):
    x = [0.0, -0.0, 1.5, -1.5, 1e-310, -1e300, float("inf"), 7.25, 7.25, 7.25, 3.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "v double")
    finite = df.where("v < 1e308")
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    want = np.quantile([v for v in x if v < 1e308], shares)
    assert ordering.quantiles(finite, "v", shares, bins) == pytest.approx(want.tolist(), rel=1e-12)
    assert ordering.quantiles(df, "v", (1.0,), bins) == [float("inf")]
    assert ordering.quantiles(df.limit(0), "v", shares, bins) is None
    one = spark.createDataFrame([(4.0,)] * 3, "v double")
    assert ordering.quantiles(one, F.col("v") / 2, (0.3,), bins) == [2.0]


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -1.0, -1e-310, 0.0, 1e-310, 0.5, 1.0, 1e300, np.inf])
    k = ordering._keys(x)
    assert (np.diff(k.astype(object)) > 0).all() and [ordering._value(int(v)) for v in k] == x.tolist()
    assert ordering._keys(np.array([-0.0]))[0] == ordering._keys(np.array([0.0]))[0]
