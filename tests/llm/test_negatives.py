from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100):
    """All scores of each anchor."""
    r = [(i, label, v) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < 65_536 for x in v)]
    q = np.zeros((len(r), max([1, *(len(v) for *_, v in r)])), np.int64)
    for k, (_, _, v) in enumerate(r):
        q[k, : len(v)] = np.floor(256 * np.array(v, float))
    ids, label = np.array([x[0] for x in r]), np.array([(x[1] + 1) % 10 if x[0] % 7 == 0 else x[1] for x in r])
    out = []
    for a in np.flatnonzero(ids % every == 0) if len(r) else []:
        s = q @ q[a]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if label[j] == label[a] and j != a][:5]:
            fits = [j for j in order if label[j] != label[a] and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:5]
            out += [(int(ids[a]), int(ids[p]), k, int(ids[j]), int(s[p]), int(s[j])) for k, j in enumerate(fits, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def made(seed, n=500, dim=8, near=0.3):
    """Labels are clusters, some rows copies."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    label = r.integers(0, 6, n)
    x = centres[label] + near * r.normal(size=(n, dim))
    x[n // 2 :] = np.where(r.random(n - n // 2)[:, None] < 0.4, x[r.integers(0, n // 2, n - n // 2)], x[n // 2 :])
    return [(k, [float(y) for y in np.float32(v)], int(t)) for k, (v, t) in enumerate(zip(x, r.integers(0, 3, n) if seed % 2 else label, strict=True))]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_scores(spark, seed):
    rows = made(seed)
    assert got(N.report(spark, spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_given_table(spark, data):
    d = spark.read.parquet(f"{data}/embeddings.parquet")
    assert got(N.report(spark, d)) == plain([tuple(r) for r in d.select("vec_id", "embedding", "label").collect()])


def test_one_vector_over_many_groups_and_salts(spark, monkeypatch):
    """A hot list in several groups, groups held by several tasks, equal scores everywhere."""
    rows = [(k, [1.0, 0.5], k % 3) for k in range(900)] + made(4, 300, 2)[250:]
    rows = [(k, v, t) for k, (_, v, t) in enumerate(rows)]
    monkeypatch.setattr(N, "ANCHORS", 2)
    assert got(N.report(spark, spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_nulls_ragged_huge_repeats_and_other_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5, 0.25], 1), (100, [], 1), (200, [0.5], 1), (300, None, 1), (400, [nan, 1.0], 1), (500, [1.0, inf], 1), (600, [1.0, None], 1), (700, [1.0], None), (None, [1.0], 1),
        (800, [70_000.0], 1), (900, [60_000.0, -60_000.0, 1.0], 2), (1, [1.0, 0.5], 2), (2, [0.9, 0.5], 1), (3, [0.875, 0.5], 3), (4, [0.875, 0.5], 3), (4, [0.875, 0.5], 3), (0, [1.0, 0.5, 0.25], 1), (5, [50_000.0], 2), (6, [40_500.0], 4),
    ]
    d = spark.createDataFrame(rows, SCHEMA)
    assert got(N.report(spark, d)) == plain(rows) != []
    clash = d.withColumns({c: F.lit(1) for c in ("uid", "q", "id", "anchor", "list", "far", "task", "kind", "scores")})
    assert got(N.report(spark, clash)) == plain(rows)
    assert got(N.report(spark, spark.createDataFrame([], SCHEMA))) == []
    assert got(N.report(spark, spark.createDataFrame([(300, None, 1)], SCHEMA))) == []
    assert got(N.report(spark, spark.createDataFrame([(0, [1.0], 1)], SCHEMA))) == []


def test_bounds_hold_and_prune():
    r = np.random.default_rng(0)
    q = (256 * (r.normal(size=(12, 1, 16)) + 0.05 * r.normal(size=(12, 80, 16)))).astype(np.int32).reshape(-1, 16)
    centres = np.array([q[k * 80 : k * 80 + 80].mean(axis=0) for k in range(12)])
    at = np.repeat(np.arange(12), 80)
    radii = np.array([np.sqrt(((q[at == k] - centres[k]) ** 2).sum(axis=1)).max() for k in range(12)])
    lists = N.Lists(centres, radii, np.arange(12), np.ones(12, np.int64), np.float64)
    lo, up = lists.bounds(q[:5].astype(float))
    s = q[:5].astype(np.int64) @ q.T.astype(np.int64)
    assert all((lo[:, k][:, None] <= s[:, at == k]).all() and (s[:, at == k] <= up[:, k][:, None]).all() for k in range(12))
    held = N.Held(lists, at, np.arange(len(q)), np.arange(len(q)), at, q)
    seen = []

    class Seen(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    held.q = held.q.view(Seen)
    (score, ids), = held.search(q[3], 3, 0, np.array([-N.FAR]), np.array([N.FAR]), True, np.array([-N.FAR]), 5)
    want = sorted((-int(x), int(i)) for i, x in enumerate(s[3]) if at[i] == 0 and i != 3)[:5]
    assert [(-int(x), int(i)) for x, i in zip(score, ids, strict=True)] == want
    assert len(seen) < 6  # lists far from the anchor were not visited


def test_best_with_ties():
    r = np.random.default_rng(2)
    for n in (3, 30, 300):
        s, i = r.integers(0, 4, n), r.permutation(n)
        a, b = N.best(s, i, 5)
        order = np.lexsort((i, -s))[:5]
        assert (a == s[order]).all() and (b == i[order]).all()
