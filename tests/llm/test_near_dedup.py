from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import embeddings, graph, simhash

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(keys, linked):
    """Smallest key reachable, by repeated relabelling."""
    low = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for i in range(len(keys)):
            for j in range(len(keys)):
                if linked(i, j) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return [min(keys[j] for j in range(len(keys)) if low[j] == low[i]) for i in range(len(keys))]


def texts(seed=0, n=40):
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        if k % 4 == 3:
            t = out[int(r.integers(len(out)))].split()
            if t:
                t[int(r.integers(len(t)))] = "zz"
            out.append(" ".join(t))
        else:
            out.append(" ".join(r.choice(words, int(r.integers(0, 90)))))
    return out


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 9), (9, 8), (8, 7), (7, 6), (1, 2)] + [(100, 100 + k) for k in range(1, 60)]
    got = dict(graph.components(spark, spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {2: 1, 3: 1, 7: 6, 8: 6, 9: 6, 10: 6} | {100 + k: 100 for k in range(1, 60)}
    assert graph.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_trie_walk_finds_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(1 << 62), base ^ np.uint64(5 << 30), np.zeros(1, np.uint64)]))
    y = np.unique(np.concatenate([base ^ np.uint64(3), r.integers(0, 2**63, 30, dtype=np.uint64)]))
    near = lambda a, b: int(a ^ b).bit_count() <= 2
    got = {(int(a), int(b)) for i, j in simhash.walk(x, None) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if near(x[i], x[j])}
    got = {(int(a), int(b)) for i, j in simhash.walk(x, y, small=1) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i in range(len(x)) for j in range(len(y)) if near(x[i], y[j])}


def test_simhash_against_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (5, texts()[5])]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.report(spark, spark.createDataFrame(rows, DOCS)).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    want = classes([k for k, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert got == {(k, f"{p:016x}"): w for (k, _), p, w in zip(rows, prints, want, strict=True)}


def test_leaves_are_bounded_and_cover(spark):
    fp = np.unique(np.concatenate([np.arange(300, dtype=np.uint64), np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)]))
    prints = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    cut = simhash.leaves(prints, len(fp), (20, 20))
    sizes = [int(((fp >> np.uint64(64 - d)) == np.uint64(p)).sum()) if d else len(fp) for p, d in cut]
    assert max(sizes) <= 20 and sum(sizes) == len(fp)
    u = simhash.links(spark, prints, leaf=(20, 20)).collect()
    got = graph.components(spark, spark.createDataFrame(u or [], "u long, v long"))
    values = fp.tolist()
    labels = simhash.merge(np.arange(len(fp)), *(np.array(z) for z in zip(*[(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 2], strict=True)))
    want = {int(fp.view(np.int64)[i]): int(fp.view(np.int64)[labels[i]]) for i in range(len(fp)) if labels[i] != i}
    assert dict(got.collect()) == want


def test_deduplicate_keeps_one_of_each_class(spark):
    schema = DOCS + ", fp string, n_chars long"
    rows = [(3, "a b c d e", "x", 1), (1, "A b c d e", "y", 1), (2, "quite another text of words", "z", 1), (2, "quite another text of words", "z", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = simhash.deduplicate(spark, df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 1, 2]
    assert simhash.report(spark, df.limit(0)).count() == 0


def vectors(seed=0, n=160, dim=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for k in range(0, n, 4):
        x[k] = x[(k * 7 + 1) % n] + 0.12 * r.normal(size=dim)
    x[:30] = x[0] + 0.2 * r.normal(size=(30, dim))
    return x


def test_embeddings_against_brute_force(spark):
    x = vectors()
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, [float("inf")] + [1.0] * 15), (505, rows[7][1]), (7, rows[7][1])]
    got = embeddings.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=64).collect()
    ok = [v is not None and all(a is not None and np.isfinite(a) for a in v) and any(v) for _, v in rows]
    unit = np.array([np.array(v) / np.linalg.norm(v) if good else np.zeros(16) for (_, v), good in zip(rows, ok, strict=True)])
    near = (unit @ unit.T >= 0.95) & np.outer(ok, ok)
    np.fill_diagonal(near, False)
    want = classes([k for k, _ in rows], lambda i, j: bool(near[i, j]))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((k, int(n), w, k == w) for (k, _), n, w in zip(rows, near.sum(axis=1), want, strict=True))


def test_embeddings_recall_with_few_probes_and_small_blocks(spark):
    x = vectors(3, 400)
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    degrees, _ = embeddings.find_links(spark, embeddings.distinct(spark, df)[1], probes=4, block=16)
    assert sum(r.n for r in degrees.collect()) == near.sum() - len(x)
    assert embeddings.near_duplicates(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_equal_vectors(spark, kind):
    r = np.random.default_rng(6)
    base = r.normal(size=(60, 16)).astype(np.float32)
    base[1] = base[0] * np.float32(1.001) + np.float32(0.01)
    which = np.concatenate((np.zeros(10_000, int), np.ones(500, int), np.arange(60)))
    df = spark.createDataFrame([(int(k), base[i].tolist()) for k, i in enumerate(which)], f"vec_id long, embedding array<{kind}>")
    got = {g.vec_id: g for g in embeddings.near_duplicates(spark, df.withColumn("uid", F.lit(1))).collect()}
    unit = base.astype(float) / np.linalg.norm(base.astype(float), axis=1)[:, None]
    near, m = unit @ unit.T >= 0.95, np.bincount(which)
    first = [int(np.flatnonzero(which == i)[0]) for i in range(60)]
    for k, i in enumerate(which.tolist()):
        assert got[k].n_links == (near[i] * m).sum() - 1 and got[k].component_id == min(first[j] for j in np.flatnonzero(near[i]))


@pytest.mark.parametrize("noise", [0.002, 0.02, 0.03])
def test_embeddings_of_a_dense_ball_lose_no_link(spark, noise):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32))
    x[:2400] = x[0] / np.linalg.norm(x[0]) + noise * r.normal(size=(2400, 32))
    x[2400:2700] = x[2700:] + 0.2 * r.normal(size=(300, 32))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = embeddings.near_duplicates(spark, df).collect()
    assert {g.vec_id: g.n_links for g in got} == dict(enumerate(near.sum(axis=1).tolist()))
    low, before = np.arange(len(x)), None
    while before is None or (low != before).any():
        before, low = low, np.minimum(low, np.where(near, low[None], len(x)).min(axis=1))
    assert [g.component_id for g in sorted(got)] == low.tolist()
    degrees, _ = embeddings.find_links(spark, embeddings.distinct(spark, df)[1], block=256)
    assert sum(g.n for g in degrees.collect()) == near.sum()
