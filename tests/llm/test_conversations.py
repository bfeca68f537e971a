from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from rasterloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie of the rebuilt conversations, prefix by prefix."""
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, n=60):
    r = random.Random(seed)
    texts = ["", "a", "a b", "b  c\td", "é ü\x0bz", None]
    rows = []
    for c in range(n):
        c = c if c % 7 else c * 1000 - 5000
        for t in range(r.choice([1, 1, 2, 3, 4, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(texts)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = made(seed)
    assert got(C.report(spark, spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_given_table(spark, data):
    d = spark.read.parquet(f"{data}/conversations.parquet")
    assert got(C.report(spark, d)) == plain([tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()])


def test_copies_over_many_tasks_and_runs(spark):
    """One conversation has most of the rows; runs of a few strings each are merged, several times."""
    rows = [(c, t, "user", f"word {t}" if c % 3 else f"w{c % 5} {t}") for c in range(1, 260) for t in range(5)]
    built = C.rebuilt(C.strings(spark.createDataFrame(rows, SCHEMA)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for run in (600, 1 << 20):
        assert got(C.trie(spark, built, run=run)) == plain(rows)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert got(C.trie(spark, built, run=900)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_nulls_repeats_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.report(spark, empty).count() == 0
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 1, "user", "x y"), (25, 1, "user", "x y"), (20, 0, "user", "h one"), (20, 1, "user", "h two"), (7, 3, "user", "z")]
    assert got(C.report(spark, spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert got(C.report(spark, spark.createDataFrame([(None, 0, "user", "lost")], SCHEMA))) == []
    again = [(9, 0, "user", "a"), (9, 0, "user", "a"), (9, 0, "user", "a")]  # turns of their own
    assert got(C.report(spark, spark.createDataFrame(again, SCHEMA))) == plain(again)
    clash = spark.createDataFrame([(*r, 1, b"k", 2, "t") for r in rows], SCHEMA + ", id long, key binary, h int, turns string")
    assert got(C.report(spark, clash)) == plain(rows)


def test_long_conversation_and_text(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 700 else f"turn {t} {c}") for c in (40, 41, 42) for t in range(800)] + [(43, 0, "user", "word " * 200_000)]
    assert got(C.report(spark, spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_common_prefix_and_merge():
    r = random.Random(1)
    t = [bytes([k]) * C.TOKEN for k in range(3)]
    items = [(b"".join(r.choice(t) for _ in range(r.randrange(12))), k) for k in range(500)]
    for (a, _), (b, _) in zip(items, items[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) // C.TOKEN and a[: (n + 1) * C.TOKEN] == b[: (n + 1) * C.TOKEN]:
            n += 1
        assert C.common(a, b) == n == C.common(a, b, n // 2)
    for run in (500, 5_000, 1 << 20):
        out = list(C.external_sort(iter(items), run, ways=3))
        assert [x[:2] for x in out] == sorted(items)
        assert all(x[2] == C.common(y[0], x[0]) for y, x in zip(out, out[1:], strict=False))


def test_plan_shuffles_no_text(spark, data):
    plan = C.strings(spark.read.parquet(f"{data}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "md5" in plan.split("Exchange")[1]
