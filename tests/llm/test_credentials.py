from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import credentials as C

SCHEMA = "doc_id long, text string"
KEY = "AKIA" + "ABCDEFGH12345678"
SECRET = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
TEXTS = [
    None,
    "",
    "token=abc",
    "token=abc token: 'abcdef' PassWord = \"x/y+z=.1\" api-key=abcdef apikey:abcdefg",
    "secret: token: abcdefghij",
    f"AKIA AKIAAKIA {KEY} x{KEY}Z AKIA1234",
    "0123456789abcdef01234567 0123456789abcdef0123456 0123456789ABCDEF01234567 zz0123456789abcdef0123456789abcdefg",
    "é日本 token = 0123456789abcdef01234567 é\n\n" * 3,
    f"{KEY} {SECRET} https://db.example.org/a",
    f"{SECRET} alone\n\n{KEY}",
    f"{SECRET}\n{KEY}",
    f"{SECRET}{' x' * 300}{KEY}",
    f"user: root\npassword: hunter22\nhttps://h.example.org:80/x?y=1",
    "user: root https://h.example.org",
    f"login=bob {SECRET}",
    "https://h.example.org/" + SECRET + f" user=al1 {SECRET.lower()}",
    "token" + " " * 3000 + "=" + " " * 3000 + "abcdefgh",
]


def plain(text):
    """Matches of the base, by hand."""
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    found.sort()
    count = [sum(k == x[1] for x in found) for k in range(3)]
    return (*count, hashlib.sha256(",".join(x[2] for x in found).encode()).hexdigest(), {x[2] for x in found})


def got(spark, df):
    return {(r[0], r[1], r[2], r[3], r[4], r[5]) for r in C.report(spark, df).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    return {r["doc_id"]: r for r in C.report(spark, d).collect()}


def test_base(rows):
    for k, text in enumerate(TEXTS):
        *counts, digest, spans = plain(text)
        r = rows[k]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == [*counts, digest], k
        assert spans <= set(filter(None, r["spans"].split(",")))


def kinds(r):
    return [s.split(":")[0] for s in filter(None, r["spans"].split(","))]


def test_weak_parts_need_their_complement(rows):
    assert kinds(rows[8]) == ["access", "token", "address"]
    assert kinds(rows[9]) == ["access"]  # another scope
    assert kinds(rows[10]) == ["token", "access"]
    assert kinds(rows[11]) == ["access"]  # too far
    assert kinds(rows[12]) == ["name", "assign", "address"]
    assert kinds(rows[13]) == []
    assert kinds(rows[14]) == ["name", "token"]
    assert kinds(rows[15]) == []  # the token is part of the address, and the other has no capital


def test_same_as_sql(spark, rows):
    d = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).toPandas()
    con = duckdb.connect()
    con.register("documents", d)
    want = con.sql(C.SQL)
    names = want.columns
    assert sorted(tuple(r[c] for c in names) for r in rows.values()) == sorted(want.fetchall())


def test_given_table(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.sql(C.SQL)
    assert sorted(tuple(r[c] for c in want.columns) for r in C.report(spark, d).collect()) == sorted(want.fetchall())


def test_empty_repeats_null_ids_and_other_columns(spark):
    assert C.report(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, TEXTS[8]), (1, TEXTS[8]), (None, TEXTS[12]), (None, "")], SCHEMA).withColumns({c: F.lit("x") for c in ("uid", "kind", "start", "scope", "t", "token", "found")})
    out = C.report(spark, twice).collect()
    assert sorted(len(kinds(r)) for r in out) == [0, 3, 3, 3] and sum(r["doc_id"] is None for r in out) == 2


def test_long_text(spark):
    """Many matches in one text; the sweep is linear."""
    text = f"user: root {SECRET} token=abcdef\n" * 20_000
    r = C.report(spark, spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert (r["n_assign"], r["n_linked"]) == (20_000, 40_000) and r["base_sha256"] == plain(text)[3]


def test_no_python_and_one_exchange(spark, data):
    plan = C.report(spark, spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
