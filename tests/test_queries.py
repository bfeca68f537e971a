"""Every registered query of the engine against its oracle on the smallest tables."""

from __future__ import annotations

import math

import pytest

from rasterloom.plans.tables import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}".replace("-0.000000", "0.000000") if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    found = duck.sql(ORACLES[name])
    cols = found.columns
    assert sorted(cols) == sorted(df.columns)
    assert rows == sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in found.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_cli(capsys):
    from rasterloom import cli

    assert cli.main(["check"]) == 0 and cli.main(["list"]) == 0
    assert "bloom_extent" in capsys.readouterr().out
    assert cli.main(["run", "nothing"]) == 2
