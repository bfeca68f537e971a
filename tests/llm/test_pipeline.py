from __future__ import annotations

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark):
    r = np.random.default_rng(0)
    words = {"aa": ["the", "thing", "ofthe", "and", "with", "reading"], "bb": ["der", "und", "schön", "nicht", "ein", "lesen"]}
    rows = []
    for k in range(120):
        lang = "aa" if k % 2 else "bb"
        text = " ".join(f"{w}{'abcdefgh'[int(x)]}" for w, x in zip(r.choice(words[lang], 70), r.integers(0, 8, 70), strict=True))
        rows.append((k, f"{text}\nshared line of all sites", lang, f"s{k % 13}", len(text)))
    rows += [(200, rows[7][1], "aa", "s1", 1), (201, None, None, None, None), (202, "1234 " * 60, "aa", "s2", 1), (203, "the " * 80, "aa", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({x.doc_id for x in docs.collect()})
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    language, rules, clean, unique, packed = kept
    assert language == {*range(120), 200, 203} and rules == clean == {*range(120), 200}
    assert unique == packed == set(range(120))


def test_run(spark, data):
    import __spark_entry__ as entry

    assert corpus_pipeline.run(spark, data).count() > 0
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}


@pytest.mark.parametrize("name", ["op4_quality_rules", "op6_line_dedup", "quality_ablations"])
def test_queries_equal_their_oracles(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    from rasterloom.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found, got = c.sql(ORACLES[name]), QUERIES[name](spark, data)
    columns = sorted(got.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(x) for x in columns]
    assert sorted(tuple(r[k] for k in at) for r in found.fetchall()) == sorted(tuple(r[x] for x in columns) for r in got.collect())
