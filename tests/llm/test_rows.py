"""Clashing names, empty tables and hot keys, for all operators alike."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import common, graph, kneser, langid, lines, lm, packing, pieces, quality, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = (
    "id l t g k c i f h n x q m v w u s b fp at size root low node n_links uid key key2 k2 row pos line bad own first site sites about stays_i stays_h number hash_of_id hash_of_text "
    "name rate draw train part low_i low_f lang_pred score threshold kept measured n_words fail_bits t_ w_ h_ _salt _of _salts _hot_0 task side class_fp component_id class_rows "
    "ids word hits held_out rare piece start length ids_crc32 salt before sequence_id offset decoded row_id"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    good = ["the thing and the other %d with some words %s" % (k % 7, " ".join(f"w{k * j % 97}" for j in range(60))) for k in range(60)]
    rows = [(k, t, "aa" if k % 2 else "bb", f"s{k % 12}", len(t)) for k, t in enumerate([*good, good[0]])] + [(None, None, None, None, None), (3, "", "aa", "s1", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")


def steps(labels):
    return {
        "language": langid.keep,
        "quality": quality.keep,
        "lines": lines.remove,
        "simhash": simhash.deduplicate,
        "kneser": lambda spark, df: kneser.keep(spark, df, labels),
    }


@pytest.mark.parametrize("name", ["language", "quality", "lines", "simhash", "kneser"])
def test_filters_keep_all_columns_whatever_their_names(spark, docs, labels, name):
    extra = docs.withColumns({c: F.lit(k) for k, c in enumerate(NAMES)})
    step = steps(labels)[name]
    got = step(spark, extra)
    assert got.columns == extra.columns
    first = lambda df: sorted(map(str, (tuple(r)[:5] for r in df.collect())))
    assert first(got) == first(step(spark, docs))
    rest = got.select(*NAMES).distinct().collect()
    assert len(rest) <= 1 and all(list(r) == list(range(len(NAMES))) for r in rest)
    assert step(spark, extra.limit(0)).count() == 0


def test_reports_ignore_other_columns(spark, docs, labels):
    extra = docs.withColumns({c: F.lit(k) for k, c in enumerate(NAMES) if c not in docs.columns})
    for report in (simhash.report, quality.report, packing.report, lines.report, pieces.report, langid.report, lm.score, lambda s, d: kneser.report(s, d, labels)):
        assert sorted(map(str, report(spark, extra).collect())) == sorted(map(str, report(spark, docs).collect()))
    pages = spark.createDataFrame([(1, "u", "<p>x", 2, "z")], "page_id long, url string, html string, key int, block string")
    assert warc.report(spark, pages).first().text_chars == 1


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST", 50)
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("j"), F.col("id").alias("at"))
    table = common.stage(spark, rows.groupBy(F.col("k").alias("o"), F.col("j").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low")), "t")
    assert common.join_split(rows, ["k", "j"], table, ["o", "p"], "n", ["at"]).columns == ["k", "j", "at", "o", "p", "n", "low"]
    got = common.join_split(rows, ["k", "j"], table, ["o", "p"], "n", ["at"]).groupBy("k", "j").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.countDistinct("low").alias("d")).collect()
    assert sum(r.c for r in got) == 5000 and all(r.c == r.n and r.d == 1 for r in got)


def test_components_of_a_hub(spark):
    n = 100_000
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).unionByName(spark.range(n, n + 50).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    got = graph.components(spark, edges).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in got} == {0: n - 1, n: 50}


def test_staged_tables_go_with_their_scope(spark):
    kept = common.stage(spark, spark.range(3), "kept")
    with common.staged(spark):
        gone = common.stage(spark, spark.range(5), "gone")
        assert gone.count() == 5
    assert kept.count() == 3 and gone._rasterloom_path not in common.staged_paths()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(gone._rasterloom_path).count()


def test_very_long_texts_are_taken_whole(spark):
    words = [f"w{k % 977}x{k % 31}" for k in range(200_000)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), "short text of five words", None]
    df = spark.createDataFrame([(k, t, "aa", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    scored = {r.doc_id: r for r in lm.score(spark, df).collect()}
    assert [scored[k].n_tokens for k in range(4)] == [200_001, 200_001, 6, 1]
    prints = {r.doc_id: r for r in simhash.report(spark, df).collect()}
    assert prints[1].component_id == 0 and prints[2].component_id == 2  # one word of 200,000 differs
    assert {r.doc_id: r.n_words for r in quality.report(spark, df).collect()} == {0: 200_000, 1: 200_000, 2: 5, 3: 0}
    pieces_ = packing.report(spark, df).where("doc_id = 0").collect()
    assert sum(r.length for r in pieces_) > 200_000 and max(r.length for r in pieces_) == 2048
