"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and gives it, reread, to the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import langid, lines, packing, quality, simhash
from rasterloom.llm.common import release, release_since, stage, staged_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language stay."""
    return langid.keep(spark, docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger stay."""
    return quality.keep(spark, docs)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of cross-site boilerplate lines go from the texts; ``n_chars`` follows."""
    from pyspark.sql import functions as F

    clean = lines.remove(spark, docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return simhash.deduplicate(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences."""
    return packing.report(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("quality_rules", rules),
    ("line_dedup", boilerplate),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", pack),
]

#: Language ID, fingerprints and tokens have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        before = staged_paths()
        out = function(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        done = stage(spark, out, name)
        release_since(before, done)  # what the stage itself had written
        release(docs)
        docs = done
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
