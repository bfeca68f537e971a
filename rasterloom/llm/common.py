"""Staging tables, shipping the package to Python workers, small helpers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import ship  # noqa: F401

#: ASCII white space that separates words in every contract of this package.
SPACE = " \t\n\x0b\f\r"

_staged: list[tuple[SparkSession, str]] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where it is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.environ.get("RASTERLOOM_STAGING")
        if not root:
            root = os.environ["RASTERLOOM_STAGING"] = tempfile.mkdtemp(prefix="rasterloom-")
        root = root if "://" in root else f"file://{root}"
    return root.rstrip("/")


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` the rows are computed once and stay columnar, so later
    readers prune columns. A lost executor only costs the re-read of its splits.
    """
    path = f"{staging_root(spark)}/rasterloom-stage/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._rasterloom_path = path  # noqa: SLF001
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_rasterloom_path", None)
        if path:
            for at, (spark, known) in enumerate(_staged):
                if known == path:
                    _delete(spark, path)
                    del _staged[at]
                    break


def staged_paths() -> set[str]:
    return {path for _, path in _staged}


def release_since(before: set[str], keep: DataFrame) -> None:
    """Delete what was staged after ``before`` was taken, but for ``keep``."""
    kept = getattr(keep, "_rasterloom_path", None)
    for spark, path in list(_staged):
        if path not in before and path != kept:
            _delete(spark, path)
            _staged.remove((spark, path))


def sweep(spark: SparkSession) -> None:
    """Have the driver drop plans that nothing refers to, so that Spark's cleaner deletes their shuffle files before the next pass writes its own."""
    gc.collect()
    spark.range(1).count()  # listeners hold the plan of the last query until another has ended
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """A scope that deletes the tables staged within it when it ends; write what is to stay before."""
    before = staged_paths()
    try:
        yield
    finally:
        release_since(before, spark.range(0))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    fs.delete(target.getParent(), True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _staged:
        with suppress(Exception):
            if spark.sparkContext._jsc is not None:  # noqa: SLF001
                _delete(spark, path)
    _staged.clear()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, one for each wanted name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with over 1 / HOT of all rows, and over LEAST, is dealt over several tasks; HOT keys can be so at most.
HOT, LEAST = 2_000, 500


def join_split(rows: DataFrame, keys: list[str], table: DataFrame, others: list[str], n: str, mix: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (staged, a row a key) where ``keys`` equal ``others``; no task gets a hot key whole.

    ``n`` is the column of ``table`` that has the number of rows with that key. Hot
    keys, HOT at most, are broadcast to salt their rows by a hash of ``mix``; the table
    has such a key once for each salt.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    limit = max(LEAST, total // HOT)
    equal = lambda a, b: F.lit(True) if not a else reduce(lambda x, y: x & y, (F.col(i) == F.col(j) for i, j in zip(a, b, strict=True)))
    hot = table.where(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(table, equal(keys, others), how)
    names = [f"_hot_{k}" for k in range(len(keys))]
    hot = hot.select(*(F.col(o).alias(h) for o, h in zip(others, names, strict=True)), F.ceil(F.col(n) / limit).cast("int").alias("_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*mix), F.col("_salts")), F.lit(0)).cast("int")
    left = rows.join(F.broadcast(hot), equal(keys, names), "left").select(*(F.col(c) for c in rows.columns), salt.alias("_salt"))
    right = table.withColumn("_of", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / limit).cast("int"), F.lit(1)) - 1)))
    out = left.join(right, equal([*keys, "_salt"], [*others, "_of"]), how)
    return out.drop("_salt", "_of")


def bucket_of(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
