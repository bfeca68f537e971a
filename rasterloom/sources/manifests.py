"""Manifests as versioned CSV tables on any file system that Spark writes.

The first version is the table itself; later ones lie beside it, in ``<path>.versions/<n>``. A writer
reads version n, claims n + 1 by a file that can be made only once, writes the whole next
version and is done with the commit of that write; readers take the highest committed
version. The table itself is then replaced by a copy of it, for readers that know of no versions. A second writer that read the same version finds the claim and starts anew from the newer
one, so no row is lost, and a reader never sees half a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rasterloom.operators import compare
from rasterloom.operators.scenes import InputDataError
from rasterloom.sources import tables


class Conflict(InputDataError):
    """Another writer holds the next version."""


def _fs(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target  # noqa: SLF001


def version(spark: SparkSession, path: str) -> int:
    """The highest committed version; -1 where there is no table."""
    fs, folder = _fs(spark, f"{path}.versions")
    found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [int(n) for n in found if n.isdigit() and fs.exists(_fs(spark, f"{path}.versions/{n}/_SUCCESS")[1])]
    fs, first = _fs(spark, path)
    return max(done, default=0 if fs.exists(first) else -1)


def location(spark: SparkSession, path: str, at: int | None = None) -> str:
    at = version(spark, path) if at is None else at
    return f"{path}.versions/{at}" if at > 0 else path


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The current version."""
    return tables.read_csv(spark, location(spark, path), schema)


def update(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], changes: DataFrame, check: Callable[[DataFrame], None] | None = None, tries: int = 5) -> int:
    """The next version: ``changes`` (keys and some of the columns) for the rows of their keys, the others as they are.

    An unknown column is a KeyError, a key that the table lacks a ValueError; ``check`` may refuse the new table. Gives its number.
    """
    for _ in range(tries):
        at = version(spark, path)
        if at < 0:
            raise InputDataError(f"no table at {path}")
        new = compare.update_rows(read(spark, path, schema), changes, keys).select(*schema.names)
        if check is not None:
            check(new)
        try:
            _commit(spark, path, new, at + 1)
            return at + 1
        except Conflict:
            if version(spark, path) == at:
                raise
    raise Conflict(f"{path} changes too often")


def _commit(spark: SparkSession, path: str, new: DataFrame, at: int) -> None:
    fs, claim = _fs(spark, f"{path}.versions/{at}.claim")
    if not fs.createNewFile(claim):
        raise Conflict(f"version {at} of {path} is being written")
    try:
        tables.write_csv(new, f"{path}.versions/{at}", "overwrite", files=1)
    except Exception:
        fs.delete(claim, False)
        raise
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    for old, to in ((path, f"{path}.versions/0"), (f"{path}.versions/{at}", f"{path}.next")):
        if at == 1 or not to.endswith("/0"):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, _fs(spark, old)[1], fs, _fs(spark, to)[1], False, True, conf)
    fs.delete(_fs(spark, path)[1], True)
    if not fs.rename(_fs(spark, f"{path}.next")[1], _fs(spark, path)[1]):
        raise InputDataError(f"{path} could not be replaced; version {at} is kept")
