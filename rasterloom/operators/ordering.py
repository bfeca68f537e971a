"""Positions in very large groups: row numbers, average ranks and quantiles without a task that sorts a group.

Rows (or counts of distinct values) are range-partitioned by group and order, so a group lies in
as many neighbouring partitions as it needs. A partition knows positions within itself; what
comes before it is a sum over a table of one row for each partition and group, which is small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_held: list[DataFrame] = []


def release() -> None:
    """Give back what was kept for results that nobody reads again."""
    while _held:
        _held.pop().unpersist()


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` in ranges of (keys, order), with its partition ``_p``.

    Kept, as the ends of ranges come from a sample: both readers must see the same ones. A lost part is made anew from the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_p", F.spark_partition_id())
    # the position within the partition: rows are sorted, and ids count up from 0 in each
    out = out.withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(out)
    return out


def _before(parts: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """(keys, _p, n, ...) with the sum of ``n`` over a group's earlier partitions (``_before``), and over all of them (``_n``)."""
    by = Window.partitionBy(*keys)
    earlier = F.sum(n).over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumns({"_before": F.coalesce(earlier, F.lit(0)), "_n": F.sum(n).over(by)})


def _same(keys: Sequence[str], prefix: str = "_g_") -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_k``, the number of a row in its group from 0, and ``_n``, the rows of the group."""
    keys = list(keys)
    ranged = _ranged(df, keys, order)
    parts = _before(ranged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_m"), F.min("_i").alias("_first")), keys, "_m")
    parts = parts.select(*(F.col(k).alias(f"_g_{k}") for k in keys), F.col("_p").alias("_q"), "_first", "_before", "_n")
    met = ranged.join(parts, (F.col("_p") == F.col("_q")) & _same(keys))
    return met.select(*df.columns, (F.col("_i") - F.col("_first") + F.col("_before")).alias("_k"), "_n")


def _hashes(columns: Sequence[str], *names: str) -> list[Column]:
    """Two independent hashes under the names: 16 bytes that stand for any number and kind of columns, nulls included."""
    return [F.xxhash64(*columns).alias(names[0]), F.xxhash64(F.lit(1), *columns).alias(names[1])]


def rank_table(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(_h, _h2, out): the average rank from 1 of each distinct value of a group, by the hashes of its group and value; null values come first.

    Equal values are counted before anything is sorted, so a value that very many rows have is one row. Groups are known by hashes, as their order doesn't matter.
    """
    group = ["_g", "_g2"]
    counts = df.select(*_hashes(keys, *group), F.col(value).alias("_v")).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = _ranged(counts, group, ["_v"])
    parts = _before(counts.groupBy(*group, "_p").agg(F.sum("_c").alias("_m")), group, "_m")
    parts = parts.select("_g", "_g2", "_p", "_before")
    upto = F.sum("_c").over(Window.partitionBy("_p", *group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))  # within one range
    ranks = counts.withColumn("_upto", upto).join(parts, ["_p", *group])
    return ranks.select(*_hashes([*group, "_v"], "_h", "_h2"), (F.col("_before") + F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, of: DataFrame | None = None) -> DataFrame:
    """Ranks from 1 in which ties share their mean, by a join with the ranks of distinct values (of ``of``, which has the same rows, where making ``df`` is dear)."""
    ranks = rank_table(df if of is None else of, keys, value, out)
    own = df.select("*", *_hashes(keys, "_g", "_g2")).select("*", *_hashes(["_g", "_g2", value], "_h", "_h2"))
    return own.join(ranks, ["_h", "_h2"]).select(*df.columns, out)


#: Bins of a pass, a power of two: 16 of the 64 bits of a key.
BINS = 65_536


def quantiles(df: DataFrame, value: str | Column, shares: Sequence[float], bins: int = BINS) -> list[float] | None:
    """Exact interpolated percentiles of a whole column; None without values. Nulls and NaN don't count.

    A double's 64 bits, turned so that they order as the values do, are refined by the bits of ``bins`` a
    pass for all ranks at once: tasks count the next bits of the keys that start as a wanted one, and
    only those counts, ``bins`` for each rank at most, leave them. Four passes, whatever the data.
    """
    v = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").persist(StorageLevel.MEMORY_AND_DISK)
    bits = bins.bit_length() - 1
    try:
        ranks: list[int] = []
        left: dict[int, int] = {}  # of each rank: how many values with its prefix come before it
        prefix: dict[int, int] = {}
        total = 0
        for done in range(0, 64, bits):
            step = min(bits, 64 - done)
            wanted = np.array(sorted(set(prefix.values())) or [0], np.uint64)
            counts = _counts(v, wanted, done, step)
            if not done:
                total = int(sum(counts[0].values()))
                if not total:
                    return None
                ranks = sorted({f(share * (total - 1)) for share in shares for f in (math.floor, math.ceil)})
                left, prefix = {r: r for r in ranks}, dict.fromkeys(ranks, 0)
            for r in ranks:
                for b, n in sorted(counts[int(np.searchsorted(wanted, np.uint64(prefix[r])))].items()):
                    if left[r] < n:
                        prefix[r] = prefix[r] << step | b
                        break
                    left[r] -= n
        known = {r: _value(prefix[r]) for r in ranks}
        out = []
        for share in shares:
            place = share * (total - 1)
            a, b = known[math.floor(place)], known[math.ceil(place)]
            out.append(a if a == b else a + (b - a) * (place - math.floor(place)))
        return out
    finally:
        v.unpersist()


def _keys(v: np.ndarray) -> np.ndarray:
    """Unsigned keys that order as the values do; both zeros have one."""
    raw = (v + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63), ~raw, raw | np.uint64(1 << 63))


def _value(key: int) -> float:
    raw = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _counts(v: DataFrame, wanted: np.ndarray, done: int, step: int) -> list[dict[int, int]]:
    """For each wanted prefix of ``done`` bits the counts by the next ``step`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted) << step, np.int64)
        for b in batches:
            key = _keys(b.column(0).to_numpy(zero_copy_only=False))
            if done:
                head = key >> np.uint64(64 - done)
                at = np.minimum(np.searchsorted(wanted, head), len(wanted) - 1)
                key, at = key[wanted[at] == head], at[wanted[at] == head]
            else:
                at = np.zeros(len(key), np.int64)
            own = (key >> np.uint64(64 - done - step)) & np.uint64((1 << step) - 1)
            total += np.bincount((at << step) + own.astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["b", "n"])

    out: list[dict[int, int]] = [{} for _ in wanted]
    for r in v.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"] >> step][r["b"] & ((1 << step) - 1)] = r["n"]
    return out
