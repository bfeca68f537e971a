"""Best-fit packing of tokenised documents by exact-complement hashing.

Only the histogram of piece lengths (``capacity`` bins at most) comes to the driver.
There the sums that one, two and three available lengths reach are indexed as bit sets.
The longest open length takes the combination whose sum fills its gap exactly, found
from the index, as often as all its counts allow; if there is none it takes the
best-fitting length and looks again for the rest. The result is a
list of patterns with multiplicities; every pattern uses up a length, so the list is
bounded by the histogram, not by the corpus. Pieces are numbered within their length
in salted groups and look their place up by that number; the salt is a running number
of the pieces of a task, so repeated rows are spread as well.

Defined results: a null text counts as empty and gives one piece with the end token
only; repeated rows and ids are packed as documents of their own; an empty table
gives an empty one; other columns are ignored. Very long texts are cut in pieces of
the capacity; the last one may be shorter. Among combinations of equal sum the one
with the longest length is taken.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter, or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import ship, stage

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END = b"\0\0\0\0"
#: Words that a worker remembers the ids of at most; beyond it starts anew.
REMEMBERED = 900_000
#: Words of ASCII and of Latin letters whose lower case and normal form are plain, without apostrophes and the marks of special tokens; and the runs that a vocabulary with these cuts makes of them.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+").fullmatch
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_are_known(vocabulary: dict) -> bool:
    """Whether words are lower-cased and cut by ``_CUTS`` into runs that go to a BPE model by their bytes."""
    steps = [x["type"] for x in (vocabulary["normalizer"] or {}).get("normalizers", [])]
    cuts = (vocabulary["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = cuts[0] if cuts else {}
    return (steps, [x["type"] for x in cuts], split.get("pattern"), split.get("behavior"), split.get("invert"), vocabulary["model"]["type"]) == (
        ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], {"Regex": _CUTS}, "Removed", True, "BPE"
    ) and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and vocabulary["post_processor"] is None


def _byte_letters() -> dict[int, str]:
    """The letter for each byte of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(rest)}
#: Rows in a salted group of one length, about; salts at most.
GROUP, SALTS = 5_000, 4_096


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Ids (little-endian 32-bit, as bytes) of words cut at ASCII white space.

    The vocabulary drops white space and never joins across it, so a text's ids are
    its words' ids. Where the vocabulary's cuts are known, a plain word's ids are those
    of its runs of letters, digits and other characters, straight from the model.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.bpe = self.model.model if _cuts_are_known(json.load(file)) else None
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode("utf-8", "replace")
        runs = _RUNS(text.lower()) if self.bpe and _PLAIN(text) else []
        if len(runs) > 1:
            ids = b"".join([self[run.encode()] for run in runs])
        else:
            found = [t.id for t in self.bpe.tokenize(self.spelt(runs[0]))] if runs else self.model.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def spelt(self, run: str) -> str:
        return run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)

    def encode(self, text: str | bytes | None) -> bytes:
        text = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
        words = text.lower().split()
        return b"".join(itemgetter(*words)(self)) if len(words) > 1 else b"".join([self[w] for w in words])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and a running number ``spread``."""
    ship(spark)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        count = TaskContext.get().partitionId() * 7919
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, value in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = coder.encode(value) + END
                for p, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    at.append(k), piece.append(p), start.append(lo // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(range(count, count + len(at)), pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "spread"],
            )
            count += len(at)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, spread long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns (multiplicity, lengths) that use every piece of ``counts`` once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index: list[int] = []  # bit t is set where one, two, three available lengths reach the total t
    whole = (1 << capacity + 1) - 1
    out: list[tuple[int, list[int]]] = []

    def complement(gap: int, used: list[int]) -> list[int] | None:
        """One, two or three available lengths that add up to the gap; the largest first."""
        if not index:
            for _ in range(3):
                below = index[-1] if index else 1
                index.append(reduce(or_, (below << int(x) for x in np.flatnonzero(left > 0)), 0) & whole)
        if not any(sums >> gap & 1 for sums in index):
            return None
        free = left[: gap + 1].copy()
        for x in used:
            if x <= gap:
                free[x] -= 1
        if free[gap] > 0:
            return [gap]
        have = free > 0

        def pair(total: int, most: int, spent: int = 0) -> list[int] | None:
            a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
            for x in a[have[a] & have[total - a]].tolist():
                y = total - x
                if free[x] - (x == spent) >= 1 + (x == y) and free[y] - (y == spent) >= 1 + (x == y):
                    return [x, y]
            return None

        if index[1] >> gap & 1 and (found := pair(gap, gap)):
            return found
        if index[2] >> gap & 1:
            tops = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
            for x in tops[have[tops]].tolist():
                if index[1] >> gap - x & 1 and (found := pair(gap - x, x, x)):
                    return [x, *found]
        return None

    for longest in range(capacity, 0, -1):
        while left[longest] > 0:
            lengths, gap = [longest], capacity - longest
            while gap:
                found = complement(gap, lengths)
                if found:
                    lengths += found
                    break
                free = left[: gap + 1].copy()
                for x in lengths:
                    if x <= gap:
                        free[x] -= 1
                fits = np.flatnonzero(free > 0)
                if not len(fits):
                    break
                lengths.append(int(fits[-1]))
                gap -= lengths[-1]
            need: dict[int, int] = {}
            for x in lengths:
                need[x] = need.get(x, 0) + 1
            times = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= times * k
                if left[x] == 0:
                    index.clear()
            out.append((times, lengths))
    return out


def places(patterns: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first numbers of its runs, the sequence of each run's first piece, the offset."""
    taken = np.zeros(capacity + 1, np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for times, lengths in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((int(taken[x]), first, offset))
            taken[x] += times
            offset += x
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in runs.items()}


def place(spark: SparkSession, parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (as ``pieces`` gives them; staged) without ``spread``, and sequence_id, offset."""
    rows = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a length, ``capacity`` at most
    counts = {int(r["length"]): int(r["n"]) for r in rows}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity), capacity))
    salts = int(np.clip(-(-sum(counts.values()) // GROUP), 16, SALTS))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("spread"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start", "spread")
    ranked = salted.join(sizes, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.withColumn("number", F.col("before") + F.row_number().over(inner) - 1).select(*(c for c in parts.columns if c != "spread"), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                start, first, place = known[x]
                run = np.searchsorted(start, number[at], "right") - 1
                seq[at] = first[run] + number[at] - start[run]
                offset[at] = place[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([f for f in ranked.schema.fields if f.name != "number"]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(run, schema)


def report(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    parts = stage(spark, pieces(spark, docs, capacity=capacity), "pieces")
    return place(spark, parts, capacity)
