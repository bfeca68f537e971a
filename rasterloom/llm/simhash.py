"""SimHash near-duplicates by a binary trie self-join.

Every document gets a 64-bit fingerprint of its 3-word shingles. The distinct
fingerprints form a binary trie. Its upper part is cut into leaves (subtrees) of a
bounded number of fingerprints; pairs of leaves whose prefixes differ in no more
bits than the budget become tasks. A task walks the two subtrees together, node
pair by node pair, adds up differing bits and drops a pair once the budget is
exceeded. It returns a spanning forest of the links it found, so a dense group of
near copies yields one row per fingerprint, not one per pair.

Defined results: a null or wordless text has fingerprint zero and links like any
other; fewer than three words give one shingle of them all; very long texts are hashed
whole, in blocks of shingles; bits at exactly half are 0; repeated rows and repeated
ids each get their row; an empty table gives an empty one; other columns of the input
are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh, join_split, release, ship, stage
from rasterloom.llm.graph import components

SEED = 42
WIDTH = 3
BUDGET = 2
#: A leaf holds about this part of the fingerprints, so that the copies that pairs of
#: leaves need stay in proportion to the input; but no fewer and no more than LEAF allows.
LEAVES = 32
LEAF = (500, 500_000)
#: Histogram bits for one refinement of the leaves.
STEP = 12
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - width + 1
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Every row of ``docs`` with its fingerprint as a signed long in ``out``."""
    fields = docs.schema
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x) for x in batch.column(text).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], [*kept, out])

    from pyspark.sql.types import LongType, StructType

    return docs.mapInArrow(run, StructType([*fields.fields]).add(out, LongType()))


# -- the trie -----------------------------------------------------------------


def walk(a: np.ndarray, b: np.ndarray | None, budget: int = BUDGET, small: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted distinct uint64 arrays within ``budget`` bits.

    ``b`` None joins ``a`` with itself and gives each pair once. Node pairs are
    ranges of the sorted arrays; they wait on a stack in bounded pieces.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    one = np.array([0])
    stack = [(0, one, np.array([len(a)]), one, np.array([len(b)]), np.zeros(1, np.int8))]
    while stack:
        depth, la, ha, lb, hb, diff = stack.pop()
        size = (ha - la) * (hb - lb)
        ready = size <= small if depth < 64 else np.ones(len(size), bool)
        if ready.any():
            yield from _compare(a, b, la[ready], ha[ready], lb[ready], hb[ready], budget, own)
            rest = ~ready
            la, ha, lb, hb, diff = la[rest], ha[rest], lb[rest], hb[rest], diff[rest]
        if not len(la):
            continue
        bit = np.uint64(1 << (63 - depth))
        high = np.uint64(((1 << depth) - 1) << (64 - depth)) if depth else np.uint64(0)
        ma = np.searchsorted(a, (a[la] & high) | bit)
        mb = np.searchsorted(b, (b[lb] & high) | bit)
        same = (la == lb) if own else np.zeros(len(la), bool)
        parts = [
            (la, ma, lb, mb, diff, None),
            (ma, ha, mb, hb, diff, None),
            (la, ma, mb, hb, diff + 1, None),
            (ma, ha, lb, mb, diff + 1, ~same),
        ]
        cols = [[], [], [], [], []]
        for pla, pha, plb, phb, pd, allowed in parts:
            ok = (pha > pla) & (phb > plb) & (pd <= budget)
            if allowed is not None:
                ok &= allowed
            for col, value in zip(cols, (pla, pha, plb, phb, pd), strict=True):
                col.append(value[ok])
        la, ha, lb, hb, diff = (np.concatenate(c) for c in cols)
        for at in range(0, len(la), _CHUNK):
            cut = slice(at, at + _CHUNK)
            stack.append((depth + 1, la[cut], ha[cut], lb[cut], hb[cut], diff[cut]))


def _compare(a, b, la, ha, lb, hb, budget, own):
    na, nb = ha - la, hb - lb
    size = na * nb
    order = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(order, (order[at - 1] if at else 0) + 8 * _CHUNK, "right")))
        s = size[at:to]
        which = np.repeat(np.arange(at, to), s)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
        i = la[which] + inner // nb[which]
        j = lb[which] + inner % nb[which]
        ok = np.bitwise_count(a[i] ^ b[j]) <= budget
        if own:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]
        at = to


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of ``i`` and ``j``; labels point at the smallest member."""
    while True:
        x, y = labels[i], labels[j]
        open_ = x != y
        if not open_.any():
            return labels
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def forest(a: np.ndarray, b: np.ndarray | None, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links between the sorted arrays."""
    values = a if b is None else np.concatenate((a, b))
    labels = np.arange(len(values))
    for i, j in walk(a, b, budget):
        labels = merge(labels, i, j if b is None else j + len(a))
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def leaves(prints: DataFrame, total: int, leaf: tuple[int, int] = LEAF) -> list[tuple[int, int]]:
    """(prefix, depth) of subtrees that hold at most total / LEAVES fingerprints each, within the bounds.

    Only counts by prefix come to the driver: at most 2**STEP for each subtree that is
    still too large, and at most total / cap of these exist.
    """
    cap = int(np.clip(-(-total // LEAVES), *leaf))
    done: list[tuple[int, int]] = []
    open_: list[tuple[int, int]] = [(0, 0)]
    depth = 0
    while open_:
        bits = min(STEP, 64 - depth)
        key = F.shiftrightunsigned("fp", 64 - depth - bits)
        frame = prints
        if depth:
            above = F.shiftrightunsigned("fp", 64 - depth)
            frame = prints.where(above.isin([_signed(p) for p, _ in open_]))
        counts = {int(r["k"]) & ((1 << 64) - 1): int(r["n"]) for r in frame.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
        keys = sorted(counts)
        sums = np.concatenate(([0], np.cumsum([counts[k] for k in keys]))) if keys else np.zeros(1)
        after: list[tuple[int, int]] = []
        todo = list(open_)
        while todo:
            prefix, d = todo.pop()
            rest = depth + bits - d
            lo, hi = np.searchsorted(keys, prefix << rest), np.searchsorted(keys, (prefix + 1) << rest)
            n = int(sums[hi] - sums[lo])
            if not n:
                continue
            if n <= cap or d == 64:
                done.append((prefix, d))
            elif rest == 0:
                after.append((prefix, d))
            else:
                todo += [(prefix << 1, d + 1), ((prefix << 1) | 1, d + 1)]
        open_, depth = after, depth + bits
    return sorted(done, key=lambda x: x[0] << (64 - x[1]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tasks_of(cut: list[tuple[int, int]], budget: int = BUDGET) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Starts of the leaves; for each leaf the tasks it is the left or the right side of."""
    starts = np.array([p << (64 - d) for p, d in cut], dtype=np.uint64)
    masks = np.array([(((1 << d) - 1) << (64 - d)) for _, d in cut], dtype=np.uint64)
    left: list[list[int]] = [[] for _ in cut]
    right: list[list[int]] = [[] for _ in cut]
    task = 0
    for i in range(len(cut)):
        near = np.bitwise_count((starts[i:] ^ starts[i]) & masks[i:] & masks[i]) <= budget
        for j in (np.flatnonzero(near) + i).tolist():
            left[i].append(task)
            if j != i:
                right[j].append(task)
            task += 1
    return starts, [np.array(x, np.int64) for x in left], [np.array(x, np.int64) for x in right]


def links(spark: SparkSession, prints: DataFrame, budget: int = BUDGET, leaf: tuple[int, int] = LEAF) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints ``prints(fp)`` within ``budget`` bits."""
    ship(spark)
    cut = leaves(prints, prints.count(), leaf)
    starts, left, right = tasks_of(cut, budget)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, fp.view(np.uint64), "right") - 1
            for side, table in ((0, left), (1, right)):
                times = np.array([len(x) for x in table], np.int64)
                rep = times[at]
                task = np.concatenate([table[k] for k in at.tolist()]) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task, pa.int64()), pa.array(np.full(len(task), side, np.int32)), pa.array(np.repeat(fp, rep), pa.int64())],
                    ["task", "side", "fp"],
                )

    def join(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        u, v = forest(a, b if len(b) else None, budget) if len(a) else (a, a)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = prints.select("fp").mapInArrow(deal, "task long, side int, fp long")
    own = {int(x[0]) for x in left if len(x)}  # a leaf's first task joins it with itself

    def one(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        if task not in own and not (table.column("side").to_numpy() == 1).any():
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        return join(table)

    return dealt.groupBy("task").applyInArrow(one, "u long, v long")


def classes_of(spark: SparkSession, rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """classes(class_fp, n, root, component_id, class_rows) of staged rows (id, fp): a row for each fingerprint.

    ``component_id`` is the smallest id whose document is reachable by links.
    """
    prints = stage(spark, rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "prints")
    found = components(spark, links(spark, prints, budget))
    member = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    member = stage(spark, member, "member")
    low = stage(spark, member.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component_id"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("m")), "low")
    out = join_split(member, ["root"], low, ["r"], "m", ["fp"])
    classes = stage(spark, out.select(F.col("fp").alias("class_fp"), "n", "root", "component_id", "class_rows"), "classes")
    release(prints, member, low)
    return classes


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """id, fp, the hash and length of the text, and the columns of the class, for every row of ``docs``."""
    ship(spark)
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"), F.length(text).alias("size"), F.monotonically_increasing_id().alias("at"))
    rows = stage(spark, fingerprints(source, "t", "fp").drop("t"), "fingerprints")
    return join_split(rows, ["fp"], classes_of(spark, rows, budget), ["class_fp"], "n", ["at"]).drop("at")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and the rows of the class."""
    rows = near_duplicates(spark, docs)
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_rows")


def deduplicate(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class stays: the smallest id, then the smallest fingerprint, length and hash of the text.

    A row repeated with the same id and text stays once. Only ids, fingerprints and
    hashes are compared; whole texts move once, to meet the list of those that stay.
    """
    rows = near_duplicates(spark, docs, doc_id, text)
    stays = rows.groupBy("root").agg(F.min(F.struct("id", "fp", "size", "h")).alias("s"))
    stays = stays.select(F.xxhash64("s.id").alias("stays_i"), F.col("s.h").alias("stays_h"))
    i, h, number = fresh(docs.withColumns({"stays_i": F.lit(0), "stays_h": F.lit(0)}), "hash_of_id", "hash_of_text", "number")
    keyed = docs.withColumns({i: F.xxhash64(doc_id), h: F.xxhash64(text)})
    names = fresh(keyed, "stays_i", "stays_h")
    stays = stays.toDF(*names)
    # repeated rows are cut to one in every task before they move, so no repeated row is hot
    order = Window.partitionBy(i, h).orderBy(F.lit(0))
    once = keyed.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    return once.join(stays, (F.col(i) == F.col(names[0])) & (F.col(h) == F.col(names[1])), "left_semi").select(*docs.columns)
