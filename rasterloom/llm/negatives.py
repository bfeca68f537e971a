"""Hard negatives by exact inner products over k-means inverted lists.

Centroids are fitted on a bounded sample; every row goes to the list of its nearest centroid,
and a list stores its radius, the largest distance of a member. By Cauchy and Schwarz the
product of an anchor a with any member lies within a.c - |a|r and a.c + |a|r. An anchor
visits lists by that upper bound, highest first, skips a list whose interval is outside its
window of scores, and stops when the upper bound falls strictly below its k-th score so
far (at equal scores a smaller id may still come in). So results are exact, whatever the lists.

Lists are dealt in groups of bounded size (small ones together, a large one over
several), which tasks hold while anchors stream by. Anchors go first to the group of their
best list alone, and then, with the k-th score from there, to every other group that the bounds
don't exclude. Groups with very many anchors are held by several tasks. The positives of all anchors come first;
their scores are the windows of the second search. Products are exact integers: in
single precision where they all fit 24 bits, in double precision up to 53, else as longs.

Vectors that no list separates (spread evenly in all directions) are compared with every anchor, in
blocks: the bounds are of no use there and cost little.

Defined results: rows without an id or a label, with a null vector, or with a part that is null or not
finite (or beyond 65,536, as sums of products may not fit a long) take no part; vectors of unequal length count as if padded with zeros, an
empty one as zeros; ties come by smaller id; repeated rows are rows of their own, so an anchor's
copy is another row; anchors with fewer partners have fewer rows, or none; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import release, ship, stage
from rasterloom.llm.embeddings import kmeans, nearest

#: Rows that the centroids are fitted on, and lists, at most.
SAMPLE = 20_000
LISTS = 4_096
#: Bytes of the vectors of a group, and anchors that one task compares with it, at most.
GROUP_BYTES = 64 << 20
ANCHORS = 100_000
SEED = 11
POSITIVES = NEGATIVES = 5
#: A negative has at least LEAST hundredths of its positive's score.
LEAST = 80


def quantised(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", label: str | Column = "label", scale: int = 256) -> DataFrame:
    """(uid, id, label, q): rows that take part, their parts as integers floor(scale * x)."""
    v, tag = F.col(column), F.col(label) if isinstance(label, str) else label
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < 65_536.0), F.lit(False)) & ~F.isnan(x))
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("id"), tag.cast("long").alias("label"), F.when(F.coalesce(fine, F.lit(False)), q).alias("q"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """Integer matrix of a list column, with zeros up to ``dim``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim).astype(np.int32)
    out = np.zeros((len(column), dim), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Lists:
    """Centroids, radii, sizes, and the groups that hold each list: ``groups`` of them from ``first`` on."""

    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    groups: np.ndarray
    kind: type

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of each row of ``x`` with a member of each list, with room for rounding; empty lists have none."""
        mid, reach = x @ self.centres.T, np.sqrt((x**2).sum(axis=1))[:, None] * self.radii[None]
        slack = 1e-6 + 1e-9 * (np.abs(mid) + reach)
        empty = (self.radii < 0)[None]
        return np.where(empty, np.inf, mid - reach - slack), np.where(empty, -np.inf, mid + reach + slack)

    def of_groups(self, high: np.ndarray) -> np.ndarray:
        """The highest of ``high`` (rows, lists) in each group: (rows, groups)."""
        lists = np.repeat(np.arange(len(self.first)), self.groups)
        group = self.first[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(self.groups) - self.groups, self.groups)
        out = np.full((len(high), int(group.max()) + 1), -np.inf)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        out[:, group[order][starts]] = np.maximum.reduceat(high[:, lists[order]], starts, axis=1)
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by higher score, then smaller id; sorting no more than needed."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over, at = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        at = at[np.argpartition(ids[at], k - 1)[:k]] if len(at) > k else at
        pick = np.concatenate((over, at))
        scores, ids = scores[pick], ids[pick]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Held:
    """The rows of a group, list by list, with the search of one anchor."""

    def __init__(self, lists: Lists, at: np.ndarray, uid: np.ndarray, ids: np.ndarray, label: np.ndarray, q: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.lists, self.known = lists, np.unique(at)
        self.cuts = np.searchsorted(at[order], self.known), np.searchsorted(at[order], self.known, "right")
        self.uid, self.ids, self.label, self.q = uid[order], ids[order], label[order], q[order].astype(lists.kind)

    def search(self, x: np.ndarray, uid: int, label: int, low: np.ndarray, high: np.ndarray, same: bool, kth: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window [low, high] of scores the first k members of the same label (or of others), worse than ``kth`` left out."""
        lo, up = (b[0, self.known] for b in self.lists.bounds(x[None].astype(np.float64)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        floor = np.maximum(low, kth)
        x = x.astype(self.lists.kind)
        for at in np.argsort(-up, kind="stable"):
            if up[at] < floor.min():
                break  # strictly below every k-th score: so are all lists after it
            open_ = np.flatnonzero((up[at] >= floor) & (lo[at] <= high))
            if not len(open_):
                continue  # outside the windows
            a, b = self.cuts[0][at], self.cuts[1][at]
            score = (self.q[a:b] @ x).astype(np.int64)
            fits = (self.label[a:b] == label) & (self.uid[a:b] != uid) if same else self.label[a:b] != label
            for w in open_:
                pick = np.flatnonzero(fits & (score >= floor[w]) & (score <= high[w]))
                if len(pick):
                    s, i = best(np.concatenate((found[w][0], score[pick])), np.concatenate((found[w][1], self.ids[a:b][pick])), k)
                    found[w] = s, i
                    if len(s) == k:
                        floor[w] = max(floor[w], s[-1])
        return found


#: Bounds of scores that no product reaches.
FAR = float(1 << 62)
#: Probes: anchors with their windows (positives of them in the second search) and k-th scores.
PROBE = "task long, kind int, list int, uid long, id long, label long, q binary, partners array<long>, scores array<long>, kth array<long>"
FOUND = "uid long, anchor long, place long, partner long, partner_score long, id long, score long"


class Index:
    """Inverted lists over staged rows (uid, id, label, q), and their searches."""

    def __init__(self, spark: SparkSession, rows: DataFrame, anchors: Column):
        ship(spark)
        self.spark = spark
        self.rows = stage(spark, rows.withColumn("anchor", anchors), "rows")
        s = self.rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d"), F.max(F.array_max(F.transform("q", F.abs))).alias("top"), F.count_if("anchor").alias("anchors")).first()
        self.n, self.dim, self.anchors = int(s["n"]), max(1, int(s["d"] or 1)), int(s["anchors"])
        most = int(s["top"] or 0) ** 2 * self.dim
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if self.n:
            self._deal()

    def _deal(self) -> None:
        spark, dim, kind = self.spark, self.dim, self.kind
        sample = self.rows.select("q").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).toArrow().column("q").combine_chunks()
        x = padded(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, dim).astype(np.float64)
        k = int(np.clip(np.sqrt(self.n), 1, min(LISTS, max(1, len(x) // 4))))
        centres = kmeans(x, k, 6, np.random.default_rng(SEED))
        # lists that lie near each other along the widest direction share groups
        centres = centres[np.argsort(centres @ np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0], kind="stable")]
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = padded(b.column("q"), dim)
                at = nearest(q.astype(np.float64), shared.value)
                far = np.sqrt(((q - shared.value[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), b.column("label"), pa.array([r.tobytes() for r in q], pa.binary()), b.column("anchor"), pa.array(at, pa.int32()), pa.array(far)], cells)

        cells = ["uid", "id", "label", "q", "anchor", "list", "far"]
        self.cells = stage(spark, self.rows.mapInArrow(assign, "uid long, id long, label long, q binary, anchor boolean, list int, far double"), "cells")
        release(self.rows)
        radii, sizes = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
        for r in self.cells.groupBy("list").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # LISTS rows at most
            radii[r["list"]], sizes[r["list"]] = r["r"], r["n"]
        tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        share = max(256, min(GROUP_BYTES // (4 * dim), -(-self.n // tasks)))
        first, groups, filled, at = np.zeros(len(centres), np.int64), np.maximum(1, -(-sizes // share)), 0, 0
        for j, size in enumerate(sizes):
            if filled and (groups[j] > 1 or filled + size > share):
                at, filled = at + 1, 0
            first[j] = at
            filled += size
            if groups[j] > 1:
                at, filled = at + groups[j], 0
        self.lists = spark.sparkContext.broadcast(Lists(centres, radii, first, groups, kind))

    def members(self, salts: DataFrame | None) -> DataFrame:
        """Rows of the lists as tasks hold them."""
        of = self.lists

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = of.value
            for b in batches:
                at, uid = b.column("list").to_numpy(), b.column("uid").to_numpy()
                mix = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                group = lists.first[at] + (mix % lists.groups[at].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(group), *(b.column(c) for c in names[1:])], names)

        names = ["task", "list", "uid", "id", "label", "q"]
        out = self.cells.select(*names[1:]).mapInArrow(place, "task long, list int, uid long, id long, label long, q binary")
        salt = F.lit(0).cast("long")
        if salts is not None:  # one row a group that has many anchors
            out = out.join(F.broadcast(salts), F.col("task") == F.col("group"), "left")
            out = out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
            salt = F.col("salt").cast("long")
        null = F.lit(None).cast("array<long>")
        return out.select((F.col("task") * F.lit(1 << 20) + salt).alias("task"), F.lit(0).alias("kind"), "list", "uid", "id", "label", "q", null.alias("partners"), null.alias("scores"), null.alias("kth"))

    def search(self, probes: DataFrame, same: bool, k: int, later: bool) -> DataFrame:
        """What the anchors ``probes(uid, id, label, q, partners, scores, kth)`` find: rows of FOUND.

        Without ``scores`` there is one window, all scores. Not ``later``: only in the
        group of the best list; ``later``: in all others that the bounds and kth leave.
        """
        of, dim = self.lists, self.dim

        def windows(scores: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
            if scores is None:
                return np.array([-FAR]), np.array([FAR])
            high = np.array(scores, np.float64)
            return np.array([-((-LEAST * s) // 100) for s in scores], np.float64), high

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = of.value
            for whole in batches:
                for cut in range(0, whole.num_rows, 512):
                    b = whole.slice(cut, 512)
                    x = np.frombuffer(b"".join(b.column("q").to_pylist()), np.int32).reshape(-1, dim).astype(np.float64)
                    lo, up = lists.bounds(x)
                    take, task = [], []
                    for r, (scores, kth) in enumerate(zip(b.column("scores").to_pylist(), b.column("kth").to_pylist(), strict=True)):
                        low, high = windows(scores)
                        if not len(low) or (low > high).all():
                            continue
                        floor = np.maximum(low, kth if later and kth else -FAR)
                        near = np.where((lo[r] <= high.max()) & (up[r] >= low.min()), up[r], -np.inf)
                        if not np.isfinite(near).any():
                            continue
                        home = lists.first[np.minimum(near, high.max()).argmax()]
                        if later:
                            open_ = ((up[r][:, None] >= floor) & (lo[r][:, None] <= high) & (low <= high)).any(axis=1)
                            groups = np.flatnonzero(np.isfinite(lists.of_groups(np.where(open_, up[r], -np.inf)[None])[0]))
                            groups = groups[groups != home]
                        else:
                            groups = np.array([home])
                        take += [r] * len(groups)
                        task += groups.tolist()
                    out = b.take(pa.array(take, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), *(out.column(c) for c in names[1:])], names)

        names = ["group", "uid", "id", "label", "q", "partners", "scores", "kth"]
        sent = probes.select(*names[1:]).mapInArrow(plan, "group long, uid long, id long, label long, q binary, partners array<long>, scores array<long>, kth array<long>")
        salts = None
        if self.anchors > ANCHORS:
            many = sent.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("salts")).where("salts > 1")
            salts = stage(self.spark, many, "salts")
            sent = sent.join(F.broadcast(salts.withColumnRenamed("group", "g")), F.col("group") == F.col("g"), "left")
        salt = F.pmod(F.xxhash64("uid"), F.coalesce("salts", F.lit(1)).cast("long")) if salts is not None else F.lit(0).cast("long")
        sent = sent.select((F.col("group") * F.lit(1 << 20) + salt).alias("task"), F.lit(1).alias("kind"), F.lit(-1).alias("list"), *names[1:])

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, held, group, task = of.value, None, [], None
            for whole in batches:
                for b in _runs(whole):
                    if b.column("task")[0].as_py() != task:
                        task, group, held = b.column("task")[0].as_py(), [], None
                    if b.column("kind")[0].as_py() == 0:
                        group.append(b)
                        continue
                    if held is None and group:
                        t = pa.Table.from_batches(group).combine_chunks()
                        q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int32).reshape(-1, dim)
                        held, group = Held(lists, *(t.column(c).to_numpy() for c in ("list", "uid", "id", "label")), q), []
                    if held is not None:
                        yield _found(held, b)

        def _found(held: Held, b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in FOUND.split(", ")]
            for r in b.to_pylist():
                low, high = windows(r["scores"])
                kth = np.array(r["kth"] or [-FAR] * len(low), np.float64)
                found = held.search(np.frombuffer(r["q"], np.int32), r["uid"], r["label"], low, high, same, kth, k)
                for w, (scores, ids) in enumerate(found):
                    n = len(ids)
                    row = (r["uid"], r["id"], w, r["partners"][w] if r["partners"] else None, r["scores"][w] if r["scores"] else None)
                    for column, value in zip(out, (*([v] * n for v in row), ids.tolist(), scores.tolist()), strict=True):
                        column += value
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [f.split()[0] for f in FOUND.split(", ")])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.members(salts).unionByName(sent).repartition(parts, "task").sortWithinPartitions("task", "kind")
        return rows.mapInArrow(visit, FOUND)


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of equal task and kind."""
    task, kind = b.column("task").to_numpy(), b.column("kind").to_numpy()
    cuts = np.flatnonzero((np.diff(task) != 0) | (np.diff(kind) != 0)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(task)], strict=True):
        if z > a:
            yield b.slice(a, z - a)


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k of each group by higher score, then smaller id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(spark: SparkSession, rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``rows(uid, id, label, q)``; ``anchors`` tells which rows are."""
    index = Index(spark, rows, anchors)
    if not index.n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    null = F.lit(None).cast("array<long>")
    probes = index.cells.where("anchor").select("uid", "id", "label", "q", null.alias("partners"), null.alias("scores"))
    # positives: at home, then wherever a higher score may be
    home = stage(spark, index.search(probes.withColumn("kth", null), True, positives, False), "home")
    kth = _kth(home, positives, "uid").select(F.col("uid").alias("u"), F.array("least").alias("kth"))
    rest = index.search(probes.join(kth, F.col("uid") == F.col("u"), "left"), True, positives, True)
    close = _first(home.unionByName(rest), positives, "uid").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("close"))
    close = close.select(F.col("uid").alias("u"), F.transform("close", lambda c: c["id"]).alias("partners"), F.transform("close", lambda c: c["score"]).alias("scores"))
    wanted = probes.drop("partners", "scores").join(stage(spark, close, "positives"), F.col("uid") == F.col("u")).drop("u")
    # negatives, within the windows of the positives
    home = stage(spark, index.search(wanted.withColumn("kth", null), False, negatives, False), "home")
    kth = _kth(home, negatives, "uid", "place").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("least"))
    kth = kth.select(F.col("uid").alias("u"), "least")
    each = F.transform("scores", lambda _, k: F.coalesce(F.element_at("least", k.cast("long")), F.lit(-(1 << 62))))
    rest = index.search(wanted.join(kth, F.col("uid") == F.col("u"), "left").withColumn("kth", F.when(F.col("least").isNotNull(), each)), False, negatives, True)
    out = _first(home.unionByName(rest), negatives, "uid", "place")
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("partner").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("partner_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _kth(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k-th score of each group that has as many."""
    return _first(found, k, *by).where(F.col("rank") == k).select(*by, F.col("score").alias("least"))


def report(spark: SparkSession, vectors: DataFrame, anchors: Callable[[Column], Column] = lambda i: i % 100 == 0) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; ids divisible by 7 have a noisy label, the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark, quantised(vectors.select("vec_id", "embedding", "label"), label=label), anchors(F.col("id")))
