"""Near-duplicate vectors by product quantisation.

Equal vectors (by two independent hashes of their parts) are collapsed first and count
with their number. An index is fitted on a bounded sample of the distinct ones: coarse centroids (inverted lists) and
codebooks for the subspaces of the residuals; centroids within the reach of another
(the distance at the least cosine) are merged. Every vector is coded in its home list
and visits all lists whose plane to its home is within half the reach. The two vectors
of a link lie on different sides of the plane between their homes, so one of them is
that near to it: no link is lost. In a list, a visitor's table of subspace distances
gives its distance to the coded members; with the stored quantisation error of each
member the triangle inequality makes that filter lossless too. What is left is
reranked by the exact cosine in double precision. A pair is found if either vector
visits the home list of the other, and is counted once.

Members within half the reach of their centroid are its core. They all link with each
other, so those pairs are counted without a search. Lists larger than ``BLOCK`` are
dealt in blocks of members and of visitors, so no task holds a whole hot list; the
pairs of a hot list outside its core are its square. Tasks return counts of links and
a spanning forest.

Vectors go to their lists as they are stored (32 or 64 bits a part) and are normalised
there in double precision.

Defined results: a vector that is null, zero, or holds null or non-finite parts
links with nothing; vectors of unequal length are compared as if padded with
zeros, however long; pairs at exactly the least cosine link; repeated rows are rows of their own; ids may be null (they are no component
id unless alone); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from rasterloom.llm.common import join_split, release, ship, stage
from rasterloom.llm.graph import components
from rasterloom.llm.simhash import merge

COSINE = 0.95
#: Vectors that the index is fitted on at most.
SAMPLE = 20_000
LISTS = 4_096
PARTS = 8
CODES = 256
#: Lists that a vector visits at least; more than the needed ones change no result.
PROBES = 1
BLOCK = 4_096
SEED = 7


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Double matrix of a list column, padded with zeros to ``dim`` and normalised, and which rows are valid."""
    return _checked(*_padded(column, dim))


def _padded(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.list_(pa.float64()))
    n = len(column)
    if column.null_count == 0 and n and column.flatten().null_count == 0 and len(column.flatten()) == n * dim:
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes == dim).all():
            return column.flatten().to_numpy(zero_copy_only=False).reshape(n, dim).copy(), np.ones(n, bool)
    out, ok = np.zeros((n, dim)), np.ones(n, bool)
    for k, row in enumerate(column.to_pylist()):
        if row is None or any(x is None for x in row):
            ok[k] = False
        else:
            out[k, : len(row)] = row
    return out, ok


def _checked(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok &= np.isfinite(x).all(axis=1)
    x[~ok] = 0
    top = np.abs(x).max(axis=1, initial=0)
    ok &= top > 0
    x[ok] /= top[ok, None]
    x[ok] /= np.sqrt((x[ok] ** 2).sum(axis=1))[:, None]
    return x, ok


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct random rows; an empty centre stays where it was."""
    k = min(k, len(x))
    return lloyd(x, x[rng.choice(len(x), k, replace=False)].copy(), rounds)


def lloyd(x: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    k = len(c)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full]) / n[full, None]
    return c


def merged(x: np.ndarray, c: np.ndarray, reach: float) -> np.ndarray:
    """The centres without those within ``reach`` of one that more rows are nearest to."""
    c = c[np.argsort(-np.bincount(nearest(x, c), minlength=len(c)), kind="stable")]
    left = np.ones(len(c), bool)
    for k in range(len(c)):
        if left[k]:
            left[k + 1 :] &= ((c[k + 1 :] - c[k]) ** 2).sum(axis=1) > reach**2
    return c[left]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - x[at : at + 4096] @ c.T).argmin(axis=1)
    return out


@dataclass
class Index:
    """Coarse centroids (lists, dim) and codebooks (parts, codes, dim / parts)."""

    coarse: np.ndarray
    books: np.ndarray
    reach: float
    probes: int

    @property
    def dim(self) -> int:
        return self.coarse.shape[1]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Home lists, which lists are visited (rows, lists), codes, quantisation errors, which rows are in the core of their home."""
        c = self.coarse
        half = (c**2).sum(axis=1) / 2
        gap = half - x @ c.T  # half the squared distance less a constant of the row
        home = gap.argmin(axis=1)
        apart = np.sqrt(np.maximum(((c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * c @ c.T), 1e-12))
        margin = (gap - gap[np.arange(len(x)), home][:, None]) / apart[home]
        margin[np.arange(len(x)), home] = -1
        visit = margin <= self.reach / 2 + 1e-6
        p = min(self.probes, len(c))
        np.put_along_axis(visit, np.argpartition(margin, p - 1, axis=1)[:, :p], True, axis=1)
        rest = x - c[home]
        parts, _, width = self.books.shape
        codes = np.stack([nearest(rest[:, m * width : (m + 1) * width], self.books[m]) for m in range(parts)], axis=1).astype(np.uint8)
        error = np.sqrt(((rest - self.decode(codes)) ** 2).sum(axis=1))
        return home, visit, codes, error, np.sqrt((rest**2).sum(axis=1)) <= self.reach / 2 - 1e-6

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[m][codes[:, m]] for m in range(len(self.books))], axis=1)

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances (rows, parts, codes) from the parts of x - coarse[at] to the codewords."""
        parts, codes, width = self.books.shape
        rest = (x - self.coarse[at]).reshape(len(x), parts, width)
        return np.stack([(rest[:, m] ** 2).sum(axis=1)[:, None] + (self.books[m] ** 2).sum(axis=1) - 2 * rest[:, m] @ self.books[m].T for m in range(parts)], axis=1)


def fit(x: np.ndarray, total: int, reach: float, probes: int = PROBES) -> Index:
    """Index for ``total`` vectors from a sample ``x`` of unit rows whose width divides by PARTS."""
    rng = np.random.default_rng(SEED)
    lists = int(np.clip(np.sqrt(total) / 2, 4, min(LISTS, max(1, len(x) // 4 or 1))))
    coarse = kmeans(x, lists, 8, rng)
    for _ in range(3):
        coarse = merged(x, lloyd(x, merged(x, coarse, reach), 1), reach)
    rest = x - coarse[nearest(x, coarse)]
    width = x.shape[1] // PARTS
    books = [kmeans(rest[:, m * width : (m + 1) * width], CODES, 6, rng) for m in range(PARTS)]
    size = max(map(len, books))
    books = [np.concatenate((b, np.repeat(b[:1], size - len(b), axis=0))) for b in books]
    return Index(coarse, np.stack(books), reach, probes)


def candidates(index: Index, at: int, x: np.ndarray, codes: np.ndarray, error: np.ndarray, reach: float) -> np.ndarray:
    """Which (visitor, member) pairs of list ``at`` may have a distance of ``reach`` or less."""
    table = index.tables(x, at).astype(np.float32)
    total = np.zeros((len(x), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        total += table[:, m].take(codes[:, m], axis=1)
    return total <= ((reach + error + 1e-6) ** 2 + 1e-4).astype(np.float32)  # more than single precision can lose


def linked(x: np.ndarray, y: np.ndarray, may: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs among those that ``may`` have the cosine; a product of matrices where they are many."""
    if may.sum() * 8 > may.size:
        near = x @ y.T
        doubt = may & (np.abs(near - cosine) < 1e-12)  # the product may round otherwise than from the other side
        near = may & (near >= cosine) & ~doubt
        may = doubt
    else:
        near = np.zeros(may.shape, bool)
    i, j = np.nonzero(may)
    for c in range(0, len(i), 50_000):
        a, b = i[c : c + 50_000], j[c : c + 50_000]
        near[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
    return near


def distinct(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Staged rows (uid, id, k, k2) and distinct valid vectors (k, k2, uid, low, m, vec): the smallest uid and id, and the number of rows.

    Rows whose vector is not valid have no hashes.
    """
    v = F.col(column)
    valid = F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    hashes = (F.when(valid, F.xxhash64(v)).alias("k"), F.when(valid, F.xxhash64(F.lit(1), v)).alias("k2"))
    rows = stage(spark, vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).alias("id"), *hashes, v.alias("vec")), "vectors")
    groups = rows.where("k IS NOT NULL").groupBy("k", "k2").agg(F.min("uid").alias("uid"), F.min("id").alias("low"), F.count(F.lit(1)).alias("m"), F.min_by("vec", "uid").alias("vec"))
    return rows.drop("vec"), stage(spark, groups, "distinct")


def find_links(spark: SparkSession, groups: DataFrame, cosine: float = COSINE, probes: int = PROBES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(degrees(uid, n), forest(u, v)) of the links between distinct vectors (uid, m, vec); n counts each with its number."""
    ship(spark)
    stats = groups.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    total, dim = int(stats["n"]), max(1, int(stats["d"] or 1))
    dim = -(-dim // PARTS) * PARTS
    sample = groups.select("vec").orderBy(F.xxhash64("uid")).limit(SAMPLE).toArrow()
    if total < 2:
        return spark.createDataFrame([], "uid long, n long"), spark.createDataFrame([], "u long, v long")
    x, _ = matrix(sample.column("vec").combine_chunks(), dim)
    stored = np.float32 if isinstance(groups.schema["vec"].dataType.elementType, FloatType) else np.float64
    reach = float(np.sqrt(2 - 2 * cosine))
    index = fit(x, total, reach, probes)
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for cut in range(0, whole.num_rows, 2048):
                batch = whole.slice(cut, 2048)
                x, ok = _padded(batch.column("vec"), dim)
                raw = pa.array([r.tobytes() for r in x.astype(stored)], pa.binary())
                x, _ = _checked(x, ok)
                uid, m = batch.column("uid").to_numpy(), batch.column("m").to_numpy()
                home, visit, codes, error, core = index.code(x)
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home), pa.array(np.ones(n, bool)), pa.array(uid), pa.array(m), pa.array(home), pa.array(core), raw,
                     pa.array([r.tobytes() for r in np.packbits(visit, axis=1)], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)],
                    names,
                )
                row, to = np.nonzero(visit)
                for lo in range(0, len(row), 20_000):
                    r, t = row[lo : lo + 20_000], to[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t), pa.array(np.zeros(len(r), bool)), pa.array(uid[r]), pa.array(m[r]), pa.array(home[r]), pa.array(core[r]), raw.take(pa.array(r)),
                         pa.nulls(len(r), pa.binary()), pa.nulls(len(r), pa.binary()), pa.array(np.zeros(len(r)))],
                        names,
                    )

    schema = "list long, member boolean, uid long, m long, home long, core boolean, x binary, lists binary, code binary, error double"
    names = [f.split()[0] for f in schema.split(", ")]
    cells = stage(spark, groups.select("uid", "m", "vec").mapInArrow(deal, schema), "cells")
    own = F.col("core") & (F.col("home") == F.col("list"))
    sizes = cells.groupBy("list").agg(
        F.count_if(F.col("member") & own).alias("core"), F.count_if(F.col("member") & ~own).alias("loose"), F.count_if(~F.col("member") & ~own).alias("visitors"), F.min(F.when(F.col("member") & own, F.col("uid"))).alias("hub"), F.sum(F.when(F.col("member") & own, F.col("m"))).alias("mass")
    ).collect()  # fmt: skip  # one row a list, LISTS at most
    # blocks of core members, of the others, of visitors out of the core (they meet both), of those in it (they meet the others)
    parts = {r["list"]: [-(-r[c] // block) for c in ("core", "loose", "visitors", "core")] for r in sizes}
    of = spark.sparkContext.broadcast(parts)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = of.value
        for batch in batches:
            take, task = [], []
            columns = (batch.column(c).to_pylist() for c in ("list", "member", "uid", "home", "core"))
            for k, (a, member, u, home, core) in enumerate(zip(*columns, strict=True)):
                mc, ml, vo, vc = parts[a]
                mix = (u * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF
                core = core and home == a
                if member:
                    own = mix % mc if core else mc + mix % ml
                    blocks = [(own, j) for j in range(vo if core else vo + vc)]
                else:
                    own = vo + mix % vc if core else mix % vo
                    blocks = [(j, own) for j in range(mc if core else 0, mc + ml)]
                take += [k] * len(blocks)
                task += [(a << 40) | (i << 20) | j for i, j in blocks]
                if len(take) >= 20_000 or k + 1 == batch.num_rows:
                    out = batch.take(pa.array(take, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), *out.columns], ["task", *out.schema.names])
                    take, task = [], []

    def join(table: pa.Table) -> pa.Table:
        index = shared.value
        member = table.column("member").to_numpy(zero_copy_only=False)
        m, v = table.filter(pa.array(member)), table.filter(pa.array(~member))
        at = table.column("list")[0].as_py()
        uid = np.concatenate((m.column("uid").to_numpy(), v.column("uid").to_numpy()))
        if not len(m) or not len(v):
            return pa.table({"kind": pa.array([], pa.int32()), "u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        mx, vx = (_checked(np.frombuffer(b"".join(t.column("x").to_pylist()), stored).reshape(len(t), -1).astype(np.float64), np.ones(len(t), bool))[0] for t in (m, v))
        codes = np.frombuffer(b"".join(m.column("code").to_pylist()), np.uint8).reshape(len(m), -1)
        visits = np.unpackbits(np.frombuffer(b"".join(m.column("lists").to_pylist()), np.uint8).reshape(len(m), -1), axis=1).astype(bool)
        error = m.column("error").to_numpy()
        m_mass, v_mass = m.column("m").to_numpy(), v.column("m").to_numpy()
        mu, vu, home = m.column("uid").to_numpy(), v.column("uid").to_numpy(), v.column("home").to_numpy()
        n_m, n_v = np.zeros(len(m), np.int64), np.zeros(len(v), np.int64)
        ids, inverse = np.unique(uid, return_inverse=True)
        labels = np.arange(len(ids))
        step = max(1, 400_000 // len(m))
        for lo in range(0, len(v), step):
            a = np.arange(lo, min(lo + step, len(v)))
            may = candidates(index, at, vx[a], codes, error, reach) & (vu[a][:, None] != mu[None])
            near = linked(vx[a], mx, may, cosine)
            n_v[a] += near @ m_mass
            n_m += v_mass[a] @ (near & ~visits[:, home[a]].T)  # the member does not come to the visitor's home
            i, j = np.nonzero(near & (labels[inverse[len(m) + a]][:, None] != labels[inverse[: len(m)]][None]))
            if len(i):
                labels = merge(labels, inverse[len(m) + a[i]], inverse[j])
        moved = np.flatnonzero(labels != np.arange(len(ids)))
        u = np.concatenate((ids[moved], mu[n_m > 0], vu[n_v > 0]))
        w = np.concatenate((ids[labels[moved]], n_m[n_m > 0], n_v[n_v > 0]))
        kind = np.concatenate((np.zeros(len(moved), np.int32), np.ones(len(u) - len(moved), np.int32)))
        return pa.table({"kind": kind, "u": u, "v": w})

    hubs = spark.createDataFrame([(r["list"], r["mass"], r["hub"]) for r in sizes if r["core"] > 1], "l long, mass long, hub long")
    core = cells.where(F.col("member") & F.col("core")).select("list", "uid", "m").join(F.broadcast(hubs), F.col("list") == F.col("l"))
    both = F.array(F.struct(F.lit(1).alias("kind"), F.col("uid").alias("u"), (F.col("mass") - F.col("m")).alias("v")), F.struct(F.lit(0).alias("kind"), F.col("uid").alias("u"), F.col("hub").alias("v")))
    core = core.select(F.explode(both).alias("e")).select("e.kind", "e.u", "e.v")
    found = cells.mapInArrow(split, f"task long, {schema}").groupBy("task").applyInArrow(join, "kind int, u long, v long")
    found = stage(spark, found.unionByName(core), "links")
    release(cells)
    degrees = found.where("kind = 1").groupBy(F.col("u").alias("uid")).agg(F.sum("v").alias("n"))
    return degrees, found.where("kind = 0").select("u", "v")


def near_duplicates(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    rows, groups = distinct(spark, vectors, vec_id, column)
    degrees, forest = find_links(spark, groups, cosine, probes)
    found = components(spark, forest)
    whole = groups.select("k", "k2", F.col("uid").alias("rep"), "low", "m").join(found, F.col("rep") == F.col("node"), "left").join(degrees, F.col("rep") == F.col("uid"), "left")
    whole = whole.select(F.col("k").alias("g"), F.col("k2").alias("g2"), "rep", "low", "m", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    whole = stage(spark, whole, "roots")
    low = stage(spark, whole.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size")), "low")
    classes = stage(spark, join_split(whole, ["root"], low, ["r"], "size", ["rep"]).select("g", "g2", "m", "n_links", "component_id"), "classes")
    out = join_split(rows.where("k IS NOT NULL"), ["k", "k2"], classes, ["g", "g2"], "m", ["uid"], "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")
    # vectors that link with nothing would all have one key: they take no part in the join
    alone = rows.where("k IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
