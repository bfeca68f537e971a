"""Prefix trie of conversations by an LCP-aware external mergesort.

A turn is known by a token of 20 bytes: 128 bits of a hash of its role and text, and its
number of words. A conversation is the string of its turns' tokens; equal prefixes are
equal nodes. Texts are read once and never shuffled.

The strings are range-partitioned by (string, id), so neither a first turn that very many share
nor a conversation with very many copies lands in one task. A task sorts its
strings in runs of bounded size; a run carries the longest common prefix (LCP) of each string with
the one before and is kept front-coded in the task's own scratch file. A loser tree merges the
runs by their LCPs: strings with different LCPs to the last winner are ordered without
looking at a turn, equal ones are compared from there on only, so shared turns are not
compared again. The merged stream goes through a stack of the open path: a node is
finished, and emitted, when a string leaves it.

Nodes on the path of a task's first or last string may go on in its neighbours. They leave the task as
partial sums, two paths a task, and one more stack walks over these in the order of the
tasks. What it holds is the length of one path and the nodes that are still open; what it
reads is two conversations a task, however many there are.

Bounds: a conversation is one string (20 bytes a turn) in a task; the nodes below one open
node of a task wait for its smallest member. The digest of the ids that end in one node is
sequential by definition, so the ids of a very large group of copies stream through the walk in
pieces, as text, without being gathered.

Defined results: a null role or text counts as empty; null turns come first, and turns with the same
number are ordered by their tokens; repeated rows are turns of their own; rows without a conv_id belong
to no conversation; very long texts are hashed and counted whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import SPACE, ship, stage

#: Bytes of a turn's token.
TOKEN = 20
#: Bytes of strings that a run holds in memory.
RUN = 32 << 20
#: Bytes of strings that a task sorts, about.
SHARE = 128 << 20
#: Ids of a node that leave a task in one row.
PIECE = 1_000


# --- strings of turns -----------------------------------------------------------------------------


def strings(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): the tokens of each conversation's turns, in order, as an array of hexadecimal text."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.array_remove(F.split(F.translate(t, SPACE[1:], " " * (len(SPACE) - 1)), " ", -1), ""))
    token = F.concat(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)), F.lpad(F.hex(words), 8, "0"))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("id"), F.struct(F.col(turn).alias("n"), token.alias("token")).alias("turn"))
    return turns.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("turn"), _by_turn), lambda x: x["token"]).alias("turns"))


def _by_turn(a: Column, b: Column) -> Column:
    """Nulls first, then by number, then by token."""
    n = F.when(a["n"].isNull() & b["n"].isNull(), 0).when(a["n"].isNull(), -1).when(b["n"].isNull(), 1).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)
    return F.when(n != 0, n).when(a["token"] < b["token"], -1).when(a["token"] > b["token"], 1).otherwise(0)


def rebuilt(own: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that start as the first of their ``every`` does: its first h turns, then their own after the first h.

    h is the CRC-32 of the decimal id modulo ``heads``; a first conversation that is absent gives no turns.
    """
    h = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = own.where(F.col("id") % every == 0).select(F.col("id").alias("of"), F.slice("turns", 1, max(1, heads - 1)).alias("head"))
    both = own.join(first, F.col("id") - F.col("id") % every == F.col("of"), "left").withColumn("h", h)
    empty = F.array().cast("array<string>")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", empty), F.lit(1), F.col("h"))).otherwise(empty)
    return both.select("id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


# --- sorted runs and their merge ------------------------------------------------------------------


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that ``a`` and ``b`` share at their start; the first ``at`` are known to be."""
    n = min(len(a), len(b)) // TOKEN
    lo, step = at, 1
    while lo < n and a[lo * TOKEN : (lo + step) * TOKEN] == b[lo * TOKEN : (lo + step) * TOKEN] and lo + step <= n:
        lo += step
        step *= 2
    hi = min(n, lo + step)
    while lo < hi:  # lo turns are equal; those up to hi are not all
        mid = (lo + hi + 1) // 2
        if a[lo * TOKEN : mid * TOKEN] == b[lo * TOKEN : mid * TOKEN]:
            lo = mid
        else:
            hi = mid - 1
    return lo


Item = tuple[bytes, int, int]  # string, id, LCP with the item before


def sorted_run(items: list[tuple[bytes, int]]) -> Iterator[Item]:
    items.sort()
    last = b""
    for k, (key, i) in enumerate(items):
        yield key, i, common(last, key) if k else 0
        last = key


def write_run(run: Iterable[Item]):
    """A scratch file of the task with the run, front-coded; it is gone once closed."""
    file = tempfile.TemporaryFile()
    for key, i, lcp in run:
        rest = key[lcp * TOKEN :]
        file.write(lcp.to_bytes(4, "little") + i.to_bytes(8, "little", signed=True) + len(rest).to_bytes(4, "little") + rest)
    file.seek(0)
    return file


def read_run(file) -> Iterator[Item]:
    last = b""
    while head := file.read(16):
        lcp, i, n = int.from_bytes(head[:4], "little"), int.from_bytes(head[4:12], "little", signed=True), int.from_bytes(head[12:], "little")
        last = last[: lcp * TOKEN] + file.read(n)
        yield last, i, lcp
    file.close()


def merge(runs: list[Iterator[Item]]) -> Iterator[Item]:
    """The items of sorted runs in order, by a loser tree over LCPs.

    Each loser keeps its LCP with the string that beat it. The one that shares more
    with the last winner is the smaller; only equal LCPs need a comparison, from there on.
    """
    n = len(runs)
    if n == 1:
        yield from runs[0]
        return
    end: Item | None = None
    now = [next(r, end) for r in runs]
    lcps = [0] * n  # of each run's string with the last winner

    def beats(a: int, b: int) -> bool:
        """Whether a's string comes before b's; the loser's LCP becomes that with the winner."""
        x, y = now[a], now[b]
        if x is None or y is None:
            return y is None
        if lcps[a] != lcps[b]:
            return lcps[a] > lcps[b]
        k = common(x[0], y[0], lcps[a])
        p, q = x[0][k * TOKEN : (k + 1) * TOKEN], y[0][k * TOKEN : (k + 1) * TOKEN]
        won = p < q if p != q else x[1] <= y[1]
        lcps[b if won else a] = k
        return won

    losers = [-1] * n

    def build(node: int) -> int:
        if node >= n:
            return node - n
        a, b = build(2 * node), build(2 * node + 1)
        won, lost = (a, b) if beats(a, b) else (b, a)
        losers[node] = lost
        return won

    best = build(1)
    while now[best] is not None:
        key, i, _ = now[best]
        yield key, i, lcps[best]
        now[best] = next(runs[best], end)
        lcps[best] = now[best][2] if now[best] else 0
        node = (best + n) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def external_sort(items: Iterable[tuple[bytes, int]], run: int = RUN, ways: int = 64) -> Iterator[Item]:
    """Items in order of (string, id), with LCPs; ``run`` bytes of strings are held at most, and ``ways`` runs are merged at a time."""
    files, held, size = [], [], 0
    for item in items:
        held.append(item)
        size += len(item[0]) + 64
        if size >= run:
            files.append(write_run(sorted_run(held)))
            held, size = [], 0
            if len(files) >= 2 * ways:
                files = [write_run(merge([read_run(f) for f in files[:ways]])), *files[ways:]]
    yield from merge([*map(read_run, files), sorted_run(held)])


# --- nodes from the open path ---------------------------------------------------------------------


class Open:
    """A node of the open path: what is known of its subtree so far."""

    __slots__ = ("children", "done", "ends", "first", "leaves", "left", "low", "n", "saved", "token")

    def __init__(self, token: bytes, left: bool):
        self.token, self.left = token, left
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends = array("q")
        self.done: list[tuple] = []  # finished children, waiting for the smallest member of this node

    def add(self, i: int) -> None:
        self.n += 1
        if self.low is None or i < self.low:
            self.low = i

    @property
    def words(self) -> int:
        return int.from_bytes(self.token[16:], "big") if self.token else 0


def digest(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


#: What a task emits. kind 0: a finished node; side and up tell an open parent of it (then parent is null); kind 1: a node of its first or last path.
ROWS = "kind int, part int, side int, depth int, seq int, conv_id long, parent long, n long, children long, leaves long, saved long, digest string, token binary, left boolean, right boolean, ids string"
NAMES = [f.split()[0] for f in ROWS.split(", ")]


def nodes(stream: Iterator[Item], part: int) -> Iterator[tuple]:
    """Rows as in ROWS from one task's sorted strings."""
    path: list[Open] = [Open(b"", True)]
    first, out, last = True, [], b""

    def close() -> None:
        """Leave the deepest node; on the path of the first string it may be another task's too."""
        x = path.pop()
        if x.left:
            out.extend(partial(x, len(path), False))
            return
        leaves = x.leaves or 1
        saved = x.saved + (x.n - 1) * x.words
        up = path[-1]
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        out.extend((0, part, None, d, 0, low, x.low, *rest) for _, _, _, d, _, low, _, *rest in x.done)
        row = (0, part, 0, len(path), 0, x.low, None, x.n, x.children, leaves, saved, digest(x.ends), None, None, None, None)
        if up.left:  # it may be open elsewhere: told by its place
            out.append(row)
        else:
            up.done.append(row)

    def partial(x: Open, depth: int, right: bool) -> Iterator[tuple]:
        side = 0 if x.left else 1
        for _, _, _, d, _, low, _, *rest in x.done:
            yield (0, part, side, d, 0, low, None, *rest)
        cuts = range(0, max(1, len(x.ends)), PIECE)
        for seq, at in enumerate(cuts):
            ids = ",".join(map(str, x.ends[at : at + PIECE]))
            sums = (x.low, None, x.n, x.children, x.leaves, x.saved) if seq == 0 else (None, None, 0, 0, 0, 0)
            yield (1, part, side, depth, seq, *sums, None, x.token, x.left, right, ids)

    for key, i, lcp in stream:
        lcp = 0 if first else lcp
        while len(path) > lcp + 1:
            close()
        for d in range(lcp, len(key) // TOKEN):
            path.append(Open(key[d * TOKEN : (d + 1) * TOKEN], first))
        for x in path:
            x.add(i)
        path[-1].ends.append(i)
        first, last = False, key
        if len(out) >= 10_000:
            yield from out
            out.clear()
    if not first:
        for d in range(len(path) - 1, -1, -1):
            out.extend(partial(path[d], d, True))
    yield from out


class Joined(Open):
    """A node that goes over tasks: its digest runs on, and it knows where its parts were."""

    __slots__ = ("places", "sha", "some")

    def __init__(self, token: bytes):
        super().__init__(token, False)
        self.sha, self.some, self.places = hashlib.sha256(), False, []

    def take(self, rows: list[dict]) -> None:
        for r in rows:
            self.n += r["n"]
            self.children += r["children"]
            self.leaves += r["leaves"]
            self.saved += r["saved"]
            if r["conv_id"] is not None and (self.low is None or r["conv_id"] < self.low):
                self.low = r["conv_id"]
            if r["ids"]:
                self.sha.update((b"," if self.some else b"") + r["ids"].encode())
                self.some = True
        self.places.append((rows[0]["part"], rows[0]["side"]))


def walk(rows: Iterator[dict]) -> Iterator[tuple]:
    """Whole nodes from the partial ones, which come by (part, side, depth, seq): the same stack once more.

    Gives rows as in ROWS: kind 0 the nodes, kind 1 the place (part, side, depth) of a part and the node's smallest member.
    """
    path: list[Joined] = []
    out: list[tuple] = []

    def close() -> None:
        x = path.pop()
        depth, leaves, saved = len(path), x.leaves or 1, x.saved + (x.n - 1) * x.words
        row = (0, None, None, depth, 0, x.low, None, x.n, x.children, leaves, saved, x.sha.hexdigest(), None, None, None, None)
        out.extend((*r[:6], x.low, *r[7:]) for r in x.done)
        out.extend((1, p, s, depth, 0, x.low, None, *[None] * 9) for p, s in x.places)
        if path:
            up = path[-1]
            up.children += 1
            up.leaves += leaves
            up.saved += saved
            up.done.append(row)
        else:
            out.append(row)

    def follow(way: dict[int, list[dict]], start: int) -> None:
        """Leave what is not on the way; add the rows of depths from ``start`` on."""
        shared = 0
        while shared < min(len(path), len(way)) and path[shared].token == way[shared][0]["token"]:
            shared += 1
        while len(path) > shared:
            close()
        for d in range(start, len(way)):
            if d >= len(path):
                path.append(Joined(way[d][0]["token"]))
            path[d].take(way[d])

    for part in _groups(rows):
        left = {r[0]["depth"]: r for r in part.values() if r[0]["left"]}
        right = {r[0]["depth"]: r for r in part.values() if r[0]["right"]}
        follow(left, 0)
        follow(right, sum(r[0]["left"] for r in right.values()))  # nodes on both paths have been added
        yield from out
        out.clear()
    while path:
        close()
    yield from out


def _groups(rows: Iterator[dict]) -> Iterator[dict[tuple[int, int], list[dict]]]:
    """The rows of one task by (side, depth)."""
    part, held = None, {}
    for r in rows:
        if r["part"] != part and held:
            yield held
            held = {}
        part = r["part"]
        held.setdefault((r["side"], r["depth"]), []).append(r)
    if held:
        yield held


# --- the operator ---------------------------------------------------------------------------------


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in ROWS.split(", "))])


def trie(spark: SparkSession, convs: DataFrame, run: int = RUN, share: int = SHARE) -> DataFrame:
    """The nodes of ``convs(id, turns)``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(spark)
    keyed = stage(spark, convs.select(F.unhex(F.array_join("turns", "")).alias("key"), "id"), "strings")
    size = keyed.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // share))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (item for b in batches for item in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _batches(nodes(external_sort(items, run), TaskContext.get().partitionId()), _SCHEMA)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(walk(r for b in batches for r in b.to_pylist()), _SCHEMA)

    found = stage(spark, keyed.repartitionByRange(parts, "key", "id").mapInArrow(sort, ROWS), "nodes")
    paths = found.where("kind = 1").repartition(1).sortWithinPartitions("part", "side", "depth", "seq")
    whole = stage(spark, paths.mapInArrow(join, ROWS), "paths")
    places = whole.where("kind = 1").select(F.col("part").alias("p"), F.col("side").alias("s"), F.col("depth").alias("d"), F.col("conv_id").alias("up"))
    below = found.where("kind = 0 AND parent IS NULL")
    below = below.join(places, (F.col("part") == F.col("p")) & (F.col("side") == F.col("s")) & (F.col("depth") - 1 == F.col("d"))).withColumn("parent", F.col("up"))
    columns = [
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256"),
    ]
    rows = (found.where("kind = 0 AND parent IS NOT NULL"), below, whole.where("kind = 0"))
    first, *rest = (r.select(*columns) for r in rows)
    for r in rest:
        first = first.unionByName(r)
    return first


def report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(spark, rebuilt(stage(spark, strings(conversations.select("conv_id", "turn", "role", "text")), "turns")))
