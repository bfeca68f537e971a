"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

Outputs are the ``WORDS`` most frequent training words and, for all others, buckets of
their last letters. The probability of a token is

    P(class | history) * P(output | class, history) * P(word | bucket, where it is one).

Both softmaxes are maximum-entropy models over hashed features. That of the class has
dense weights for the last word, the skipped word, both, and the last very frequent
word; it is trained by distributed gradient updates: in each round the tasks take
gradient steps on their documents from common weights, and the weights are averaged by
tokens (so they depend, a little, on how the table is cut into tasks). That of the
output has a weight for every pair of a history (the two words before, hashed) and an
output seen after it; their number grows with the corpus. These weights are sharded by
history: the tokens of a shard meet in one task (``SHARD`` of them, about), which takes
gradient steps on the weights of its histories, with an L1 penalty, and scores its
tokens with them. Histories seen once have no weights. A history that has more tokens than a
shard (by its own count) is salted; each salt learns from its own tokens, a shard's worth of them.
The last factor is a closed form of the counts. Classes come from clustering the
outputs by the very frequent words before them. Every training text is counted, and
takes part in one round.

Counts of all words stay distributed. Those of at most ``KNOWN`` frequent words (a
threshold from a histogram of counts) are broadcast; rare words are joined by word, so
no join key is hot.

Defined results: a null text counts as empty (its end token only); a null id counts as
the empty text in the split; very long texts are learned and scored whole; words of
equal count are ordered by their bytes; repeated rows are learned and scored as often
as they occur; without training rows every score is that of a model that knows nothing;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import bucket_of, ship, stage

#: Words whose counts are broadcast at most; those of them that are outputs; buckets of the others.
KNOWN = 131_072
WORDS = 40_960
BUCKETS = 4_096
TOP = 24
CLASSES = 32
HASH_BITS = 12
ROUNDS = 2
RATE = 0.25
BATCH = 8_192
#: Bound of a logit, so that no exponential is out of range.
CLIP = 60.0
BLOCKS = 16
#: Arrays of tasks that one group adds up; more are added in levels.
FAN = 64
#: Tokens of a shard of histories, about; shards at least.
SHARD, SHARDS = 2_000_000, 16
#: Rows and tokens of a batch whose tokens are dealt to the shards together, about.
DEALT = 1_024, 1_000_000
#: Steps, rate and L1 penalty of the weights of histories and outputs.
STEPS, STEP, L1 = 12, 1.5, 0.7
_OUTPUTS = WORDS + BUCKETS
_BOS = _OUTPUTS
_FLUSH = 300_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def bucket(word: bytes) -> int:
    """Output of a word that is none itself, by its last three bytes."""
    import zlib

    return WORDS + zlib.crc32(word[-3:]) % BUCKETS


def word_counts(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, c long) of all texts, the end token as the empty word."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return made

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(words_of(t))
                seen[b""] += 1
                if len(seen) > _FLUSH:
                    yield out()
        if seen:
            yield out()

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Tables:
    """What every task knows: ids and counts of the known words, closed forms, classes."""

    known: dict[bytes, int]  # number by falling count
    logs: np.ndarray  # log10(c + 1) of the known words
    fixed: np.ndarray  # log10 of P(output | class), less the bucket's total where it is one
    classes: np.ndarray  # class of each output

    @property
    def tops(self) -> int:
        return min(TOP, len(self.known))


def encode(tables: Tables, text: str | None) -> tuple[np.ndarray, float, int, float, list[bytes]]:
    """Outputs of a text, sum of the known words' logs, their number, that sum for bucket words, the rare words."""
    words = words_of(text)
    words.append(b"")
    get = tables.known.get
    at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
    hit = at[at >= 0]
    out = np.where((at >= 0) & (at < WORDS), at, 0)
    other = np.flatnonzero((at < 0) | (at >= WORDS)).tolist()
    out[other] = [bucket(words[i]) for i in other]
    rare = [words[i] for i in np.flatnonzero(at < 0).tolist()]
    return out.astype(np.uint16), float(tables.logs[hit].sum()), len(hit), float(tables.logs[hit[hit >= WORDS]].sum()), rare


def features(seq: np.ndarray, tops: int) -> list[np.ndarray]:
    """Rows of the weights for every position of a padded sequence; each kind has its own rows."""
    size, bits = 1 << HASH_BITS, np.uint32(32 - HASH_BITS)
    s = seq.astype(np.uint32)
    one = np.concatenate(([_BOS], s[:-1])).astype(np.uint32)
    two = np.concatenate(([_BOS, _BOS], s[:-2])).astype(np.uint32)[: len(s)]
    mix = lambda x: ((x * np.uint32(2654435761)) >> bits).astype(np.int64)
    where = np.where((one < tops) | (one == _BOS), np.arange(len(s)), 0)
    last = one[np.maximum.accumulate(where)]
    last = np.where(last < tops, last, TOP)
    both = (one * np.uint32(40503) + two) * np.uint32(2246822519) ^ (one >> np.uint32(3))
    return [mix(one + np.uint32(1)), size + mix(two + np.uint32(7)), 2 * size + mix(both), 3 * size + last.astype(np.int64)]


ROWS = 3 * (1 << HASH_BITS) + TOP + 1


def padded(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another, each behind two marks; the positions of tokens; the first token of each text."""
    parts, start, at = [], [], 0
    marks = np.full(2, _BOS, np.uint16)
    for raw in ids:
        x = np.frombuffer(raw, "<u2")
        parts += [marks, x]
        start.append(at)
        at += len(x)
    seq = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    return seq, np.flatnonzero(seq != _BOS), np.array(start, np.int64)


def logits(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    z += bias
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    return np.clip(z, -CLIP, CLIP, out=z)


def train_on(weights: np.ndarray, bias: np.ndarray, seq: np.ndarray, at: np.ndarray, classes: np.ndarray, tops: int, squares: np.ndarray) -> None:
    """Gradient steps in place, with a rate for every row that falls with its squared gradients."""
    rows = [f[at].astype(np.uint16) for f in features(seq, tops)]
    y = classes[seq[at]]
    ones = np.ones(weights.shape[1], np.float32)
    for lo in range(0, len(at), BATCH):
        part = [r[lo : lo + BATCH] for r in rows]
        g = logits(weights, bias, part)
        np.exp(g, out=g)
        g /= (g @ ones)[:, None]
        g[np.arange(len(g)), y[lo : lo + BATCH]] -= 1
        bias -= RATE / len(g) * (np.ones(len(g), np.float32) @ g)
        for r in part:
            order = np.argsort(r, kind="stable")  # rows are 16-bit numbers: sorted in linear time
            rows_ = r[order]
            first = np.flatnonzero(np.concatenate(([True], rows_[1:] != rows_[:-1])))
            found = rows_[first]
            d = np.add.reduceat(g.take(order, axis=0), first, axis=0)
            squares[found] += np.einsum("ij,ij->i", d, d) / d.shape[1]
            d *= (RATE / np.sqrt(1.0 + squares[found]))[:, None]
            weights[found] -= d


def log_probabilities(weights: np.ndarray, bias: np.ndarray, fixed: np.ndarray, classes: np.ndarray, tops: int, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 P of every token, as far as its output."""
    rows = [f[at] for f in features(seq, tops)]
    out = np.empty(len(at))
    o = seq[at]
    for lo in range(0, len(at), 16_384):
        z = logits(weights, bias, [r[lo : lo + 16_384] for r in rows])
        mine = o[lo : lo + 16_384]
        own = z[np.arange(len(z)), classes[mine]].astype(np.float64)
        mass = np.log(np.exp(z, out=z) @ np.ones(z.shape[1]))
        out[lo : lo + 16_384] = (own - mass) / np.log(10) + fixed[mine]
    return out


def cluster(signature: np.ndarray, mass: np.ndarray, classes: int, seed: int = 5) -> np.ndarray:
    """Classes of outputs: weighted k-means of the roots of their context shares, split by mass."""
    rng = np.random.default_rng(seed)
    x = np.sqrt((signature + 0.02 * signature.sum(axis=0) / max(1, signature.sum())) / np.maximum(signature.sum(axis=1, keepdims=True) + 0.02, 1e-9)).astype(np.float64)
    groups = max(1, classes // 4)
    heavy = np.argsort(-mass, kind="stable")[: max(groups * 64, groups)]
    c = x[rng.choice(heavy, min(groups, len(heavy)), replace=False)]
    for _ in range(12):
        near = ((c**2).sum(axis=1) / 2 - x @ c.T).argmin(axis=1)
        for k in range(len(c)):
            own = near == k
            if own.any():
                c[k] = np.average(x[own], axis=0, weights=mass[own] + 1e-9)
    near = ((c**2).sum(axis=1) / 2 - x @ c.T).argmin(axis=1)
    out, made = np.zeros(len(x), np.int64), 0
    for k in range(len(c)):
        own = np.flatnonzero(near == k)
        if not len(own):
            continue
        own = own[np.argsort(-mass[own], kind="stable")]
        share = np.cumsum(mass[own]) / max(mass[own].sum(), 1e-9)
        out[own] = made + np.minimum((share * 3.9999).astype(np.int64), 3)
        made += 4
    return out


def _blocks(array: np.ndarray, weight: int) -> pa.RecordBatch:
    """A task's array times its weight, in blocks, under the task's number."""
    parts = np.array_split(array * np.float32(weight), BLOCKS)
    slot = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array(range(BLOCKS), pa.int32()), pa.array([slot] * BLOCKS, pa.int64()), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary()), pa.array([weight] * BLOCKS, pa.int64())], ["block", "slot", "part", "n"]
    )


_BLOCK = "block int, slot long, part binary, n long"


def _gather(df: DataFrame, shape: tuple[int, int], average: bool) -> np.ndarray | None:
    """Sum (or mean by weight) of the tasks' arrays, added on the executors, ``FAN`` at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw, "<f4").astype(np.float64) for raw in table.column("part").to_pylist())
        n = sum(table.column("n").to_pylist())
        return pa.table({"block": table.column("block")[:1], "slot": pa.array([table.column("slot")[0].as_py() // FAN]), "part": pa.array([total.astype("<f4").tobytes()], pa.binary()), "n": pa.array([n])})

    tasks = df.rdd.getNumPartitions()
    while tasks:
        df = df.groupBy("block", F.expr(f"slot div {FAN}")).applyInArrow(lambda _, table: add(table), _BLOCK)
        tasks = tasks // FAN if tasks > FAN else 0
    rows = sorted(df.collect())
    if not rows:
        return None
    whole = np.concatenate([np.frombuffer(r["part"], "<f4").astype(np.float64) for r in rows]) / (max(1, rows[0]["n"]) if average else 1)
    return whole.astype(np.float32).reshape(shape)


# -- weights of histories and outputs -------------------------------------------


def histories(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every position of a padded sequence the hash of the two outputs before it, and these two."""
    s = seq.astype(np.uint64)
    one = np.concatenate(([_BOS], s[:-1])).astype(np.uint64)
    two = np.concatenate(([_BOS, _BOS], s[:-2])).astype(np.uint64)[: len(s)]
    return mixed((one << np.uint64(17)) ^ two), one.astype(np.int64), two.astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fit_shard(history: np.ndarray, output: np.ndarray, learn: np.ndarray, share: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 of P(output | class, history) / P(output | class) for the tokens of a shard.

    P(o | c, h) = share[o] * exp(w[h, o]) / Z[h, c], with weights from the tokens that
    are to ``learn`` from: gradient steps of the penalised log-likelihood for all
    histories at once. Z is exact, since outputs without a weight keep their share.
    """
    if not len(history):
        return np.zeros(0, np.float32)
    low = (classes.astype(np.uint64) << np.uint64(16)) | np.arange(len(classes), dtype=np.uint64)
    key = history.astype(np.uint64)
    key <<= np.uint64(22)
    key |= low[output]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = key[new]
    del key
    pair = np.cumsum(new, dtype=np.int32) - np.int32(1)  # number of the (history, class, output) of each ordered token
    n = np.bincount(pair, weights=learn[order])
    of = lambda shift: np.cumsum(np.concatenate(([True], first[1:] >> np.uint64(shift) != first[:-1] >> np.uint64(shift))), dtype=np.int32) - np.int32(1)
    group, whole = of(16), of(22)  # of (history, class), of the history
    q = share[(first & np.uint64(0xFFFF)).astype(np.int32)]
    del first, new
    groups = int(group[-1]) + 1
    has = (n > 0) & (np.bincount(whole, weights=n)[whole] > 1)
    n_has, q_has, at = n[has], q[has], group[has]
    in_group = np.bincount(at, weights=n_has, minlength=groups)[at]
    w, squares = np.zeros(len(n_has)), np.full(len(n_has), 1e-6)
    z = np.ones(groups)
    for _ in range(STEPS if len(w) else 0):
        g = n_has - L1 - in_group * q_has * np.exp(w) / z[at]
        squares += g * g
        w = np.maximum(w + STEP * g / np.sqrt(squares), 0)
        z = 1 + np.bincount(at, weights=q_has * np.expm1(w), minlength=groups)
    gain = -np.log(z)[group]
    gain[has] += w
    out = np.empty(len(order), np.float32)
    out[order] = (gain / np.log(10)).astype(np.float32)[pair]
    return out


def _hot(coded: DataFrame, closed) -> tuple[np.ndarray, np.ndarray]:
    """Histories with more tokens than a shard, in order, and their salts; there are fewer of them than shards.

    Only pairs of words that both have as many tokens are counted at all.
    """
    count = np.concatenate((closed.value[3], [max(closed.value[4], 1)]))  # that of the marks: rows
    if not (count > SHARD).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.concatenate((closed.value[3], [max(closed.value[4], 1)]))
        for whole in batches:
            for cut in range(0, whole.num_rows, 512):
                seq, at, _ = padded(whole.column("ids").slice(cut, 512).to_pylist())
                h, one, two = (x[at] for x in histories(seq))
                key, n = np.unique(h[np.minimum(count[one], count[two]) > SHARD], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])

    found = coded.select("ids").mapInArrow(tally, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD).collect()  # one a shard at most
    found = sorted((r["h"] % (1 << 64), r["n"]) for r in found)
    return np.array([h for h, _ in found], np.uint64), np.array([-(-n // SHARD) for _, n in found], np.uint64)


def joint(spark: SparkSession, coded: DataFrame, closed, tokens: int) -> DataFrame:
    """(u, gain): for every row of ``coded`` (uid, held_out, ids) what its tokens gain by their histories' weights.

    ``closed`` is a broadcast of the closed forms; its third part has each output's
    share of its class, the fourth its count.
    """
    shards = max(SHARDS, -(-tokens // SHARD))
    top, most = DEALT
    salts_of = spark.sparkContext.broadcast(_hot(coded, closed))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, n_salts = salts_of.value
        for whole in batches:
            uid, held, size = whole.column("uid").to_numpy(), whole.column("held_out").to_numpy(zero_copy_only=False), whole.column("n_tokens").to_numpy()
            room, ids = np.cumsum(size), whole.column("ids")
            lo = 0
            while lo < len(uid):
                hi = lo + 1  # rows of a batch have numbers one after another
                limit = room[lo] - size[lo] + most
                while hi < len(uid) and hi - lo < top and room[hi] <= limit and uid[hi] == uid[hi - 1] + 1:
                    hi += 1
                seq, at, _ = padded(ids.slice(lo, hi - lo).to_pylist())
                h = histories(seq)[0][at]
                if len(hot):
                    near = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    salted = np.flatnonzero(hot[near] == h)
                    own = mixed(np.array([uid[lo]], np.uint64))[0]
                    h[salted] = mixed(h[salted] + np.uint64(1) + own % n_salts[near[salted]])
                shard = ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                row = np.repeat(np.arange(hi - lo) + np.where(held[lo:hi], 1 << 15, 0), size[lo:hi]).astype("<u2")
                order = np.argsort(shard, kind="stable")
                found, begin = np.unique(shard[order], return_index=True)
                columns = [(h & np.uint64(0xFFFFFFFF)).astype("<u4")[order], seq[at].astype("<u2")[order], row[order]]
                ends = [*begin[1:].tolist(), len(order)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), uid[lo])), *(pa.array([c[x:y].tobytes() for x, y in zip(begin.tolist(), ends, strict=True)], pa.binary()) for c in columns)], ["shard", "batch", "h", "o", "row"]
                )
                lo = hi

    def learn(table: pa.Table) -> pa.Table:
        share, classes = closed.value[2], closed.value[1]
        h, o, row = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h", "<u4"), ("o", "<u2"), ("row", "<u2")))
        gain = fit_shard(h, o, row < 1 << 15, share, classes)
        row = row & 0x7FFF
        rows, gains, at = [], [], 0
        for raw in table.column("row").to_pylist():  # rows rise within a batch
            mine = row[at : at + len(raw) // 2]
            start = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            rows.append(mine[start].astype("<u2").tobytes())
            gains.append(np.add.reduceat(gain[at : at + len(mine)], start).astype("<f4").tobytes())
            at += len(mine)
        return pa.table({"batch": table.column("batch"), "row": pa.array(rows, pa.binary()), "gain": pa.array(gains, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        row, gain = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("row", "<u2"), ("gain", "<f4")))
        total = np.bincount(row, weights=gain)
        own = np.unique(row)
        return pa.table({"u": own.astype(np.int64) + table.column("batch")[0].as_py(), "gain": total[own]})

    dealt = coded.select("uid", "held_out", "n_tokens", "ids").mapInArrow(deal, "shard long, batch long, h binary, o binary, row binary")
    # as many tasks as shards, at every size of the corpus
    gained = dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(learn, "batch long, row binary, gain binary")
    return gained.groupBy("batch").applyInArrow(add, "u long, gain double")


def score(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    ship(spark)
    sc = spark.sparkContext
    held = bucket_of(doc_id, 7) == 2
    counts = stage(spark, word_counts(spark, docs.where(~held), text), "counts")
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.min("c").alias("low")).collect()  # 8 bins an octave
    v_all, n_all = sum(r["v"] for r in bins), sum(r["n"] or 0 for r in bins)
    low, held_words = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["b"]):
        held_words += r["v"]
        if held_words > KNOWN:
            break
        low = r["low"]
    frequent = sorted(((r["c"], bytes(r["word"])) for r in counts.where(F.col("c") >= low).collect()), key=lambda r: (-r[0], r[1]))  # KNOWN rows at most
    known = {w: k for k, (_, w) in enumerate(frequent)}
    c_known = np.array([c for c, _ in frequent], np.float64)
    # totals and distinct words of the buckets: BUCKETS rows at most
    outputs = spark.createDataFrame([(w,) for _, w in frequent[:WORDS]], "w binary")
    others = counts.join(outputs, counts["word"] == outputs["w"], "left_anti") if frequent else counts
    key = (F.lit(WORDS) + F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")), F.lit(BUCKETS))).cast("int")
    tails = others.groupBy(key.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    mass = np.zeros(_OUTPUTS)
    mass[: min(WORDS, len(c_known))] = c_known[:WORDS]
    inside = np.zeros(_OUTPUTS)
    for r in tails:
        mass[r["b"]] = r["n"]
        inside[r["b"]] = r["n"] + r["v"]
    less = np.where(np.arange(_OUTPUTS) >= WORDS, np.log10(inside + 1), 0.0)
    tables = Tables(known, np.log10(c_known + 1), np.zeros(_OUTPUTS), np.zeros(_OUTPUTS, np.int64))
    first = sc.broadcast(tables)
    kind = docs.schema[doc_id].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = first.value
        for whole in batches:
            for cut in range(0, whole.num_rows, 512):
                batch = whole.slice(cut, 512)
                rows = [encode(tables, t) for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid"), batch.column("doc_id"), batch.column("held_out"), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows]), pa.array([r[3] for r in rows]), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.list_(pa.binary()))],
                    ["uid", "doc_id", "held_out", "n_tokens", "hits", "hit_sum", "tail_sum", "ids", "rare"],
                )

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("t"))
    coded = source.mapInArrow(code, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, hits long, hit_sum double, tail_sum double, ids binary, rare array<binary>")
    coded = stage(spark, coded, "coded")
    rare = coded.select("uid", F.explode("rare").alias("word"))
    joined = rare.join(counts.select(F.col("word").alias("w"), "c"), F.col("word") == F.col("w"), "left")
    rare = joined.groupBy(F.col("uid").alias("u")).agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_sum"), F.count("c").alias("rare_hits"))
    rare = stage(spark, rare, "rare")
    learn = coded.where(~F.col("held_out"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, total, tokens = first.value.tops, np.zeros(_OUTPUTS * (TOP + 1)), 0
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for lo in range(0, len(ids), 512):
                seq, at, _ = padded(ids[lo : lo + 512])
                last = features(seq, tops)[3][at] - 3 * (1 << HASH_BITS)
                total += np.bincount(seq[at].astype(np.int64) * (TOP + 1) + last, minlength=len(total))
                tokens += len(at)
        if tokens:
            yield _blocks(total.reshape(_OUTPUTS, TOP + 1), 1)

    signature = _gather(learn.select("ids").mapInArrow(sign, _BLOCK), (_OUTPUTS, TOP + 1), average=False)
    if signature is None:
        signature = np.zeros((_OUTPUTS, TOP + 1))
    tables.classes = cluster(signature, mass, CLASSES)
    classes = int(tables.classes.max()) + 1
    smooth = mass + 0.5
    inside_class = smooth / np.bincount(tables.classes, weights=smooth, minlength=classes)[tables.classes]
    tables.fixed = np.log10(inside_class) - less
    tables.known = {}
    tops = min(TOP, len(known))
    sizes = coded.agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    closed = sc.broadcast((tables.fixed, tables.classes, inside_class, mass.astype(np.int64), sizes["rows"]))
    weights = np.zeros((ROWS + 1, classes), np.float32)  # the last row is the bias
    share = np.bincount(tables.classes, weights=smooth, minlength=classes)
    weights[-1] = np.log(np.maximum(share, 0.5) / share.sum())
    for k in range(ROUNDS):
        start = sc.broadcast(weights)

        def descend(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            group = closed.value[1]
            w = start.value[:-1].copy()
            b = start.value[-1].copy()
            squares, tokens = np.zeros(len(w), np.float32), 0
            for batch in batches:
                ids = batch.column("ids").to_pylist()
                for lo in range(0, len(ids), 256):
                    seq, at, _ = padded(ids[lo : lo + 256])
                    train_on(w, b, seq, at, group, tops, squares)
                    tokens += len(at)
            if tokens:
                yield _blocks(np.concatenate((w, b[None])), tokens)

        own = learn.where(F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == k).select("ids")
        got = _gather(own.mapInArrow(descend, _BLOCK), weights.shape, average=True)
        weights = weights if got is None else got
    final = sc.broadcast(weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, group = closed.value[:2]
        w, b = final.value[:-1], final.value[-1]
        for whole in batches:
            for cut in range(0, whole.num_rows, 256):
                batch = whole.slice(cut, 256)
                seq, at, start_ = padded(batch.column("ids").to_pylist())
                p = log_probabilities(w, b, fixed, group, tops, seq, at)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.add.reduceat(p, start_))], [*batch.schema.names[:-1], "model_sum"])

    columns = ["uid", "doc_id", "held_out", "n_tokens", "hits", "hit_sum", "tail_sum"]
    judged = coded.select(*columns, "ids").mapInArrow(judge, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, hits long, hit_sum double, tail_sum double, model_sum double")
    gained = stage(spark, joint(spark, coded, closed, sizes["n"] or 0), "gained").withColumnRenamed("u", "g")
    out = judged.join(gained, F.col("uid") == F.col("g")).join(rare, F.col("uid") == F.col("u"), "left")
    extra = F.coalesce("rare_sum", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("rare_hits", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("hit_sum") + extra - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))).alias("base_score"), (F.col("model_sum") + F.col("gain") + F.col("tail_sum") + extra).alias("score"),
    )
