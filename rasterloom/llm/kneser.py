"""Quality by the perplexity under an interpolated modified Kneser-Ney trigram model.

The model counts every trusted text (labelled good, not toxic) of one half, told by a
hash of the text (copies are in one half), whole and at any number; the other half gives the thresholds. Tokens
of all texts go to tasks by their middle word (frequent ones by last word, too), packed
as numbers of trained words; a task counts the trained trigrams, pairs and contexts of
its middle words anew and looks up all others in them, so that no table of trigrams is
sent, joined or stored. Middle words are dealt into ``PASSES`` parts that follow one
another, so that one part's tokens are on disk. A task unpacks one bucket of its words at a time. The trained words with their counts
(20 bytes a word) are broadcast, ``SHARD_ROWS`` at a time, and held by every task. A caller may bound the training instead (``bound``
documents and ``chars`` characters in expectation, half of the bound dealt by the
languages' sizes, half in equal shares; ``ROWS`` rows of the tables, by drawing anew); its tables are broadcast then.
All trusted documents that the model wasn't trained on give the quantiles of the log
perplexity for each language and band of lengths, from distributed counts of its values
in steps of 1 / ``STEPS``; documents beyond their quantile fail. Quantiles of small
groups are drawn towards those of larger ones in proportion to ``PRIOR`` documents.

Defined results: a null or wordless text has one token, its end; very long texts are
scored and counted whole (with a bound, those of over ``LONGEST`` characters give
thresholds only); texts of equal perplexity get the same verdict (a text at its
threshold stays); without trusted text every perplexity is null and every document is
kept; repeated rows are judged alike; null ids are never trusted; a null language is a
group of its own; an empty table gives an empty one; other columns are ignored and may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from rasterloom.llm.common import HOT, SPACE, fresh, join_split, release, release_since, ship, stage, staged_paths, sweep

#: Share of the trusted documents that is counted; the rest gives the thresholds.
COUNTED = 0.5
#: With a bound: characters of a document that the model may be trained on at most.
LONGEST = 200_000
#: With a bound: rows of the model at most; were there more, half as much text would be drawn.
ROWS = 8_000_000
#: Ids to count that are sent to all executors at most (about 30 bytes each); were there more, the texts would be shuffled to them.
SENT = 1_000_000
#: Rows of a shard of the model, about, and bytes of texts that are joined with it at once.
SHARD_ROWS = 1_000_000
SLAB = 1_000_000
#: Without a bound: parts of the middle words, by hash, that are scored one after the other, so that only one part's tokens are on disk; and those counted so.
PASSES, COUNT_PASSES = 4, 2
#: Tokens of a task, about; a middle word with over twice that, and over 1 / HOT of all tokens, is dealt over several tasks.
TASK_TOKENS = 750_000
#: Tokens that a task looks up at once; and, about, those that it deals out at once.
STEP, DEALT = 1 << 17, 400_000
#: Parts of a unit of log10 P in which sums are kept; being whole numbers, they don't depend on the order of tokens.
UNIT = float(1 << 24)
QUANTILE = 0.999
#: Steps of a unit of log10 perplexity, rounded up, in which the quantiles are counted.
STEPS = 1 << 14
#: Documents' worth of the larger group's quantile in that of a smaller group.
PRIOR = 20.0
#: Upper ends of the bands of lengths, in tokens.
BANDS = (16, 64, 256)
#: Added to a quantile, in units of the distance between it and the median.
SLACK = 0.25
#: Discount of the lowest order.
D1 = 0.75
_BOS = 1
_SEED = np.uint64(42)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 1) >> 1


def chain(seed: np.ndarray | np.uint64, value: np.ndarray) -> np.ndarray:
    """XXH64 of longs under a seed each; the JVM's xxhash64(a, b) is chain(chain(42, a), b)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (np.asarray(seed, np.uint64) + p5 + np.uint64(8)) ^ (turn(value.view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def discounts(counts: dict[int, int]) -> np.ndarray:
    """D1, D2, D3+ from the numbers of n-grams that occur 1, 2, 3 and 4 times, within what keeps them right."""
    n = [float(counts.get(k, 0)) for k in (1, 2, 3, 4)]
    if n[0] == 0 or n[1] == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.1), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))])


@dataclass
class Facts:
    """What is the same for all keys: discounts of trigrams and of continued bigrams, distinct bigrams, distinct words."""

    d3: np.ndarray
    d2: np.ndarray
    pairs: int
    words: int
    sizes: dict[str, int] = field(default_factory=dict)


def tables(spark: SparkSession, grams: DataFrame) -> tuple[dict[str, DataFrame], Facts]:
    """Staged count tables by key from distinct trigrams (u, v, w, n), and the facts.

    ``tri``: count. ``pair``: distinct words before it; as a context its count, and the
    mass that its discounts free. ``uni``: distinct words before it; as a context
    likewise.
    """
    of_counts = lambda df, c: discounts({r["k"]: r["m"] for r in df.groupBy(F.least(F.col(c), F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()})
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def sides(df: DataFrame, ends: tuple, context: tuple, n: str) -> DataFrame:
        """Each row once for what it ends with (a distinct word before that), once for its context (by count 1, 2, 3 or more)."""
        classes = [F.when((F.col(n) == k) if k < 3 else (F.col(n) >= 3), one).otherwise(zero) for k in (1, 2, 3)]
        both = F.array(
            F.struct(*(c.alias(f"k{i}") for i, c in enumerate(ends)), one.alias("before"), zero.alias("total"), *(zero.alias(f"c{k}") for k in (1, 2, 3))),
            F.struct(*(c.alias(f"k{i}") for i, c in enumerate(context)), zero.alias("before"), F.col(n).alias("total"), *(c.alias(f"c{k + 1}") for k, c in enumerate(classes))),
        )
        return df.select(F.explode(both).alias("e")).select("e.*").groupBy(*(f"k{i}" for i in range(len(ends)))).agg(*(F.sum(c).alias(c) for c in ("before", "total", "c1", "c2", "c3")))

    freed = lambda d: sum(F.col(f"c{k}") * float(d[k]) for k in (1, 2, 3)).alias("freed")
    d3 = of_counts(grams, "n")
    pairs = stage(spark, sides(grams, (F.col("v"), F.col("w")), (F.col("u"), F.col("v")), "n"), "pairs")
    seen = pairs.where("before > 0")
    d2 = of_counts(seen, "before")
    uni = stage(spark, sides(seen, (F.col("k1"),), (F.col("k0"),), "before"), "words")
    made = {
        "tri": grams.select(F.xxhash64("u", "v", "w").alias("key"), F.col("n").cast("float").alias("n")),
        "pair": pairs.select(F.xxhash64("k0", "k1").alias("key"), *(F.col(c).cast("float") for c in ("before", "total")), freed(d3).cast("float")),
        "uni": uni.select(F.col("k0").alias("key"), *(F.col(c).cast("float") for c in ("before", "total")), freed(d2).cast("float")),
    }
    facts = Facts(d3, d2, seen.count(), uni.where("before > 0").count(), {name: df.count() for name, df in made.items()})
    return made, facts


def shards(table: DataFrame, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """A table's rows by rising key ranges, each sorted by key; only one is on the driver at a time."""
    width = (1 << 64) // parts
    for k in range(parts):
        low = k * width - (1 << 63)
        rows = table.where(F.col("key").between(low, low + width - 1 if k + 1 < parts else (1 << 63) - 1)).toArrow()
        columns = [rows.column(c).to_numpy() for c in rows.column_names]
        order = np.argsort(columns[0])
        yield tuple(c[order] for c in columns)


def _held(shard) -> tuple[np.ndarray, ...]:
    """What a shard or its broadcast holds, read anew from the executor's disk: ``value`` would keep all shards in memory."""
    path = getattr(shard, "_path", None)
    return shard.load_from_path(path) if path else shard.value if hasattr(shard, "value") else shard


def find(shared: list, keys: np.ndarray) -> list[np.ndarray]:
    """The values of the keys, joined with one shard after the other; 0 where absent."""
    order = np.argsort(keys)
    ordered = keys[order]
    values: list[np.ndarray] = []
    for shard in shared:
        known, *columns = _held(shard)
        if not values:
            values = [np.zeros(len(keys), np.float32) for _ in columns]
        if len(known):
            lo, hi = np.searchsorted(ordered, known[0]), np.searchsorted(ordered, known[-1], "right")
            at = np.searchsorted(known, ordered[lo:hi])
            hit = np.flatnonzero(known[at] == ordered[lo:hi])
            to = order[lo:hi][hit]
            for value, column in zip(values, columns, strict=True):
                value[to] = column[at[hit]]
    return values


class Scorer:
    """Word counts that a worker has met and the joins of its documents."""

    def __init__(self, facts: Facts, tri: list, pair: list, uni: list):
        self.facts, self.tri, self.pair, self.uni = facts, tri, pair, uni
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.known = [np.array([_BOS], np.int64), *(x.astype(np.float64) for x in find(self.uni, np.array([_BOS], np.int64)))]

    def learn(self, words: list[bytes]) -> None:
        hashes = np.fromiter(map(word_hash, words), np.int64, len(words))
        first = len(self.known[0])
        self.known = [np.concatenate((a, b)) for a, b in zip(self.known, (hashes, *find(self.uni, hashes)), strict=True)]
        self.numbers.update(zip(words, range(first, first + len(words)), strict=True))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 P and the number of tokens of every text."""
        if len(self.numbers) > 300_000:
            self.forget()
        split = [[*words_of(t), b""] for t in texts]
        numbers = self.numbers
        new = {w for words in split for w in words if w not in numbers}
        if new:
            self.learn(sorted(new))
        n = np.array([len(words) for words in split], np.int64)
        seq: list[int] = []
        for words in split:
            seq += (0, 0)
            seq += [numbers[w] for w in words]
        x = np.array(seq, np.int64)
        token = np.ones(len(x), bool)
        start = np.cumsum(n + 2) - n - 2
        token[start] = token[start + 1] = False
        hashes, before, total, freed = (column[x] for column in self.known)
        key = np.concatenate((np.zeros(1, np.uint64), chain(chain(_SEED, hashes[:-1]), hashes[1:])))  # the pair that ends here
        before2, total3, freed3 = find(self.pair, key.view(np.int64))
        at = np.flatnonzero(token)
        (count,) = find(self.tri, chain(key[at - 1], hashes[at]).view(np.int64))
        facts = self.facts
        cut = lambda c, d: np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0)
        p1 = (np.maximum(before[at] - D1, 0) + D1 * facts.words / (facts.words + 1)) / max(1, facts.pairs)
        t2, t3 = total[at - 1], total3[at - 1].astype(np.float64)
        p2 = np.where(t2 > 0, (cut(before2[at].astype(np.float64), facts.d2) + freed[at - 1] * p1) / np.maximum(t2, 1), p1)
        p3 = np.where(t3 > 0, (cut(count.astype(np.float64), facts.d3) + freed3[at - 1] * p2) / np.maximum(t3, 1), p2)
        return np.add.reduceat(np.log10(p3), np.cumsum(n) - n), n


def slabs(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, with up to about ``SLAB`` bytes of texts each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    of = np.cumsum(sizes) // SLAB
    ends = [*np.flatnonzero(np.diff(of)) + 1, batch.num_rows] if len(of) else []
    for start, end in zip([0, *ends], ends, strict=False):
        yield batch.slice(int(start), int(end - start))


@dataclass
class Shared:
    """The model in broadcasts; ``scorer`` is for tasks."""

    facts: Facts
    parts: dict[str, list]

    def scorer(self) -> Scorer:
        return Scorer(self.facts, self.parts["tri"], self.parts["pair"], self.parts["uni"])

    def drop(self) -> None:
        for part in self.parts.values():
            for b in part:
                if hasattr(b, "unpersist"):
                    b.unpersist()


def share(spark: SparkSession, made: dict[str, DataFrame], facts: Facts) -> Shared:
    """Broadcast the tables shard by shard."""
    return Shared(facts, {name: [spark.sparkContext.broadcast(x) for x in shards(df, 1 + facts.sizes[name] // SHARD_ROWS)] for name, df in made.items()})


def rates(sizes: dict[str | None, tuple[int, int]], bound: int, chars: int) -> dict[str | None, float]:
    """Share of each language's trusted documents to train on, from their numbers and characters.

    Half of ``bound`` by size, half in equal parts, half of a language at most; less where that is over ``chars``.
    """
    left, share = bound / 2, 0.0
    for k, (n, _) in enumerate(sorted(sizes.values())):  # small languages leave the rest of their parts to the others
        share = left / (len(sizes) - k)
        if n / 2 > share:
            break
        left -= n / 2
        share = n / 2
    total = max(1, sum(n for n, _ in sizes.values()))
    out = {name: min(0.5, max(bound / 2 / total, share / max(1, n))) for name, (n, _) in sizes.items()}
    drawn = sum(out[name] * c for name, (_, c) in sizes.items())
    return {name: rate * min(1.0, chars / max(1.0, drawn)) for name, rate in out.items()}


def trusted(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bound: int | None = None, chars: int | None = None) -> DataFrame:
    """(g, l, train): ids and languages of the documents labelled good and not toxic, and whether they are to train on (half of them, without a bound)."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("g")).distinct()
    found = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("c"), F.xxhash64(text).alias("h")).join(good, F.col("i") == F.col("g"))
    found = stage(spark, found.groupBy("g", "l").agg(F.sum("c").alias("c"), F.min("h").alias("h")), "trusted")
    draw = F.pmod(F.xxhash64("h" if bound is None else "g", F.lit(23)), F.lit(1 << 40)) / float(1 << 40)
    if bound is None:
        return found.select("g", "l", (draw < COUNTED).alias("train"))
    some = F.when(F.col("c") <= LONGEST, F.col("c")).otherwise(0)
    sizes = found.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(some).alias("c")).collect()  # one row a language
    share = rates({r["l"]: (r["n"], r["c"]) for r in sizes}, bound, sum(r["c"] for r in sizes) if chars is None else chars)
    table = F.broadcast(spark.createDataFrame(list(share.items()), "name string, rate double"))
    return found.join(table, F.col("l").eqNullSafe(F.col("name"))).select("g", "l", ((draw < F.col("rate")) & (F.col("c") <= LONGEST)).alias("train"))


def trigrams(texts: DataFrame) -> DataFrame:
    """(u, v, w, n): distinct trigrams of word hashes of a table with one column of texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: dict[bytes, int] = {}
            for t in batch.column(0).to_pylist():
                words = [*words_of(t), b""]
                for w in words:
                    if w not in hashes:
                        hashes[w] = word_hash(w)
                a = np.array([_BOS, _BOS, *(hashes[w] for w in words)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[:-2]), pa.array(a[1:-1]), pa.array(a[2:])], ["u", "v", "w"])

    return texts.mapInArrow(emit, "u long, v long, w long").groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("n"))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for every byte (the same for either case of A-Z), and powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    of = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    of[65:91] = of[97:123]
    up = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (base, pow(base, -1, 1 << 64))]
    return of, *up


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Keys of the start and of the end of a text; those of words are hashes.
START, END = 1, 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words (those of ``words_of``), each text as start, start, words, end; and the numbers of words of every text."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    in_word = np.zeros(len(data) + 2, bool)
    in_word[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = in_word[1:] & ~in_word[:-1]
    cuts = bounds[in_word[bounds] & in_word[bounds + 1]]  # two texts meet without a space
    first[cuts] = True
    starts = np.flatnonzero(first[: len(data)])
    last = in_word[:-1] & ~in_word[1:]
    last[cuts] = True
    ends = np.flatnonzero(last)
    of, up, down = _powers(1 << max(20, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of[data] * up[: len(data)], out=sums[1:])
    keys = (_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    n = np.diff(np.searchsorted(starts, bounds))
    out = np.full(len(keys) + 3 * len(n), START, np.int64)
    word = np.ones(len(out), bool)
    stop = np.cumsum(n + 3)
    for k in (stop - 1, stop - n - 3, stop - n - 2):
        word[k] = False
    out[word] = keys
    out[stop - 1] = END
    return out, n


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal rows of sorted columns begin, and their lengths."""
    size = len(columns[0])
    new = np.ones(size, bool)
    new[1:] = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns)) if size else new[1:]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, size))


def _seek(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in the known, which are sorted; -1 where absent."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return np.where(known[at] == wanted, at, -1)


def _numbers(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Numbers of the keys x by their place in the known (0: absent); a key is sought once for all its rows, which find it by its low bits."""
    own = np.unique(x)
    number = _seek(known, own) + 1
    low = np.int64((1 << (4 * len(own)).bit_length()) - 1)
    place = np.zeros(low + 1, np.int32)
    place[own & low] = np.arange(len(own))
    at = place[x & low]
    other = np.flatnonzero(own[at] != x)
    at[other] = np.searchsorted(own, x[other])
    return number[at]


_LOW = np.int64((1 << 32) - 1)


@dataclass
class Counted:
    """Trigrams, pairs and contexts of one task's trained tokens, all that have its middle words (of a salted word: its share of the last words)."""

    k: np.ndarray  # middle << 32 | last, of each distinct trigram
    u: np.ndarray
    n: np.ndarray
    ends: np.ndarray  # distinct k, and the distinct words before them
    before: np.ndarray

    @classmethod
    def of(cls, k: np.ndarray, u: np.ndarray) -> Counted:
        order = np.lexsort((u, k))
        k, u = k[order], u[order]
        at, n = _runs(k, u)
        k, u = k[at], u[at]
        at, before = _runs(k)
        return cls(k, u, n, k[at], before)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """middle << 32 | first, sorted; and total, words after it once, twice, more often."""
        key = (self.k >> 32 << 32) | self.u
        order = np.argsort(key, kind="stable")
        key, n = key[order], self.n[order]
        at, _ = _runs(key)
        return key[at], _sums(n, at)


def _sums(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.stack((n, n == 1, n == 2, n > 2)).astype(np.int64)
    return np.add.reduceat(rows, at, axis=1) if len(at) else rows[:, :0]


@dataclass
class Words:
    """Broadcasts: sorted keys of the trained words (number 1 and up; 0: never trained), salts of the frequent ones, and their counts by number."""

    keys: list
    salts: dict[int, int] = field(default_factory=dict)
    counts: list = field(default_factory=list)

    def known(self) -> np.ndarray:
        return np.concatenate([b.value for b in self.keys])

    def table(self) -> np.ndarray:
        """By number: distinct words before it; as a context its count and the mass freed."""
        return np.concatenate([np.zeros((3, 1), np.float32), *(b.value for b in self.counts)], axis=1)


def dealt(rows: DataFrame, words: Words, part: int, parts: int, facts: Facts | None, tasks: int) -> DataFrame:
    """Packed tokens (k, m, h) of (t, h, f) whose middle word is of the part; b tells the task: k is middle << 32 | last, m first << 1 | trained.

    h numbers the texts. With facts, each has two more rows: k = SUM with a sum, in
    parts of 1 / ``UNIT``, as m, over its tokens after words that were never trained (these only need their
    last word), and k = HASH with its hash as m.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.known()
        salts = np.ones(len(known) + 1, np.int64)
        for i, s in words.salts.items():
            salts[i] = s
        p1 = None if facts is None else _lowest(words.table()[0], facts)
        number = TaskContext.get().partitionId() << 32  # of a text: the task, and its place there
        held: list[list[np.ndarray]] = []
        for whole in batches:
            for batch in slabs(whole, 0):
                x, n = tokens(batch.column(0))
                doc = np.repeat(np.arange(len(n)), n + 3)
                last = np.ones(len(x), bool)
                begin = np.cumsum(n + 3) - n - 3
                last[begin] = last[begin + 1] = False
                last[1:] &= (x[:-1] >> 20) % parts == part
                at = np.flatnonzero(last)
                number_of = _numbers(known, x) if len(x) else x
                u, v, w = (number_of[at - k] for k in (2, 1, 0))
                doc = doc[at]
                f = batch.column(2).to_numpy(zero_copy_only=False) & (n > 0)
                ok = v > 0
                if p1 is not None:
                    sums = np.bincount(doc[~ok], np.rint(np.log10(p1[w[~ok]]) * UNIT), len(n)).astype(np.int64)
                    every = np.arange(len(n))
                    for kind, value in ((SUM, sums), (HASH, batch.column(1).to_numpy())):
                        yield from packed([_bucket(every * 0 + number % 1_000_003, 0, tasks), every * 0 + kind, value, every + number])
                u, v, w, doc = u[ok], v[ok], w[ok], doc[ok]
                salt = (w * 0x9E3779B1 >> 7) % salts[v]
                held.append([_bucket(v, salt, tasks), v << 32 | w, u << 1 | f[doc], doc + number])
                number += len(n)
                if sum(len(columns[0]) for columns in held) >= DEALT:
                    yield from packed([np.concatenate(c) for c in zip(*held, strict=True)])
                    held.clear()
        if held:
            yield from packed([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows.select("t", "h", "f").mapInArrow(emit, PACKED)


#: Rows of a text, told by k.
SUM, HASH = -1, -2
#: Rows of one kind that go to one task, packed.
PACKED = "b int, packed binary"


def packed(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (b, k, m, h) as one compressed value for each b: columns of k by halves, m and h, sorted by k."""
    order = np.lexsort((columns[1], columns[0]))
    b, k, m, h = (c[order] for c in columns)
    at, n = _runs(b)
    codec = pa.Codec("zstd", 1)
    values = []
    for i, size in zip(at.tolist(), n.tolist(), strict=True):
        own, wide, of = k[i : i + size], m[i : i + size], h[i : i + size]
        first = of.min()
        narrow = own[0] >= 0 and wide.min() >= 0 and wide.max() < 1 << 31
        high = np.diff(own >> 32, prepend=0).astype(np.int32)
        rest = (wide.astype(np.int32), (of - first).astype(np.uint32)) if narrow else (wide, of)
        raw = b"".join(x.tobytes() for x in (np.array([size, first, narrow], np.int64), *rest, high, (own & _LOW).astype(np.uint32)))
        values.append(len(raw).to_bytes(8, "little") + size.to_bytes(8, "little") + codec.compress(raw, asbytes=True))
    yield pa.RecordBatch.from_arrays([pa.array(b[at], pa.int32()), pa.array(values, pa.binary())], ["b", "packed"])


def unpacked(values: list[bytes]) -> tuple[np.ndarray, ...]:
    """(k, m, h) of all rows of packed values."""
    codec = pa.Codec("zstd")
    out = tuple(np.empty(sum(int.from_bytes(value[8:16], "little") for value in values), np.int64) for _ in range(3))
    end = 0
    for value in values:
        raw = codec.decompress(memoryview(value)[16:], int.from_bytes(value[:8], "little"), asbytes=True)
        size, first, narrow = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24
        columns = []
        for kind in (np.int32, np.uint32, np.int32, np.uint32) if narrow else (np.int64, np.int64, np.int32, np.uint32):
            columns.append(np.frombuffer(raw, kind, size, at))
            at += columns[-1].nbytes
        k, m, h = (c[end : end + size] for c in out)
        m[:], h[:], high, low = columns
        h += first if narrow else 0
        np.cumsum(high, dtype=np.int64, out=k)
        k <<= 32
        k |= low
        end += size
    return out


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(k, m, h) of a task's rows, one bucket after the other; the others stay packed."""
    values: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, value in zip(batch.column("b").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            values.setdefault(b, []).append(value)
    for b in list(values):
        yield unpacked(values.pop(b))


def _bucket(v: np.ndarray, salt: np.ndarray | int, tasks: int) -> np.ndarray:
    """Several to a task, so that tasks are about even."""
    return (_mix((v << 20 | salt).astype(np.uint64)) % np.uint64(4 * tasks)).astype(np.int64)


def _lowest(before: np.ndarray, facts: Facts) -> np.ndarray:
    return (np.maximum(before.astype(np.float64) - D1, 0) + D1 * facts.words / (facts.words + 1)) / max(1, facts.pairs)


#: Rows of the counts: numbers of trigrams by count, of pairs by words before them; a word as a context, and as the last; contexts of salted words.
TRI, PAIR, CONTEXT, LAST, SALTED = range(5)


def counts(rows: DataFrame, words: Words, part: int, tasks: int) -> DataFrame:
    """(kind, a, b, n, c1, c2, c3) of one part's trained tokens, summed by kind, a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m, _ = unpacked([value for batch in batches for value in batch.column("packed").to_pylist()])
        c = Counted.of(k, m >> 1)
        middle = c.ends >> 32
        at, _ = _runs(middle)
        last, number = np.unique(c.ends & _LOW, return_counts=True)
        context, sums = c.contexts()
        salted = np.isin(context >> 32, np.array(list(words.salts), np.int64))
        histogram = lambda n: np.bincount(np.minimum(n, 5), minlength=6)[1:]
        plain = lambda kind, a, n: (kind, a, a * 0, np.stack((n, *[n * 0] * 3)))
        of = np.arange(1, 6)
        for kind, a, b, n in (plain(TRI, of, histogram(c.n)), plain(PAIR, of, histogram(c.before)), (CONTEXT, middle[at], middle[at] * 0, _sums(c.before, at)), plain(LAST, last, number), (SALTED, context[salted] >> 32, context[salted] & _LOW, sums[:, salted])):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), *(pa.array(x.astype(np.int64)) for x in (a, b, *n))], ["kind", "a", "b", "n", "c1", "c2", "c3"])

    made = dealt(rows, words, part, COUNT_PASSES, None, tasks).repartition(tasks, "b").mapInArrow(run, "kind long, a long, b long, n long, c1 long, c2 long, c3 long")
    return made.groupBy("kind", "a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "c1", "c2", "c3")))


#: Sums or hashes (kind) of the texts that one task of ``dealt`` numbered (p), packed.
BUNDLED = "p int, kind int, packed binary"


def bundled(kind: int, d: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """A row for each task that numbered the texts d, which are sorted, with their values."""
    codec = pa.Codec("zstd", 1)
    at, n = _runs(d >> 32)
    values = []
    for i, size in zip(at.tolist(), n.tolist(), strict=True):
        own = value[i : i + size]
        raw = b"".join(x.tobytes() for x in (np.diff(d[i : i + size] & _LOW, prepend=0).astype(np.uint32), (own & _LOW).astype(np.uint32), (own >> 32).astype(np.int32)))
        values.append(size.to_bytes(8, "little") + codec.compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(d[at] >> 32, pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(values, pa.binary())], ["p", "kind", "packed"])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, s): the hash of every text and its sum, by the texts' places in the task that numbered them."""
    codec = pa.Codec("zstd")
    whole: dict[int, dict[int, np.ndarray]] = {SUM: {}, HASH: {}}
    n: dict[int, int] = {}
    for batch in batches:
        for p, kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = int.from_bytes(value[:8], "little")
            raw = codec.decompress(memoryview(value)[8:], 12 * size, asbytes=True)
            d = np.cumsum(np.frombuffer(raw, np.uint32, size), dtype=np.int64)
            known = whole[kind].get(p, np.zeros(0, np.int64))
            if len(known) <= d[-1]:
                known = whole[kind][p] = np.concatenate((known, np.zeros(max(int(d[-1]) + 1, 2 * len(known)) - len(known), np.int64)))
            known[d] += np.frombuffer(raw, np.int32, size, 8 * size).astype(np.int64) << 32 | np.frombuffer(raw, np.uint32, size, 4 * size)
            if kind == HASH:
                n[p] = max(n.get(p, 0), int(d[-1]) + 1)
    for p, size in n.items():
        s = whole[SUM].get(p, np.zeros(0, np.int64))[:size]
        yield pa.RecordBatch.from_arrays([pa.array(whole[HASH][p][:size]), pa.array(np.concatenate((s, np.zeros(size - len(s), np.int64))) / UNIT)], ["h", "s"])


def task_sums(batches: Iterator[pa.RecordBatch], table: np.ndarray, salted: np.ndarray, facts: Facts) -> Iterator[pa.RecordBatch]:
    """Bundled sums of log10 P by text, of a task's packed rows, and hashes of the texts.

    Of all the task's tokens only one bucket's are unpacked at a time, and only ``STEP`` of these are looked up at once.
    """
    cut = lambda n, d: np.maximum(n - d[np.minimum(n, 3)], 0)
    lowest = _lowest(table[0], facts)
    logs: list[np.ndarray] = []
    of: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        texts, place = np.unique(np.concatenate(of), return_inverse=True)
        total = np.bincount(place, np.concatenate(logs), len(texts)).astype(np.int64)
        of.clear(), logs.clear()
        return bundled(SUM, texts, total)

    for k, m, h in buckets(batches):
        named, done, sent = k == HASH, k == SUM, (k >= 0) & (m < 0)
        order = np.argsort(h[named])
        yield bundled(HASH, h[named][order], m[named][order])
        logs.append(m[done].astype(np.float64)), of.append(h[done])
        extra_key, extra = k[sent] | (-1 - m[sent]), h[sent].view(np.float32).reshape(-1, 2)
        rest = ~(named | done | sent)
        k, m, h = k[rest], m[rest], h[rest]
        trained = (m & 1) == 1
        c = Counted.of(k[trained], m[trained] >> 1)
        context, n = c.contexts()
        stats = np.stack((n[0], n[1:].T @ facts.d3[1:]), 1)
        whole = ~np.isin(context >> 32, salted)
        context, stats = np.concatenate((context[whole], extra_key)), np.concatenate((stats[whole], extra))
        order = np.argsort(context)
        context, stats = context[order], np.concatenate((stats[order], np.zeros((1, 2))))  # absent ones get the last
        known, before, count = (_seek(c.ends, c.k) << 32) | c.u, np.append(c.before, 0), np.append(c.n, 0)
        for low in range(0, len(k), STEP):
            own = k[low : low + STEP]
            u, v, w = m[low : low + STEP] >> 1, own >> 32, own & _LOW
            end = _seek(c.ends, own)
            tri = _seek(known, np.where(end < 0, -1, (end << 32) | u))
            p1, t2 = lowest[w], table[1][v].astype(np.float64)
            p2 = np.where(t2 > 0, (cut(before[end], facts.d2) + table[2][v] * p1) / np.maximum(t2, 1), p1)
            t3, freed = stats[_seek(context, (v << 32) | u)].T
            p3 = np.where(t3 > 0, (cut(count[tri], facts.d3) + freed * p2) / np.maximum(t3, 1), p2)
            logs.append(np.rint(np.log10(p3) * UNIT)), of.append(h[low : low + STEP])
            if sum(map(len, of)) >= TASK_TOKENS:
                yield summed()
    if of:
        yield summed()


def sums_of(rows: DataFrame, words: Words, facts: Facts, part: int, tasks: int, contexts: DataFrame | None) -> DataFrame:
    """(h, s): sums of log10 P over the part's tokens of all texts of a hash.

    A task counts its trained tokens anew and looks up the others in these counts.
    Salted words have their ``contexts`` (v, u, n, freed) sent to each of their tasks.
    """
    mine = dealt(rows, words, part, PASSES, facts, tasks)
    if contexts is not None:

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = words.known()
            for batch in batches:
                v, u, n, freed = (c.to_numpy() for c in batch.columns)
                here = (known[v - 1] >> 20) % PASSES == part
                v, u, n, freed = (c[here] for c in (v, u, n, freed))
                salts = np.array([words.salts[i] for i in v.tolist()], np.int64)
                each = np.repeat(np.arange(len(v)), salts)
                salt = np.arange(len(each)) - np.repeat(np.cumsum(salts) - salts, salts)
                payload = np.stack((n, freed), 1).astype(np.float32).view(np.int64).ravel()
                yield from packed([_bucket(v[each], salt, tasks), v[each] << 32, -1 - u[each], payload[each]])

        mine = mine.unionByName(contexts.mapInArrow(send, PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task_sums(batches, words.table(), np.array(list(words.salts), np.int64), facts)

    return mine.repartition(tasks, "b").mapInArrow(run, BUNDLED).repartition(tasks, "p").mapInArrow(gathered, "h long, s double").groupBy("h").agg(F.sum("s").alias("s"))


def measure_all(spark: SparkSession, docs: DataFrame, chosen: DataFrame) -> tuple[Shared | None, DataFrame | None]:
    """The model's facts and every row's (id, l, n, x, h), with the counts of all chosen texts; a text and its copies share h.

    Tokens go to tasks by their middle word, where all that its trigrams, pairs and
    contexts need comes together: trained tokens are counted there and never leave.
    """
    before = staged_paths()
    rows = docs.withColumn("h", F.xxhash64("t"))
    match = (F.col("id") == F.col("g")) & F.col("l").eqNullSafe(F.col("k"))
    trained = rows.join(chosen, match).select("t", "h", F.lit(True).alias("f"))
    flagged = rows.join(chosen, match, "left").select("t", "h", F.col("g").isNotNull().alias("f"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slabs(whole, 0):
                x, n = tokens(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(x[np.repeat(n > 0, n + 3)]))], ["key"])

    vocabulary = stage(spark, trained.select("t").mapInArrow(distinct, "key long").distinct(), "vocabulary")
    size = vocabulary.count()
    if not size:
        return None, None
    send = spark.sparkContext.broadcast
    words = Words([send(keys) for (keys,) in shards(vocabulary, 1 + size // SHARD_ROWS)])
    kind = docs.schema["id"].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.known()
        for whole in batches:
            for batch in slabs(whole, 2):
                x, n = tokens(batch.column(2))
                keys, c = np.unique(x[x != END], return_counts=True)
                some = c > len(x) // HOT
                number = _seek(known, keys[some]) + 1
                c = c[some][number > 0]
                number, none = number[number > 0], pa.nulls(int((number > 0).sum()))
                first = [*batch.columns[:2], batch.column(3), pa.array(n + 1), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())]
                names = ["id", "l", "h", "n", "v", "c"]
                yield pa.RecordBatch.from_arrays(first, names)
                yield pa.RecordBatch.from_arrays([none.cast(first[0].type), none.cast(first[1].type), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(number), pa.array(c)], names)

    found = stage(spark, rows.select("id", "l", "t", "h").mapInArrow(lengths, f"id {kind}, l string, h long, n long, v long, c long"), "lengths")
    known = found.where("v IS NULL").select("id", "l", "h", "n")
    total = known.agg(F.sum("n")).first()[0]
    limit = max(2 * TASK_TOKENS, total // HOT)
    words.salts = {r["v"]: -(-r["c"] // limit) for r in found.where("v IS NOT NULL").groupBy("v").agg(F.sum("c").alias("c")).where(F.col("c") > limit).collect()}  # HOT at most
    tasks = lambda parts: max(4, total // parts // TASK_TOKENS)
    parted = []
    for part in range(COUNT_PASSES):
        parted.append(stage(spark, counts(trained, words, part, tasks(COUNT_PASSES)), "counts"))
        sweep(spark)
    made = reduce(DataFrame.unionByName, parted).groupBy("kind", "a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "c1", "c2", "c3")))
    few = {(r["kind"], r["a"]): r["n"] for r in made.where(F.col("kind").isin(TRI, PAIR)).collect()}  # ten rows
    of = lambda kind: {a: n for (k, a), n in few.items() if k == kind}
    d3, d2 = discounts(of(TRI)), discounts(of(PAIR))
    freed = lambda d: sum(F.col(f"c{k}") * float(d[k]) for k in (1, 2, 3))
    is_last = F.col("kind") == LAST
    uni = made.where(F.col("kind").isin(CONTEXT, LAST)).groupBy(F.col("a").alias("key")).agg(F.sum(F.when(is_last, F.col("n"))).alias("before"), F.sum(F.when(~is_last, F.col("n"))).alias("total"), F.sum(F.when(~is_last, freed(d2))).alias("freed"))
    uni = stage(spark, uni.na.fill(0), "words")
    facts = Facts(d3, d2, sum(of(PAIR).values()), uni.where("before > 0").count(), {"tri": sum(of(TRI).values()), "pair": sum(of(PAIR).values()), "uni": size})
    for low in range(1, size + 1, SHARD_ROWS):
        shard = uni.where(F.col("key").between(low, low + SHARD_ROWS - 1)).toArrow()
        table = np.zeros((3, min(SHARD_ROWS, size + 1 - low)), np.float32)
        for row, c in zip(table, ("before", "total", "freed"), strict=True):
            row[shard.column("key").to_numpy() - low] = shard.column(c).to_numpy()
        words.counts.append(send(table))
    contexts = stage(spark, made.where(F.col("kind") == SALTED).select("a", "b", "n", freed(d3).alias("freed")), "contexts") if words.salts else None
    release(*parted, vocabulary, uni)
    sums = []
    for part in range(PASSES):
        sums.append(stage(spark, sums_of(flagged, words, facts, part, tasks(PASSES), contexts), "sums"))
        sweep(spark)
    copies = known.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.lit(0.0).alias("s"))
    scored = reduce(DataFrame.unionByName, (df.withColumn("copies", F.lit(0).cast("long")) for df in sums), copies.select("h", "s", "copies"))
    scored = stage(spark, scored.groupBy(F.col("h").alias("g")).agg(F.sum("s").alias("s"), F.sum("copies").alias("copies")), "scored")
    x = (-F.col("s") / (F.col("copies") * F.col("n"))).alias("x")
    measured = stage(spark, join_split(known, ["h"], scored, ["g"], "copies", ["id"]).select("id", "l", "n", x, "h"), "measured")
    release_since(before, measured)
    return Shared(facts, {"uni": [*words.keys, *words.counts], "tri": list(range(PASSES))}), measured


def limits_of(measured: DataFrame, good: DataFrame) -> list[tuple]:
    """Thresholds (language or None, band or None, log10 perplexity, documents) from the trusted documents that weren't counted."""
    band = F.lit(len(BANDS))
    for k, top in reversed(list(enumerate(BANDS))):
        band = F.when(F.col("n") <= top, F.lit(k)).otherwise(band)
    rest = good.where(~F.col("train")).select("g", F.col("l").alias("k"))
    judged = measured.where("n > 1").join(rest, (F.col("id") == F.col("g")) & F.col("l").eqNullSafe(F.col("k")))
    steps = judged.groupBy("l", band.alias("b"), F.ceil(F.col("x") * STEPS).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    sums = [F.sum("c").alias("m"), F.expr(f"percentile(x, {QUANTILE}D, c)").alias("q"), F.expr("percentile(x, 0.5D, c)").alias("mid")]
    rows = steps.cube("l", "b").agg(F.grouping("l").alias("any_l"), F.grouping("b").alias("any_b"), *sums).collect()  # a row a language and band
    return [(ANY if r["any_l"] else r["l"], ANY if r["any_b"] else r["b"], (r["q"] + SLACK * (r["q"] - r["mid"])) / STEPS, r["m"]) for r in rows]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bound: int | None = None, chars: int | None = None) -> tuple[Shared | None, list[tuple], DataFrame | None]:
    """The shared model, thresholds (language or None, band or None, log10 perplexity), and every row's (id, l, n, x) with its measures."""
    ship(spark)
    docs = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("l"), F.col(text).alias("t"))
    good = trusted(spark, docs, labels, "id", "t", "l", bound, chars)
    chosen = good.where("train").select("g", F.col("l").alias("k"))
    chosen = F.broadcast(chosen) if chosen.count() <= SENT else chosen
    if bound is None:
        shared, measured = measure_all(spark, docs, chosen)
        return shared, limits_of(measured, good) if shared else [], measured
    some = docs.join(chosen, (F.col("id") == F.col("g")) & F.col("l").eqNullSafe(F.col("k"))).select("t")
    before = staged_paths()
    grams = stage(spark, trigrams(some.where(F.length(F.btrim("t", F.lit(SPACE))) > 0)), "grams")
    if grams.isEmpty():
        return None, [], None
    made, facts = tables(spark, grams)
    if sum(facts.sizes.values()) > ROWS:
        return fit(spark, docs, labels, "id", "t", "l", max(1, bound // 2), None if chars is None else chars // 2)
    shared = share(spark, made, facts)
    release_since(before, good)
    kind = docs.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.scorer()
        for whole in batches:
            for batch in slabs(whole, 2):
                s, n = scorer.score(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(-s / n)], ["id", "l", "n", "x"])

    measured = stage(spark, docs.mapInArrow(measure, f"id {kind}, l string, n long, x double"), "measured")
    return shared, limits_of(measured, good), measured


#: Stands for every language or band; no value of a column.
ANY = ("any",)


def threshold(rows: list[tuple], lang: str | None, n: int) -> float:
    """That of the language's band, drawn towards the larger of the language's and the band's, and these towards that of all."""
    band = sum(n > top for top in BANDS)
    known = {(x, b): (q, m) for x, b, q, m in rows}
    if (ANY, ANY) not in known:
        return float("inf")

    def drawn(key: tuple, towards: float) -> float:
        q, m = known.get(key, (0.0, 0))
        return (m * q + PRIOR * towards) / (m + PRIOR)

    every = known[ANY, ANY][0]
    return drawn((lang, band), max(drawn((lang, ANY), every), drawn((ANY, band), every)))


def judge(spark: SparkSession, measured: DataFrame, limits: list[tuple]) -> DataFrame:
    """Measured rows with their threshold and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        for batch in batches:
            top = []
            for name, n in zip(batch.column("l").to_pylist(), batch.column("n").to_pylist(), strict=True):
                key = (name, sum(n > t for t in BANDS))
                if key not in known:
                    known[key] = threshold(limits, name, n)
                top.append(known[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top, pa.float64()), pa.array(batch.column("x").to_numpy() <= np.array(top))], [*batch.schema.names, "threshold", "kept"])

    return measured.mapInArrow(run, StructType([*measured.schema.fields]).add("threshold", DoubleType()).add("kept", BooleanType()))


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_perplexity, perplexity, threshold, kept."""
    shared, limits, measured = fit(spark, docs, labels)
    if shared is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", F.lit(None).cast("long").alias("n_tokens"), none.alias("log_perplexity"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    shared.drop()
    done = judge(spark, measured, limits)
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), F.col("x").alias("log_perplexity"), F.pow(F.lit(10.0), "x").alias("perplexity"), "threshold", "kept")


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose perplexity is within their threshold; the others are told by hashes, so that texts aren't staged."""
    shared, limits, measured = fit(spark, docs, labels)
    if shared is None:
        return docs
    shared.drop()
    h, lang = fresh(docs, "failed_hash", "failed_lang")
    failed = stage(spark, judge(spark, measured, limits).where(~F.col("kept")).select(F.col("h").alias(h), F.col("l").alias(lang)).distinct(), "failed")
    release(measured)
    failed = F.broadcast(failed) if failed.count() <= SENT else failed
    return docs.join(failed, (F.xxhash64("text") == F.col(h)) & F.col("lang").eqNullSafe(F.col(lang)), "left_anti")
