"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three letters, other
characters count as one space). Training uses follow-the-regularised-leader with an
elastic net on a bounded sample of every labelled language: ``PER_LANG`` rows of each
in expectation, or equal parts of ``TOTAL`` rows where those are less, but ``FEWEST`` at
least (all rows of a language that has no more), and twice as many at most; a part of the sample that the weights never
saw sets the temperature of the scores. A step only touches the weights of the features
in its rows: they are made from two sums a weight when they are needed, so memory is
that of the sample and of these sums. Every whole text is then scored.

Defined results: a null text, or one without letters, is ``und`` with score 0, and so
is every text if no language was learned; very long texts are counted whole; between
languages of equal score the first by name is predicted; repeated rows are scored
alike; an empty table gives an empty one; other columns never enter a prediction and
may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from rasterloom.llm.common import bucket_of, fresh, ship

BITS = 14
ORDERS = 3
PER_LANG = 600
#: Sampled rows of all languages together, and the part that every language has even beyond that.
TOTAL = 24_000
FEWEST = 30
EPOCHS = 6
BATCH = 32
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
MIN_SCORE = 0.4

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    alpha = letters()[c]
    if not alpha.any():
        return None
    c = np.where(alpha, c, 32).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]  # runs of spaces count once
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    out = np.zeros(1 << BITS, np.int64)
    h = c.copy()
    for n in range(ORDERS):
        if n:
            if len(c) <= n:
                break
            h = h[:-1] * np.uint32(0x01000193) + c[n:]
        mixed = (h + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        out += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def weigh(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero features and their unit-length weights."""
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


class Model:
    """Weights (features, languages), bias, inverse document frequencies, temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def logits(self, n: np.ndarray) -> np.ndarray:
        at, x = weigh(n, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text) if self.languages else None
        if n is None:
            return "und", 0.0
        z = self.logits(n) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def per_language(sizes: list[int], per_lang: int = PER_LANG, total: int = TOTAL) -> float:
    """Rows to sample of a language that has as many: equal parts of ``total``, within FEWEST and ``per_lang``."""
    left, share = float(total), 0.0
    for k, n in enumerate(sorted(sizes)):  # small languages leave the rest of their parts to the others
        share = left / (len(sizes) - k)
        if n > share:
            break
        left -= n
        share = max(share, n)
    return min(per_lang, max(share, FEWEST))


class Ftrl:
    """Follow-the-regularised-leader with an elastic net; a row of sums for each feature, the last one for the bias."""

    def __init__(self, features: int, classes: int):
        self.z, self.s = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, s = self.z[at], self.s[at]
        return np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA * 0.01 + np.sqrt(s)) / ALPHA + L2))

    def step(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, cost: np.ndarray) -> None:
        """One step on rows over the features ``at``; ``cost`` weighs the rows."""
        w = self.weights(at)
        p = softmax(x @ w)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ (p * cost[:, None])
        s = self.s[at]
        self.z[at] += g - (np.sqrt(s + g * g) - np.sqrt(s)) / ALPHA * w
        self.s[at] = s + g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def joined(rows: list[tuple[np.ndarray, np.ndarray]], bias: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (features, values) as a matrix over the features that any of them has, and those; the bias is the last."""
    at = np.append(np.unique(np.concatenate([f for f, _ in rows])), bias)
    x = np.zeros((len(rows), len(at)))
    x[:, -1] = 1
    for k, (f, v) in enumerate(rows):
        x[k, np.searchsorted(at, f)] = v
    return x, at


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> Model:
    """Weights from minibatches of (language, features, counts), then the temperature."""
    names = sorted({lang for lang, _, _ in rows})
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    rng = np.random.default_rng(seed)
    number = {name: k for k, name in enumerate(names)}
    y = np.array([number[lang] for lang, _, _ in rows])
    held = np.zeros(len(rows), bool)
    for k in range(len(names)):
        own = np.flatnonzero(y == k)
        if len(own) >= 10:
            held[rng.choice(own, len(own) // 5, replace=False)] = True
    df = np.zeros(1 << BITS, np.int64)
    for k in np.flatnonzero(~held):
        df[rows[k][1]] += 1
    idf = np.log((1 + (~held).sum()) / (1 + df)) + 1
    values = []
    for _, at, n in rows:
        v = (1 + np.log(n)) * idf[at]
        values.append((at, (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32)))
    m, bias = len(names), 1 << BITS
    leader = Ftrl(bias + 1, m)
    own = np.flatnonzero(~held)
    share = np.bincount(y[own], minlength=m) / max(1, len(own))
    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for lo in range(0, len(order), BATCH):
            chosen = order[lo : lo + BATCH]
            x, at = joined([values[k] for k in chosen], bias)
            leader.step(x, at, y[chosen], 1 / (m * share[y[chosen]] * len(chosen)))  # every language weighs the same
    w = leader.weights(np.arange(bias + 1))
    model = Model(names, idf, w[:-1].astype(np.float32), w[-1].astype(np.float32))
    check = np.flatnonzero(held) if held.any() else own
    logits = np.stack([v @ w[at] + w[-1] for at, v in (values[k] for k in check)])
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.02), np.log(5), 60)):
        v = logits / t
        v -= v.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(check)), y[check]]).mean())
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    return model


def fit(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, total: int = TOTAL) -> Model:
    """Model from the rows whose crc32 bucket is not the held-out one and whose language is known."""
    ship(spark)
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (bucket_of(doc_id, 4) != 2)).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    none = Model([], np.ones(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    if not sizes:
        return none
    per_lang = per_language([r["n"] for r in sizes], per_lang, total)
    rate = F.broadcast(spark.createDataFrame([(r["l"], per_lang / r["n"]) for r in sizes], "name string, rate double"))
    draw = F.pmod(F.xxhash64(F.col("i"), F.lit(11)), F.lit(1 << 52)) / float(1 << 52)
    sample = known.join(rate, F.col("l") == F.col("name")).where(draw < F.col("rate")).select("l", "t")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang, n) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (n := counts(t)) is not None]
            at = [np.flatnonzero(n) for _, n in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.string()), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([n[a].astype("<i4").tobytes() for a, (_, n) in zip(at, out, strict=True)], pa.binary())],
                ["l", "at", "n"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = [], {}
        for batch in batches:
            for name, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[name] = seen.get(name, 0) + 1
                if seen[name] <= 2 * per_lang:
                    rows.append((name, np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<i4")))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["model"])

    got = sample.mapInArrow(extract, "l string, at binary, n binary").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else none  # noqa: S301


def predict(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every row of ``docs`` with the predicted language and its calibrated probability."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*batch.schema.names, *names]
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType()))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(spark, docs)
    found = predict(spark, docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def keep(spark: SparkSession, docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is recognised with at least ``min_score``."""
    names = tuple(fresh(docs, "lang_pred", "score"))
    found = predict(spark, docs, fit(spark, docs), names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= min_score)).select(*docs.columns)
