from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import kneser, langid, lines, lm, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \t\n", "a", "one two", "a b c a b c a b c", "x # $ %% <|>\n\nx\nx\n y\n", "LOUD " * 60, "a\x0bb\x0cc\rd", "ünïcödé ß " * 30, ("w " * 30_000).strip(), "é" * 5000]


def docs(spark, texts, lang=None, source=None):
    rows = [(k, t, lang[k] if lang else None, source[k] if source else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    with_word = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(with_word) - len(set(with_word)), len(covered)


def test_quality_measures(spark):
    got = {r.doc_id: r for r in quality.report(spark, docs(spark, EDGE)).collect()}
    for k, t in enumerate(EDGE):
        r, want = got[k], plain_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (k, want)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_policies_and_ablations(spark):
    book = quality.ledger(docs(spark, EDGE))
    rows = book.collect()
    full = quality.mask("web/1")
    found = {r.rule: r for r in quality.ablations(book).collect()}
    for k, rule in enumerate(quality.rules()):
        assert found[rule].n_failed == sum(r.fail_bits >> k & 1 for r in rows)
        assert found[rule].n_kept_without == sum(r.fail_bits & full & ~(1 << k) == 0 for r in rows)
    good = " ".join(f"word{k}" for k in range(80))
    df = docs(spark, [good, *EDGE]).withColumns({"n_words": F.lit(1), "t_": F.lit("x"), "fail_bits": F.lit(2)})
    kept = quality.keep(spark, df)
    assert kept.columns == df.columns and [r.text for r in kept.collect()] == [good]
    assert quality.report(spark, df.limit(0)).count() == 0
    assert quality.report(spark, df).where("kept").count() == 1


def test_lines_against_brute_force(spark):
    r = np.random.default_rng(0)
    pool = [f"line number {k}" for k in range(12)]
    texts = ["\n".join(r.choice(pool[: 3 + k % 10], 4)) + f"\n own {k} \n\n" for k in range(40)] + [None, "", "line number 0\n  line number 0\t", "line number 1"]
    source = [None if k % 11 == 5 else f"s{k % 14}" for k in range(len(texts))]
    df = docs(spark, texts, source=source).withColumns({"row": F.lit(1), "bad": F.lit("b")})
    got = {x.doc_id: x for x in lines.remove(spark, df, min_sites=10, report=True).collect()}
    spread, first = {}, {}
    for k, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            key = line.strip(" \t\n\x0b\f\r")
            if key:
                spread.setdefault(key, set()).add(source[k])
                first.setdefault(key, (k, p))
    bad = {k for k, s in spread.items() if len(s - {None}) >= 10}
    assert bad
    for k, t in enumerate(texts):
        cut = (t or "").split("\n")
        rest = [x for p, x in enumerate(cut) if not (x.strip(" \t\n\x0b\f\r") in bad and first[x.strip(" \t\n\x0b\f\r")] != (k, p))]
        assert got[k].text == (None if t is None else "\n".join(rest)) and got[k].n_removed == len(cut) - len(rest)
    assert lines.report(spark, docs(spark, texts, source=source)).where(F.col("clean_md5") == hashlib.md5(b"").hexdigest()).count() == 2 + sum(not x.text for x in got.values() if x.text is not None and x.n_lines)  # noqa: S324
    assert lines.report(spark, df.limit(0)).count() == 0


def many(spark, n=400, seed=1):
    r = np.random.default_rng(seed)
    words = {"aa": ["the", "thing", "ofthe", "and", "with"], "bb": ["der", "und", "schön", "nicht", "ein"], "cc": ["el", "los", "niño", "para", "que"]}
    lang = [str(r.choice(list(words))) for _ in range(n)]
    texts = [" ".join(r.choice(words[x], int(r.integers(3, 40)))) + "." for x in lang]
    return texts, lang


def test_language_id(spark):
    texts, lang = many(spark)
    texts[:6] = [None, "", "123 !?", "the thing", "der schön " * 4000, "the thing"]
    lang[:6] = ["aa", "aa", "bb", None, "bb", "aa"]
    df = docs(spark, texts, lang)
    got = {r.doc_id: r for r in langid.report(spark, df).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    held = [k for k in got if got[k].held_out and lang[k] and k > 5]
    assert np.mean([got[k].lang_pred == lang[k] for k in held]) > 0.97
    assert [(got[k].lang_pred, got[k].score) for k in (0, 1, 2)] == [("und", 0.0)] * 3
    assert got[3].lang_pred == got[5].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep(spark, df.withColumn("score", F.lit(9)))
    assert kept.columns == [*df.columns, "score"] and not {0, 1, 2} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in langid.report(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.report(spark, df.limit(0)).count() == 0


def test_character_n_grams_against_plain_counting():
    text = "Ab c! ünï  日本 x"
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {' '.join(letters.split())} "
    want = Counter()
    for n in range(1, langid.ORDERS + 1):
        for k in range(len(padded) - n + 1):
            h = 0
            for j, c in enumerate(padded[k : k + n]):
                h = ord(c) if not j else (h * 0x01000193 + ord(c)) % 2**32
            h = ((h + ((n - 1) * 0x9E3779B9)) * 0x85EBCA6B) % 2**32
            want[h >> (32 - langid.BITS)] += 1
    got = langid.counts(text)
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want)


def test_sparse_steps_equal_plain_ftrl():
    """Every weight by itself, over all features, as the published recurrence has it."""
    r = np.random.default_rng(0)
    features, classes = 9, 3
    rows = [(np.sort(r.choice(features - 1, 3, replace=False)), r.random(3)) for _ in range(24)]
    y = r.integers(0, classes, 24)
    leader = langid.Ftrl(features, classes)
    z, s = [[0.0] * classes for _ in range(features)], [[0.0] * classes for _ in range(features)]

    def weight(f, c):
        if abs(z[f][c]) <= langid.L1:
            return 0.0
        sign = 1 if z[f][c] > 0 else -1
        return -(z[f][c] - sign * langid.L1) / ((langid.BETA * 0.01 + s[f][c] ** 0.5) / langid.ALPHA + langid.L2)

    for lo in range(0, 24, 8):
        cost = r.random(8)
        leader.step(*langid.joined(rows[lo : lo + 8], features - 1), y[lo : lo + 8], cost)
        w = [[weight(f, c) for c in range(classes)] for f in range(features)]
        g = [[0.0] * classes for _ in range(features)]
        for k in range(8):
            x = {features - 1: 1.0} | dict(zip(rows[lo + k][0].tolist(), rows[lo + k][1].tolist(), strict=True))
            e = [np.exp(sum(v * w[f][c] for f, v in x.items())) for c in range(classes)]
            for c in range(classes):
                for f, v in x.items():
                    g[f][c] += cost[k] * v * (e[c] / sum(e) - (c == y[lo + k]))
        for f in range(features):
            for c in range(classes):
                z[f][c] += g[f][c] - ((s[f][c] + g[f][c] ** 2) ** 0.5 - s[f][c] ** 0.5) / langid.ALPHA * w[f][c]
                s[f][c] += g[f][c] ** 2
    assert leader.weights(np.arange(features)) == pytest.approx(np.array([[weight(f, c) for c in range(classes)] for f in range(features)]))


def test_language_model(spark):
    texts, _ = many(spark, 300)
    texts[:4] = [None, "", "unseen words only", "The THE the"]
    got = {r.doc_id: r for r in lm.score(spark, docs(spark, texts)).collect()}
    held = {k for k in got if zlib.crc32(str(k).encode()) % 7 == 2}
    assert {k for k in got if got[k].held_out} == held
    counts = Counter(w for k, t in enumerate(texts) if k not in held for w in [*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        words = [*(t or "").lower().split(), None]
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert got[k].base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert np.isfinite(got[k].score) and got[k].score <= 0
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held)
    assert lm.score(spark, docs(spark, texts).limit(0)).count() == 0


def test_language_model_is_a_distribution():
    tables = lm.Tables({b"a": 0, b"b": 1, b"": 2}, np.zeros(3), np.full(lm._OUTPUTS, -np.log10(lm._OUTPUTS / 4)), np.arange(lm._OUTPUTS) % 4)
    r = np.random.default_rng(0)
    w, b = r.normal(size=(lm.ROWS, 4)).astype(np.float32), r.normal(size=4).astype(np.float32)
    seq = np.array([lm._BOS, lm._BOS, 0, 1], np.uint16)
    p = 0.0
    for o in range(lm._OUTPUTS):
        p += 10 ** lm.log_probabilities(w, b, tables.fixed, tables.classes, 3, np.append(seq, np.uint16(o)), np.array([4]))[0]
    assert p == pytest.approx(1, abs=1e-4)


def test_history_weights_are_a_distribution_and_plain_gradient_steps():
    r = np.random.default_rng(1)
    outputs, classes = 12, np.arange(12) % 3
    share = r.random(12)
    share /= np.bincount(classes, weights=share)[classes]
    h, o, learn = r.integers(0, 9, 400).astype(np.uint32), r.integers(0, outputs, 400), r.random(400) < 0.8
    h[:2], learn[:2], h[2:4], learn[2] = (90, 91), (True, False), 92, True
    learn[3] = False  # histories 90 and 92 are seen once, 91 never: no weights
    every = np.unique(h)
    hs, os = np.concatenate((h, np.repeat(every, outputs))), np.concatenate((o, np.tile(np.arange(outputs), len(every))))
    got = lm.fit_shard(hs, os, np.concatenate((learn, np.zeros(len(every) * outputs, bool))), share, classes)[400:].reshape(len(every), outputs)
    for k, x in enumerate(every):
        n = np.bincount(o[(h == x) & learn], minlength=outputs)
        want = np.zeros(outputs)
        for c in range(3) if n.sum() > 1 else ():
            own = [i for i in range(outputs) if classes[i] == c]
            w, squares = dict.fromkeys((i for i in own if n[i]), 0.0), {}
            for _ in range(lm.STEPS):
                z = sum(share[i] * np.exp(w.get(i, 0.0)) for i in own)
                for i, value in list(w.items()):
                    g = n[i] - lm.L1 - n[own].sum() * share[i] * np.exp(value) / z
                    squares[i] = squares.get(i, 1e-6) + g * g
                    w[i] = max(value + lm.STEP * g / np.sqrt(squares[i]), 0.0)
            z = sum(share[i] * np.exp(w.get(i, 0.0)) for i in own)
            want[own] = [(w.get(i, 0.0) - np.log(z)) / np.log(10) for i in own]
        assert got[k] == pytest.approx(want, abs=1e-6)
        assert np.bincount(classes, weights=share * 10 ** got[k]) == pytest.approx([1] * 3)
    assert len(lm.fit_shard(*(np.zeros(0, np.int64),) * 2, np.zeros(0, bool), share, classes)) == 0


def test_repeated_texts_score_apart_and_shards_change_little(spark, monkeypatch):
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 400, 60)) for _ in range(120)]
    texts += texts[:20]
    df = docs(spark, texts)
    rows = {x.doc_id: x for x in lm.score(spark, df).collect()}
    twice = [k for k in range(20) if not rows[k].held_out and not rows[k + 120].held_out]
    once = [k for k in range(20, 120) if not rows[k].held_out]
    mean = lambda ks: np.mean([(rows[k].score - rows[k].base_score) / rows[k].n_tokens for k in ks])
    assert mean(twice) > mean(once) + 0.5
    monkeypatch.setattr(lm, "SHARD", 100)  # many shards, the marks' history salted
    monkeypatch.setattr(lm, "DEALT", (7, 300))
    cut = {x.doc_id: x for x in lm.score(spark, df).collect()}
    assert all(cut[k].score == pytest.approx(rows[k].score, abs=6) for k in rows)


def test_arrays_of_many_tasks_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)

    def emit(batches):
        for b in batches:
            yield lm._blocks(np.full((4, 5), float(b.column(0)[0].as_py())), 1)

    df = spark.range(9).repartition(9, "id").mapInArrow(emit, lm._BLOCK)
    assert lm._gather(df, (4, 5), average=False) is not None
    many = spark.range(0, 7, 1, 7).mapInArrow(emit, lm._BLOCK)
    assert (lm._gather(many, (4, 5), average=False) == 21).all() and (lm._gather(many, (4, 5), average=True) == 3).all()


def plain_kneser(texts):
    """P(w | u v) of interpolated modified Kneser-Ney, written out from the raw counts."""
    n3 = Counter()
    for t in texts:
        x = ["<s>", "<s>", *t.lower().split(), ""]
        n3.update(zip(x, x[1:], x[2:], strict=False))
    n2 = Counter((v, w) for _, v, w in n3)  # distinct words before the bigram
    n1 = Counter(w for _, w in n2)

    def cuts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2])
        raw = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        d = [0.0, *(min(max(x, 0.1), k - 0.05) for k, x in zip((1, 2, 3), raw, strict=True))]
        return lambda c: d[min(c, 3)]

    d3, d2, known = cuts(n3), cuts(n2), len(n1)

    def p(u, v, w):
        low = (max(n1[w] - 0.75, 0) + 0.75 * known / (known + 1)) / sum(n1.values())
        total = sum(c for (a, _), c in n2.items() if a == v)
        if total:
            low = (max(n2[v, w] - d2(n2[v, w]), 0) + low * sum(d2(c) for (a, _), c in n2.items() if a == v)) / total
        total = sum(c for (a, b, _), c in n3.items() if (a, b) == (u, v))
        if total:
            low = (max(n3[u, v, w] - d3(n3[u, v, w]), 0) + low * sum(d3(c) for (a, b, _), c in n3.items() if (a, b) == (u, v))) / total
        return low

    return p, set(n1)


def test_kneser_ney_equals_the_plain_model_and_sums_to_one(spark):
    r = np.random.default_rng(0)
    texts = [" ".join(f"w{int(x) % 20}" for x in r.zipf(1.5, 12)) for _ in range(60)]
    p, known = plain_kneser(texts)
    for u, v in (("<s>", "<s>"), ("w1", "w1"), ("w1", "never"), ("w2", "w1")):
        assert sum(p(u, v, w) for w in [*known, "unknown"]) == pytest.approx(1)
    made, facts = kneser.tables(spark, kneser.trigrams(spark.createDataFrame([(t,) for t in texts], "t string")))
    scorer = kneser.Scorer(facts, *(list(kneser.shards(made[c], 3)) for c in ("tri", "pair", "uni")))
    new = ["w1 w1 w2 w3 unknown", None, "w5", "W1  w1\tw2", *texts[:20]]
    got, n = scorer.score(new)
    for t, s, m in zip(new, got, n, strict=True):
        x = ["<s>", "<s>", *(t or "").lower().split(), ""]
        assert m == len(x) - 2 and s == pytest.approx(sum(np.log10(p(*x[i : i + 3])) for i in range(m)), rel=1e-5)


def test_chained_hash_is_that_of_the_jvm(spark):
    x = np.random.default_rng(0).integers(-(2**62), 2**62, (50, 3))
    want = [r.h for r in spark.createDataFrame(x.tolist(), "a long, b long, c long").select(F.xxhash64("a", "b", "c").alias("h")).collect()]
    assert kneser.chain(kneser.chain(kneser.chain(np.uint64(42), x[:, 0].copy()), x[:, 1].copy()), x[:, 2].copy()).view(np.int64).tolist() == want


def test_quality_classifier(spark):
    texts, lang = many(spark, 900)
    r = np.random.default_rng(4)
    for k in range(0, 900, 10):
        texts[k] = " ".join("".join(r.choice(list("qxzkjv"), 8)) for _ in range(30))
    texts[1], lang[2] = None, None
    labels = spark.createDataFrame([(k, int(k % 10 != 0), 0) for k in range(900)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts, lang)
    got = {x.doc_id: x for x in kneser.report(spark, df, labels).collect()}
    assert len(got) == 900 and np.mean([got[k].kept for k in got if k % 10]) > 0.98
    assert not any(got[k].kept for k in got if k % 10 == 0)
    assert kneser.keep(spark, df.withColumn("threshold", F.lit(1)), labels).columns == [*df.columns, "threshold"]
    assert all(x.kept and x.perplexity is None for x in kneser.report(spark, df, labels.limit(0)).collect())
    assert kneser.report(spark, df.limit(0), labels).count() == 0


def test_quality_thresholds_cover_all_trusted_documents_and_rare_languages(spark):
    texts, _ = many(spark, 1200)
    lang = ["rare" if k % 100 == 0 else "common" for k in range(1200)]
    df = docs(spark, texts, lang)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1200)], "doc_id long, quality int, toxic int")
    good = kneser.trusted(spark, df, labels, bound=40)
    n = {(r.l, r.train): r["count"] for r in good.groupBy("l", "train").count().collect()}
    assert sum(n.values()) == 1200 and 0 < n["rare", True] < 12 and n["common", True] < 80
    _, limits, _ = kneser.fit(spark, df, labels, bound=40)
    assert {name: m for name, band, _, m in limits if name != kneser.ANY and band == kneser.ANY} == {"rare": n["rare", False], "common": n["common", False]}


def test_quality_training_rates():
    few = 10**12
    assert kneser.rates({"a": (30, 0), "b": (70, 0)}, 4000, few) == {"a": 0.5, "b": 0.5}
    sizes = {"a": (1_000_000, 9_000_000), "b": (200, 1000), None: (40, 0)}
    got = kneser.rates(sizes, 4000, few)
    assert got["b"] == got[None] == 0.5 and sum(sizes[k][0] * got[k] for k in sizes) <= 4000
    assert sum(c * kneser.rates(sizes, 4000, 500)[k] for k, (_, c) in sizes.items()) <= 501
    got = kneser.rates({k: (10_000, 0) for k in range(1000)}, 4000, few)
    assert sum(10_000 * x for x in got.values()) <= 4000


def test_quality_model_over_its_rows_is_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(kneser, "ROWS", 400)
    texts, lang = many(spark, 400)
    texts[0] = "der und " * 40_000  # too long to train on, judged all the same
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    shared, _, measured = kneser.fit(spark, docs(spark, texts, lang), labels, bound=200)
    assert sum(shared.facts.sizes.values()) <= 400
    got = {r.id: r for r in measured.collect()}
    assert len(got) == 400 and got[0].n == 80_001 and all(r.x > 0 for r in got.values())


def test_every_labelled_language_is_learned(spark):
    names = [f"m{k:03d}" for k in range(400)]
    model = langid.fit(spark, docs(spark, [f"{n} text" for n in names], names))
    assert len(model.languages) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(400)) > 256
    assert langid.per_language([1000] * 4) == 600 and langid.per_language([1000] * 100) == 240 and langid.per_language([1000] * 3000) == 30
    assert langid.per_language([5, 5]) == 600  # all of them


def test_rare_pairs_of_common_words_stay_whole(spark, monkeypatch):
    """Salts go by a history's own tokens: a pair of two very frequent words that seldom meet is learned from all of its tokens."""
    from types import SimpleNamespace

    monkeypatch.setattr(lm, "SHARD", 50)
    seq = [0, 2] * 60 + [1, 2] * 60 + [0, 1, 2] * 5 + [3]  # 0 and 1 are frequent; 0 1 is a rare history, 0 2 a frequent one
    rows = [(k, np.array(seq, np.uint16).tobytes()) for k in range(2)]
    coded = spark.createDataFrame(rows, "uid long, ids binary")
    count = np.zeros(lm._OUTPUTS, np.int64)
    count[:4] = 2 * np.bincount(seq, minlength=4)
    hot, salts = lm._hot(coded, SimpleNamespace(value=(None, None, None, count, 2)))
    plain = {}
    for raw in rows:
        ids, at, _ = lm.padded([raw[1]])
        h = lm.histories(ids)[0][at]
        for x in h.tolist():
            plain[x] = plain.get(x, 0) + 1
    want = {h: -(-n // 50) for h, n in plain.items() if n > 50}
    assert dict(zip(hot.tolist(), salts.tolist(), strict=True)) == want and 1 < len(want) < len(plain)
    assert (np.diff(hot.astype(object)) > 0).all()
    rare = [h for h, n in plain.items() if n <= 50]
    assert rare and not set(rare) & set(want)
    assert len(lm._hot(coded, SimpleNamespace(value=(None, None, None, count // 10, 2)))[0]) == 0


def test_lines_of_a_very_long_text(spark):
    """A text of 60,000 lines among short ones: only repeats of lines on ten sites go, and the first of them stays."""
    shared = "all rights reserved"
    long = "\n".join(shared if k % 1000 == 0 else f"own line {k}" for k in range(60_000))
    texts = [f"{shared}\nshort {k}" for k in range(12)] + [long]
    df = docs(spark, texts, source=[f"s{k}" for k in range(13)])
    got = {x.doc_id: x for x in lines.report(spark, df).collect()}
    assert [got[k].n_removed for k in range(13)] == [0] + [1] * 11 + [60] and got[12].n_lines == 60_000
    assert got[12].clean_md5 == hashlib.md5("\n".join(x for x in long.split("\n") if x != shared).encode()).hexdigest()  # noqa: S324


def test_repeated_rows_are_judged_alike(spark):
    """Copies of a row, under its own id or another, get one language and score, and one perplexity and verdict."""
    texts, lang = many(spark, 300)
    texts, lang = texts + texts[:40], lang + lang[:40]
    df = docs(spark, texts, lang)
    twice = df.unionByName(df.where("doc_id < 30"))
    rows = langid.report(spark, twice).collect()
    assert len(rows) == 370
    seen = {}
    for x in rows:
        assert seen.setdefault(texts[x.doc_id], (x.lang_pred, x.score)) == (x.lang_pred, x.score)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    rows = kneser.report(spark, twice, labels).collect()
    assert len(rows) == 370
    seen = {}
    for x in rows:
        assert seen.setdefault((texts[x.doc_id], lang[x.doc_id]), (x.perplexity, x.kept)) == (x.perplexity, x.kept)


def test_quality_counts_every_trusted_document_of_its_half(spark, monkeypatch):
    """More trusted text than the bounds of old rows and long texts would let in; the tables come in many shards, the texts in many slabs."""
    for name, value in (("ROWS", 100), ("LONGEST", 50), ("SHARD_ROWS", 300), ("SLAB", 2_000)):
        monkeypatch.setattr(kneser, name, value)
    texts, lang = many(spark, 300)
    texts[0], texts[200:250] = "der und " * 2_000, texts[150:200]
    df = docs(spark, texts, lang)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    half = {r.g for r in kneser.trusted(spark, df, labels).where("train").collect()}
    assert 120 < len(half) < 180
    assert {k for k in range(300) if texts[k] in {texts[j] for j in half}} == half
    p, _ = plain_kneser([texts[k] for k in sorted(half)])
    shared, limits, measured = kneser.fit(spark, df, labels)
    assert sum(shared.facts.sizes.values()) > 100 and len(shared.parts["tri"]) > 1
    assert sum(m for name, band, _, m in limits if name == kneser.ANY and band == kneser.ANY) == 300 - len(half)
    got = {r.id: r for r in measured.collect()}
    for k in (0, 1, 7, min(half), 299):
        x = ["<s>", "<s>", *texts[k].lower().split(), ""]
        grams = Counter(zip(x, x[1:], x[2:], strict=False))
        assert got[k].n == len(x) - 2 and got[k].x == pytest.approx(-sum(c * np.log10(p(*g)) for g, c in grams.items()) / (len(x) - 2), rel=1e-5)


def test_quality_counts_stay_in_tasks_and_frequent_words_are_dealt(spark, monkeypatch):
    """No counts of trigrams in broadcasts, which every executor's disk would hold; words over several tasks give the plain model's sums."""
    monkeypatch.setattr(kneser, "TASK_TOKENS", 40)
    monkeypatch.setattr(kneser, "HOT", 20)
    texts, lang = many(spark, 200)
    texts[3], texts[4], texts[5], texts[6:9] = None, " \n", "Never0 seen1 NEVER0 seen1 " * 40, texts[9:12]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts, lang)
    half = {r.g for r in kneser.trusted(spark, df, labels).where("train").collect()}
    p, _ = plain_kneser([texts[k] for k in sorted(half) if (texts[k] or "").split()])
    shared, _, measured = kneser.fit(spark, df, labels)
    assert not any(hasattr(b, "value") for b in shared.parts["tri"])
    got = {r.id: r for r in measured.collect()}
    assert len(got) == 200
    for k in (*range(3, 12), 60, 150, 199):
        x = ["<s>", "<s>", *(texts[k] or "").lower().split(), ""]
        grams = Counter(zip(x, x[1:], x[2:], strict=False))
        assert got[k].n == len(x) - 2 and got[k].x == pytest.approx(-sum(c * np.log10(p(*g)) for g, c in grams.items()) / (len(x) - 2), rel=1e-5)


def test_a_task_unpacks_one_bucket_of_tokens_at_a_time(monkeypatch):
    """A task's memory stays under what all its tokens would take unpacked, and its sums are the same in any order."""
    import tracemalloc

    monkeypatch.setattr(kneser, "TASK_TOKENS", 60_000)
    r, n = np.random.default_rng(3), 30_000
    facts = kneser.Facts(np.array([0.0, 0.5, 0.7, 0.9]), np.array([0.0, 0.5, 0.7, 0.9]), 100, 100)
    table = r.integers(1, 50, (3, 1_001)).astype(np.float32)
    texts, tokens = np.arange(2_000), [(40 * b + r.integers(1, 40, n), r.integers(1, 900, n), r.integers(1, 900, n) << 1 | (r.random(n) < 0.2), r.integers(0, 2_000, n)) for b in range(20)]
    rows = [x for b, (v, w, m, h) in enumerate(tokens) for x in kneser.packed([np.full(n, b), v << 32 | w, m, h])]
    rows += kneser.packed([texts * 0, texts * 0 + kneser.HASH, texts * 7 - 99, texts])
    got = []
    for order in (rows, rows[::-1]):
        tracemalloc.start()
        sums = list(kneser.task_sums(iter(order), table, np.zeros(0, np.int64), facts))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 3 * 8 * n * len(tokens)
        got.append({h: s for x in kneser.gathered(iter(sums)) for h, s in zip(*(c.to_pylist() for c in x.columns), strict=True)})
    assert got[0] == got[1] and sorted(got[0]) == (texts * 7 - 99).tolist() and max(got[0].values()) < 0


def test_words_of_a_batch_are_those_of_each_text():
    import pyarrow as pa

    texts = ["a B\tc", None, "", " lead", "trail ", "x", "x", "Ä ä É é", "b\x1cc\x85 a", "c b a"]
    for column in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        x, n = kneser.tokens(column)
        assert n.tolist() == [len(kneser.words_of(t)) for t in texts]
        words, at = {}, 0
        for t in texts:
            own = [*kneser.words_of(t), b""]
            assert x[at : at + 2].tolist() == [kneser.START] * 2
            for w, key in zip(own, x[at + 2 : at + 2 + len(own)].tolist(), strict=True):
                assert words.setdefault(w, key) == key
            at += len(own) + 2
        assert at == len(x) and len(set(words.values())) == len(words)
