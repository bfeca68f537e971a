"""Quality rules as a bitmask ledger, in DataFrame operations only.

``ledger`` measures every whole text once and stores one failure bit for each rule
beside the measurements. A policy is a named, versioned mask of rules: applying it,
or taking one of its rules out (an ablation), only reads the bits.

Defined results: a null text counts as empty (no words: it fails ``few_words``); very
long texts are measured whole; a value at its limit passes; repeated rows and ids get a row each; an empty table gives an empty ledger; extra
columns are carried along, and ledger columns that clash with them are not added
twice (the ledger selects the id and its own columns only).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import SPACE, fresh, stage

SYMBOLS = "#*$%&|<>"
#: Rules in the order of their bits; a bit once given to a rule stays with it.
ORDER = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting")
BASE = ("few_words", "repeated_words")
#: Versioned policies. Results name the version; a change of rules is a new version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base/1": BASE,
    "web/1": (*BASE, "symbols", "repeated_lines", "word_length", "shouting"),
}
CURRENT = "web/1"


def rules() -> dict[str, Column]:
    """Failure conditions over the measurements, by name."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "shouting": 100 * c("n_upper") > 40 * c("word_chars"),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the measurements of every text, in one narrow stage.

    Three-word windows are compared by their 64-bit hashes within one text. Sorting
    happens only in texts in which a window occurs twice.
    """
    kept = [F.col(c) for c in (docs.columns if keep is None else keep)]
    names = fresh(docs, "t_", "w_", "h_", "s_", "p_", *(f"m_{m}" for m in MEASURES))
    t, w, h, s, p = names[:5]
    m = dict(zip(MEASURES, names[5:], strict=True))
    words = F.array_remove(F.split(F.translate(F.col(t), SPACE[1:], " " * (len(SPACE) - 1)), " ", -1), "")
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    length = lambda drop: F.length(F.col(t)) - F.length(F.translate(F.col(t), drop, ""))
    one = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(t))
    two = one.withColumns({w: words, "l_" + t: lines})
    n = F.size(w)
    hashes = F.when(
        n >= 3, F.transform(F.slice(F.col(w), F.lit(1), n - 2), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    three = two.select(
        *kept,
        F.col(t),
        n.cast("long").alias(m["n_words"]),
        hashes.alias(h),
        F.size("l_" + t).cast("long").alias(m["n_lines"]),
        (F.size("l_" + t) - F.size(F.array_distinct("l_" + t))).cast("long").alias(m["n_dup_lines"]),
    )
    four = three.withColumn(
        s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    )
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(F.col(s), k - 1)["h"] == x["h"])) | F.coalesce(F.get(F.col(s), k + 1)["h"] == x["h"], F.lit(False)))
    five = four.withColumn(p, F.when(F.col(s).isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        p, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"]
    )
    return five.select(
        *kept,
        # not deterministic for the optimiser, so that no filter moves below and repeats the nested expressions
        (F.col(m["n_words"]) + F.monotonically_increasing_id() * 0).alias("n_words"),
        (F.length(F.translate(F.col(t), SPACE, ""))).cast("long").alias("word_chars"),
        length(SYMBOLS).cast("long").alias("n_symbols"),
        F.col(m["n_dup_lines"]).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col(m["n_lines"]).alias("n_lines"),
        length("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
    )


def bits() -> Column:
    """Bit k is set where rule k fails."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(cond, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, cond in enumerate(map(rules().get, ORDER))))


def mask(policy: str, without: str | None = None) -> int:
    return sum(1 << ORDER.index(r) for r in POLICIES[policy] if r != without)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits``."""
    return measure(docs, text, [doc_id]).withColumn("fail_bits", bits())


def passes(policy: str = CURRENT, without: str | None = None, column: str = "fail_bits") -> Column:
    return F.col(column).bitwiseAND(F.lit(mask(policy, without)).cast("long")) == 0


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: rows that fail it, that only it removes, and that stay without it.

    One pass over the ledger, one row for each rule.
    """
    full = mask(policy)
    held = F.col("fail_bits").bitwiseAND(F.lit(full).cast("long"))
    sums = [F.count(F.lit(1)).alias("n_rows"), F.count_if(held == 0).alias("n_kept")]
    for rule in POLICIES[policy]:
        bit = 1 << ORDER.index(rule)
        sums += [
            F.count_if(held.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"{rule}_failed"),
            F.count_if(held == bit).alias(f"{rule}_only"),
        ]
    row = book.agg(*sums)
    each = F.explode(
        F.array(
            *(
                F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_only").alias("n_only"), (F.col("n_kept") + F.col(f"{r}_only")).alias("n_kept_without"))
                for r in POLICIES[policy]
            )
        )
    )
    return row.select("n_rows", "n_kept", each.alias("e")).select(F.lit(policy).alias("policy"), "n_rows", "n_kept", "e.*")


def ablation_report(spark: SparkSession, docs: DataFrame, policies: Sequence[str] = ("base/1", "web/1")) -> DataFrame:
    """Ablations of several policies from one ledger, staged so that texts are measured once."""
    book = stage(spark, ledger(docs).select("fail_bits"), "ledger")
    return reduce(lambda a, b: a.unionByName(b), (ablations(book, p) for p in policies))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    book = ledger(docs)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base/1")).alias("base_failed"), passes().alias("kept"), "n_lines", "n_upper", "fail_bits", F.lit(CURRENT).alias("policy"),
    )


def keep(spark: SparkSession, docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their columns."""
    names = fresh(docs, *(f"q_{k}" for k in range(len(docs.columns))))
    renamed = docs.select(*(F.col(c).alias(x) for c, x in zip(docs.columns, names, strict=True)))
    judged = measure(renamed, names[docs.columns.index(text)]).where((bits().bitwiseAND(F.lit(mask(policy)).cast("long"))) == 0)
    return judged.select(*(F.col(x).alias(c) for c, x in zip(docs.columns, names, strict=True)))


#: The same results in DuckDB.
SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 cut AS (SELECT *, list_filter(string_split(translate(t, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS w,
   list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) > 0) AS l FROM base),
 won AS (SELECT *, CASE WHEN len(w) < 3 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g FROM cut),
 twice AS (SELECT doc_id, row_no, count(DISTINCT pos) AS n FROM (
   SELECT doc_id, row_no, unnest([i, i + 1, i + 2]) AS pos FROM (
     SELECT doc_id, row_no, i, count(*) OVER (PARTITION BY row_no, x) AS c FROM (
       SELECT doc_id, row_no, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM (SELECT *, row_number() OVER () AS row_no FROM won))) WHERE c > 1) GROUP BY ALL),
 m AS (SELECT won.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) AS BIGINT) AS word_chars,
   CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(twice.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
   CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper
   FROM (SELECT *, row_number() OVER () AS row_no FROM won) won LEFT JOIN twice USING (row_no)),
 f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
   + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 32 * (100 * n_upper > 40 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
 n_lines, n_upper, fail_bits, 'web/1' AS policy FROM f
"""

_HELD = {p: f"(fail_bits & {mask(p)})" for p in ("base/1", "web/1")}
#: Ablations of both policies in DuckDB, from the rows of ``SQL``.
ABLATIONS_SQL = f"WITH r AS ({SQL}) " + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, count(*) AS n_rows, count(*) FILTER ({_HELD[p]} = 0) AS n_kept, '{rule}' AS rule, count(*) FILTER ((fail_bits & {1 << ORDER.index(rule)}) <> 0) AS n_failed, "
    f"count(*) FILTER ({_HELD[p]} = {1 << ORDER.index(rule)}) AS n_only, count(*) FILTER (({_HELD[p]} & ~{1 << ORDER.index(rule)}) = 0) AS n_kept_without FROM r"
    for p in ("base/1", "web/1")
    for rule in POLICIES[p]
)
