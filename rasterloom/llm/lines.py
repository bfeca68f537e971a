"""Cross-site line dedup by the spread of lines over distinct sites.

DataFrame operations only. Lines are known by two independent 64-bit hashes of their
trimmed text, so that lines of a very large corpus don't meet by chance. Counts prune
lines that cannot reach ``min_sites``; the others get a HyperLogLog sketch of their
sites, merged by aggregation. Where the estimate is near the threshold the distinct
sites are counted exactly. Lines that reach it are boilerplate: their first occurrence
(smallest id, then position) stays, so that no content is lost altogether, and all
others go. Aggregates are staged before they are joined with the occurrences, and the
occurrences of a very frequent line are salted.

Defined results: blank lines are never removed; a null site is no site; a null text
stays null and counts as no lines; very long texts are split whole; of equal lines the
smallest (id, row, position) is the first; rows repeated with the same id and text are
treated alike; documents stay even if no line of theirs does (their text is empty); an
empty table gives an empty one; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import SPACE, fresh, join_split, stage

MIN_SITES = 10
#: Sketch size 2**LG_K; estimates within BAND of the threshold are counted exactly.
LG_K = 10
BAND = 0.25


def line_keys(line: Column) -> list[Column]:
    """Two hashes of a line, independent of each other."""
    line = F.btrim(line, F.lit(SPACE))
    return [F.xxhash64(line).alias("key"), F.xxhash64(F.lit(1), line).alias("key2")]


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def exploded(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """row, id, site, pos and the keys of every line with a word."""
    lines = docs.select(_row_key(doc_id, text).alias("row"), F.col(doc_id).alias("id"), F.col(site).alias("site"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return lines.where(F.length(F.btrim("line", F.lit(SPACE))) > 0).select("row", "id", "site", "pos", *line_keys(F.col("line")))


_KEYS = ["key", "key2"]
_OTHERS = ["k", "k2"]


def boilerplate(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(occurrences of lines seen often enough, boilerplate(k, k2, sites, first, n))."""
    as_others = [F.col(a).alias(b) for a, b in zip(_KEYS, _OTHERS, strict=True)]
    every = exploded(docs, doc_id, text, site)
    often = every.groupBy(*as_others).agg(F.count("site").alias("with_site"), F.count(F.lit(1)).alias("n")).where(F.col("with_site") >= min_sites)
    often = stage(spark, often.drop("with_site"), "often")
    # stays of the size of what repeats: lines seen fewer than min_sites times are gone
    seen = stage(spark, join_split(every, _KEYS, often, _OTHERS, "n", ["row", "pos"]).select(*every.columns), "lines")
    spread = seen.groupBy(*as_others).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"), F.min(F.struct("id", "row", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    spread = stage(spark, spread.where(F.col("about") >= min_sites * (1 - BAND)), "spread")
    near = spread.where(F.col("about") <= min_sites * (1 + BAND)).select(*_OTHERS, "n")
    pairs = join_split(seen, _KEYS, near, _OTHERS, "n", ["row", "pos"]).where("site IS NOT NULL").select(*_KEYS, "site").distinct()
    exact = pairs.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("exact"))
    joined = spread.join(exact, (F.col("k") == F.col("key")) & (F.col("k2") == F.col("key2")), "left")
    sites = F.coalesce("exact", "about")
    return seen, stage(spark, joined.where(sites >= min_sites).select(*_OTHERS, sites.alias("sites"), "first", "n"), "wide")


def remove(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, report: bool = False) -> DataFrame:
    """``docs`` with the repeats of boilerplate lines taken out of ``text``.

    ``report`` adds n_lines and n_removed.
    """
    seen, wide = boilerplate(spark, docs, doc_id, text, site, min_sites)
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))
    out = join_split(seen, _KEYS, wide, _OTHERS, "n", ["row", "pos"]).where(~first)
    key, key_id, bad, own = fresh(docs, "row", "row_id", "bad", "own")
    out = out.groupBy(F.col("row").alias(key), F.col("id").alias(key_id)).agg(F.collect_set("pos").alias(bad))
    keyed = docs.select("*", _row_key(doc_id, text).alias(own))
    joined = keyed.join(out, (keyed[own] == out[key]) & keyed[doc_id].eqNullSafe(out[key_id]), "left")
    split = F.split(F.col(text), "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(bad))
    # the lines are bound once by the outer lambda, not split again for each position
    clean = F.transform(F.array(split), lambda lines: F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    columns = [F.when(F.col(bad).isNull(), F.col(text)).otherwise(F.get(clean, F.lit(0))).alias(c) if c == text else F.col(c) for c in docs.columns]
    if report:
        words = F.filter(split, lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
        columns += [F.coalesce(F.size(words), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(bad), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, and length and MD5 of the cleaned text."""
    done = remove(spark, docs.select("doc_id", "text", "source"), report=True)
    return done.select(
        "doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("clean_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("clean_md5")
    )


#: The same results in DuckDB, for tables without repeated rows.
SQL = rf"""
WITH sp AS (SELECT ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13) AS s),
 d AS (SELECT doc_id, source, text, row_number() OVER () AS r, string_split(text, chr(10)) AS l FROM documents),
 e AS (SELECT r, doc_id, source, pos, trim(l[pos], s) AS line, l[pos] AS raw FROM (SELECT *, unnest(range(1, len(l) + 1)) AS pos FROM d), sp),
 w AS (SELECT line, min((doc_id, r, pos)) AS f FROM e WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
 g AS (SELECT e.*, w.line IS NOT NULL AND (doc_id, r, pos) <> w.f AS bad FROM e LEFT JOIN w USING (line)),
 t AS (SELECT r, CAST(count(*) FILTER (line <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (bad) AS BIGINT) AS n_removed,
   coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS clean FROM g GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(length(coalesce(clean, '')) AS BIGINT) AS clean_chars, md5(coalesce(clean, '')) AS clean_md5
FROM d LEFT JOIN t USING (r)
"""
