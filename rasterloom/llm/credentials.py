"""Secret scans that link the parts of a credential, in DataFrame operations only.

One pass over every whole text finds matches of all kinds (``KINDS``); a match is known by
the characters since the match of its kind before it and by its length. Matches become
rows and meet by document in one shuffle: running sums give their places, and the number of
blank lines before a match gives its scope (a block of lines without a blank one). No
text is shuffled.

Strong kinds are reported as they are. Weak ones (a name given to an account, a long token of
mixed letters and digits, an address of a service) say little by themselves. They are joined with the
intervals of the other parts in their scope: each match looks at the last end before it and
the first start after it of every part, taken by ordered windows, so a scope with
many parts is swept once and no pairs are made. A weak

* token is reported where an identifier lies within ``REACH`` code points,
* name where a secret (strong or weak) does,
* address where both do.

A weak match that overlaps a stronger one (``KINDS`` in their order, names before addresses before tokens) is not reported.

Defined results: a null text counts as empty (no matches; the digest is that of no
bytes); very long texts are scanned whole (a text's matches are sorted in one task, never its
characters); matches that start together are in the order of their kinds; repeated rows and ids, null ids too, get a row each;
an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kind, pattern (the value is in the group given) and the least length of the group. RE2 reads the same patterns.
_NAMES = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ACCOUNTS = r"(?:[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee]|_?[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt](?:_?[Ii][Dd])?)"
_GIVEN = r"[\"']?\x20*[:=]\x20*[\"']?"
PATTERNS: dict[str, tuple[str, int, int]] = {
    "assign": (f"{_NAMES}{_GIVEN}([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "name": (f"{_ACCOUNTS}{_GIVEN}([A-Za-z0-9._@+-]+)", 1, 3),
    "address": (r"(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._~:@/?=&%+-]+", 0, 10),
    "token": (r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
}
#: What a text must have if it is to match: any of the literals, or a long run. Cheap to look for, and most texts lack it.
LITERALS = {"assign": (":", "="), "access": ("AKIA",), "name": (":", "="), "address": ("://",)}
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"
#: First letters, looked at before the alternatives.
FIRST = {"assign": "(?=[PpSsTtAa])", "name": "(?=[UuLlCcAa])", "address": "(?=[a-z])"}
#: All kinds in the order of ties; the first three are the base.
KINDS = tuple(PATTERNS)
BASE = KINDS[:3]
#: A token has letters of both cases and digits.
MIXED = ("[a-z]", "[A-Z]", "[0-9]")
#: A line without a visible character ends a scope.
BLANK = r"\n[\x20\t\r]*\n"
#: Code points between two parts of one credential.
REACH = 400


def _found(text: str, whole: str, kind: str) -> Column:
    """Matches of a kind (in ``whole``) in order: (kind, k, skip: code points since the last match, size, ok: it counts)."""
    pattern, group, least = PATTERNS.get(kind, (BLANK, 0, 0))
    value = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)) if group else F.col(whole)
    pieces = F.split(F.col(text), pattern, -1)  # one more than matches
    code = F.lit(KINDS.index(kind) if kind in KINDS else -1)
    zipped = F.zip_with(F.zip_with(whole, value, lambda x, v: F.struct(x.alias("x"), v.alias("v"))), pieces, lambda m, p: F.struct(m["x"].alias("x"), m["v"].alias("v"), p.alias("p")))

    def one(z: Column, i: Column) -> Column:
        ok = F.length(z["v"]) >= least
        if kind == "token":
            ok = reduce(lambda a, b: a & b, (z["x"].rlike(m) for m in MIXED), ok)
        return F.struct(code.alias("kind"), i.alias("k"), F.length(z["p"]).cast("long").alias("skip"), F.length(z["x"]).cast("long").alias("size"), ok.alias("ok"))

    return F.when(F.size(whole) > 0, F.transform(F.slice(zipped, F.lit(1), F.size(whole)), one)).otherwise(F.array().cast(MATCHES))


MATCHES = "array<struct<kind:int,k:int,skip:bigint,size:bigint,ok:boolean>>"


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, id, kind, start, end, scope): the matches that count, by row of ``docs``, and one of a null kind for each row."""
    one = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    one = one.withColumn("run", F.col("t").rlike(RUN))
    every, none = (*KINDS, "blank"), F.array().cast("array<string>")

    def whole(kind: str) -> Column:
        may = reduce(lambda a, b: a | b, (F.contains(F.col("t"), F.lit(x)) for x in LITERALS[kind])) if kind in LITERALS else F.col("run")
        return F.when(may, F.regexp_extract_all("t", F.lit(FIRST.get(kind, "") + PATTERNS[kind][0]), F.lit(0))).otherwise(none)

    two = one.select("uid", "id", "t", *(whole(k).alias(k) for k in KINDS))
    parts = F.size("name") + F.size("token") + F.size("access") + F.size("assign") + F.size("hex")
    weak = F.size("name") + F.size("token") + F.size("address")
    # scopes are needed only where a weak match may find another part
    blanks = F.when((weak > 0) & (parts > 1), F.regexp_extract_all("t", F.lit(BLANK), F.lit(0))).otherwise(none)
    three = two.withColumn("blank", blanks)
    head = F.array(F.lit(None)).cast(MATCHES)  # a row of its own for every document
    rows = three.select("uid", "id", F.explode(F.concat(head, *(_found("t", k, k) for k in every))).alias("m")).select("uid", "id", "m.*")
    # one exchange by document serves both windows and the sums after them
    rows = rows.repartition(F.col("uid"))
    before = Window.partitionBy("uid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skip") + F.col("size")).over(before)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("kind IS NULL OR ok")
    order = Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("uid", "id", "kind", "start", "end", F.count(F.when(F.col("kind") < 0, 1)).over(order).alias("scope")).where("kind IS NULL OR kind >= 0")


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*(KINDS.index(k) for k in kinds))


#: Parts of a credential and the kinds that are such a part.
PARTS = {"who": ("access", "name"), "what": ("assign", "hex", "token"), "where": ("address",)}
#: What a weak kind needs nearby.
NEEDS = {"token": ("who",), "name": ("what",), "address": ("who", "what")}
#: Stronger kinds that a weak match must not overlap.
OVER = {"name": BASE, "address": (*BASE, "name"), "token": (*BASE, "name", "address")}


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The matches that are reported: all of the base, and weak ones whose other parts are near in their scope."""
    by, before = Window.partitionBy("uid", "scope"), (Window.unboundedPreceding, -1)
    past = by.orderBy("start", "kind").rowsBetween(*before)
    future = by.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(*before)  # a frame that ends at the last row would be summed anew for each row
    hidden = F.lit(False)
    for kind, over in OVER.items():
        cover = F.coalesce(F.max(F.when(_is(*over), F.col("end"))).over(past) > F.col("start"), F.lit(False))
        cover |= F.coalesce(F.min(F.when(_is(*over), F.col("start"))).over(future) < F.col("end"), F.lit(False))
        hidden = F.when(_is(kind), cover).otherwise(hidden)
    seen = found.withColumn("hidden", hidden).where("NOT hidden")
    near = {}
    for part, kinds in PARTS.items():
        left = F.col("start") - F.max(F.when(_is(*kinds), F.col("end"))).over(past)
        right = F.min(F.when(_is(*kinds), F.col("start"))).over(future) - F.col("end")
        near[part] = F.coalesce(left <= reach, F.lit(False)) | F.coalesce(right <= reach, F.lit(False))
    keep = _is(*BASE) | F.col("kind").isNull()
    for kind, needs in NEEDS.items():
        keep |= _is(kind) & reduce(lambda a, b: a & b, (near[p] for p in needs))
    return seen.withColumn("keep", keep)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """id and ``found``: the reported (kind, start, end) of each row of ``docs`` in order, ends exclusive, in code points."""
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("at"), "end", name.alias("kind"))
    rows = linked(matches(docs, doc_id, text), reach)
    return rows.groupBy("uid").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(F.col("keep") & F.col("kind").isNotNull(), span))).alias("found")).drop("uid")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of matches of the base, a digest of their spans, all spans as text, and the number of linked weak ones."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("found", lambda s: s["at"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size(base)).cast("long").alias("n_linked"),
    )


def _sql() -> str:
    """The same results in DuckDB."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for code, kind in enumerate((*KINDS, "blank")):
        pattern, group, least = PATTERNS.get(kind, (BLANK, 0, 0))
        ok = f"length(x[2]) >= {least}" + "".join(f" AND regexp_matches(x[1], '{m}')" for m in MIXED if kind == "token")
        parts.append(
            f"SELECT r, {code if kind in KINDS else -1} AS kind, k, length(p[k]) AS skip, length(x[1]) AS size, {ok} AS ok FROM (SELECT r, k, p, [a[k], b[k]] AS x FROM (SELECT r, unnest(range(1, len(a) + 1)) AS k, a, b, p FROM "
            f"(SELECT r, regexp_extract_all(t, {quote(pattern)}, 0) AS a, regexp_extract_all(t, {quote(pattern)}, {group}) AS b, string_split_regex(t, {quote(pattern)}) AS p FROM d)))"
        )
    within = lambda kinds: f"kind IN ({', '.join(str(KINDS.index(k)) for k in kinds)})"
    cover = lambda over: f"(coalesce(max(CASE WHEN {within(over)} THEN e END) OVER past > s, false) OR coalesce(min(CASE WHEN {within(over)} THEN s END) OVER future < e, false))"
    near = lambda kinds: f"(coalesce(s - max(CASE WHEN {within(kinds)} THEN e END) OVER past <= {REACH}, false) OR coalesce(min(CASE WHEN {within(kinds)} THEN s END) OVER future - e <= {REACH}, false))"
    windows = "WINDOW past AS (PARTITION BY r, scope ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), future AS (PARTITION BY r, scope ORDER BY s, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    hidden = " ".join(f"WHEN kind = {KINDS.index(k)} THEN {cover(v)}" for k, v in OVER.items())
    needs = " OR ".join(f"(kind = {KINDS.index(k)} AND " + " AND ".join(near(PARTS[p]) for p in v) + ")" for k, v in NEEDS.items())
    joined = lambda where: f"coalesce(string_agg(['{"','".join(KINDS)}'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 m AS ({" UNION ALL ".join(parts)}),
 placed AS (SELECT r, kind, ok, size, CAST(sum(skip + size) OVER (PARTITION BY r, kind ORDER BY k) AS BIGINT) AS e FROM m),
 scoped AS (SELECT r, kind, e - size AS s, e, count(*) FILTER (kind < 0) OVER (PARTITION BY r ORDER BY e - size, kind ROWS UNBOUNDED PRECEDING) AS scope FROM placed WHERE ok),
 seen AS (SELECT * FROM (SELECT *, CASE {hidden} ELSE false END AS hidden FROM scoped WHERE kind >= 0 {windows}) WHERE NOT hidden),
 kept AS (SELECT * FROM (SELECT r, kind, s, e, (kind < {len(BASE)} OR {needs}) AS keep FROM seen {windows}) WHERE keep)
SELECT d.doc_id, {counts}, sha256({joined(f"kind < {len(BASE)}")}) AS base_sha256, {joined("kind >= 0")} AS spans, count(*) FILTER (kind >= {len(BASE)}) AS n_linked
FROM d LEFT JOIN kept USING (r) GROUP BY r, d.doc_id
"""


SQL = _sql()
