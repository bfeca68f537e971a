"""Areas and clean rings of outlines that cross, touch or overlap.

Rings come as points (keys, ring, role, k, x, y). Their edges are cut where they meet (noding),
each piece learns whether the region lies on its left, on its right, on both or on neither
side, and pieces with the region on one side only are its boundary. All of that are joins
and aggregations: edges meet by horizontal bands of their outline, so an edge is compared with
those near it alone. The area is a sum over the boundary. Only the last step, walking
the boundary into rings, takes an outline as a whole.

Rules: ``union`` is what lies in any outer ring and in no inner one (a ring by itself is even-odd); ``parity`` is even-odd over all rings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.spatial import _odd

#: Bands of an outline at most.
BANDS = 4096
_PIECE = ("ax", "ay", "bx", "by")


def _edges(points: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """(keys, ring, inner, id, x0, y0, x1, y1, b0, b1, low, step): edges that aren't points, with their bands."""
    by = Window.partitionBy(*keys, "ring").orderBy("k")
    after = [F.coalesce(F.lead(c).over(by), F.first(c).over(by)).alias(f"{c}1") for c in ("x", "y")]
    inner = (F.col("role") == "inner") if "role" in points.columns and rule == "union" else F.lit(False)
    e = points.select(*keys, "ring", F.coalesce(inner, F.lit(False)).alias("inner"), F.struct("ring", "k").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), *after)
    e = e.where("x0 <> x1 OR y0 <> y1")
    if rule == "parity":
        e = e.withColumn("ring", F.lit(0))
    whole = Window.partitionBy(*keys)
    low, high = F.min(F.least("y0", "y1")).over(whole), F.max(F.greatest("y0", "y1")).over(whole)
    e = e.withColumns({"low": low, "step": (high - low) / F.least(F.count(F.lit(1)).over(whole), F.lit(BANDS))})
    return e.withColumns({"b0": _band(F.least("y0", "y1")), "b1": _band(F.greatest("y0", "y1"))})


def _band(y: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide(y - F.col("low"), F.col("step"))), F.lit(0)).cast("int")


def _side(p: str, a: str, b: str) -> Column:
    """Twice the area of the triangle a, b, p: zero where p lies on the line."""
    c = F.col
    return (c(f"{b}x") - c(f"{a}x")) * (c(f"{p}y") - c(f"{a}y")) - (c(f"{b}y") - c(f"{a}y")) * (c(f"{p}x") - c(f"{a}x"))


def _between(p: str, a: str, b: str) -> Column:
    c = F.col
    return c(f"{p}x").between(F.least(f"{a}x", f"{b}x"), F.greatest(f"{a}x", f"{b}x")) & c(f"{p}y").between(F.least(f"{a}y", f"{b}y"), F.greatest(f"{a}y", f"{b}y"))


def _noded(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ring, inner, id, low, step, x0, y0, x1, y1): pieces of the edges between the points where they meet others."""
    keys = list(keys)
    banded = edges.withColumn("band", F.explode(F.sequence("b0", "b1")))
    one = lambda p, q, s: banded.select(*keys, "band", F.col("id").alias(f"i{s}"), F.col("b0").alias(f"f{s}"), *(F.col(f"{c}{n}").alias(f"{t}{c}") for n, t in ((0, p), (1, q)) for c in "xy"))
    near = (F.col("i1") < F.col("i2")) & (F.col("band") == F.greatest("f1", "f2"))  # a pair meets in the first band of both
    near &= (F.greatest("px", "qx") >= F.least("rx", "sx")) & (F.greatest("rx", "sx") >= F.least("px", "qx")) & (F.greatest("py", "qy") >= F.least("ry", "sy")) & (F.greatest("ry", "sy") >= F.least("py", "qy"))
    pairs = one("p", "q", 1).join(one("r", "s", 2), [*keys, "band"]).where(near)
    pairs = pairs.withColumns({"dp": _side("p", "r", "s"), "dq": _side("q", "r", "s"), "dr": _side("r", "p", "q"), "ds": _side("s", "p", "q")})
    t = F.col("dp") / (F.col("dp") - F.col("dq"))
    point = lambda i, x, y: F.struct(F.col(i).alias("id"), x.alias("x"), y.alias("y"))
    cx, cy = F.col("px") + t * (F.col("qx") - F.col("px")), F.col("py") + t * (F.col("qy") - F.col("py"))
    proper = (F.col("dp") * F.col("dq") < 0) & (F.col("dr") * F.col("ds") < 0)
    cuts = [F.when(proper, point(i, cx, cy)) for i in ("i1", "i2")]
    for p, i, a, b in (("r", "i1", "p", "q"), ("s", "i1", "p", "q"), ("p", "i2", "r", "s"), ("q", "i2", "r", "s")):
        cuts.append(F.when((F.col(f"d{p}") == 0) & _between(p, a, b), point(i, F.col(f"{p}x"), F.col(f"{p}y"))))
    met = pairs.select(*keys, F.explode(F.array_compact(F.array(*cuts))).alias("c")).select(*keys, "c.id", F.struct("c.x", "c.y").alias("p"))
    met = met.groupBy(*keys, "id").agg(F.collect_set("p").alias("cuts"))
    own = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    every = edges.join(met, [*keys, "id"], "left").withColumn("cuts", F.array_distinct(F.concat(own, F.coalesce("cuts", own))))
    along = lambda p: (p["x"] - F.col("x0")) * (F.col("x1") - F.col("x0")) + (p["y"] - F.col("y0")) * (F.col("y1") - F.col("y0"))
    every = every.withColumn("cuts", F.array_sort(F.transform("cuts", lambda p: F.struct(along(p).alias("t"), p["x"].alias("x"), p["y"].alias("y")))))
    pieces = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("a"), F.get("cuts", i + 1).alias("b")))
    out = every.select(*keys, "ring", "inner", "id", "low", "step", F.explode(pieces).alias("s"))
    return out.select(*keys, "ring", "inner", "id", "low", "step", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def boundary(points: DataFrame, keys: Sequence[str] = ("lago",), rule: str = "union") -> DataFrame:
    """(keys, x0, y0, x1, y1): the pieces of edges that bound the region, which lies to the left of each."""
    keys = list(keys)
    edges = _edges(points, keys, rule)
    up = (F.col("y0") < F.col("y1")) | ((F.col("y0") == F.col("y1")) & (F.col("x0") < F.col("x1")))
    turned = {n: F.when(up, F.col(a)).otherwise(F.col(b)) for n, a, b in (("ax", "x0", "x1"), ("ay", "y0", "y1"), ("bx", "x1", "x0"), ("by", "y1", "y0"))}
    pieces = _noded(edges, keys).withColumns(turned)
    # pieces that coincide are one, crossed by all their rings
    once = pieces.groupBy(*keys, *_PIECE).agg(F.collect_set("id").alias("own"), F.first("low").alias("low"), F.first("step").alias("step"))
    once = once.withColumns({"mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2})
    once = once.withColumn("band", _band(F.col("my")))
    # rings crossed on the way right from the middle of a piece (from just above it, if it is level)
    active = edges.where("y0 <> y1").select(*keys, "ring", "inner", "id", *(F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")), F.explode(F.sequence("b0", "b1")).alias("band"))
    crossed = once.join(active, [*keys, "band"]).where(~F.array_contains("own", F.col("id")) & ((F.col("ey0") > F.col("my")) != (F.col("ey1") > F.col("my"))))
    crossed = crossed.where(F.col("mx") < F.col("ex0") + (F.col("my") - F.col("ey0")) / (F.col("ey1") - F.col("ey0")) * (F.col("ex1") - F.col("ex0")))
    sides = crossed.select(*keys, *_PIECE, "ring", "inner", F.lit(1).alias("n"), F.lit(0).alias("own")).unionByName(pieces.select(*keys, *_PIECE, "ring", "inner", F.lit(0).alias("n"), F.lit(1).alias("own")))
    ring = sides.groupBy(*keys, *_PIECE, "ring", "inner").agg((F.sum("n") % 2 == 1).alias("near"), ((F.sum("n") + F.sum("own")) % 2 == 1).alias("far"))
    within = lambda c: F.bool_or(F.col(c) & ~F.col("inner")) & ~F.bool_or(F.col(c) & F.col("inner"))
    both = ring.groupBy(*keys, *_PIECE).agg(within("near").alias("near"), within("far").alias("far")).where("near <> far")
    # a rising piece has its near side on the right, a level one on the left
    ahead = F.when(F.col("ay") == F.col("by"), F.col("near")).otherwise(F.col("far"))
    return both.select(*keys, *(F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("x0", "ax", "bx"), ("y0", "ay", "by"), ("x1", "bx", "ax"), ("y1", "by", "ay"))))


def areas(points: DataFrame, keys: Sequence[str] = ("lago",), rule: str = "union") -> DataFrame:
    """(keys, area) of each region; 0 where rings enclose nothing."""
    term = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    found = boundary(points, keys, rule).groupBy(*keys).agg((F.sum(term) / 2).alias("area"))
    return points.select(*keys).distinct().join(found, list(keys), "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def walk(edges: Sequence[tuple[float, float, float, float]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons (a shell, then its holes) of boundary edges that have their region on the left.

    At a point where several ways lead on, the sharpest turn to the left stays with the same part.
    """
    ways: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x0, y0, x1, y1 in edges:
        ways.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    for start in sorted(ways):
        while ways.get(start):
            ring, at, to = [start], start, ways[start].pop()
            while to != start:
                ring.append(to)
                back = math.atan2(at[1] - to[1], at[0] - to[0])
                choice = ways[to]
                best = max(range(len(choice)), key=lambda k: (math.atan2(choice[k][1] - to[1], choice[k][0] - to[0]) - back) % math.tau)  # noqa: B023
                at, to = to, choice.pop(best)
            rings.append(ring)
    size = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True)) / 2
    shells = sorted((r for r in rings if size(r) > 0), key=size)
    parts = [[s] for s in shells]
    for hole in (r for r in rings if size(r) < 0):
        x, y = ((hole[0][k] + hole[1][k]) / 2 for k in (0, 1))
        for part in parts:  # the smallest shell around it
            if _odd(x, y, part[0]):
                part.append(hole)
                break
    return sorted(([[*r, r[0]] for r in p] for p in parts), key=lambda p: (-size(p[0][:-1]), p[0]))


def polygons(points: DataFrame, keys: Sequence[str] = ("lago",), rule: str = "union") -> DataFrame:
    """(keys, part, ring, k, x, y): the region as closed rings; ring 0 of a part is its shell, the others its holes, the largest part first.

    One task walks an outline's boundary.
    """
    keys = list(keys)

    def one(t: pa.Table) -> pa.Table:
        found = walk(list(zip(*(t.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")), strict=True)))
        rows = [(p, r, k, *xy) for p, part in enumerate(found) for r, ring in enumerate(part) for k, xy in enumerate(ring)]
        out = {c: pa.array([t.column(c)[0].as_py()] * len(rows), t.schema.field(c).type) for c in keys}
        return pa.table(out | {n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate((("part", pa.int32()), ("ring", pa.int32()), ("k", pa.int32()), ("x", pa.float64()), ("y", pa.float64())))})

    types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return boundary(points, keys, rule).groupBy(*keys).applyInArrow(one, f"{types}, part int, ring int, k int, x double, y double")
