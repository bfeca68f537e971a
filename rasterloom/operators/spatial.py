"""Geometry on grids: outlines, areas, alignment, reprojection, hexagons."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import ship

Ring = Sequence[tuple[float, float]]


def bbox_ring(west: float, east: float, south: float, north: float) -> list[tuple[float, float]]:
    """Closed ring of five points."""
    return [(west, south), (east, south), (east, north), (west, north), (west, south)]


def edges(rings: Sequence[Ring]) -> list[tuple[float, float, float, float]]:
    """Edges of all rings, closed where they are open."""
    out = []
    for ring in rings:
        points = list(ring) if ring[0] == ring[-1] else [*ring, ring[0]]
        out += [(*a, *b) for a, b in zip(points, points[1:], strict=False)]
    return out


def inside(x: Column, y: Column, rings: Sequence[Ring]) -> Column:
    """Even-odd test of a point against rings; holes fall out by parity.

    The outline's edges are a literal array, folded beside each row: no join.
    """
    table = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(e, ("x0", "y0", "x1", "y1"), strict=True))) for e in edges(rings)))

    def crosses(e: Column) -> Column:
        between = (e["y0"] > y) != (e["y1"] > y)
        at = e["x0"] + (y - e["y0"]) / F.when(e["y1"] != e["y0"], e["y1"] - e["y0"]) * (e["x1"] - e["x0"])
        return (between & F.coalesce(x < at, F.lit(False))).cast("int")

    return F.aggregate(table, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def edge_table(points: DataFrame, keys: Sequence[str] = ("lago",), ring: str = "ring") -> DataFrame:
    """(keys, ring, x0, y0, x1, y1): the edges of rings whose points (keys, ring, k, x, y) come in order; open rings are closed."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys, ring).orderBy("k")
    after = [F.coalesce(F.lead(c).over(by), F.first(c).over(by)).alias(f"{c}1") for c in ("x", "y")]
    return points.select(*keys, ring, F.col("x").alias("x0"), F.col("y").alias("y0"), *after)


def scanlines(edges_: DataFrame, keys: Sequence[str] = ("lago",), height: Column | int | None = None, offset: float = 0.5) -> DataFrame:
    """(keys, row, desde, hasta): the runs of columns of a grid that lie inside outlines by the even-odd rule.

    ``edges_`` are in pixel coordinates. A cell is inside if its centre (its index plus
    ``offset``) is. Each edge is active on the rows whose centres it spans, and gives the place where
    it crosses each; the sorted crossings of a row are its runs' ends, two by two. What is made
    is a crossing for each edge and row it spans, however wide the grid.
    """
    keys = list(keys)
    low, high = (F.ceil(f("y0", "y1") - offset).cast("int") for f in (F.least, F.greatest))
    top = high - 1 if height is None else F.least(high - 1, (height if isinstance(height, Column) else F.lit(height)) - 1)
    active = edges_.withColumns({"_a": F.greatest(low, F.lit(0)), "_b": top}).where("y0 <> y1 AND _a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    cross = F.col("x0") + (F.col("row") + offset - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    ends = active.select(*keys, "row", cross.alias("_x")).groupBy(*keys, "row").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    column = lambda i: F.ceil(F.get("_x", i) - offset).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2)), lambda i: F.struct(column(i).alias("desde"), (column(i + 1) - 1).alias("hasta")))
    return ends.where(F.size("_x") > 1).select(*keys, "row", F.explode(pairs).alias("_r")).select(*keys, "row", "_r.desde", "_r.hasta").where("desde <= hasta")


#: Runs that are sent to all executors at most (about 32 bytes each).
RUNS = 1_000_000


def _sent(runs: DataFrame) -> DataFrame:
    return F.broadcast(runs) if runs.limit(RUNS + 1).count() <= RUNS else runs


def within(cells: DataFrame, runs: DataFrame, keys: Sequence[str] = ("lago",)) -> DataFrame:
    """The cells (keys, row, col) that lie in one of the runs of their row; the cells aren't shuffled while the runs are few."""
    return _met(cells, runs, keys, "left_semi")


def _met(cells: DataFrame, runs: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    other = _sent(runs.select(*(F.col(k).alias(f"_{k}") for k in (*keys, "row")), "desde", "hasta", F.lit(True).alias("_in")))
    same = F.col("col").between(F.col("desde"), F.col("hasta"))
    for k in (*keys, "row"):
        same &= F.col(k) == F.col(f"_{k}")
    return cells.join(other, same, how)


def marked(cells: DataFrame, runs: DataFrame, keys: Sequence[str] = ("lago",), name: str = "dentro") -> DataFrame:
    """All cells, with whether they lie in one of the runs (a cell lies in one at most)."""
    return _met(cells, runs, keys, "left").select(*cells.columns, F.coalesce("_in", F.lit(False)).alias(name))


def ring_area(points: DataFrame, keys: Sequence[str], order: str = "k") -> DataFrame:
    """Shoelace area of the closed ring whose points each group holds in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    term = F.col("x") * F.coalesce(ny, F.first("y").over(whole)) - F.coalesce(nx, F.first("x").over(whole)) * F.col("y")
    return points.withColumn("_t", term).groupBy(*keys).agg(F.abs(F.sum("_t") / 2).alias("area"))


def area(rings: Sequence[Ring]) -> float:
    """Even-odd area of rings that don't cross: those within an odd number of others are holes."""
    total = 0.0
    for k, ring in enumerate(rings):
        x, y = (sum(p[i] for p in ring[:2]) / 2 for i in (0, 1))
        depth = sum(_odd(x, y, other) for j, other in enumerate(rings) if j != k)
        total += (-1) ** depth * abs(sum(x0 * y1 - x1 * y0 for x0, y0, x1, y1 in edges([ring]))) / 2
    return total


def _odd(x: float, y: float, ring: Ring) -> bool:
    """Whether a way right from a point crosses a ring an odd number of times."""
    return sum((y0 > y) != (y1 > y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0) for x0, y0, x1, y1 in edges([ring])) % 2 == 1


def coverage_ratio(outline: Sequence[Ring], box: Ring) -> dict[str, float | None]:
    """Areas of outline and box, and their ratio rounded to four digits."""
    a, b = area(outline), area([box])
    return {"area_contorno": a, "area_caja": b, "razon": round(a / b, 4) if b else None}


# Ellipsoid WGS 84 and the scale of the projection.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def to_utm(lon: Column, lat: Column, zone: int = 15) -> tuple[Column, Column]:
    """Easting and northing in metres (northern hemisphere), by the third-order series."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(float(6 * zone - 183)))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * radius * x, _K0 * radius * y


def utm_arrays(lon: np.ndarray, lat: np.ndarray, zone: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """The same for arrays."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * math.sqrt(n) / (1 + n)
    s = np.sin(np.radians(lat))
    lam = np.radians(lon - (6 * zone - 183))
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate((n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240), 1):
        x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return 500000 + _K0 * radius * x, _K0 * radius * y


def degree_arrays(east: np.ndarray, north: np.ndarray, zone: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of arrays of northern UTM points: the very inverse of ``utm_arrays``.

    The series is solved by Newton's method over complex numbers, the latitude by iteration; a series
    back would err by 1e-9 degrees from 25 degrees off the zone's meridian on. Within a few degrees
    of the two points on the equator 90 degrees off it the projection has no inverse.
    """
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * math.sqrt(n) / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    z = (north + 1j * (east - 500000)) / (_K0 * radius)
    w = z
    for _ in range(6):
        off = w - z + sum(a * np.sin(2 * j * w) for j, a in enumerate(alpha, 1))
        w = w - off / (1 + sum(2 * j * a * np.cos(2 * j * w) for j, a in enumerate(alpha, 1)))
    t = np.sin(w.real) / np.hypot(np.sinh(w.imag), np.cos(w.real))
    s = t / np.sqrt(1 + t * t)
    for _ in range(8):
        s = np.tanh(np.arcsinh(t) + e * np.arctanh(e * s))
    return 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(w.imag), np.cos(w.real))), np.degrees(np.arcsin(s))


def _by_arrays(function: Callable, a: Column, b: Column, zone: int) -> tuple[Column, Column]:
    """A function of two arrays as two columns, in Arrow tasks."""
    ship(SparkSession.active())

    @F.arrow_udf("a double, b double")
    def both(x: pa.Array, y: pa.Array) -> pa.Array:
        none = pa.compute.or_(x.is_null(), y.is_null())
        with np.errstate(all="ignore"):
            out = function(x.to_numpy(zero_copy_only=False).astype(float), y.to_numpy(zero_copy_only=False).astype(float), zone)
        return pa.StructArray.from_arrays([pa.array(v, mask=none.to_numpy(zero_copy_only=False)) for v in out], ["a", "b"])

    pair = both(a.cast("double"), b.cast("double"))
    return pair["a"], pair["b"]


def utm_points(lon: Column, lat: Column, zone: int = 15) -> tuple[Column, Column]:
    """``to_utm`` by ``utm_arrays``: the C library's sines, with which other engines agree to the last bit."""
    return _by_arrays(utm_arrays, lon, lat, zone)


def from_utm(east: Column, north: Column, zone: int = 15) -> tuple[Column, Column]:
    """Longitude and latitude of a northern UTM point, by ``degree_arrays``."""
    return _by_arrays(degree_arrays, east, north, zone)


def turned(a: Column, b: Column) -> Column:
    """Distance of two angles in degrees, whole turns aside."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def align_bilinear(source: DataFrame, targets: DataFrame, keys: Sequence[str], row: Column, col: Column) -> DataFrame:
    """Values at fractional source positions from the four neighbours.

    ``row`` and ``col`` give a target's position among the source's pixel centres.
    Invalid or missing neighbours lose their weight and the others share it; a target
    without a valid neighbour is NULL. An equi-join on the neighbour's indices.
    """
    r0, c0 = F.floor(row), F.floor(col)
    corner = lambda dr, dc: F.struct(
        (r0 + dr).cast("int").alias("r"), (c0 + dc).cast("int").alias("c"), ((1 - F.abs(row - (r0 + dr))) * (1 - F.abs(col - (c0 + dc)))).alias("w")
    )
    near = targets.withColumn("_n", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1))))).where("_n.w > 0")
    near = near.select(*targets.columns, F.col("_n.r").alias("_r"), F.col("_n.c").alias("_c"), F.col("_n.w").alias("_w"))
    known = source.where(F.col("v").isNotNull()).select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias("_v"))
    met = near.join(known, [*keys, "_r", "_c"], "left")
    weight = F.when(F.col("_v").isNotNull(), F.col("_w"))
    return met.groupBy(*targets.columns).agg(F.try_divide(F.sum(weight * F.col("_v")), F.sum(weight)).alias("v"))


def align(source: DataFrame, targets: DataFrame, keys: Sequence[str], of: dict, to: dict) -> DataFrame:
    """``source`` (keys, row, col, v) of one grid at the cells of another; equal grids only meet by row and column."""
    if same_grid(of, to):
        return targets.join(source.select(*keys, "row", "col", "v"), [*keys, "row", "col"], "left")
    (x0, y0, px, py), (x1, y1, qx, qy) = of["transform"], to["transform"]
    row = (F.lit(float(y0 - y1)) + (F.col("row") + 0.5) * float(qy)) / float(py) - 0.5
    col = (F.lit(float(x1 - x0)) + (F.col("col") + 0.5) * float(qx)) / float(px) - 0.5
    return align_bilinear(source, targets, keys, row, col)


def boxes(zones: DataFrame) -> DataFrame:
    """(lago, k, x, y): the closed ring of each zone's box (west, east, south, north)."""
    c = F.col
    point = lambda k, x, y: F.struct(F.lit(k).alias("k"), c(x).alias("x"), c(y).alias("y"))
    corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    return zones.select("lago", F.explode(F.array(*(point(k, *p) for k, p in enumerate(corners)))).alias("p")).select("lago", "p.*")


def outline_areas(points: DataFrame, keys: Sequence[str] = ("lago",)) -> DataFrame:
    """Even-odd area of outlines (keys, ring, k, x, y), whatever crosses, touches or lies within."""
    from rasterloom.operators import polygons

    return polygons.areas(points, keys, "parity")


def coverage(outlines_: DataFrame, box_points: DataFrame, keys: Sequence[str] = ("lago",)) -> DataFrame:
    """Areas of outline and box of each zone, and their ratio to four digits."""
    a = outline_areas(outlines_, keys).withColumnRenamed("area", "area_contorno")
    b = ring_area(box_points, keys).withColumnRenamed("area", "area_caja")
    return a.join(b, list(keys)).withColumn("razon", F.round(F.try_divide("area_contorno", "area_caja"), 4))


def largest_outline(points: DataFrame, candidate: str = "contorno") -> DataFrame:
    """The points of each zone's largest candidate outline; the smallest name on ties."""
    from rasterloom.operators.series import first_of

    areas = outline_areas(points, ("lago", candidate))
    best = first_of(areas, ["lago"], F.col("area").desc(), F.col(candidate)).select("lago", candidate)
    return points.join(F.broadcast(best), ["lago", candidate], "left_semi")  # a row a zone


def rings_on_grid(points: DataFrame, grids: dict[str, dict], zone: int = 15) -> dict[str, list[list[tuple[float, float]]]]:
    """Rings in pixel coordinates (column, row) of outlines in degrees (lago, ring, k, x, y), for ``inside``.

    Outlines are reprojected on the executors; their points (a few thousand a zone) are literals of the plan.
    """
    e, n = to_utm(F.col("x"), F.col("y"), zone)
    out: dict[str, list[list[tuple[float, float]]]] = {}
    for r in points.select("lago", "ring", "k", e.alias("e"), n.alias("n")).orderBy("lago", "ring", "k").collect():
        if r["lago"] in grids:
            x, y, px, py = grids[r["lago"]]["transform"]
            rings = out.setdefault(r["lago"], [])
            while len(rings) <= r["ring"]:
                rings.append([])
            rings[r["ring"]].append(((r["e"] - x) / px, (y - r["n"]) / py))
    return out


def same_grid(a: dict, b: dict) -> bool:
    """Grids are the same if system, transform, width and height are."""
    return all(a.get(k) == b.get(k) for k in ("crs", "transform", "width", "height"))


def hex_cells(points: DataFrame, x: str, y: str, low: tuple[float, float], high: tuple[float, float], wide: int = 55, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of points in hexagons, ``wide`` across: two offset lattices, the nearer centre wins."""
    tall = max(1, int(wide / math.sqrt(3)))
    sx, sy = (high[0] - low[0]) / wide or 1.0, (high[1] - low[1]) / tall or 1.0
    u, v = (F.col(x) - low[0]) / sx, (F.col(y) - low[1]) / sy
    i1, j1 = F.floor(u + 0.5), F.floor(v + 0.5)
    i2, j2 = F.floor(u), F.floor(v)
    d1 = (u - i1) * (u - i1) + 3 * (v - j1) * (v - j1)
    d2 = (u - i2 - 0.5) * (u - i2 - 0.5) + 3 * (v - j2 - 0.5) * (v - j2 - 0.5)
    first = d1 < d2
    cell = [F.when(first, F.lit(0)).otherwise(F.lit(1)).alias("malla"), F.when(first, i1).otherwise(i2).cast("long").alias("i"), F.when(first, j1).otherwise(j2).cast("long").alias("j")]
    return points.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("n"))


def histogram(values: DataFrame, value: str, low: Column | float, high: Column | float, bins: int = 44, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins of [low, high]; the last bin is closed."""
    v = F.col(value)
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    b = F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins)).cast("int")
    return values.where((v >= lo) & (v <= hi)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def outlines(spark: SparkSession, zones: dict[str, Sequence[Ring]]) -> DataFrame:
    """(lago, ring, k, x, y) of the points of outlines."""
    rows = [(z, r, k, float(x), float(y)) for z, rings in zones.items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "lago string, ring int, k int, x double, y double")


def warp_wgs84(source: DataFrame, keys: Sequence[str], origin: tuple[float, float], pixel: float, bounds: tuple[float, float, float, float], width: int, height: int, most: int = 1000, zone: int = 15) -> DataFrame:
    """A UTM grid (keys, row, col, v) on a longitude-latitude grid of at most ``most`` pixels a side; NULL where no neighbour is valid.

    ``origin`` is the grid's upper left corner, ``bounds`` are west, east, south, north. Tiles, not pixels, meet in the shuffle.
    """
    from rasterloom.operators import tiles

    scale = min(1.0, most / max(width, height))
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    west, east, south, north = bounds
    grid = lambda *v: F.struct(*(F.lit(x).alias(n) for n, x in zip(("crs", "x", "y", "px", "py", "width", "height"), v, strict=True)))
    every = (1 << 31) - 1  # the source's own cells bound it
    of = grid(32600 + zone, float(origin[0]), float(origin[1]), float(pixel), float(pixel), every, every)
    to = grid(4326, float(west), float(north), (east - west) / w, (north - south) / h, w, h)
    made = tiles.from_cells(source, keys)
    scenes = made.select(*keys).distinct().withColumns({"of": of, "to": to})
    found = tiles.cells(tiles.resample(made, scenes, keys), keys)
    cells = source.sparkSession.range(w * h).select((F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col"))
    every = scenes.select(*keys).join(cells)  # a row a scene, times the capped grid
    return every.join(found, [*keys, "row", "col"], "left")
