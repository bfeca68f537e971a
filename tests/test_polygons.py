"""Areas and clean rings of outlines that cross, touch, overlap or nest; answers of the outline service."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import polygons, spatial
from rasterloom.sources import tables

SCHEMA = "lago string, ring int, role string, k int, x double, y double"


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


CASES = {  # rings, union, even-odd, number of parts, number of holes
    "two": ([("outer", square(0, 0, 3)), ("outer", square(10, 0, 2))], 13, 13, 2, 0),
    "overlap": ([("outer", square(0, 0, 3)), ("outer", square(2, 2, 3))], 17, 16, 1, 0),
    "hole": ([("outer", square(0, 0, 4)), ("inner", square(1, 1, 1))], 15, 15, 1, 1),
    "bow": ([("outer", [(0, 0), (2, 2), (2, 0), (0, 2)])], 2, 2, 2, 0),
    "adjacent": ([("outer", square(0, 0, 2)), ("outer", square(2, 0, 2))], 8, 8, 1, 0),
    "same": ([("outer", square(0, 0, 2)), ("outer", square(0, 0, 2))], 4, 0, 1, 0),
    "nested": ([("outer", square(0, 0, 6)), ("inner", square(1, 1, 4)), ("outer", square(20, 0, 1)), ("inner", square(20.25, 0.25, 0.5))], 20.75, 20.75, 2, 2),
    "touching": ([("outer", square(0, 0, 4)), ("inner", [(0, 0), (2, 1), (1, 2)])], 14.5, 14.5, 1, 1),
    "corner": ([("outer", square(0, 0, 2)), ("outer", square(2, 2, 2))], 8, 8, 2, 0),
    "island": ([("outer", square(0, 0, 6)), ("inner", square(1, 1, 4)), ("outer", square(2, 2, 1))], 20, 21, 1, 1),
    "line": ([("outer", [(0, 0), (1, 1), (0, 0), (1, 1)])], 0, 0, 0, 0),
    "closed": ([("outer", [*square(0, 0, 2), (0, 0)])], 4, 4, 1, 0),
}


def points(spark, cases):
    rows = [(z, r, role, k, float(x), float(y)) for z, rings in cases.items() for r, (role, ring) in enumerate(rings) for k, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, SCHEMA)


def test_known_regions(spark):
    d = points(spark, {z: c[0] for z, c in CASES.items()})
    for rule, at in (("union", 1), ("parity", 2)):
        assert {r.lago: r.area for r in polygons.areas(d, rule=rule).collect()} == pytest.approx({z: c[at] for z, c in CASES.items()})
    rings = polygons.polygons(d).select("lago", "part", "ring").distinct().collect()
    for z, c in CASES.items():
        own = [r for r in rings if r.lago == z]
        assert (sum(r.ring == 0 for r in own), sum(r.ring > 0 for r in own)) == c[3:], z


def test_random_stars_against_a_fine_grid(spark):
    """Crossing rings, unions and holes, counted on a grid and by scanlines."""
    r = np.random.default_rng(3)
    cases = {}
    for z in "abc":
        rings = []
        for k in range(3):
            at, n = r.uniform(20, 60, 2), 11
            turn = np.sort(r.uniform(0, 2 * math.pi, n)) if k else r.uniform(0, 2 * math.pi, n)  # the first crosses itself
            rings.append(("inner" if k == 2 else "outer", [(float(at[0] + s * math.cos(a)), float(at[1] + s * math.sin(a))) for a, s in zip(turn, r.uniform(8, 19, n), strict=True)]))
        cases[z] = rings
    d = points(spark, cases)
    union = {x.lago: x.area for x in polygons.areas(d).collect()}
    clean = polygons.polygons(d)
    runs = spatial.scanlines(spatial.edge_table(clean.withColumn("x", F.col("x") * 20).withColumn("y", F.col("y") * 20), ("lago", "part")), ("lago", "part"))
    counted = {x.lago: x.n / 400 for x in runs.groupBy("lago").agg(F.sum(F.col("hasta") - F.col("desde") + 1).alias("n")).collect()}
    gx, gy = np.meshgrid((np.arange(1600) + 0.5) / 20, (np.arange(1600) + 0.5) / 20)
    for z, rings in cases.items():
        inside = {"outer": np.zeros(gx.shape, bool), "inner": np.zeros(gx.shape, bool)}
        for role, ring in rings:
            odd = np.zeros(gx.shape, bool)
            for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
                odd ^= ((y0 > gy) != (y1 > gy)) & (gx < x0 + (gy - y0) / (y1 - y0) * (x1 - x0))
            inside[role] |= odd
        want = (inside["outer"] & ~inside["inner"]).sum() / 400
        assert union[z] == pytest.approx(want, rel=0.01) and counted[z] == pytest.approx(want, rel=0.01), z
    shoelace = {x.lago: x.a for x in spatial.ring_area(clean, ["lago", "part", "ring"]).groupBy("lago").agg(F.sum(F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))).alias("a")).collect()}
    assert shoelace == pytest.approx(union)


def test_long_outline(spark):
    """Ten thousand edges meet by bands, not each with each."""
    n = 10_000
    ring = [(100 + (60 + 5 * (k % 2)) * math.cos(2 * math.pi * k / n), 100 + (60 + 5 * (k % 2)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    d = points(spark, {"a": [("outer", ring)]})
    want = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2
    assert polygons.areas(d).first().area == pytest.approx(want)


def test_area_of_rings():
    assert spatial.area([square(0, 0, 3), square(10, 0, 2)]) == 13
    assert spatial.area([square(0, 0, 4), square(1, 1, 1)]) == spatial.area([square(1, 1, 1), square(0, 0, 4)]) == 15


def geo(line):
    return [{"lon": x, "lat": y} for x, y in line]


def test_answers_of_the_service(spark):
    bow = {"type": "way", "id": 1, "geometry": geo([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])}
    open_way = {"type": "way", "id": 2, "geometry": geo([(0, 0), (9, 0), (9, 9), (0, 9)])}
    lines = [[(0, 0), (3, 0), (3, 3)], [(0, 0), (0, 3), (3, 3)], square(10, 0, 2) + [(10, 0)], [(50, 50), (60, 60)]]
    relation = {"type": "relation", "id": 3, "members": [{"role": "outer", "geometry": geo(s)} for s in lines] + [{"role": "inner", "geometry": geo([*square(1, 1, 1), (1, 1)])}, {"role": "label"}]}
    rows = [("a", json.dumps({"elements": [bow, open_way]})), ("b", json.dumps({"elements": [bow, relation]})), ("c", json.dumps({"elements": []})), ("d", "no answer")]
    d = spark.createDataFrame(rows, "lago string, answer string")
    sized = {(r.lago, r.contorno): r.area for r in polygons.areas(tables.water_rings(d), ["lago", "contorno"]).collect()}
    assert sized == {("a", "way/1"): 2, ("b", "way/1"): 2, ("b", "relation/3"): 12}
    best = tables.largest_water(d)
    assert {(r.lago, r.part, r.ring) for r in best.collect()} == {("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("b", 0, 1), ("b", 1, 0)}
    text = {r.lago: json.loads(r.geojson)["features"][0]["geometry"] for r in tables.geojson(best).collect()}
    assert text["b"]["type"] == "MultiPolygon" and [len(p) for p in text["b"]["coordinates"]] == [2, 1]


def test_parts_are_read_back(spark, tmp_path):
    d = points(spark, {"atitlan": CASES["two"][0]})
    tables.write_geojson(polygons.polygons(d), str(tmp_path / "o"))
    back = tables.read_outlines(spark, str(tmp_path / "o"))
    assert spatial.outline_areas(back).first().area == 13
