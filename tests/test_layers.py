"""Tiles and their resampling, fetched layers on grids of their own, outlines as runs of cells."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.operators import spatial
from rasterloom.operators import tiles as T
from rasterloom.operators.scenes import InputDataError
from rasterloom.plans import workflows as W
from rasterloom.sources import geotiff, tables

NAMES = ("crs", "x", "y", "px", "py", "width", "height")


def grid(g):
    return F.struct(*(F.lit(v).alias(n) for n, v in zip(NAMES, (g["crs"], *g["transform"], g["width"], g["height"]), strict=True)))


def cells(spark, h, w, seed=0, zones="ab"):
    r = np.random.default_rng(seed)
    rows = [(z, i, j, float(r.normal()) if r.random() < 0.8 else None) for z in zones for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "lago string, row int, col int, v double")


@pytest.mark.parametrize("to", [((3.0, -2.0, 2.5, 1.7), 20, 50), ((-5.0, 6.0, 0.5, 0.7), 100, 90), ((0.0, 0.0, 1.0, 1.0), 45, 70), ((500.0, 0.0, 1.0, 1.0), 9, 9)])
def test_tiles_equal_the_join_of_neighbours(spark, to):
    d = cells(spark, 70, 45)
    of, to = {"crs": 32615, "transform": (0.0, 0.0, 1.0, 1.0), "width": 45, "height": 70}, {"crs": 32615, "transform": to[0], "width": to[1], "height": to[2]}
    n = to["width"]
    targets = d.select("lago").distinct().join(spark.range(n * to["height"]).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col")))
    want = {(r.lago, r.row, r.col): r.v for r in spatial.align(d, targets, ["lago"], of, to).collect()}
    plan = d.select("lago").distinct().withColumns({"of": grid(of), "to": grid(to)})
    made = T.from_cells(d, ["lago"], 16)
    got = {(r.lago, r.row, r.col): r.v for r in T.cells(T.resample(made, plan, ["lago"], 16), ["lago"], 16).collect()}
    assert set(got) <= set(want)
    assert all((v is None) == (got.get(k) is None) and (v is None or got[k] == pytest.approx(v, abs=1e-12)) for k, v in want.items())


def test_tiles_shuffle_few_rows(spark):
    d = cells(spark, 70, 45)
    of, to = {"crs": 32615, "transform": (0.0, 0.0, 1.0, 1.0), "width": 45, "height": 70}, {"crs": 32615, "transform": (0.3, -0.4, 1.0, 1.0), "width": 44, "height": 69}
    made = T.from_cells(d, ["lago"], 16)
    sent = T.requests(made.select("lago").distinct().withColumns({"of": grid(of), "to": grid(to)}), ["lago"], 16).count() + made.count()
    assert sent * 10 < 4 * d.count()  # the join of neighbours sends each target four times, and the source


def test_strips_are_cut_and_missing_cells_are_null(spark):
    d = spark.createDataFrame([("a", 1, 3, [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0]), ("a", 6, 0, [9.0]), ("a", 0, 0, [])], "lago string, row int, col int, v array<double>")
    got = {(r.row, r.col): r.v for r in T.cells(T.build(d, ["lago"], 4), ["lago"], 4).where("v IS NOT NULL").collect()}
    assert got == {(1, 3): 1.0, (1, 5): 3.0, (1, 6): 4.0, (1, 7): 5.0, (1, 8): 6.0, (1, 9): 7.0, (6, 0): 9.0}
    assert T.build(d.limit(0), ["lago"]).count() == 0


def test_systems(spark):
    r, c = T.positions({"crs": 4326, "x": -91.0, "y": 14.5, "px": 0.001, "py": 0.001}, {"crs": 32615, "x": 720000.0, "y": 1600000.0, "px": 10.0, "py": 10.0}, np.arange(3), np.arange(4))
    lon, lat = spatial.degree_arrays(*np.meshgrid(720000.0 + 10 * (np.arange(4) + 0.5), 1600000.0 - 10 * (np.arange(3) + 0.5)))
    back = spatial.utm_arrays(lon, lat)
    assert np.allclose(back[0][0], 720000.0 + 10 * (np.arange(4) + 0.5), atol=1e-4) and r.shape == c.shape == (3, 4)
    assert np.allclose(-91.0 + (c + 0.5) * 0.001, lon, atol=1e-12)
    e, n = spatial.to_utm(F.lit(float(lon[1, 2])), F.lit(float(lat[1, 2])))
    x = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert (x.e, x.n) == pytest.approx((back[0][1, 2], back[1][1, 2]), abs=1e-6)
    with pytest.raises(InputDataError):
        T.positions({"crs": 3857}, {"crs": 32615}, np.arange(1), np.arange(1))


# -- a work folder of four-band scenes -----------------------------------------------------

SIDE = 12
DAYS = {"atitlan": "2026-04-13", "amatitlan": "2026-04-13"}
ORIGIN = {"atitlan": (690000.0, 1620000.0), "amatitlan": (760000.0, 1600000.0)}


def layer(zone):
    """A layer on a grid of its own: the plane easting / 1000, so that values tell their place."""
    x, y = ORIGIN[zone][0] - 20, ORIGIN[zone][1] + 20
    v = np.broadcast_to((x + (np.arange(30) + 0.5) * 7) / 1000 - ORIGIN[zone][0] / 1000 + 5, (40, 30)).astype(np.float32).copy()
    return geotiff.Raster(v[None], 32615, (x, y), (7.0, 7.0), float("nan"))


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("four")
    root = folder / "rasters"
    paths = []
    for zone, day in DAYS.items():
        (root / zone / day).mkdir(parents=True)
        bands = np.stack([np.full((SIDE, SIDE), v, np.float32) for v in (0.10, 0.05, 0.02, 6.0)])
        bands[0] += np.arange(SIDE) / 1000  # B03
        bands[3, 0, 1], bands[2, 2, 2] = 9, -32768.0  # cloud; no data
        raster = geotiff.Raster(bands, 32615, ORIGIN[zone], (10.0, 10.0), -32768.0, bands=["B03", "B04", "B08", "SCL"])
        (root / zone / day / "l2a.tif").write_bytes(geotiff.encode(raster))
        paths.append((zone, day, f"{zone}/{day}/l2a.tif"))
    zone = "atitlan"
    (root / zone / DAYS[zone] / "cyano_ndci_l1c.tif").write_bytes(geotiff.encode(layer(zone)))
    full = W.prepare(spark, str(folder / "first"))
    given = spark.createDataFrame(paths, "lago string, d string, p string").select("lago", F.to_date("d").alias("fecha"), "p")
    full = full.join(given, ["lago", "fecha"], "left").withColumn("ruta_local", F.coalesce("p", F.lit(""))).select(*S.SCENE_MANIFEST.names)
    tables.write_csv(full, str(folder / "scenes"), "errorifexists", 1)
    assert W.run_indices(spark, str(folder)) == 2
    return folder


def rows(spark, work):
    return {(r.lago, str(r.fecha), r.indice): r for r in tables.read_csv(spark, f"{work}/indices", S.INDEX_MANIFEST).collect()}


def test_layer_and_scene_without_one(spark, work):
    found = rows(spark, work)
    assert len(found) == 66
    day = DAYS["atitlan"]
    cyano, ndvi = found["atitlan", day, "cianobacteria"], found["atitlan", day, "ndvi"]
    assert ndvi.pixeles_validos == ndvi.pixeles_lago == SIDE * SIDE - 2 and cyano.pixeles_validos == SIDE * SIDE
    assert (cyano.crs, cyano.resolucion_m, cyano.quality_flag) == ("EPSG:32615", 10.0, S.COMPUTED)
    pixels = W.read_pixels(spark, str(work)).where("lago = 'atitlan'").collect()
    assert all(p.cyano == pytest.approx(5 + (p.col + 0.5) * 0.01, abs=1e-4) for p in pixels)  # on its place, masked by no class
    # no layer: the others are computed, cyano stays pending
    day = DAYS["amatitlan"]
    assert found["amatitlan", day, "cianobacteria"].quality_flag == S.PENDING
    assert {found["amatitlan", day, i].quality_flag for i in ("ndvi", "ndwi")} == {S.COMPUTED}
    assert W.check_grid(spark, str(work)).isEmpty()


def test_second_run_touches_only_what_is_new(spark, work, tmp_path):
    import shutil

    copy = tmp_path / "again"
    shutil.copytree(work, copy)
    assert W.run_indices(spark, str(copy)) == 0
    files = lambda zone: sorted(p.name for p in (copy / "pixels" / f"lago={zone}").rglob("part*"))
    kept, day = files("atitlan"), DAYS["amatitlan"]
    (copy / "rasters" / f"amatitlan_{day}_cyano.tif").write_bytes(geotiff.encode(layer("amatitlan")))
    assert W.run_indices(spark, str(copy)) == 1
    assert files("atitlan") == kept and rows(spark, copy)["amatitlan", day, "cianobacteria"].quality_flag == S.COMPUTED
    assert W.run_indices(spark, str(copy)) == 0 and len(rows(spark, copy)) == 66
    # from the rasters on two grids to the comparison of zones
    done = {r.lago: r for r in W.comparison(spark, str(copy)).collect()}
    assert set(done) == set(DAYS) and all(r.cyano_promedio_general == pytest.approx(5.06, abs=0.01) for r in done.values())


def test_bands_on_different_grids_are_errors(spark, tmp_path):
    a = geotiff.Raster(np.ones((1, 4, 4), np.float32), 32615, (0.0, 0.0), (10.0, 10.0), bands=["B03"])
    b = geotiff.Raster(np.ones((1, 4, 4), np.float32), 32615, (5.0, 0.0), (10.0, 10.0), bands=["B04"])
    for name, r in (("a.tif", a), ("b.tif", b)):
        (tmp_path / name).write_bytes(geotiff.encode(r))
    row = spark.createDataFrame([("atitlan", "a.tif;b.tif")], "lago string, ruta_local string").withColumn("fecha", F.to_date(F.lit("2026-04-13")))
    with pytest.raises(Exception, match="different grids"):
        geotiff.read_bands(spark, row, ["B03", "B04"], str(tmp_path)).collect()


# -- runs -----------------------------------------------------------------------------------


def star(n, cx, cy, far, near):
    return [(cx + (far if k % 2 else near) * math.cos(2 * math.pi * k / n), cy + (far if k % 2 else near) * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.mark.parametrize("offset", [0.0, 0.5])
def test_runs_equal_the_point_test(spark, offset):
    outlines = {"a": [star(30, 20, 18, 17, 6), [(15, 10), (25, 10), (25, 20), (15, 20)]], "b": [[(2, 2), (30, 2), (30, 30), (2, 30)], [(10, 10), (20, 10), (20, 20), (10, 20), (10, 10)]]}
    d = cells(spark, 40, 40)
    runs = spatial.scanlines(spatial.edge_table(spatial.outlines(spark, outlines)), height=40, offset=offset)
    got = spatial.marked(d, runs)
    for zone, rings in outlines.items():
        test = spatial.inside(F.col("col") + offset, F.col("row") + offset, rings)
        assert got.where(F.col("lago") == zone).where(test != F.col("dentro")).isEmpty()
        assert spatial.within(d, runs).where(F.col("lago") == zone).count() == d.where(F.col("lago") == zone).where(test).count() > 0
    assert got.count() == d.count()


def test_runs_are_cheap_for_long_outlines(spark):
    """A thousand edges and 250,000 cells: no edge is looked at beside a cell."""
    ring = {"a": [star(1000, 250, 250, 240, 180)]}
    d = spark.range(500 * 500).select(F.lit("a").alias("lago"), (F.col("id") / 500).cast("int").alias("row"), (F.col("id") % 500).cast("int").alias("col"))
    runs = spatial.scanlines(spatial.edge_table(spatial.outlines(spark, ring)))
    got = spatial.within(d, runs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "aggregate(" not in plan
    inner, outer = (math.pi * r * r for r in (180, 240))
    assert inner < got.count() < outer


def test_index_rasters(spark, work, tmp_path):
    W.export_indices(spark, str(work), str(tmp_path / "r"))
    names = sorted(p.name for p in (tmp_path / "r").glob("*.tif"))
    assert names == sorted(f"{z}_{d}_{i}.tif" for z, d in DAYS.items() for i in S.INDICES if (z, i) != ("amatitlan", "cianobacteria"))
    r = geotiff.decode((tmp_path / "r" / f"atitlan_{DAYS['atitlan']}_ndvi.tif").read_bytes())
    assert r.grid == {"crs": 32615, "transform": (*ORIGIN["atitlan"], 10.0, 10.0), "width": SIDE, "height": SIDE}
    assert r.tags == {"lago": "atitlan", "fecha": DAYS["atitlan"], "indice": "ndvi", "formula_version": "1", "unidad": "adimensional"} and r.description == "ndvi"
    assert np.isnan(r.data[0, 0, 1]) and np.isfinite(r.data).sum() == SIDE * SIDE - 2 and not any((tmp_path / "r" / ".strips").iterdir())


# -- the data source --------------------------------------------------------------------------


def test_strips_by_many_tasks(spark, tmp_path):
    spark.dataSource.register(geotiff.GeoTiffSource)
    h, w = 300, 70
    d = spark.range(h * w).select(F.lit("a.tif").alias("path"), F.lit(1).alias("band"), (F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col")).where("row < 64 OR row >= 128")
    d = d.withColumn("value", F.col("row") + F.col("col") / 1000)
    d.repartition(6, F.col("path"), F.floor(F.col("row") / geotiff.STRIP_ROWS)).write.format("geotiff").options(width=w, height=h, crs=32615, x=5, y=9, resolution=2).mode("append").save(str(tmp_path))
    raw = (tmp_path / "a.tif").read_bytes()
    r, f = geotiff.decode(raw), geotiff.Layout(raw)
    want = np.arange(h)[:, None] + np.arange(w)[None] / 1000
    want[64:128] = np.nan
    assert np.allclose(r.values(), want, equal_nan=True, atol=1e-4) and len(f.starts) == 5 and r.grid["transform"] == (5.0, 9.0, 2.0, 2.0)
    with pytest.raises(Exception, match="several tasks"):
        d.repartition(6, "col").write.format("geotiff").options(width=w, height=h, replace="true").mode("append").save(str(tmp_path))
    assert (tmp_path / "a.tif").read_bytes() == raw and not any((tmp_path / ".strips").iterdir())
    # the big format has the same values
    one = geotiff.header(r, (h, w, 1), np.dtype("<f4"), f.sizes, [s - f.starts[0] for s in f.starts], big=True)
    assert one[:4] == b"II+\0" and np.allclose(geotiff.decode(one + raw[f.starts[0] :]).data, r.data, equal_nan=True)


def test_files_are_split_and_conditions_leave_blocks_unread(spark, tmp_path):
    data = np.arange(2 * 400 * 30, dtype=np.float32).reshape(2, 400, 30)
    data[0, 3, 4] = -1
    (tmp_path / "x.tif").write_bytes(geotiff.encode(geotiff.Raster(data, 32615, nodata=-1.0)))
    reader = geotiff._PushingReader({"path": str(tmp_path), "bands": "1,2", "share": "9000"})
    parts = reader.partitions()
    assert len(parts) > 3
    rest = list(reader.pushFilters([geotiff.EqualTo(("band",), 2), geotiff.GreaterThan(("row",), 99), geotiff.LessThanOrEqual(("row",), 180), geotiff.EqualTo(("col",), 3)]))
    assert len(rest) == 1 and reader.bands == [2] and reader.rows == (100, 180)
    read = []
    block = geotiff.Layout.block
    geotiff.Layout.block = lambda self, raw, k: read.append(k) or block(self, raw, k)
    try:
        got = sum(b.num_rows for p in parts for b in reader.read(p))
    finally:
        geotiff.Layout.block = block
    assert got == 81 * 30 and read == [1, 2]
    spark.dataSource.register(geotiff.GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        d = spark.read.format("geotiff").options(bands="1,2", share=9000, pushdown="true").load(str(tmp_path))
        some = d.where("band = 2 AND row BETWEEN 100 AND 180")
        assert some.count() == got and {r.value for r in some.where("col = 3 AND row = 101").collect()} == {float(data[1, 101, 3])}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    every = spark.read.format("geotiff").options(bands="1,2", share=9000).load("file://" + str(tmp_path) + "/*.tif")
    assert every.rdd.getNumPartitions() == len(parts) and every.count() == 2 * 400 * 30 - 1
    with pytest.raises(Exception, match="no raster"):
        spark.read.format("geotiff").load(str(tmp_path / "none")).count()


def test_layers_of_a_map(spark, work):
    got = W.layers_on_map(spark, str(work), most=SIDE)
    assert {(r.lago, str(r.fecha)) for r in got.select("lago", "fecha").distinct().collect()} <= {("atitlan", DAYS["atitlan"])}
    assert {"rojo", "verde", "azul", "alfa", "v"} <= set(got.columns)
