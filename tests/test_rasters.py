"""From raster files to the comparison of zones, within outlines; formats, manifests, command line."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom import schema as S
from rasterloom.operators import checks, render, scenes, spatial
from rasterloom.operators.scenes import InputDataError
from rasterloom.plans import workflows as W
from rasterloom.sources import geotiff, remote, tables

SIDE = 24
GRID = {z: {"crs": 32615, "transform": (x, y, 10.0, 10.0), "width": SIDE, "height": SIDE} for z, (x, y) in {"atitlan": (690000.0, 1620000.0), "amatitlan": (760000.0, 1600000.0)}.items()}


def lzw(data: bytes) -> bytes:
    """A plain encoder: each byte by itself, with a new table before the codes would widen."""
    codes = []
    for k, b in enumerate(data):
        if k % 200 == 0:
            codes.append(256)
        codes.append(b)
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_lzw():
    data = bytes(np.random.default_rng(0).integers(0, 7, 1000, dtype=np.uint8))
    assert geotiff.unlzw(lzw(data)) == data
    # a phrase that is used while it is made (k w k), at the first widths
    assert geotiff.unlzw(int("".join(f"{c:09b}" for c in (256, 65, 258, 259, 257)) + "000", 2).to_bytes(6, "big")) == b"AAAAAA"
    with pytest.raises(InputDataError):
        geotiff.unlzw(int("".join(f"{c:09b}" for c in (256, 300)) + "000000", 2).to_bytes(3, "big"))


def test_big_tiff():
    data = np.arange(12, dtype="<u2").reshape(3, 4)
    body = zlib.compress(data.tobytes())
    fields = [(256, 4, 4), (257, 4, 3), (258, 3, 16), (259, 3, 8), (277, 3, 1), (278, 4, 3)]
    head = 16 + 8 + 20 * 8 + 8
    fields = sorted([*fields, (273, 16, head), (279, 16, len(body))])
    raw = b"II+\0" + struct.pack("<HHQ", 8, 0, 16) + struct.pack("<Q", len(fields))
    for tag, kind, value in fields:
        raw += struct.pack("<HHQ", tag, kind, 1) + struct.pack({3: "<H6x", 4: "<I4x", 16: "<Q"}[kind], value)
    raw += b"\0" * 8 + body
    assert (geotiff.decode(raw).data[0] == data).all()
    with pytest.raises(InputDataError):
        geotiff.decode(b"II")


def test_bands_by_description():
    a = np.arange(8, dtype=np.float32).reshape(2, 2, 2)
    r = geotiff.decode(geotiff.encode(geotiff.Raster(a, 32615, bands=["B08", "B04 & x"], tags={"a": "<b>"})))
    assert r.bands == ["B08", "B04 & x"] and r.tags == {"a": "<b>"}
    assert (geotiff.load_bands({"x.tif": r}, ["B08"])["B08"] == a[0]).all()


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    """A work folder with rasters for the scenes of 2026: one file of all bands, or two files."""
    folder = tmp_path_factory.mktemp("rasters")
    (folder / "rasters").mkdir()
    rng = np.random.default_rng(1)
    rows = []
    for zone, day, *_ in S.SCENES:
        paths = []
        if day >= "2026-02-01":
            data = rng.uniform(0.01, 0.12, (8, SIDE, SIDE)).astype(np.float32)
            data[1] += 0.1  # green over near infrared: water by its index
            data[7] = np.where(np.arange(SIDE) % 5 == 0, 8, 6)
            data[2, 0, 1] = np.nan
            names = list(W.BANDS)
            order = rng.permutation(8)
            parts = [order] if zone == "atitlan" else [order[:3], order[3:]]
            for k, part in enumerate(parts):
                paths.append(f"{zone}_{day}_{k}.tif")
                g = GRID[zone]["transform"]
                raster = geotiff.Raster(data[part], 32615, g[:2], g[2:], float("nan"), bands=[names[i] for i in part])
                (folder / "rasters" / paths[-1]).write_bytes(geotiff.encode(raster))
        rows.append((zone, day, ";".join(paths)))
    full = W.prepare(spark, str(folder / "first"))
    paths = spark.createDataFrame(rows, "lago string, d string, p string").select("lago", F.to_date("d").alias("fecha"), "p")
    tables.write_csv(full.join(paths, ["lago", "fecha"]).withColumn("ruta_local", F.col("p")).select(*S.SCENE_MANIFEST.names), str(folder / "scenes"), "errorifexists", 1)
    grids = [(z, 32615, *g["transform"][:3], SIDE, SIDE) for z, g in GRID.items()]
    tables.write_csv(spark.createDataFrame(grids, S.GRIDS), str(folder / "grids"), "errorifexists", 1)
    points = []
    for z, g in GRID.items():
        x, y, step, _ = g["transform"]
        ring = [(x, y), (x + step * 12, y), (x + step * 12, y - step * SIDE), (x, y - step * SIDE)]  # the west half
        points += [(z, 0, k, float(a), float(b)) for k, (a, b) in enumerate([*ring, ring[0]])]
    df = spark.createDataFrame(points, "lago string, ring int, k int, e double, n double")
    lon, lat = spatial.from_utm(F.col("e"), F.col("n"))
    tables.write_geojson(df.select("lago", "ring", "k", lon.alias("x"), lat.alias("y")), str(folder / "outlines"))
    return str(folder)


def test_from_rasters_to_the_comparison(spark, work):
    assert W.run_all(spark, work) == list(W.TABLES)
    assert W.run_all(spark, work) == []
    bands = spark.read.parquet(f"{work}/bands")
    assert bands.count() == bands.select("lago", "fecha", "row", "col").distinct().count() == 13 * SIDE * SIDE - (13 - bands.select("lago", "fecha").distinct().count()) * SIDE * SIDE
    one = geotiff.decode(open(f"{work}/rasters/atitlan_2026-04-13_0.tif", "rb").read())
    want = one.values(one.bands.index("B05"))
    got = {(r.row, r.col): r.b05 for r in bands.where("lago = 'atitlan' AND fecha = '2026-04-13'").collect()}
    assert all(got[i, j] == pytest.approx(want[i, j]) for i in range(SIDE) for j in range(SIDE))
    assert bands.where("b04 IS NULL").count() == bands.select("lago", "fecha").distinct().count()
    rings = W.zone_outlines(spark, work)
    assert [(round(a, 3), round(b, 3)) for a, b in rings["atitlan"][0]] == [(0, 0), (12, 0), (12, SIDE), (0, SIDE), (0, 0)]
    inside = spark.read.parquet(f"{work}/tables/extent").agg(F.max("pixeles_validos_lago")).first()[0]
    assert 0 < inside <= SIDE * 12
    rows = {r.lago: r for r in spark.read.parquet(f"{work}/tables/comparison").collect()}
    assert set(rows) == set(S.ZONES) and all(r.pct_area_alguna_vez_alta is not None for r in rows.values())
    assert spark.read.parquet(f"{work}/tables/maps").count() == 3 * bands.select("lago", "fecha").distinct().count()


def test_persistence_rasters_have_their_place_and_tags(spark, work, tmp_path):
    W.run_all(spark, work)
    W.export_persistence(spark, work, str(tmp_path / "p"))
    r = geotiff.decode((tmp_path / "p" / "atitlan_proporcion_alto.tif").read_bytes())
    assert r.grid == GRID["atitlan"] and r.tags["unidad"] == "fraccion_0_1" and r.description == "proporcion_alto"
    found = W.persistence(spark, work).where("lago = 'atitlan' AND proporcion IS NOT NULL").collect()
    assert found and all(r.data[0, x.row, x.col] == pytest.approx(x.proporcion) for x in found)
    assert np.isnan(r.data[0, 3, 20])  # out of the outline


def test_missing_rasters_are_errors(spark, work):
    rows = W.prepare(spark, work).where("fecha = '2026-04-13'")
    with pytest.raises(InputDataError, match="no such raster"):
        geotiff.read_bands(spark, rows.withColumn("ruta_local", F.lit("none.tif")), W.BANDS, f"{work}/rasters")
    with pytest.raises(InputDataError, match="no raster declared"):
        geotiff.read_bands(spark, rows.withColumn("ruta_local", F.lit("")), W.BANDS, f"{work}/rasters")
    with pytest.raises(Exception, match="no band"):
        geotiff.read_bands(spark, rows, [*W.BANDS, "B99"], f"{work}/rasters").collect()


def test_manifests_are_validated(spark, work, tmp_path):
    W.run_all(spark, work)
    assert cli.main(["prepare", work]) == cli.main(["check-grid", work]) == 0
    assert W.validate(spark, work).isEmpty() and cli.main(["validate", work]) == 0
    bad = W.prepare(spark, work).limit(21).drop("estado")
    tables.write_csv(bad, str(tmp_path / "scenes"))
    assert {r.problema for r in W.validate(spark, str(tmp_path)).collect()} == {"columna faltan", "clave falta"}
    assert cli.main(["validate", str(tmp_path)]) == 2


def test_command_line_of_services(tmp_path, monkeypatch, capsys):
    for k in ("TOKEN_URL", "CLIENT", "SECRET", "OUTLINE_URL", "PROCESS_URL"):
        monkeypatch.setenv(f"RASTERLOOM_{k}", "http://x")
    (tmp_path / "s.js").write_text("//")
    monkeypatch.setenv("RASTERLOOM_SCRIPT", str(tmp_path / "s.js"))
    ring = [{"lon": a, "lat": b} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]

    def send(url, data, headers, timeout):
        if b"grant_type" in data:
            return b'{"access_token": "t"}'
        return b"tif" if headers.get("Authorization") else json.dumps({"elements": [{"type": "way", "geometry": ring}]}).encode()

    assert cli.remote_action("check-connection", None, None, None, send) == "token received"
    target = cli.remote_action("fetch-boundary", "atitlan", str(tmp_path / "a.json"), None, send)
    assert json.load(open(target))["features"][0]["properties"]["lago"] == "atitlan"
    got = cli.remote_action("fetch-cyano", "atitlan", "2026-04-13", str(tmp_path), send)
    assert open(got, "rb").read() == b"tif"
    with pytest.raises(InputDataError, match="confirmation"):
        cli.remote_action("fetch-cyano", "atitlan", "all", str(tmp_path), send)

    class Client:
        def bands(self):
            return W.BANDS

        def download(self, box, day, bands, folder):
            return [f"{folder}/x.tif"]

    assert cli.remote_action("download", "atitlan", "2026-04-13", str(tmp_path), send, Client).endswith("x.tif")
    with pytest.raises(InputDataError):
        cli.remote_action("fetch-boundary", "nowhere", "x", None, send)
    monkeypatch.delenv("RASTERLOOM_CLIENT")
    assert cli.main(["check-connection"]) == 2 and "missing" in capsys.readouterr().err
    with pytest.raises(remote.RemoteError):
        remote.http("http://127.0.0.1:9/none", b"", {}, 1)


@pytest.mark.parametrize("n", [1, 5, 5000])
def test_quantiles_are_exact(spark, monkeypatch, n):
    monkeypatch.setattr(scenes, "BINS", 16)
    x = np.round(np.random.default_rng(n).normal(size=n) ** 3, 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    shares = (0.0, 0.01, 0.5, 0.98, 1.0)
    assert scenes.quantiles(df, "v", shares) == pytest.approx(np.quantile(x, shares).tolist())
    assert scenes.quantiles(df.where("v IS NULL"), "v", shares) is None


def test_deviation_of_large_values(spark):
    x = 1e9 + np.random.default_rng(0).normal(size=500)
    df = spark.createDataFrame([("a", "b", float(v)) for v in x], "lago string, fecha string, v double")
    assert scenes.distribution(df).first().desviacion_std == pytest.approx(x.std(), rel=1e-6)


def test_lookups(spark):
    rows = checks.expected_indices(spark).withColumn("ruta_raster", F.when(F.col("fecha") > "2026-04-01", "x").otherwise("")).withColumn("quality_flag", F.lit(S.COMPUTED))
    assert [str(r.fecha) for r in scenes.ready_of(rows, "atitlan").collect()] == ["2026-04-13", "2026-04-28", "2026-07-22"]
    assert scenes.lookup(rows, "atitlan", "2026-04-13").count() == 1
    for call in (lambda: scenes.lookup(rows, "atitlan", "2026-03-24"), lambda: scenes.lookup(rows, "atitlan", "1999-01-01"), lambda: scenes.ready_of(rows.where("ruta_raster = ''"), "atitlan"), lambda: scenes.of_index(rows, "evi")):
        with pytest.raises(InputDataError):
            call()


def test_shifted_grids_and_layers(spark):
    cells = spark.createDataFrame([("z", r, c, float(r * 10 + c)) for r in range(4) for c in range(4)], "lago string, row int, col int, v double")
    a = {"crs": 1, "transform": (0.0, 0.0, 10.0, 10.0), "width": 4, "height": 4}
    b = a | {"transform": (5.0, -10.0, 10.0, 10.0)}  # half a cell east, one cell south
    got = {(r.row, r.col): r.v for r in spatial.align(cells, cells.select("lago", "row", "col"), ["lago"], a, b).collect()}
    assert got[0, 0] == 10.5 and got[3, 0] is None
    out = render.layers(cells, ["lago"], a | {"transform": (500000.0, 1600000.0, 10.0, 10.0)}, (-93.0, -92.9996, 14.4710, 14.4714), 0, 40)
    assert out.columns[-4:] == ["rojo", "verde", "azul", "alfa"] and out.count() == 16


def test_rings_are_cleaned():
    a, b, c, d = (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 2.0)
    assert remote.cleaned([a, b, b, c, d, c, a]) == [a, b, c, a]
    assert remote.cleaned([a, b, a]) == [] and remote.cleaned([]) == []


def test_folders_and_boxes(spark, work, tmp_path):
    assert geotiff.inspect_folder(spark, f"{work}/rasters").count() > 10
    with pytest.raises(InputDataError):
        (tmp_path / "none").mkdir()
        geotiff.inspect_folder(spark, str(tmp_path / "none"))
    W.prepare(spark, str(tmp_path / "w"))
    box = spark.read.text(str(tmp_path / "w" / "boxes")).where("lago = 'atitlan'").first().value
    assert json.loads(box)["features"][0]["geometry"]["coordinates"][0][0] == [-91.326256, 14.5948]
    tables.write_geojson(spark.createDataFrame([("atitlan", 0, k, float(k), 1.0) for k in range(4)], "lago string, ring int, k int, x double, y double"), str(tmp_path / "w2" / "boxes"))
    with pytest.raises(InputDataError, match="not overwritten"):
        W.prepare(spark, str(tmp_path / "w2"))


def test_formulas_and_collections(spark):
    from rasterloom.functions import indices as M

    M.register("doble", ["b04"], lambda red: 2 * red)
    try:
        df = spark.createDataFrame([(1.5, 0.5), (float("nan"), 0.5)], "b04 double, b08 double")
        got = df.select(M.formula("doble").alias("d"), M.formula("ndvi").alias("v")).collect()
        assert [(r.d, r.v) for r in got] == [(3.0, -0.5), (None, None)]
        with pytest.raises(ValueError, match="exists"):
            M.register("doble", [], None)
    finally:
        del M.FORMULAS["doble"]

    class Client:
        def bands(self):
            return ["B04", "B03"]

    assert remote.inspect_collection(Client, ["B03", "B99"]) == {"ofrecidas": ["B03", "B04"], "faltan": ["B99"]}
