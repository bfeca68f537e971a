from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.operators.scenes import InputDataError
from rasterloom.sources import geotiff, remote, tables
from rasterloom.streaming import arrivals


@pytest.mark.parametrize("kind", [np.uint8, np.int16, np.uint16, np.float32, np.float64])
def test_raster_round_trip(kind):
    a = (np.random.default_rng(0).normal(size=(2, 130, 70)) * 100).astype(kind)
    x = geotiff.Raster(a, 32615, (5.0, 6.0), (10.0, 10.0), None, "b", {"unidad": "ug"})
    y = geotiff.decode(geotiff.encode(x))
    assert (y.data == a).all() and y.grid == x.grid and y.tags == x.tags and y.description == "b"


def test_integer_raster_with_nodata(spark, tmp_path):
    a = np.array([[[1, 2], [3, -9999]]], np.int16)
    (tmp_path / "x.tif").write_bytes(geotiff.encode(geotiff.Raster(a, 32615, nodata=-9999.0)))
    r = geotiff.inspect(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (r.validos, r.total, r.cobertura_valida_pct, r.crs) == (3, 4, 75.0, 32615)
    assert geotiff.read_pixels(spark, str(tmp_path)).where("v IS NULL").count() == 1


def test_data_source_reads_and_writes(spark, tmp_path):
    spark.dataSource.register(geotiff.GeoTiffSource)
    rows = [("s.tif", 1, 0, 0, 1.5), ("s.tif", 1, 1, 2, 2.5)]
    df = spark.createDataFrame(rows, "path string, band int, row int, col int, value double").repartition("path")
    df.write.format("geotiff").mode("append").save(str(tmp_path / "out"))
    got = spark.read.format("geotiff").load(str(tmp_path / "out")).select("row", "col", "value").orderBy("row").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1.5), (1, 2, 2.5)]
    with pytest.raises(Exception, match="exists"):
        df.write.format("geotiff").mode("append").save(str(tmp_path / "out"))


def test_scenes_to_rasters(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, None), ("b", 0, 0, 2.0)], "lago string, row int, col int, v double")
    got = {r.lago: geotiff.decode(bytes(r.content)).values() for r in geotiff.encode_scenes(df, ["lago"]).collect()}
    assert got["a"].shape == (2, 2) and np.isnan(got["a"][1, 1]) and got["b"][0, 0] == 2.0


def test_bands_by_position_and_name():
    r = lambda k: geotiff.Raster(np.full((1, 1, 1), k, np.int16))
    two = geotiff.Raster(np.arange(2, dtype=np.int16).reshape(2, 1, 1))
    assert geotiff.load_bands({"x": two}, ["B03", "B04"])["B04"][0, 0] == 1
    assert geotiff.load_bands({"s_B03.tif": r(3), "s_B04.tif": r(4)}, ["B04"])["B04"][0, 0] == 4
    with pytest.raises(InputDataError):
        geotiff.load_bands({"s_B03.tif": r(3), "t_B03.tif": r(4)}, ["B03"])


def test_csv_is_typed_and_checked(spark, tmp_path):
    df = spark.createDataFrame([("a", "2025-01-01", 1.5, None)], "lago string, fecha string, cyano_promedio double, cyano_mediana double")
    for c in ("cyano_std", "pixeles_validos", "cobertura_valida_pct", "quality_flag"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    tables.write_csv(df, str(tmp_path / "t"))
    got = tables.read_csv(spark, str(tmp_path / "t"), S.TEMPORAL_SUMMARY).first()
    assert (got.cyano_promedio, got.cyano_mediana, str(got.fecha)) == (1.5, None, "2025-01-01")
    with pytest.raises(InputDataError):
        tables.read_csv(spark, str(tmp_path / "t"), S.BLOOM_EXTENT)


def test_outlines(spark, tmp_path):
    rings = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]]
    (tmp_path / "o.geojson").write_text(tables.outline_geojson("a", rings))
    got = tables.read_outlines(spark, str(tmp_path / "o.geojson")).collect()
    assert len(got) == 9 and {r.ring for r in got} == {0, 1}


def test_remote_clients(tmp_path):
    way = {"type": "way", "geometry": [{"lon": x, "lat": y} for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]}
    outer = [[(0, 0), (3, 0), (3, 3)], [(3, 3), (0, 3), (0, 0)]]
    geo = lambda s: [{"lon": x, "lat": y} for x, y in s]
    relation = {"type": "relation", "members": [{"role": "outer", "geometry": geo(s)} for s in outer] + [{"role": "inner", "geometry": way["geometry"]}]}
    asked = []

    def send(url, body, headers, timeout):
        asked.append(body)
        return json.dumps({"elements": [] if b'"first"' in body else [way, relation], "access_token": "t"}).encode()

    rings = remote.fetch_outline(send, "u", ["first", "second"], S.ZONES["atitlan"])
    assert len(asked) == 2 and len(rings) == 2
    assert remote.token(send, "u", "c", "s") == "t"
    with pytest.raises(remote.RemoteError):
        remote.fetch_outline(send, "u", ["first"], S.ZONES["atitlan"])
    target = str(tmp_path / "x.tif")
    remote.fetch_layer(send, "u", "t", {}, target)
    n = len(asked)
    remote.fetch_layer(send, "u", "t", {}, target)
    assert os.path.exists(target) and len(asked) == n


def test_streamed_extent(spark, tmp_path):
    src = spark.sql("SELECT timestamp'2025-01-01 10:00:00' + make_interval(0,0,0,CAST(id AS INT)) AS ts, 'a' AS lago, CAST(id * 5 AS DOUBLE) AS v FROM range(6)")
    src.write.parquet(str(tmp_path / "in"))
    stream = arrivals.read_arrivals(spark, str(tmp_path / "in"), src.schema)
    arrivals.start(arrivals.windowed_extent(stream, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {str(r.inicio)[:10]: (r.n_valido, r.n_alto) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2025-01-01"] == (1, 0) and got["2025-01-04"] == (1, 1) and len(got) == 5
