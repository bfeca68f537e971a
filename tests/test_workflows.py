"""The workflows from bands to tables, on a few synthetic scenes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.operators.scenes import InputDataError
from rasterloom.plans import workflows as W


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("work"))
    r = np.random.default_rng(0)
    rows = []
    for lago, fecha, *_ in [x for x in S.SCENES if x[1] >= "2026-02-01"]:
        for k in range(36):
            b = [float(v) for v in r.uniform(0.01, 0.12, 7)]
            rows.append((lago, fecha, k // 6, k % 6, 6 if k % 5 else 8, b[0], b[1] + 0.1, b[2], b[3], b[4] / 5, b[5] / 9, b[6] / 9))
    names = "lago string, fecha string, row int, col int, scl int, b02 double, b03 double, b04 double, b05 double, b08 double, b11 double, b12 double"
    spark.createDataFrame(rows, names).withColumn("fecha", F.to_date("fecha")).write.parquet(f"{folder}/bands")
    W.run_indices(spark, folder)
    return folder


def test_manifests(spark, work):
    assert W.prepare(spark, work).count() == 22 and W.plan(spark, work).count() == 22
    rows = W.tables.read_csv(spark, f"{work}/indices", S.INDEX_MANIFEST).collect()
    scenes = {(r.lago, r.fecha) for r in rows}
    assert len(rows) == 3 * len(scenes)
    assert {r.quality_flag for r in rows if str(r.fecha) == "2026-02-07"} == {S.PARTIAL}
    assert {r.quality_flag for r in rows if str(r.fecha) < "2026-02-01"} == {S.PENDING}
    assert len(rows) == 66
    lake = [r for r in rows if r.indice == "ndvi" and r.quality_flag != S.PENDING]
    assert all(r.pixeles_validos == r.pixeles_lago == 28 for r in lake)


def test_tables(spark, work):
    t = W.temporal(spark, work)
    assert t.columns == S.TEMPORAL_SUMMARY.names and t.count() > 10
    e = W.extent(spark, work)
    assert e.columns == S.BLOOM_EXTENT.names and e.where("pixeles_altos > pixeles_validos_lago").isEmpty()
    west = W.extent(spark, work, {z: [[(0, 0), (3, 0), (3, 6), (0, 6)]] for z in S.ZONES})
    assert west.agg(F.max("pixeles_validos_lago")).first()[0] <= 18
    assert W.persistence(spark, work).count() == 72


def test_correlations_and_comparison(spark, work):
    dates, zones = W.correlations(spark, work)
    assert dates.count() == 4 * W.temporal(spark, work).count() and zones.count() == 8
    c = {r.lago: r for r in W.comparison(spark, work).collect()}
    assert set(c) == set(S.ZONES) and c["atitlan"].correlacion_ndvi_pearson_mediana is not None
    assert W.distributions(spark, work).where("criterio_seleccion <> ''").count() >= 2
    assert {r.estacion for r in W.seasonal(spark, work).collect()} == {"seca", "lluviosa"}


def test_wrong_manifest_is_an_error(spark, tmp_path):
    rows = W.prepare(spark, str(tmp_path)).limit(3)
    W.tables.write_csv(rows, str(tmp_path / "other" / "scenes"))
    with pytest.raises(InputDataError):
        W.prepare(spark, str(tmp_path / "other"))
