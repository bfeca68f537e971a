"""Versioned manifests: updates, conflicts, scenes that register themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.operators.scenes import InputDataError
from rasterloom.plans import workflows as W
from rasterloom.sources import geotiff, manifests

KEYS = ["lago", "fecha"]


@pytest.fixture
def path(spark, tmp_path):
    W.prepare(spark, str(tmp_path))
    return f"{tmp_path}/scenes"


def change(spark, state, day="2026-04-13", **more):
    return spark.range(1).select(F.lit("atitlan").alias("lago"), F.to_date(F.lit(day)).alias("fecha"), F.lit(state).alias("estado"), *(F.lit(v).alias(k) for k, v in more.items()))


def states(spark, path):
    return {(r.lago, str(r.fecha)): r.estado for r in manifests.read(spark, path, S.SCENE_MANIFEST).collect()}


def test_updates_are_new_versions(spark, path):
    assert manifests.version(spark, path) == 0
    assert manifests.update(spark, path, S.SCENE_MANIFEST, KEYS, change(spark, "descargado")) == 1
    assert manifests.update(spark, path, S.SCENE_MANIFEST, KEYS, change(spark, "otro", "2026-04-28")) == 2
    got = states(spark, path)
    assert (got["atitlan", "2026-04-13"], got["atitlan", "2026-04-28"], len(got)) == ("descargado", "otro", 22)
    assert manifests.location(spark, path, 1).endswith("/1") and manifests.location(spark, path, 0) == path
    with pytest.raises(KeyError):
        manifests.update(spark, path, S.SCENE_MANIFEST, KEYS, change(spark, "x", nada="y"))
    with pytest.raises(ValueError, match="keys"):
        manifests.update(spark, path, S.SCENE_MANIFEST, KEYS, change(spark, "x", "1999-01-01"))

    def refuse(new):
        raise InputDataError("no")

    with pytest.raises(InputDataError):
        manifests.update(spark, path, S.SCENE_MANIFEST, KEYS, change(spark, "x"), refuse)
    assert manifests.version(spark, path) == 2


def test_two_writers_lose_no_row(spark, path):
    """The second writer starts anew from the first one's version."""
    calls = []

    def meanwhile(new):
        calls.append(1)
        if len(calls) == 1:
            manifests.update(spark, path, S.SCENE_MANIFEST, KEYS, change(spark, "primero", "2026-04-28"))

    assert manifests.update(spark, path, S.SCENE_MANIFEST, KEYS, change(spark, "segundo"), meanwhile) == 2 and len(calls) == 2
    got = states(spark, path)
    assert (got["atitlan", "2026-04-28"], got["atitlan", "2026-04-13"]) == ("primero", "segundo")


def test_claims_and_unfinished_versions(spark, path, tmp_path):
    (tmp_path / "scenes.versions" / "1").mkdir(parents=True)
    (tmp_path / "scenes.versions" / "1" / "part-0.csv").write_text("half")
    (tmp_path / "scenes.versions" / "1.claim").write_text("")
    assert manifests.version(spark, path) == 0 and len(states(spark, path)) == 22  # not committed: not read
    with pytest.raises(manifests.Conflict):
        manifests.update(spark, path, S.SCENE_MANIFEST, KEYS, change(spark, "x"))
    with pytest.raises(InputDataError):
        manifests.update(spark, str(tmp_path / "none"), S.SCENE_MANIFEST, KEYS, change(spark, "x"))


def test_downloaded_scenes_register_and_compute(spark, tmp_path):
    """Files that a download left in <zone>/<date> are declared, computed, and both manifests tell so."""
    W.prepare(spark, str(tmp_path))
    folder = tmp_path / "rasters" / "atitlan" / "2026-04-13"
    folder.mkdir(parents=True)
    bands = np.stack([np.full((4, 4), v, np.float32) for v in (0.1, 0.05, 0.02, 6.0)])
    bands[0, 0, 0] = np.nan
    (folder / "l2a.tif").write_bytes(geotiff.encode(geotiff.Raster(bands, 32615, (690000.0, 1620000.0), (10.0, 10.0), float("nan"), bands=list(S.LEAST_BANDS))))
    (folder / "cyano_ndci_l1c.tif").write_bytes(geotiff.encode(geotiff.Raster(np.full((1, 4, 4), 3, np.float32), 32615, (690000.0, 1620000.0), (10.0, 10.0), float("nan"))))
    assert W.run_indices(spark, str(tmp_path)) == 1
    row = manifests.read(spark, f"{tmp_path}/scenes", S.SCENE_MANIFEST).where("estado = 'descargado'").collect()
    assert len(row) == 1 and (row[0].crs_salida, row[0].resolucion_salida, row[0].cobertura_valida_pct) == ("EPSG:32615", "10", 93.75)
    assert row[0].ruta_local.endswith("/rasters/atitlan/2026-04-13/l2a.tif")
    done = manifests.read(spark, f"{tmp_path}/indices", S.INDEX_MANIFEST).where(F.col("quality_flag") != S.PENDING)
    assert {(r.indice, r.pixeles_validos) for r in done.collect()} == {("ndvi", 15), ("ndwi", 15), ("cianobacteria", 16)}
    assert W.run_indices(spark, str(tmp_path)) == 0
    dates, zones = W.correlation_tables(spark, str(tmp_path))
    assert dates.schema.names == S.CORRELATION_BY_DATE.names and zones.schema.names == S.CORRELATION_BY_ZONE.names
    r = dates.collect()
    assert {x.quality_flag_cianobacteria for x in r} == {x.quality_flag_indice for x in r} == {S.COMPUTED} and {x.nota_inferencia for x in r} == {S.DATE_NOTE}
    assert {x.nota_inferencia for x in zones.collect()} <= {S.ZONE_NOTE}
