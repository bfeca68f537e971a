from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.operators import checks, compare, correlate, render, scenes, series, spatial

SERIES = "lago string, fecha date, cyano_promedio double, quality_flag string"


def table(spark, rows, schema):
    cols = [c.split()[0] for c in schema.split(", ")]
    dates = [c.split()[0] for c in schema.split(", ") if c.endswith(" date")]
    df = spark.createDataFrame(rows, schema.replace(" date", " string"))
    return df.withColumns({c: F.to_date(c) for c in dates}).select(*cols) if dates else df


def test_summary_ignores_nodata(spark):
    r = scenes.summarize(table(spark, [("a", "2025-01-01", v) for v in (1.0, 3.0, None, None)], "lago string, fecha date, v double")).first()
    assert (r.pixeles_validos, r.pixeles_total, r.cobertura_valida_pct, r.media, r.mediana, r.desviacion) == (2, 4, 50.0, 2.0, 2.0, 1.0)


def test_extent_fixture_and_empty_scene(spark):
    rows = [("a", "2025-01-01", v) for v in (20.0, 5.0, None, 12.0)] + [("a", "2025-01-02", None)]
    a, b = scenes.extent(table(spark, rows, "lago string, fecha date, v double")).orderBy("fecha").collect()
    assert (a.pixeles_validos_lago, a.pixeles_altos, a.area_valida_m2, a.area_alta_m2) == (3, 2, 300.0, 200.0)
    assert (b.pixeles_validos_lago, b.porcentaje_alto) == (0, 0.0)


def test_threshold_is_inclusive(spark):
    df = table(spark, [("a", "2025-01-01", 10.0)], "lago string, fecha date, v double")
    assert scenes.extent(df).first().pixeles_altos == 1


def test_persistence_has_a_variable_denominator(spark):
    values = {(0, 0): (20, 20, None), (0, 1): (20, None, None), (1, 0): (20, 5, 20)}
    rows = [("a", f"2025-01-0{k + 1}", r, c, None if v is None else float(v)) for (r, c), vs in values.items() for k, v in enumerate(vs)]
    got = scenes.persistence(table(spark, rows, "lago string, fecha date, row int, col int, v double"), least_dates=2).orderBy("row", "col").collect()
    assert [(r.n_valido, r.proporcion if r.proporcion is None else round(r.proporcion, 4)) for r in got] == [(2, 1.0), (1, None), (3, 0.6667)]


def test_distribution_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=500).round(2)
    r = scenes.distribution(table(spark, [("a", "2025-01-01", float(v)) for v in x] + [("a", "2025-01-01", None)], "lago string, fecha date, v double")).first()
    assert [r[c] for c in scenes.QUANTILE_NAMES] == pytest.approx(np.percentile(x, [100 * q for q in scenes.QUANTILES]))
    assert (r.n_pixeles, r.media, r.desviacion_std) == (500, pytest.approx(x.mean()), pytest.approx(x.std()))


def test_peaks(spark):
    rows = [("a", f"2025-01-0{k}", v, S.COMPUTED) for k, v in enumerate((10.0, 11.0, 9.0, 50.0), 1)]
    rows += [("b", "2025-01-01", 10.0, S.COMPUTED), ("b", "2025-01-02", 10.0, S.COMPUTED), ("b", "2025-01-03", 300.0, S.PARTIAL), ("c", "2025-01-01", 10.0, S.COMPUTED)]
    got = {(r.lago, r.fecha.day): (r.es_pico, r.umbral_pico) for r in series.flag_peaks(table(spark, rows, SERIES)).collect()}
    assert [k for k, (p, _) in got.items() if p] == [("a", 4), ("b", 3)]
    assert got["b", 1][1] == 10.0 and got["c", 1] == (False, None)


def test_dates_merge_their_reasons(spark):
    rows = [("a", "2026-04-13", 1.0, S.COMPUTED), ("a", "2026-04-28", 9.0, S.COMPUTED), ("a", "2026-01-01", 2.0, S.PARTIAL)]
    ext = table(spark, [("a", "2026-04-28", 50.0), ("a", "2026-04-13", 50.0)], "lago string, fecha date, porcentaje_alto double")
    got = {str(r.fecha): r.criterio_seleccion for r in series.select_dates(table(spark, rows, SERIES), ext).collect()}
    assert got == {"2026-04-13": "fecha_comun_entre_lagos;mayor_extension;referencia_primera_fecha_completa", "2026-04-28": "pico_promedio_temporal"}


@settings(max_examples=12, deadline=None)
@given(n=st.integers(1, 400), m=st.integers(1, 60))
def test_sample_is_linspace(spark, n, m):
    got = [r.id for r in series.systematic_sample(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"], m).orderBy("id").collect()]
    want = list(range(n)) if n <= m else sorted({i * (n - 1) // (m - 1) for i in range(m)}) if m > 1 else [0]
    assert got == want


def test_correlations(spark):
    x = np.arange(20.0)
    rows = [("l", "2025-01-01", "ndvi", float(a), float(3 * a + 2)) for a in x] + [("k", "2025-01-01", "ndvi", 1.0, float(a)) for a in x] + [("s", "2025-01-01", "ndvi", 1.0, 2.0)]
    r = np.random.default_rng(2)
    xs, ys = r.integers(0, 5, 60), r.integers(0, 7, 60)
    rows += [("r", "2025-01-01", "ndvi", float(a), float(b)) for a, b in zip(xs, ys, strict=True)]
    got = {(q.lago, q.metodo): q for q in correlate.by_date(table(spark, rows, "lago string, fecha date, indice string, x double, y double")).collect()}
    assert got["l", "pearson"].coeficiente == got["l", "spearman"].coeficiente == 1.0
    assert got["k", "pearson"].coeficiente is None and got["s", "spearman"].p_value == ""
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got["r", "spearman"].coeficiente == pytest.approx(np.corrcoef(rank(xs), rank(ys))[0, 1], abs=1e-8)


def test_upper_median_and_season(spark):
    rows = [("a", d, v, S.COMPUTED) for d, v in (("2025-01-01", 2.0), ("2025-02-01", 4.0), ("2025-06-01", 10.0))]
    got = {r.estacion: r for r in compare.seasonal(table(spark, rows, SERIES)).collect()}
    assert (got["seca"].n_fechas, got["seca"].cyano_promedio, got["seca"].cyano_mediana, got["seca"].cyano_std) == (2, 3.0, 4.0, 1.0)
    assert got["lluviosa"].n_fechas == 1 and got["seca"].fechas == "2025-01-01;2025-02-01"


def test_zone_comparison_and_empty_extent(spark):
    rows = [("a", "2025-01-01", 2.0, S.COMPUTED), ("a", "2025-02-01", 12.0, S.COMPUTED), ("a", "2025-03-01", 8.0, S.PARTIAL)]
    s = table(spark, rows, SERIES)
    none = spark.createDataFrame([], "lago string, indice string, metodo string, coef_mediana double")
    held = spark.createDataFrame([("a", 1.0, 0.5)], "lago string, pct_alguna_vez double, pct_persistente double")
    ext = table(spark, [("a", "2025-01-01", 5.0), ("a", "2025-02-01", 60.0)], "lago string, fecha date, porcentaje_alto double")
    r = compare.zone_comparison(s, ext, held, none).first()
    assert (r.n_fechas_total, r.n_fechas_calculado, r.frecuencia_fechas_sobre_umbral, str(r.fecha_porcentaje_alto_maximo), r.tendencia_temporal) == (3, 2, 1, "2025-02-01", "creciente")
    assert compare.zone_comparison(s, ext.limit(0), held, none).first().porcentaje_alto_maximo is None


def test_change_map(spark):
    rows = [("a", "2025-01-01", 0, 0, 1.0), ("a", "2025-02-01", 0, 0, 4.0), ("a", "2025-01-01", 0, 1, 1.0), ("a", "2025-02-01", 0, 1, None)]
    d, scale = render.change_map(table(spark, rows, "lago string, fecha date, row int, col int, v double"), "2025-01-01", "2025-02-01")
    assert [r.diferencia for r in d.collect()] == [3.0] and scale.first().vmax == 3.0


def test_inside_with_a_hole_and_area(spark):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]
    assert spatial.area([outer, hole]) == 15
    grid = spark.range(16).select((F.col("id") % 4 + 0.5).alias("x"), (F.floor(F.col("id") / 4) + 0.5).alias("y"))
    assert grid.where(spatial.inside(F.col("x"), F.col("y"), [outer, hole])).count() == 15
    west = grid.where(spatial.inside(F.col("x"), F.col("y"), [[(0, 0), (2, 0), (2, 4), (0, 4)]]))
    assert {r.x for r in west.collect()} == {0.5, 1.5}


def test_utm(spark):
    e, n = spatial.to_utm(F.lit(-93.0), F.lit(0.0))
    assert spark.range(1).select(e, n).first()[:] == pytest.approx((500000.0, 0.0), abs=1e-6)
    p = spark.createDataFrame([(-91.2, 14.7), (-90.5, 14.4)], "lon double, lat double")
    e, n = spatial.to_utm(F.col("lon"), F.col("lat"))
    q = p.withColumns({"e": e, "n": n})
    lon, lat = spatial.from_utm(F.col("e"), F.col("n"))
    for r in q.withColumns({"a": lon, "b": lat}).collect():
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-9)


def test_utm_and_back_far_from_the_meridian(spark):
    points = [(k * 7.3 - 93.0, lat) for k in range(-10, 60) for lat in (14.4, 52.0)] + [(-91.2, None)]
    p = spark.createDataFrame([(float(x), y) for x, y in points], "lon double, lat double")
    e, n = spatial.utm_points(F.col("lon"), F.col("lat"))
    near = p.where("abs(lon + 93) < 30 AND lat IS NOT NULL").select(e, n, *spatial.to_utm(F.col("lon"), F.col("lat"))).collect()
    assert len(near) == 18 and all(r[:2] == pytest.approx(r[2:], abs=1e-6) for r in near)
    q = p.withColumns({"e": e, "n": n})
    lon, lat = spatial.from_utm(F.col("e"), F.col("n"))
    *rows, last = q.select("lon", "lat", "e", lon.alias("a"), lat.alias("b"), spatial.turned(lon, F.col("lon")).alias("d")).collect()
    assert max(r.d for r in rows) < 1e-10 and max(abs(r.b - r.lat) for r in rows) < 1e-10
    assert (last.e, last.a, last.b) == (None, None, None)


def test_bilinear_shares_the_weight_of_nodata(spark):
    src = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("a", 1, 0, None)], "lago string, row int, col int, v double")
    to = spark.createDataFrame([("a", 0, 0), ("a", 5, 5)], "lago string, row int, col int")
    got = {r.row: r.v for r in spatial.align_bilinear(src, to, ["lago"], F.col("row") + 0.5, F.col("col") + 0.5).collect()}
    assert got == {0: 2.0, 5: None}


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "v double")
    assert {r.bin: r.n for r in spatial.histogram(df, "v", 0.0, 1.0, 2).collect()} == {0: 1, 1: 2}


def test_checks(spark):
    assert checks.configuration() == []
    assert checks.expected_scenes(spark).count() == 22 and checks.expected_indices(spark).count() == 66
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.lado) for r in checks.key_differences(a, b, ["k"]).collect()} == {(1, "falta"), (3, "sobra")}
    with pytest.raises(scenes.InputDataError):
        scenes.select_scenes(checks.expected_scenes(spark), "nowhere")
    with pytest.raises(scenes.InputDataError):
        checks.guard_batch(2, confirmed=False)


def test_update_rows(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], "k int, f string")
    assert {(r.k, r.f) for r in compare.update_rows(m, spark.createDataFrame([(2, "c")], "k int, f string"), ["k"]).collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(KeyError):
        compare.update_rows(m, spark.createDataFrame([(2, "c")], "k int, g string"), ["k"])
    with pytest.raises(ValueError):
        compare.update_rows(m, spark.createDataFrame([(9, "c")], "k int, f string"), ["k"])


def test_grid_consistency(spark):
    rows = [("a", "2025-01-01", 1), ("a", "2025-01-02", 2), ("a", "2025-01-03", 1)]
    df = table(spark, rows, "lago string, fecha date, w int").withColumn("grid", F.struct("w"))
    assert [str(r.fecha) for r in compare.reference_grid(df).collect()] == ["2025-01-02"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0, 30)), min_size=1, max_size=30))
def test_extent_bounds(spark, values):
    r = scenes.extent(table(spark, [("a", "2025-01-01", v) for v in values], "lago string, fecha date, v double")).first()
    assert 0 <= r.pixeles_altos <= r.pixeles_validos_lago <= len(values) and 0 <= r.porcentaje_alto <= 100 and math.isfinite(r.porcentaje_alto)


def test_warp_keeps_a_plane(spark):
    # v is the easting in kilometres, so that the warped value tells the target's easting
    src = spark.range(60 * 60).select(F.lit("a").alias("lago"), (F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"))
    src = src.withColumn("v", (700000 + (F.col("col") + 0.5) * 100) / 1000)
    got = spatial.warp_wgs84(src, ["lago"], (700000.0, 1600000.0), 100.0, (-91.13, -91.11, 14.43, 14.45), 40, 40, most=10)
    rows = got.where("v IS NOT NULL").collect()
    assert got.count() == 100 and len(rows) > 50
    for r in rows[:20]:
        e, _ = spatial.to_utm(F.lit(-91.13 + (r.col + 0.5) * 0.002), F.lit(14.45 - (r.row + 0.5) * 0.002))
        assert spark.range(1).select(e).first()[0] / 1000 == pytest.approx(r.v, abs=1e-3)


def test_uneven_grids(spark):
    rows = [("a", "2025-01-01", i, w) for i, w in zip(S.INDICES, (1, 1, 2), strict=True)] + [("b", "2025-01-01", i, 1) for i in S.INDICES] + [("c", "2025-01-01", "ndvi", 1)]
    df = table(spark, rows, "lago string, fecha date, indice string, w int").withColumn("grid", F.struct("w"))
    assert {r.lago: (r.n_mallas, r.n_indices) for r in checks.uneven_grids(df).collect()} == {"a": (2, 3), "c": (1, 1)}
