"""Registered queries of the engine's own operators, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions import indices as M
from rasterloom.operators import checks, compare, correlate, render, scenes, series, spatial
from rasterloom.plans import analogs as A
from rasterloom.plans.analogs import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name; ``sql`` follows the WITH clause of ``views``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (with_views(*views) if views else "") + sql
        return f

    return add


def text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def r6(c: str, to: str | None = None) -> Column:
    return F.round(F.col(c), 6).alias(to or c)


_SUMMARY = "count(v) AS pixeles_validos, count(*) AS pixeles_total, round(100.0 * count(v) / count(*), 4) AS cobertura_valida_pct, round(min(v), 6) AS minimo, round(max(v), 6) AS maximo, round(avg(v), 6) AS media, round(quantile_cont(v, 0.5), 6) AS mediana, round(stddev_pop(v), 6) AS desviacion"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


@query(f"SELECT lago, CAST(fecha AS VARCHAR) AS fecha, {_SUMMARY} FROM obs GROUP BY lago, fecha", "obs")
def scene_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.summarize(A.obs(spark, sf))
    return _rounded(out, "minimo", "maximo", "media", "mediana", "desviacion").withColumn("fecha", text("fecha"))


@query("SELECT lago, CAST(fecha AS VARCHAR) AS fecha, round(cyano_promedio, 6) AS cyano_promedio, quality_flag FROM series ORDER BY lago, fecha", "obs", "series")
def temporal_series(spark: SparkSession, sf: str) -> DataFrame:
    return A.series(spark, sf).orderBy("lago", "fecha").select("lago", text("fecha"), r6("cyano_promedio"), "quality_flag")


@query(
    f""", t AS (SELECT lago, count(*) AS n, avg(cyano_promedio) + stddev_pop(cyano_promedio) AS u FROM series WHERE quality_flag = '{S.COMPUTED}' GROUP BY lago)
SELECT s.lago, CAST(fecha AS VARCHAR) AS fecha, CASE WHEN n >= 2 THEN round(u, 4) END AS umbral_pico, coalesce(n >= 2 AND cyano_promedio > u, false) AS es_pico FROM series s LEFT JOIN t USING (lago)""",
    "obs", "series",
)
def flag_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return series.flag_peaks(A.series(spark, sf)).select("lago", text("fecha"), "umbral_pico", "es_pico")


@query("SELECT * REPLACE (CAST(fecha AS VARCHAR) AS fecha) FROM extent", "obs", "extent")
def bloom_extent(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.extent(A.obs(spark, sf)).withColumn("fecha", text("fecha"))


_PERSIST = ", p AS (SELECT lago, pix, count(v) AS n_valido, count(*) FILTER (v >= 10) AS n_alto, CASE WHEN count(v) >= 3 THEN count(*) FILTER (v >= 10) / count(v)::DOUBLE END AS proporcion FROM pixels GROUP BY lago, pix) "


@query(_PERSIST + "SELECT lago, pix, n_valido, n_alto, round(proporcion, 6) AS proporcion FROM p", "obs", "pixels")
def persistence(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scenes.persistence(A.pixels(spark, sf), keys=("lago", "pix")), "proporcion")


@query(
    _PERSIST + "SELECT lago, round(100.0 * count(*) FILTER (proporcion > 0) / count(proporcion), 3) AS pct_alguna_vez, round(100.0 * count(*) FILTER (proporcion >= 0.5) / count(proporcion), 3) AS pct_persistente FROM p GROUP BY lago",
    "obs", "pixels",
)
def persistence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.persistence_summary(scenes.persistence(A.pixels(spark, sf), keys=("lago", "pix")))


@query("SELECT id, scl, b1, round((b3 - b4) / nullif(b3 + b4, 0), 6) AS nd, (b3 + b4) = 0 AS sin_denominador FROM bands", "bands")
def normalized_difference(spark: SparkSession, sf: str) -> DataFrame:
    b = A.bands(spark, sf)
    return b.select("id", "scl", "b1", F.round(M.normalized_difference(F.col("b3"), F.col("b4")), 6).alias("nd"), (F.col("b3") + F.col("b4") == 0).alias("sin_denominador"))


@query(", x AS (SELECT id, b1, b2, (b2 / 1000 - b1) / nullif(b2 / 1000 + b1, 0) AS n FROM bands) SELECT id, b1, b2, round(n, 6) AS ndci, round(826.57 * n * n * n - 176.43 * n * n + 19 * n + 4.071, 4) AS chl FROM x", "bands")
def ndci_chl(spark: SparkSession, sf: str) -> DataFrame:
    b = A.bands(spark, sf).withColumn("n", M.ndci(F.col("b1"), F.col("b2") / 1000))
    return b.select("id", "b1", "b2", r6("n", "ndci"), F.round(M.chlorophyll(F.col("n")), 4).alias("chl"))


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({a}) > 0 THEN 'inf'::DOUBLE WHEN ({a}) < 0 THEN '-inf'::DOUBLE END)"


_WBI = (
    ", x AS (SELECT *, b1 / 50 AS r, b2 / 100000 AS g, b3 * 5 AS b, b4 * 5 AS n, b1 / 100 AS s1, b3 AS s2 FROM bands), y AS (SELECT *, "
    + f"{_div('n - r', 'n + r')} AS v, {_div('g - s1', 'g + s1')} AS m, {_div('g - n', 'g + n')} AS w, {_div('n - s1', 'n + s1')} AS l, "
    + "b + 2.5 * g - 1.5 * (n + s1) - 0.25 * s2 AS sh, 4 * (g - s1) - (0.25 * n + 2.75 * s1) AS br, "
    + f"{_div('s1 - g', 's1 + g')} AS so FROM x) SELECT id, scl, b1, b2, "
    + "(coalesce(m > 0.42, false) OR coalesce(w > 0.4, false) OR br > 0.1879 OR sh > 0.1112 OR coalesce(v < -0.2, false) OR coalesce(l > 1, false)) AND NOT (br <= -0.03 OR coalesce(so - v > 0, false)) AS agua FROM y"
)


@query(_WBI, "bands")
def water_body_index(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    wet = M.water_body(c("b1") / 50, c("b2") / 100000, c("b3") * 5, c("b4") * 5, c("b1") / 100, c("b3"))
    return A.bands(spark, sf).select("id", "scl", "b1", "b2", wet.alias("agua"))


@query("SELECT id, scl, b1, scl NOT IN (0, 1, 2, 3, 8, 9, 10, 11) AS valido, scl = 6 AS agua, b3 <> 0 AND b4 <> 0 AS con_dato, scl = 6 AND b3 <> 0 AND b4 <> 0 AS lago_valido FROM bands", "bands")
def class_mask(spark: SparkSession, sf: str) -> DataFrame:
    valid, water, data = M.class_valid(F.col("scl")), M.class_water(F.col("scl")), M.bands_valid(F.col("b3"), F.col("b4"), nodata=0.0)
    return A.bands(spark, sf).select("id", "scl", "b1", valid.alias("valido"), water.alias("agua"), data.alias("con_dato"), (valid & water & data).alias("lago_valido"))


@query("SELECT lago, round(avg(CASE WHEN v IS NOT NULL THEN (v < 1 OR v > 20)::INT END), 6) AS fraccion FROM obs GROUP BY lago", "obs")
def outlier_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return A.obs(spark, sf).groupBy("lago").agg(F.round(scenes.outlier_fraction(1.0, 20.0), 6).alias("fraccion"))


@query(
    f", f AS (SELECT lago, fecha, avg((v > 20)::INT) AS fraccion FROM obs GROUP BY lago, fecha) SELECT lago, CAST(fecha AS VARCHAR) AS fecha, CASE WHEN day(fecha) % 7 = 0 THEN '{S.PARTIAL}' WHEN fraccion > 0.1 THEN '{S.OUTLIERS}' ELSE '{S.COMPUTED}' END AS quality_flag FROM f",
    "obs",
)
def quality_flag(spark: SparkSession, sf: str) -> DataFrame:
    f = A.obs(spark, sf).groupBy("lago", "fecha").agg(scenes.outlier_fraction(float("-inf"), 20.0).alias("f"))
    return f.select("lago", text("fecha"), M.quality_flag(F.dayofmonth("fecha") % 7 == 0, F.col("f")).alias("quality_flag"))


_QUANTILES = ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for q, n in zip(scenes.QUANTILES, scenes.QUANTILE_NAMES, strict=True))


@query(f"SELECT lago, CAST(fecha AS VARCHAR) AS fecha, count(v) AS n_pixeles, round(min(v), 6) AS min, round(max(v), 6) AS max, {_QUANTILES}, round(avg(v), 6) AS media, round(stddev_pop(v), 6) AS desviacion_std FROM obs GROUP BY lago, fecha", "obs")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.distribution(A.obs(spark, sf))
    return _rounded(out, "min", "max", "media", "desviacion_std", *scenes.QUANTILE_NAMES).withColumn("fecha", text("fecha"))


_RANKS = ", k AS (SELECT *, rank() OVER (PARTITION BY lago, fecha, indice ORDER BY x) + (count(*) OVER (PARTITION BY lago, fecha, indice, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lago, fecha, indice ORDER BY y) + (count(*) OVER (PARTITION BY lago, fecha, indice, y) - 1) / 2.0 AS ry FROM pairs), c AS (SELECT lago, fecha, indice, count(*) AS n_pares, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM k GROUP BY lago, fecha, indice) "
_PAIRS = ("bands", "pairs")


@query("SELECT lago, CAST(fecha AS VARCHAR) AS fecha, indice, count(*) AS n_pares, round(CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END, 6) AS pearson FROM pairs GROUP BY lago, fecha, indice", *_PAIRS)
def pearson_by_scene(spark: SparkSession, sf: str) -> DataFrame:
    p = correlate.complete_pairs(A.pairs(spark, sf))
    return p.groupBy("lago", text("fecha"), "indice").agg(F.count(F.lit(1)).alias("n_pares"), F.round(correlate.pearson("x", "y"), 6).alias("pearson"))


@query(_RANKS + "SELECT lago, CAST(fecha AS VARCHAR) AS fecha, indice, n_pares, round(spearman, 6) AS spearman FROM c", *_PAIRS)
def spearman_by_scene(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.by_group(A.pairs(spark, sf), ["lago", "fecha", "indice"]).select("lago", text("fecha"), "indice", "n_pares", r6("spearman"))


_LABEL = "CASE WHEN r IS NULL THEN 'indeterminada' WHEN r > 0 THEN 'positiva' WHEN r < 0 THEN 'negativa' ELSE 'nula' END AS direccion, CASE WHEN r IS NULL THEN 'indeterminada' WHEN abs(r) < 0.1 THEN 'muy_debil' WHEN abs(r) < 0.3 THEN 'debil' WHEN abs(r) < 0.5 THEN 'moderada' WHEN abs(r) < 0.7 THEN 'fuerte' ELSE 'muy_fuerte' END AS magnitud"
_LONG = _RANKS + ", u AS (SELECT lago, fecha, indice, n_pares, 'pearson' AS metodo, pearson AS r FROM c UNION ALL SELECT lago, fecha, indice, n_pares, 'spearman', spearman FROM c) "


@query(_LONG + f"SELECT lago, CAST(fecha AS VARCHAR) AS fecha, indice, metodo, round(round(r, 8), 6) AS coeficiente, n_pares, {_LABEL} FROM u", *_PAIRS)
def corr_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = correlate.by_date(A.pairs(spark, sf)).drop("p_value")
    return rows.withColumns({"fecha": text("fecha"), "coeficiente": F.round("coeficiente", 6)})


#: The two-sided probability as 2 / B(v / 2, 1 / 2) times the integral of cos(a)^(v - 1) from asin |r| to pi / 2 (or 12 / sqrt v beyond it: the rest is below 1e-30 of it), by Simpson's rule in 2000 steps.
_P_VALUE = (
    ", g AS (SELECT *, n_pares - 2 AS v, asin(least(1.0, abs(r))) AS a, least(pi() / 2 - asin(least(1.0, abs(r))), 12 / sqrt(n_pares - 2)) / 2000 AS h FROM u WHERE r IS NOT NULL), "
    "s AS (SELECT lago, fecha, indice, metodo, exp(max(lgamma((v + 1) / 2.0) - lgamma(v / 2.0))) / sqrt(pi()) * 2 * max(h) / 3 * sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp((v - 1) * ln(greatest(cos(a + k * h), 1e-300)))) AS p FROM g, range(2001) t(k) GROUP BY ALL) "
    "SELECT u.lago, CAST(u.fecha AS VARCHAR) AS fecha, u.indice, u.metodo, n_pares, CASE WHEN r IS NULL THEN 'vacio' WHEN p < 1e-300 THEN 'minimo' ELSE 'finito' END AS clase, round(CASE WHEN p >= 1e-300 THEN log10(p) END, 5) AS log10_p FROM u LEFT JOIN s USING (lago, fecha, indice, metodo)"
)


@query(_LONG + _P_VALUE, *_PAIRS)
def corr_p_values(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_value")
    kind = F.when(p == "", "vacio").when(p.startswith("<"), "minimo").otherwise("finito")
    value = F.round(F.log10(F.expr("try_cast(p_value AS double)")), 5)
    return correlate.by_date(A.pairs(spark, sf)).select("lago", text("fecha"), "indice", "metodo", "n_pares", kind.alias("clase"), value.alias("log10_p"))


@query(
    _LONG + "SELECT lago, indice, metodo, count(*) AS n_fechas, CAST(sum(n_pares) AS BIGINT) AS n_pares_total, round(avg(round(r, 8)), 6) AS coef_media, round(quantile_cont(round(r, 8), 0.5), 6) AS coef_mediana, round(min(r), 6) AS coef_min, round(max(r), 6) AS coef_max, round(avg((r > 0)::INT), 4) AS fraccion_fechas_positivas FROM u WHERE r IS NOT NULL GROUP BY lago, indice, metodo",
    *_PAIRS,
)
def corr_by_zone(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(correlate.by_zone(correlate.by_date(A.pairs(spark, sf))), "coef_media", "coef_mediana", "coef_min", "coef_max")


_SAMPLE = ", n AS (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY row, col) - 1 AS k, count(*) OVER (PARTITION BY lago) AS n FROM tile) SELECT lago, row, col, round(v, 6) AS v FROM n WHERE n <= 50 OR k IN (SELECT (i * (n - 1)) // 49 FROM range(50) t(i))"


@query(_SAMPLE, "tile")
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return series.systematic_sample(A.tile(spark, sf), ["lago"], ["row", "col"], 50).select("lago", "row", F.col("col").cast("long").alias("col"), r6("v"))


@query(
    ", n AS (SELECT *, row_number() OVER (PARTITION BY lago, fecha, indice ORDER BY id, scl, part, x, y) - 1 AS k, count(*) OVER (PARTITION BY lago, fecha, indice) AS n FROM pairs), s AS (SELECT * FROM n WHERE n <= 200 OR k IN (SELECT (i * (n - 1)) // 199 FROM range(200) t(i))) SELECT lago, indice, count(*) AS n_pares, round(corr(x, y), 6) AS pearson FROM s GROUP BY lago, indice",
    *_PAIRS,
)
def balanced_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = series.balanced_pool(A.pairs(spark, sf), ["id", "scl", "part", "x", "y"], 200)
    return pool.groupBy("lago", "indice").agg(F.count(F.lit(1)).alias("n_pares"), F.round(correlate.pearson("x", "y"), 6).alias("pearson"))


_DATES = ", d AS (SELECT min(fecha) AS a, max(fecha) AS b FROM obs) "


@query(_DATES + ", m AS (SELECT lago, pix, max(v) FILTER (fecha = b) - max(v) FILTER (fecha = a) AS x FROM pixels, d GROUP BY lago, pix) SELECT lago, pix, round(x, 6) AS diferencia FROM m WHERE x IS NOT NULL", "obs", "pixels")
def difference_map(spark: SparkSession, sf: str) -> DataFrame:
    a, b = A.obs(spark, sf).agg(F.min("fecha"), F.max("fecha")).first()
    return _rounded(compare.difference_map(A.pixels(spark, sf), str(a), str(b), ("lago", "pix")), "diferencia")


@query(_DATES + ", m AS (SELECT lago, pix, max(v) FILTER (fecha = b) - max(v) FILTER (fecha = a) AS x FROM pixels, d GROUP BY lago, pix) SELECT count(x) AS n_pares, round(greatest(1.0, quantile_cont(abs(x), 0.98)), 6) AS vmax FROM m", "obs", "pixels")
def difference_scale(spark: SparkSession, sf: str) -> DataFrame:
    a, b = A.obs(spark, sf).agg(F.min("fecha"), F.max("fecha")).first()
    d = compare.difference_map(A.pixels(spark, sf), str(a), str(b), ("lago", "pix"))
    return _rounded(scenes.difference_scale(d), "vmax")


_COMMON = "2024-01-15"


@query(
    f""", p AS (
 SELECT lago, fecha, 'referencia_primera_fecha_completa' AS m FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY quality_flag = '{S.COMPUTED}' DESC, fecha) AS k FROM series) WHERE k = 1
 UNION ALL SELECT lago, fecha, 'pico_promedio_temporal' FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY cyano_promedio DESC, fecha) AS k FROM series) WHERE k = 1
 UNION ALL SELECT lago, fecha, 'mayor_extension' FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY porcentaje_alto DESC, fecha) AS k FROM extent) WHERE k = 1
 UNION ALL SELECT DISTINCT lago, DATE '{_COMMON}', 'fecha_comun_entre_lagos' FROM series)
SELECT lago, CAST(fecha AS VARCHAR) AS fecha, string_agg(DISTINCT m, ';' ORDER BY m) AS criterio_seleccion FROM p GROUP BY lago, fecha""",
    "obs", "series", "extent",
)
def select_dates(spark: SparkSession, sf: str) -> DataFrame:
    return series.select_dates(A.series(spark, sf), scenes.extent(A.obs(spark, sf)), _COMMON).withColumn("fecha", text("fecha"))


_HALF = ", h AS (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY fecha) AS k, count(*) OVER (PARTITION BY lago) AS n FROM series), t AS (SELECT lago, avg(cyano_promedio) FILTER (k <= n // 2 OR n = 1) AS a, avg(cyano_promedio) FILTER (k > n // 2) AS b FROM h GROUP BY lago) "
_TREND = "CASE WHEN abs(b - a) < 0.05 THEN 'estable' WHEN b > a THEN 'creciente' WHEN b < a THEN 'decreciente' END AS tendencia_temporal"


@query(_HALF + f"SELECT lago, round(a, 6) AS primera_mitad, round(b, 6) AS segunda_mitad, {_TREND} FROM t", "obs", "series")
def trend_label(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(series.half_split_trend(A.series(spark, sf), flat=0.05), "primera_mitad", "segunda_mitad")


@query(
    f""", c AS (SELECT * FROM series WHERE quality_flag = '{S.COMPUTED}'),
 g AS (SELECT lago, count(*) AS n_fechas_calculado, avg(cyano_promedio) AS m, (list_sort(list(cyano_promedio)))[count(*) // 2 + 1] AS u, count(*) FILTER (cyano_promedio >= 10) AS f FROM c GROUP BY lago),
 e AS (SELECT extent.* FROM extent JOIN c USING (lago, fecha)), a AS (SELECT lago, avg(porcentaje_alto) AS pa, max(porcentaje_alto) AS pm FROM e GROUP BY lago),
 l AS (SELECT lago, fecha AS lf FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY porcentaje_alto DESC, fecha) AS k FROM e) WHERE k = 1),
 h AS (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY fecha) AS k, count(*) OVER (PARTITION BY lago) AS n FROM c), t AS (SELECT lago, avg(cyano_promedio) FILTER (k <= n // 2 OR n = 1) AS a, avg(cyano_promedio) FILTER (k > n // 2) AS b FROM h GROUP BY lago),
 n AS (SELECT lago, count(*) AS n_fechas_total FROM series GROUP BY lago),
 pp AS (SELECT lago, pix, count(v) AS nv, count(*) FILTER (v >= 10) AS nh FROM pixels GROUP BY lago, pix),
 held AS (SELECT lago, round(100.0 * count(*) FILTER (nv >= 3 AND nh > 0) / nullif(count(*) FILTER (nv >= 3), 0), 3) AS una, round(100.0 * count(*) FILTER (nv >= 3 AND 2 * nh >= nv) / nullif(count(*) FILTER (nv >= 3), 0), 3) AS dos FROM pp GROUP BY lago),
 cc AS (SELECT lago, fecha, indice, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 8) END AS r FROM obs_pairs GROUP BY ALL),
 cz AS (SELECT lago, quantile_cont(r, 0.5) FILTER (indice = 'ndvi') AS c1, quantile_cont(r, 0.5) FILTER (indice = 'ndwi') AS c2 FROM cc WHERE r IS NOT NULL GROUP BY lago)
SELECT lago, una AS pct_area_alguna_vez_alta, dos AS pct_area_persistente, round(c1, 6) AS correlacion_ndvi_pearson_mediana, round(c2, 6) AS correlacion_ndwi_pearson_mediana, n_fechas_total, n_fechas_calculado, round(m, 6) AS cyano_promedio_general, round(u, 6) AS cyano_mediana_general, f AS frecuencia_fechas_sobre_umbral, round(100.0 * f / n_fechas_calculado, 4) AS pct_fechas_sobre_umbral,
 round(pa, 6) AS porcentaje_alto_promedio, pm AS porcentaje_alto_maximo, CAST(lf AS VARCHAR) AS fecha_porcentaje_alto_maximo, CASE WHEN abs(b - a.a0) < 0.5 THEN 'estable' WHEN b > a.a0 THEN 'creciente' ELSE 'decreciente' END AS tendencia_temporal
FROM n LEFT JOIN g USING (lago) LEFT JOIN (SELECT lago, pa, pm FROM a) USING (lago) LEFT JOIN l USING (lago) LEFT JOIN (SELECT lago, a AS a0, b FROM t) a USING (lago) LEFT JOIN held USING (lago) LEFT JOIN cz USING (lago)""",
    "obs", "series", "extent", "pixels", "obs_pairs",
)
def zone_comparison(spark: SparkSession, sf: str) -> DataFrame:
    held = scenes.persistence_summary(scenes.persistence(A.pixels(spark, sf), keys=("lago", "pix")))
    held = held.select("lago", F.col("pct_alguna_vez").alias("pct_area_alguna_vez_alta"), F.col("pct_persistente").alias("pct_area_persistente"))
    zones = correlate.by_zone(correlate.by_date(A.obs_pairs(spark, sf)))
    out = compare.zone_comparison(A.series(spark, sf), scenes.extent(A.obs(spark, sf)), held, zones)
    out = _rounded(out, "cyano_promedio_general", "cyano_mediana_general", "porcentaje_alto_promedio", "correlacion_ndvi_pearson_mediana", "correlacion_ndwi_pearson_mediana")
    return out.withColumn("fecha_porcentaje_alto_maximo", text("fecha_porcentaje_alto_maximo"))


_MONTHS = ", s AS (SELECT o_orderpriority AS lago, CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, avg(o_totalprice) AS c FROM orders GROUP BY 1, 2), e AS (SELECT *, CASE WHEN month(fecha) IN (11, 12, 1, 2, 3, 4) THEN 'seca' ELSE 'lluviosa' END AS estacion FROM s)"


def _months(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders")
    month = F.trunc(F.to_date("o_orderdate"), "month").alias("fecha")
    return o.groupBy(F.col("o_orderpriority").alias("lago"), month).agg(F.avg("o_totalprice").alias("cyano_promedio"))


@query("WITH " + _MONTHS[2:] + " SELECT lago, estacion, count(*) AS n_fechas, round(avg(c), 4) AS cyano_promedio, round((list_sort(list(c)))[count(*) // 2 + 1], 4) AS cyano_mediana, round(stddev_pop(c), 4) AS cyano_std, string_agg(CAST(fecha AS VARCHAR), ';' ORDER BY fecha) AS fechas FROM e GROUP BY lago, estacion")
def seasonal(spark: SparkSession, sf: str) -> DataFrame:
    return compare.seasonal(_months(spark, sf)).withColumns({c: F.round(F.col(c), 4) for c in ("cyano_promedio", "cyano_mediana", "cyano_std")})


@query(
    "WITH " + _MONTHS[2:] + ", g AS (SELECT lago, estacion, count(*) AS n FROM e WHERE lago <> '5-LOW' OR estacion = 'seca' GROUP BY lago, estacion), d AS (SELECT DISTINCT lago, x AS estacion FROM e, (VALUES ('seca'), ('lluviosa')) v(x)) SELECT d.lago, d.estacion, n AS n_fechas FROM d LEFT JOIN g ON d.lago = g.lago AND d.estacion = g.estacion"
)
def season_domain(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare.seasonal(_months(spark, sf)).where("lago <> '5-LOW' OR estacion = 'seca'").select("lago", "estacion", "n_fechas")
    domain = A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("lago")).distinct().withColumn("estacion", F.explode(F.array(F.lit("seca"), F.lit("lluviosa"))))
    return compare.over_domain(rows, domain, ["lago", "estacion"])


@query("SELECT lago, round((list_sort(list(cyano_promedio)))[count(*) // 2 + 1], 6) AS mediana_superior, round(quantile_cont(cyano_promedio, 0.5), 6) AS mediana FROM series GROUP BY lago", "obs", "series")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return A.series(spark, sf).groupBy("lago").agg(F.round(compare.upper_median("cyano_promedio"), 6).alias("mediana_superior"), F.round(F.percentile("cyano_promedio", F.lit(0.5)), 6).alias("mediana"))


_OUTLINE = [[(5.5, 3.25), (60.5, 20.75), (40.25, 480.5), (10.75, 300.25)], [(20.5, 100.5), (30.5, 100.5), (30.5, 200.5), (20.5, 200.5)]]
_EDGES = "e(x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in spatial.edges(_OUTLINE)) + ")"


@query(
    f", {_EDGES}, i AS (SELECT lago, row, col, v, sum(((y0 > row) <> (y1 > row) AND coalesce(col < x0 + (row - y0) / nullif(y1 - y0, 0) * (x1 - x0), false))::INT) % 2 = 1 AS dentro FROM tile, e GROUP BY ALL) SELECT lago, count(*) AS n_celdas, count(*) FILTER (dentro) AS n_dentro, count(*) FILTER (dentro AND v >= 0) AS n_validas FROM i GROUP BY lago",
    "tile",
)
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    runs = spatial.scanlines(spatial.edge_table(spatial.outlines(spark, {"todas": _OUTLINE})), (), offset=0.0)
    t = spatial.marked(A.tile(spark, sf), runs, ())
    return t.groupBy("lago").agg(F.count(F.lit(1)).alias("n_celdas"), F.count_if("dentro").alias("n_dentro"), F.count_if(F.col("dentro") & (F.col("v") >= 0)).alias("n_validas"))


@query(
    ", w AS (SELECT lago, row, x, y, lead(x) OVER (PARTITION BY lago, row ORDER BY col) AS nx, lead(y) OVER (PARTITION BY lago, row ORDER BY col) AS ny, first(x) OVER (PARTITION BY lago, row ORDER BY col) AS fx, first(y) OVER (PARTITION BY lago, row ORDER BY col) AS fy FROM (SELECT *, (1 + v) * cos(col * 0.09) AS x, (1 + v) * sin(col * 0.09) AS y FROM tile)) SELECT lago, row, round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 6) AS area FROM w GROUP BY lago, row",
    "tile",
)
def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tile(spark, sf)
    points = t.select("lago", "row", F.col("col").alias("k"), ((1 + F.col("v")) * F.cos(F.col("col") * 0.09)).alias("x"), ((1 + F.col("v")) * F.sin(F.col("col") * 0.09)).alias("y"))
    return _rounded(spatial.ring_area(points, ["lago", "row"]), "area")


@query(
    "SELECT lago, CAST(fecha AS VARCHAR) AS fecha, ancho, referencia FROM (SELECT *, first(ancho) OVER (PARTITION BY lago ORDER BY fecha) AS referencia FROM (SELECT o_orderpriority AS lago, CAST(o_orderdate AS DATE) AS fecha, CAST(count(*) % 3 AS BIGINT) AS ancho FROM orders GROUP BY 1, 2)) WHERE ancho <> referencia"
)
def grid_consistency(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("lago"), F.to_date("o_orderdate").alias("fecha")).agg((F.count(F.lit(1)) % 3).alias("n"))
    found = compare.reference_grid(o.withColumn("grid", F.struct(F.col("n").alias("ancho"))))
    return found.select("lago", text("fecha"), F.col("grid.ancho").alias("ancho"), F.col("grid_referencia.ancho").alias("referencia"))


@query(
    ", s AS (SELECT * FROM tile WHERE v >= -0.1), t AS (SELECT lago, row, col, row + 0.25 AS pr, col + 0.5 AS pc FROM tile), n AS (SELECT t.lago, t.row, t.col, s.v, (1 - abs(pr - s.row)) * (1 - abs(pc - s.col)) AS w FROM t LEFT JOIN s ON s.lago = t.lago AND s.row IN (t.row, t.row + 1) AND s.col IN (t.col, t.col + 1)) SELECT lago, row, col, round(sum(w * v) / nullif(sum(w), 0), 6) AS v FROM n GROUP BY lago, row, col",
    "tile",
)
def align_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tile(spark, sf)
    source = t.withColumn("v", F.when(F.col("v") >= -0.1, F.col("v")))
    out = spatial.align_bilinear(source, t.select("lago", "row", "col"), ["lago"], F.col("row") + 0.25, F.col("col") + 0.5)
    return _rounded(out, "v").withColumn("col", F.col("col").cast("long"))


@query("SELECT lago, CASE WHEN row < 125 THEN 'norte' ELSE 'sur' END AS mitad, count(v) AS n, round(avg(v), 6) AS media FROM tile GROUP BY 1, 2", "tile")
def north_south(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scenes.halves(A.tile(spark, sf), 250), "media")


@query("SELECT 0.0::DOUBLE AS vmin, round(greatest(quantile_cont(v, 0.98), 10), 6) AS vmax FROM obs", "obs")
def color_scale(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scenes.comparison_scale(A.obs(spark, sf)), "vmax")


@query(", b AS (SELECT lago, least(43, floor((v + 0.5) / 1.0 * 44)) AS bin FROM tile WHERE v BETWEEN -0.5 AND 0.5) SELECT lago, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY lago, bin", "tile")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.histogram(A.tile(spark, sf), "v", -0.5, 0.5, keys=["lago"]).withColumn("bin", F.col("bin").cast("long"))


@query(
    ", p AS (SELECT lago, (b1 - 0) / (50 / 55.0) AS u, (b2 - 0) / (110000 / 31.0) AS w FROM bands), q AS (SELECT lago, u, w, floor(u + 0.5) AS i1, floor(w + 0.5) AS j1, floor(u) AS i2, floor(w) AS j2 FROM p), c AS (SELECT *, (u - i1) * (u - i1) + 3 * (w - j1) * (w - j1) < (u - i2 - 0.5) * (u - i2 - 0.5) + 3 * (w - j2 - 0.5) * (w - j2 - 0.5) AS f FROM q) SELECT lago, CAST(CASE WHEN f THEN 0 ELSE 1 END AS BIGINT) AS malla, CAST(CASE WHEN f THEN i1 ELSE i2 END AS BIGINT) AS i, CAST(CASE WHEN f THEN j1 ELSE j2 END AS BIGINT) AS j, count(*) AS n FROM c GROUP BY ALL",
    "bands",
)
def hexbin(spark: SparkSession, sf: str) -> DataFrame:
    out = spatial.hex_cells(A.bands(spark, sf), "b1", "b2", (0.0, 0.0), (50.0, 110000.0), keys=["lago"])
    return out.withColumn("malla", F.col("malla").cast("long"))


@query(f"SELECT lago, count(*) FILTER (quality_flag <> '{S.PENDING}' AND ruta_raster <> '') AS n_listas, count(*) FILTER (quality_flag = '{S.PENDING}' OR ruta_raster = '') AS n_pendientes FROM manifest GROUP BY lago", "manifest")
def ready_pending(spark: SparkSession, sf: str) -> DataFrame:
    ready = F.coalesce(scenes.is_ready(), F.lit(False))
    return A.manifest(spark, sf).groupBy("lago").agg(F.count_if(ready).alias("n_listas"), F.count_if(~ready).alias("n_pendientes"))


@query(
    f", m AS (SELECT *, quality_flag = '{S.PENDING}' OR ruta_raster = '' AS p FROM manifest) SELECT lago, CAST(fecha AS VARCHAR) AS fecha, count(*) AS n_total, count(*) FILTER (NOT p) AS n_listas, count(*) FILTER (p) AS n_pendientes, coalesce(string_agg(DISTINCT indice, ';' ORDER BY indice) FILTER (p), '') AS pendientes FROM m GROUP BY lago, fecha",
    "manifest",
)
def pending_report(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.pending_report(A.manifest(spark, sf)).withColumn("fecha", text("fecha"))


@query("SELECT lago, CAST(fecha AS VARCHAR) AS fecha, indice, count(*) AS n FROM manifest GROUP BY lago, fecha, indice HAVING count(*) > 1", "manifest")
def manifest_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_keys(A.manifest(spark, sf), ["lago", "fecha", "indice"]).withColumn("fecha", text("fecha"))


@query("(SELECT n_nationkey AS clave, 'falta' AS lado FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 4000)) UNION ALL (SELECT clave, 'sobra' FROM (SELECT s_nationkey AS clave FROM supplier WHERE s_acctbal < 4000 EXCEPT SELECT n_nationkey FROM nation WHERE true))")
def expected_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    have = A.table(spark, sf, "supplier").where("s_acctbal < 4000").select(F.col("s_nationkey").alias("clave"))
    return checks.key_differences(A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("clave")), have, ["clave"])


@query("SELECT n_nationkey AS clave, n_name AS nombre FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def missing_files_anti(spark: SparkSession, sf: str) -> DataFrame:
    there = A.table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("clave"))
    return checks.missing_rows(A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("clave"), F.col("n_name").alias("nombre")), there, ["clave"])


@query(_LONG + "SELECT lago, CAST(fecha AS VARCHAR) AS fecha, indice, metodo, round(r, 6) AS coeficiente FROM u ORDER BY abs(round(r, 8)) DESC NULLS LAST, lago, fecha, indice, metodo LIMIT 12", *_PAIRS)
def top_abs(spark: SparkSession, sf: str) -> DataFrame:
    rows = correlate.by_date(A.pairs(spark, sf)).select("lago", "fecha", "indice", "metodo", "coeficiente")
    return correlate.strongest(rows).withColumns({"fecha": text("fecha"), "coeficiente": F.round("coeficiente", 6)})


@query("SELECT o_custkey AS cliente, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS motivos FROM orders GROUP BY o_custkey")
def reasons_listagg(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("cliente")).agg(M.joined(F.collect_set("o_orderpriority")).alias("motivos"))


@query(f"SELECT id, lago, CAST(fecha AS VARCHAR) AS fecha, quality_flag FROM manifest WHERE quality_flag <> '{S.COMPUTED}'", "manifest")
def suspicious(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.suspicious(A.manifest(spark, sf)).select("id", "lago", text("fecha"), "quality_flag")


@query(
    f"SELECT lago, CAST(fecha AS VARCHAR) AS fecha, list_sort(list_filter(['ndvi', 'ndwi', 'cianobacteria'], lambda x: NOT list_contains(coalesce(h, []), x)))::VARCHAR AS faltan FROM (SELECT lago, fecha, list(DISTINCT indice) FILTER (quality_flag <> '{S.PENDING}' AND ruta_raster <> '') AS h FROM manifest GROUP BY lago, fecha) WHERE len(coalesce(h, [])) < 3",
    "manifest",
)
def incomplete_scenes(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.incomplete_scenes(A.manifest(spark, sf))
    return found.select("lago", text("fecha"), F.concat(F.lit("["), F.array_join("faltan", ", "), F.lit("]")).alias("faltan"))


@query("SELECT s.lago, CAST(s.fecha AS VARCHAR) AS fecha, round(s.cyano_promedio, 6) AS cyano_promedio, e.porcentaje_alto FROM series s LEFT JOIN (SELECT * FROM extent WHERE pixeles_altos > 20) e USING (lago, fecha)", "obs", "series", "extent")
def series_extent_join(spark: SparkSession, sf: str) -> DataFrame:
    e = scenes.extent(A.obs(spark, sf)).where("pixeles_altos > 20").select("lago", "fecha", "porcentaje_alto")
    return A.series(spark, sf).join(e, ["lago", "fecha"], "left").select("lago", text("fecha"), r6("cyano_promedio"), "porcentaje_alto")


@query(_LONG + ", z AS (SELECT lago, indice, metodo, quantile_cont(round(r, 8), 0.5) AS m FROM u WHERE r IS NOT NULL GROUP BY lago, indice, metodo) SELECT lago, indice, round(max(m) FILTER (metodo = 'pearson'), 6) AS pearson, round(max(m) FILTER (metodo = 'spearman'), 6) AS spearman FROM z GROUP BY lago, indice", *_PAIRS)
def corr_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(compare.pivot_methods(correlate.by_zone(correlate.by_date(A.pairs(spark, sf)))), "pearson", "spearman")


@query("SELECT lago, row, col, CAST(CASE WHEN v IS NULL THEN 0 ELSE floor(greatest(0, least(1, (v + 0.4) / 0.8)) * 255) END AS BIGINT) AS nivel, CAST(255 AS BIGINT) AS alfa FROM tile", "tile")
def color_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = render.rgba(A.tile(spark, sf), -0.4, 0.4)
    return out.select("lago", "row", *(F.col(c).cast("long").alias(c) for c in ("col", "nivel", "alfa")))


_CLASSES = " ".join(f"WHEN c < {t} THEN {k}" for k, (t, _) in enumerate(M.PALETTE))


@query(f", x AS (SELECT id, scl, b1, b2 / 200 AS c, b3 AS f FROM bands) SELECT id, scl, b1, CAST(CASE WHEN f > 0.08 THEN {len(M.PALETTE)} {_CLASSES} ELSE {len(M.PALETTE)} END AS BIGINT) AS clase FROM x", "bands")
def color_classes(spark: SparkSession, sf: str) -> DataFrame:
    return A.bands(spark, sf).select("id", "scl", "b1", M.colour_class(F.col("b2") / 200, F.col("b3")).cast("long").alias("clase"))


@query(
    ", q AS (SELECT indice, quantile_cont(x, 0.01) AS xa, quantile_cont(x, 0.99) AS xb, quantile_cont(y, 0.01) AS ya, quantile_cont(y, 0.99) AS yb FROM pairs GROUP BY indice) SELECT lago, indice, count(*) AS n FROM pairs JOIN q USING (indice) WHERE x BETWEEN xa AND xb AND y BETWEEN ya AND yb GROUP BY lago, indice",
    *_PAIRS,
)
def visible_pairs(spark: SparkSession, sf: str) -> DataFrame:
    each = [render.visible(A.pairs(spark, sf).where(F.col("indice") == i).select("lago", "indice", "x", "y")) for i in ("ndvi", "ndwi")]
    return each[0].unionByName(each[1]).groupBy("lago", "indice").agg(F.count(F.lit(1)).alias("n"))


@query(
    f", b AS (SELECT lago, fecha FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY quality_flag = '{S.COMPUTED}' DESC, cyano_promedio, fecha) AS k FROM series) WHERE k = 1), a AS (SELECT lago, fecha FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY cyano_promedio DESC, fecha) AS k FROM series) WHERE k = 1) SELECT b.lago, b.fecha::VARCHAR || CASE WHEN a.fecha <> b.fecha THEN ';' || a.fecha ELSE '' END || CASE WHEN DATE '{_COMMON}' NOT IN (a.fecha, b.fecha) THEN ';{_COMMON}' ELSE '' END AS fechas FROM b JOIN a ON a.lago = b.lago",
    "obs", "series",
)
def panel_dates(spark: SparkSession, sf: str) -> DataFrame:
    out = series.panel_dates(A.series(spark, sf), _COMMON)
    return out.select("lago", F.array_join(F.transform("fechas", lambda d: d.cast("string")), ";").alias("fechas"))


@query("SELECT lago, count(*) AS n, round(100.0 * count(*) FILTER (b3 <> 0 AND b4 <> 0) / count(*), 4) AS cobertura_valida_pct FROM bands GROUP BY lago", "bands")
def raster_inspection(spark: SparkSession, sf: str) -> DataFrame:
    valid = M.bands_valid(F.col("b3"), F.col("b4"), nodata=0.0)
    files = A.bands(spark, sf).groupBy("lago", "fecha").agg(F.count_if(valid).alias("validos"), F.count(F.lit(1)).alias("total"))
    return scenes.file_coverage(files, ["lago"]).join(files.groupBy("lago").agg(F.sum("total").alias("n")), "lago")


@query(
    ", q AS (SELECT DISTINCT lago, floor(b1) AS b1 FROM bands), z AS (SELECT *, greatest(1, round_even(b1 * 0.1 * 111320.0 / 10, 0)) AS w, greatest(1, round_even(0.03 * 111320.0 / 10, 0)) AS h FROM q), f AS (SELECT *, least(1.0, 2500.0 / greatest(w, h)) AS k FROM z) SELECT lago, CAST(b1 AS BIGINT) AS b1, CAST(greatest(1, round_even(w * k, 0)) AS BIGINT) AS ancho, CAST(greatest(1, round_even(h * k, 0)) AS BIGINT) AS alto FROM f",
    "bands",
)
def request_pixels(spark: SparkSession, sf: str) -> DataFrame:
    b = A.bands(spark, sf).select("lago", F.col("b1").cast("long").alias("b1")).distinct()
    size = M.request_size(F.lit(0.0), F.col("b1") * 0.1, F.lit(0.0), F.lit(0.03))
    return b.select("lago", "b1", size["width"].cast("long").alias("ancho"), size["height"].cast("long").alias("alto"))


@query("SELECT lago, indice, quality_flag, count(*) AS n FROM manifest GROUP BY ALL", "manifest")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.manifest(spark, sf).groupBy("lago", "indice", "quality_flag").count().withColumnRenamed("count", "n")


@query(f"SELECT id, CASE WHEN quality_flag = '{S.PARTIAL}' THEN '{S.COMPUTED}' ELSE quality_flag END AS quality_flag, CASE WHEN quality_flag = '{S.PARTIAL}' THEN 'nuevo/' || id ELSE ruta_raster END AS ruta_raster FROM manifest", "manifest")
def manifest_update(spark: SparkSession, sf: str) -> DataFrame:
    m = A.manifest(spark, sf).select("id", "quality_flag", "ruta_raster")
    new = m.where(F.col("quality_flag") == S.PARTIAL).select("id", F.lit(S.COMPUTED).alias("quality_flag"), F.concat(F.lit("nuevo/"), F.col("id").cast("string")).alias("ruta_raster"))
    return compare.update_rows(m, new, ["id"])


@query("SELECT c_custkey AS id, round(try_cast(nullif(trim(c_name[11:]), '') AS DOUBLE), 2) AS valor FROM customer")
def coerce_text(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.expr("round(try_cast(nullif(trim(substring(c_name, 11)), '') AS double), 2)").alias("valor"))


@query(f"SELECT lago, CAST(fecha AS VARCHAR) AS fecha, indice, '{S.PENDING}' AS quality_flag FROM (SELECT DISTINCT lago, fecha FROM escenas), (VALUES ('ndvi'), ('ndwi'), ('cianobacteria')) i(indice)", "escenas")
def expected_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return checks.index_rows(A.scenes(spark, sf).select("lago", "fecha").distinct()).withColumn("fecha", text("fecha"))


def utm_sql(points: str) -> str:
    """SQL of easting and northing (zone 15) of a relation with lon and lat, beside its columns: the same series, written out."""
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    return (
        f"(SELECT * EXCLUDE (s, t, l, xi, eta), 500000 + {0.9996 * radius!r} * ({east}) AS este, {0.9996 * radius!r} * ({north}) AS norte FROM (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta "
        f"FROM (SELECT *, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) AS t FROM (SELECT *, sin(radians(lat)) AS s, radians(lon + 93) AS l FROM {points}))))"
    )


@query(f"SELECT lon, lat, round(este, 3) AS este, round(norte, 3) AS norte, 0.0::DOUBLE AS error_lon, 0.0::DOUBLE AS error_lat FROM {utm_sql('(SELECT round(row * 0.001::DOUBLE - 91.3::DOUBLE, 6) AS lon, round(col * 0.002::DOUBLE + 14.4::DOUBLE, 6) AS lat FROM tile)')}", "tile")
def utm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    points = A.tile(spark, sf).select(F.round(F.col("row") * 0.001 - 91.3, 6).alias("lon"), F.round(F.col("col") * 0.002 + 14.4, 6).alias("lat"))
    e, n = spatial.utm_points(F.col("lon"), F.col("lat"))
    out = points.withColumns({"este": e, "norte": n})
    lon, lat = spatial.from_utm(F.col("este"), F.col("norte"))
    out = out.withColumns({"error_lon": F.round(spatial.turned(lon, F.col("lon")), 9), "error_lat": F.round(F.abs(lat - F.col("lat")), 9)})
    return out.withColumns({c: F.round(c, 3) for c in ("este", "norte")})
