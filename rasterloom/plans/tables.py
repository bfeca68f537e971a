"""Registered queries of selections, masks, manifests, texts, outlines and figure data, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions import indices as M
from rasterloom.operators import checks, compare, correlate, polygons, render, scenes, series, spatial
from rasterloom.operators import tiles as tiles_
from rasterloom.plans import analogs as A
from rasterloom.plans.queries import _LONG, _PAIRS, _WBI, ORACLES, QUERIES, _rounded, query, r6, text, utm_sql
from rasterloom.sources import tables

__all__ = ["ORACLES", "QUERIES"]


# -- selections and manifests -------------------------------------------------------


@query("SELECT id, lago, CAST(fecha AS VARCHAR) AS fecha, nubosidad_oficial_pct, satelite_oficial, cobertura_valida_oficial_pct FROM escenas WHERE lago = 'amatitlan' AND nubosidad_oficial_pct < 5", "escenas")
def scene_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = scenes.select_scenes(A.scenes(spark, sf), "amatitlan").where("nubosidad_oficial_pct < 5")
    return chosen.select("id", "lago", text("fecha"), "nubosidad_oficial_pct", "satelite_oficial", "cobertura_valida_oficial_pct")


@query(
    f"SELECT id, lago, CAST(fecha AS VARCHAR) AS fecha, '{S.PRODUCT}' AS producto, 'B03;B04;B08;SCL' AS bandas, 'pendiente' AS estado, CASE WHEN cobertura_valida_oficial_pct IS NULL THEN 'pendiente_descarga' ELSE '{S.PARTIAL}' END AS quality_flag FROM escenas",
    "escenas",
)
def expected_scene_rows(spark: SparkSession, sf: str) -> DataFrame:
    return checks.scene_rows(A.scenes(spark, sf)).select("id", "lago", text("fecha"), "producto", "bandas", "estado", "quality_flag")


@query("SELECT id, lago, CAST(fecha AS VARCHAR) AS fecha, quality_flag FROM manifest WHERE indice = 'cianobacteria'", "manifest")
def index_filter(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.of_index(A.manifest(spark, sf), "cianobacteria").select("id", "lago", text("fecha"), "quality_flag")


@query(f"SELECT id, CAST(fecha AS VARCHAR) AS fecha, ruta_raster FROM manifest WHERE indice = 'cianobacteria' AND lago = '1-URGENT' AND quality_flag <> '{S.PENDING}' AND ruta_raster <> ''", "manifest")
def ready_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.ready_of(A.manifest(spark, sf), "1-URGENT").select("id", text("fecha"), "ruta_raster")


@query(", f AS (SELECT lago, fecha FROM manifest WHERE indice = 'ndvi' AND id % 5 <> 0 ORDER BY id LIMIT 1) SELECT id, lago, CAST(fecha AS VARCHAR) AS fecha, ruta_raster FROM manifest JOIN f USING (lago, fecha) WHERE indice = 'ndvi' AND id % 5 <> 0", "manifest")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    m = A.manifest(spark, sf).where("id % 5 <> 0")  # those with a path
    one = m.where("indice = 'ndvi'").orderBy("id").select("lago", "fecha").first()
    return scenes.lookup(m, one["lago"], str(one["fecha"]), "ndvi").select("id", "lago", text("fecha"), "ruta_raster")


@query(
    "SELECT 'lago' AS columna, list_sort(list(DISTINCT lago))::VARCHAR AS valores FROM manifest UNION ALL SELECT 'indice', list_sort(list(DISTINCT indice))::VARCHAR FROM manifest UNION ALL SELECT 'quality_flag', list_sort(list(DISTINCT quality_flag))::VARCHAR FROM manifest",
    "manifest",
)
def distinct_sets(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.distinct_sets(A.manifest(spark, sf), ["lago", "indice", "quality_flag"])
    return out.select("columna", F.concat(F.lit("["), F.array_join("valores", ", "), F.lit("]")).alias("valores"))


@query(
    "WITH l AS (SELECT c_mktsegment AS indice, 'saldo' AS columna, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer UNION ALL SELECT c_mktsegment, 'pais', CAST(c_nationkey AS DOUBLE) FROM customer) SELECT indice, columna, count(v) AS n, round(avg(v), 6) AS media, min(v) AS minimo, max(v) AS maximo FROM l GROUP BY indice, columna"
)
def coerced_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "customer")
    blank = F.when(F.col("c_custkey") % 7 == 0, F.lit("  ")).when(F.col("c_custkey") % 5 == 0, F.lit("sin dato")).otherwise(F.col("c_acctbal").cast("string"))
    rows = c.select(F.col("c_mktsegment").alias("indice"), blank.alias("saldo"), F.col("c_nationkey").cast("string").alias("pais"))
    return scenes.coerced_summary(rows, ["saldo", "pais"]).withColumn("media", F.round("media", 6))


_ZONED = "z AS (SELECT DISTINCT o_orderpriority AS lago, CAST(left(o_orderpriority, 1) AS DOUBLE) AS p FROM orders), e AS (SELECT o_orderpriority AS lago, CAST(o_orderdate AS DATE) AS fecha, (o_orderkey % 1300) / 10.0::DOUBLE AS c FROM orders)"


@query(
    f"WITH {_ZONED} SELECT 'caja' AS problema, lago AS clave FROM z WHERE p % 3 = 0 UNION ALL SELECT DISTINCT 'sin caja', lago FROM z WHERE p = 5 UNION ALL SELECT 'fechas', lago FROM e GROUP BY lago HAVING count(DISTINCT fecha) <> 11 "
    "UNION ALL SELECT 'escena repetida', lago || ' ' || fecha FROM e GROUP BY lago, fecha HAVING count(*) > 1 UNION ALL SELECT 'nubosidad', lago || ' ' || fecha FROM e WHERE c NOT BETWEEN 0 AND 100"
)
def configuration_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as scenes of five zones: one zone's box is empty, another has none."""
    o = A.scenes(spark, sf).withColumn("lago", F.col("satelite_oficial"))
    p = F.left("lago", F.lit(1)).cast("double")
    zones = o.select("lago").distinct().where(p < 5).select("lago", p.alias("west"), (p + p % 3).alias("east"), F.lit(0.0).alias("south"), F.lit(1.0).alias("north"))
    return checks.configuration_problems(o, zones, 11)


@query(
    "WITH o AS (SELECT o_orderpriority AS lago, CAST(o_orderdate AS DATE) AS fecha, o_orderkey AS id, o_custkey AS c FROM orders), e AS (SELECT DISTINCT lago, fecha FROM o WHERE c % 10 <> 0), h AS (SELECT lago, fecha FROM o WHERE id % 7 <> 0) "
    "SELECT 'clave repetida' AS problema, lago || ' ' || fecha AS clave FROM h GROUP BY lago, fecha HAVING count(*) > 1 UNION ALL SELECT 'clave falta', lago || ' ' || fecha FROM (SELECT * FROM e EXCEPT SELECT * FROM h) UNION ALL SELECT 'clave sobra', lago || ' ' || fecha FROM (SELECT * FROM h EXCEPT SELECT * FROM e) "
    "UNION ALL SELECT 'columna faltan', 'estado' UNION ALL SELECT 'columna sobran', 'sobrante'"
)
def scene_manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("lago"), F.to_date("o_orderdate").alias("fecha"), "o_orderkey", "o_custkey")
    have = o.where("o_orderkey % 7 <> 0").select("lago", "fecha", F.lit(1).alias("sobrante"))
    return checks.manifest_violations(have, o.where("o_custkey % 10 <> 0").select("lago", "fecha").distinct(), ["lago", "fecha"], ["lago", "fecha", "estado"])


@query(
    ", e AS (SELECT lago, fecha, indice FROM (SELECT DISTINCT lago, fecha FROM manifest WHERE id % 4 <> 0), (VALUES ('ndvi'), ('ndwi'), ('cianobacteria')) i(indice)), h AS (SELECT lago, fecha, indice FROM manifest) SELECT 'clave falta' AS problema, lago || ' ' || fecha || ' ' || indice AS clave FROM (SELECT * FROM e EXCEPT SELECT * FROM h) "
    "UNION ALL SELECT 'clave sobra', lago || ' ' || fecha || ' ' || indice FROM (SELECT * FROM h EXCEPT SELECT * FROM e) UNION ALL SELECT 'clave repetida', lago || ' ' || fecha || ' ' || indice FROM h GROUP BY lago, fecha, indice HAVING count(*) > 1",
    "manifest",
)
def index_manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    m = A.manifest(spark, sf)
    return checks.manifest_violations(m, checks.index_rows(m.where("id % 4 <> 0").select("lago", "fecha").distinct()), ["lago", "fecha", "indice"])


@query(f"SELECT id, quality_flag FROM (SELECT id, CASE WHEN id % 11 = 0 THEN 'otra' WHEN id % 13 = 0 THEN NULL ELSE quality_flag END AS quality_flag FROM manifest) WHERE coalesce(quality_flag NOT IN ('{S.PENDING}', '{S.COMPUTED}', '{S.PARTIAL}', '{S.OUTLIERS}'), true)", "manifest")
def flag_violations(spark: SparkSession, sf: str) -> DataFrame:
    m = A.manifest(spark, sf).withColumn("quality_flag", F.when(F.col("id") % 11 == 0, "otra").when(F.col("id") % 13 != 0, F.col("quality_flag")))
    return checks.flag_violations(m).select("id", "quality_flag")


@query(
    f"SELECT id, concat_ws(',', CASE WHEN id % 3 = 0 THEN 'unidad' END, CASE WHEN id % 4 = 0 THEN 'dtype' END) AS campos FROM manifest WHERE quality_flag <> '{S.PENDING}' AND ruta_raster <> '' AND (id % 3 = 0 OR id % 4 = 0)",
    "manifest",
)
def undeclared_fields(spark: SparkSession, sf: str) -> DataFrame:
    m = A.manifest(spark, sf).withColumns({"unidad": F.when(F.col("id") % 3 != 0, "ug/L").otherwise(" "), "dtype": F.when(F.col("id") % 4 != 0, "float32")})
    return checks.undeclared(m, ("unidad", "dtype")).select("id", F.array_join("campos", ",").alias("campos"))


@query(
    "SELECT lago, CAST(fecha AS VARCHAR) AS fecha, CAST(count(DISTINCT id % 2) AS INTEGER) AS n_mallas, CAST(count(DISTINCT indice) AS INTEGER) AS n_indices FROM manifest GROUP BY lago, fecha HAVING count(DISTINCT id % 2) <> 1 OR count(DISTINCT indice) <> 3",
    "manifest",
)
def uneven_grids(spark: SparkSession, sf: str) -> DataFrame:
    m = A.manifest(spark, sf).withColumn("grid", F.struct((F.col("id") % 2).alias("ancho")))
    return checks.uneven_grids(m).withColumn("fecha", text("fecha"))


@query(
    "WITH a AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size >= 35) SELECT 'falta' AS lado, p_brand, p_type FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'sobra', p_brand, p_type FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"
)
def column_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Set differences both ways of two selections' values."""
    p = A.table(spark, sf, "part")
    return checks.key_differences(p.where("p_size < 10"), p.where("p_size >= 35"), ["p_brand", "p_type"])


@query("SELECT lago, pieza, count(*) AS n, round(sum(v), 4) AS suma FROM (SELECT lago, 'primera' AS pieza, v FROM obs WHERE day(fecha) <= 15 UNION ALL SELECT lago, 'segunda', v FROM obs WHERE day(fecha) > 15) GROUP BY lago, pieza", "obs")
def concatenation(spark: SparkSession, sf: str) -> DataFrame:
    o = A.obs(spark, sf)
    first, second = (o.where(c).select(F.lit(p).alias("pieza"), "v", "lago") for c, p in ((F.dayofmonth("fecha") <= 15, "primera"), (F.dayofmonth("fecha") > 15, "segunda")))
    return first.unionByName(second.select("lago", "v", "pieza")).groupBy("lago", "pieza").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("suma"))


# -- map algebra and masks ------------------------------------------------------------


@query("SELECT lago, count(*) AS n, count(*) FILTER (scl NOT IN (1, 2) AND b3 IS NOT NULL) AS n_finitos FROM bands GROUP BY lago", "bands")
def finite_values(spark: SparkSession, sf: str) -> DataFrame:
    b = A.bands(spark, sf)
    v = F.when(F.col("scl") == 1, float("nan")).when(F.col("scl") == 2, float("-inf")).otherwise(F.col("b3"))
    return b.groupBy("lago").agg(F.count(F.lit(1)).alias("n"), F.count_if(M.finite(v)).alias("n_finitos"))


@query(_WBI.replace(") SELECT id, scl, b1, b2, ", "), w AS (SELECT id, scl, b1, b2, ").replace(" AS agua FROM y", " AS agua, (g - r) / nullif(g + r, 0) AS x FROM y) SELECT id, scl, b1, b2, round(CASE WHEN agua THEN ((826.57 * x - 176.43) * x + 19.0) * x + 4.071 END, 4) AS chl FROM w"), "bands")
def masked_chlorophyll(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    wet = M.water_body(c("b1") / 50, c("b2") / 100000, c("b3") * 5, c("b4") * 5, c("b1") / 100, c("b3"))
    value = M.chlorophyll(M.ndci(c("b1") / 50, c("b2") / 100000))
    return A.bands(spark, sf).select("id", "scl", "b1", "b2", F.round(M.masked(wet, value), 4).alias("chl"))


@query("SELECT id, scl, b1, round(b3 - b1 / 100 - (b4 - b1 / 100) * 118 / 200, 6) AS fai, CASE WHEN scl = 6 THEN b3 END AS solo_agua FROM bands", "bands")
def floating_algae(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    out = F.round(M.floating_algae(c("b1") / 100, c("b3"), c("b4")), 6)
    return A.bands(spark, sf).select("id", "scl", "b1", out.alias("fai"), M.masked(M.class_water(c("scl")), c("b3")).alias("solo_agua"))


@query(
    ", x AS (SELECT id, scl, b1, b1 / 50 AS r, b2 / 100000 AS e, b3 AS n FROM bands) SELECT id, scl, b1, round((n - r) / nullif(n + r, 0), 6) AS ndvi, round((e - r) / nullif(e + r, 0), 6) AS ndci, round((826.57 * c - 176.43) * c * c + 19.0 * c + 4.071, 4) AS clorofila FROM (SELECT *, (e - r) / nullif(e + r, 0) AS c FROM x)",
    "bands",
)
def per_pixel_formulas(spark: SparkSession, sf: str) -> DataFrame:
    band = {"b04": F.col("b1") / 50, "b05": F.col("b2") / 100000, "b08": F.col("b3")}
    value = {n: M.formula(n, band.__getitem__) for n in ("ndvi", "ndci", "clorofila")}
    return A.bands(spark, sf).select("id", "scl", "b1", F.round(value["ndvi"], 6).alias("ndvi"), F.round(value["ndci"], 6).alias("ndci"), F.round(value["clorofila"], 4).alias("clorofila"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 100.0::DOUBLE ELSE CAST(s_nationkey AS DOUBLE) * s_nationkey END AS area FROM supplier")
def pixel_area(spark: SparkSession, sf: str) -> DataFrame:
    s = A.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), M.pixel_area(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey").cast("double"))).alias("area"))


_STAR = "((y0 > row + 0.5) <> (y1 > row + 0.5) AND col + 0.5 < x0 + (row + 0.5 - y0) / nullif(y1 - y0, 0) * (x1 - x0))::INT"
#: Each zone's outline: a star of 40 points about a centre that moves with the zone, in pixels.
_STAR_POINTS = "p AS (SELECT lago, k, 32 + 3 * (lago % 5) + (CASE WHEN k % 2 = 0 THEN 24 ELSE 11 END) * cos(k * 0.15707963267948966) AS x, 200 + 20.0::DOUBLE * (lago % 7) + (CASE WHEN k % 2 = 0 THEN 180 ELSE 70 END) * sin(k * 0.15707963267948966) AS y FROM (SELECT DISTINCT lago FROM tile), range(40) k(k))"


def _stars(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines (lago, ring, k, x, y) of the zones of ``tile``."""
    z = A.table(spark, sf, "embeddings").select(F.col("label").alias("lago")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39))))
    odd, turn = F.col("k") % 2 == 0, F.col("k") * 0.15707963267948966
    x = 32 + 3 * (F.col("lago") % 5) + F.when(odd, 24).otherwise(11) * F.cos(turn)
    y = 200 + 20.0 * (F.col("lago") % 7) + F.when(odd, 180).otherwise(70) * F.sin(turn)
    return z.select("lago", F.lit(0).alias("ring"), "k", x.alias("x"), y.alias("y"))


@query(
    f", {_STAR_POINTS}, e AS (SELECT lago, x AS x0, y AS y0, coalesce(lead(x) OVER (PARTITION BY lago ORDER BY k), first(x) OVER (PARTITION BY lago ORDER BY k)) AS x1, coalesce(lead(y) OVER (PARTITION BY lago ORDER BY k), first(y) OVER (PARTITION BY lago ORDER BY k)) AS y1 FROM p), "
    f"d AS (SELECT lago, row, col, v, sum({_STAR}) % 2 = 1 AS dentro FROM tile JOIN e USING (lago) GROUP BY ALL) SELECT lago, count(*) AS n, count(*) FILTER (dentro) AS n_dentro, count(v) FILTER (dentro AND v > 0) AS n_positivos, round(avg(v) FILTER (dentro), 6) AS media FROM d GROUP BY lago",
    "tile",
)
def pixel_mask_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every zone's cells against its own outline, by (zone, row, run)."""
    t = spatial.marked(A.tile(spark, sf), spatial.scanlines(spatial.edge_table(_stars(spark, sf))))
    v = M.masked(F.col("dentro"), F.col("v"))
    return t.groupBy("lago").agg(F.count(F.lit(1)).alias("n"), F.count_if("dentro").alias("n_dentro"), F.count_if(v > 0).alias("n_positivos"), F.round(F.avg(v), 6).alias("media"))


# -- texts ------------------------------------------------------------------------------


@query("""SELECT c_custkey AS id, replace(c_mktsegment || ' "' || c_custkey || '"', '"', '\\"') AS texto, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE printf('%.2f', c_acctbal) END AS fijo, upper(trim('  b' || (c_custkey % 9) || ' ')) AS banda FROM customer""".replace("upper(trim('  b' || (c_custkey % 9) || ' '))", "'B0' || (c_custkey % 9)"))
def request_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    raw = F.concat("c_mktsegment", F.lit(' "'), key, F.lit('"'))
    fixed = M.fixed_text(F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")), 2)
    band = M.band_name(F.concat(F.lit("  b"), (F.col("c_custkey") % 9).cast("string"), F.lit(" ")))
    return c.select(F.col("c_custkey").alias("id"), M.escape_quotes(raw).alias("texto"), fixed.alias("fijo"), band.alias("banda"))


@query("SELECT c_custkey AS id, printf('%g', c_acctbal) AS saldo, printf('%g', c_acctbal * 1000) AS grande, printf('%g', c_acctbal / 100000000) AS chico, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE printf('%g', CAST(c_nationkey AS DOUBLE) * 10) END AS entero FROM customer")
def general_texts(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("c_acctbal")
    whole = M.general_text(F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey") * 10))
    return A.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), M.general_text(b).alias("saldo"), M.general_text(b * 1000).alias("grande"), M.general_text(b / 100_000_000).alias("chico"), whole.alias("entero"))


@query("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS desde, CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) AS hasta, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T00:00:00Z' AS primer, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T23:59:59Z' AS ultimo FROM orders")
def day_intervals(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    (a, b), (c, d) = M.day_interval(day), M.day_range(day)
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), a.cast("string").alias("desde"), b.cast("string").alias("hasta"), c.alias("primer"), d.alias("ultimo"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'r/' || o_orderkey ELSE '/otra/r/' || o_orderkey END AS ruta FROM orders")
def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/datos/r/"), key)).otherwise(F.concat(F.lit("/otra/r/"), key))
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), M.relative_path(path, "/datos").alias("ruta"))


# -- outlines -----------------------------------------------------------------------------

_BOXES = "boxes AS (SELECT n_nationkey AS lago, n_nationkey * 1.0::DOUBLE AS west, n_nationkey + 2.0::DOUBLE AS east, n_regionkey * 1.0::DOUBLE AS south, n_regionkey + 3.0::DOUBLE AS north FROM nation)"
_CANDIDATES = (
    "c AS (SELECT lago, k AS contorno, r AS ring, p AS k, west + (east - west) * dx * f + r * 0.1 AS x, south + (north - south) * dy * f + r * 0.1 AS y FROM boxes, range(3) k(k), range(2) r(r), "
    "(VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0::DOUBLE, 0.0::DOUBLE), (2, 1.0::DOUBLE, 1.0::DOUBLE), (3, 0.0::DOUBLE, 1.0::DOUBLE)) v(p, dx, dy), LATERAL (SELECT CASE WHEN r = 0 THEN (1 + (lago + k) % 3) / 3.0::DOUBLE ELSE 0.2::DOUBLE END AS f))"
)
_AREAS = ", a AS (SELECT lago, contorno, sum(CASE WHEN ring = 0 THEN s ELSE -s END) AS area FROM (SELECT lago, contorno, ring, (max(x) - min(x)) * (max(y) - min(y)) AS s FROM c GROUP BY ALL) GROUP BY ALL) "


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as zones with a box each."""
    n = A.table(spark, sf, "nation")
    key, region = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    return n.select(F.col("n_nationkey").alias("lago"), key.alias("west"), (key + 2).alias("east"), region.alias("south"), (region + 3).alias("north"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Three candidate outlines for each zone, with a hole each."""
    corners = F.explode(F.array(*(F.struct(F.lit(p).alias("k"), F.lit(float(a)).alias("dx"), F.lit(float(b)).alias("dy")) for p, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))).alias("p")
    z = _zones(spark, sf).withColumn("contorno", F.explode(F.array(*map(F.lit, range(3))))).withColumn("ring", F.explode(F.array(F.lit(0), F.lit(1)))).select("*", corners)
    f = F.when(F.col("ring") == 0, (1 + (F.col("lago") + F.col("contorno")) % 3) / 3).otherwise(0.2)
    place = lambda a, b, d: F.col(a) + (F.col(b) - F.col(a)) * F.col(f"p.{d}") * f + F.col("ring") * 0.1
    return z.select("lago", "contorno", "ring", F.col("p.k").alias("k"), place("west", "east", "dx").alias("x"), place("south", "north", "dy").alias("y"))


@query(f"WITH {_BOXES} SELECT lago, CAST(p AS INTEGER) AS k, CASE WHEN p IN (1, 2) THEN east ELSE west END AS x, CASE WHEN p IN (2, 3) THEN north ELSE south END AS y FROM boxes, range(5) t(p)")
def box_rings(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.boxes(_zones(spark, sf))


@query(f"WITH {_BOXES}, {_CANDIDATES}{_AREAS} SELECT lago, contorno, round(area, 6) AS area FROM a")
def outlines_with_holes(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.outline_areas(_candidates(spark, sf), ("lago", "contorno")).select("lago", F.col("contorno").cast("long").alias("contorno"), r6("area"))


@query(f"WITH {_BOXES}, {_CANDIDATES}{_AREAS}, b AS (SELECT lago, contorno FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY round(area, 9) DESC, contorno) AS n FROM a) WHERE n = 1) SELECT lago, contorno, CAST(ring AS BIGINT) AS ring, CAST(k AS BIGINT) AS k, round(x, 6) AS x, round(y, 6) AS y FROM c JOIN b USING (lago, contorno)")
def largest_outline(spark: SparkSession, sf: str) -> DataFrame:
    out = spatial.largest_outline(_candidates(spark, sf))
    return out.select("lago", *(F.col(c).cast("long").alias(c) for c in ("contorno", "ring", "k")), r6("x"), r6("y"))


@query(f"WITH {_BOXES}, {_CANDIDATES}{_AREAS} SELECT lago, round(area, 6) AS area_contorno, 6.0::DOUBLE AS area_caja, round(area / 6, 4) AS razon FROM a WHERE contorno = 0")
def outline_coverage(spark: SparkSession, sf: str) -> DataFrame:
    one = _candidates(spark, sf).where("contorno = 0")
    return _rounded(spatial.coverage(one, spatial.boxes(_zones(spark, sf))), "area_contorno", "area_caja")


@query(f"WITH {_BOXES} SELECT lago, '{{\"type\":\"FeatureCollection\",\"features\":[{{\"type\":\"Feature\",\"properties\":{{\"lago\":' || lago || ',\"is_lake_boundary\":true}},\"geometry\":{{\"type\":\"Polygon\",\"coordinates\":[[[' || west || ',' || south || '],[' || east || ',' || south || '],[' || east || ',' || north || '],[' || west || ',' || north || '],[' || west || ',' || south || ']]]}}}}]}}' AS geojson FROM boxes")
def outline_geojson(spark: SparkSession, sf: str) -> DataFrame:
    return tables.geojson(spatial.boxes(_zones(spark, sf)).withColumn("ring", F.lit(0)))


def _corners(df: DataFrame, *rings: tuple) -> DataFrame:
    """(lago, ring, role, k, x, y) of rings given as (role, ((x, y), ...)) in columns."""
    points = F.array(*(F.struct(F.lit(r).alias("ring"), F.lit(role).alias("role"), F.lit(k).alias("k"), x.cast("double").alias("x"), y.cast("double").alias("y")) for r, (role, ring) in enumerate(rings) for k, (x, y) in enumerate(ring)))
    return df.select("lago", F.explode(points).alias("p")).select("lago", "p.*")


def _supplied(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as zones, with the corner of a box and a shift of another."""
    s = A.table(spark, sf, "supplier")
    c = F.col
    return s.select(c("s_suppkey").alias("lago"), (c("s_suppkey") * 0.5).alias("w"), c("s_nationkey").cast("double").alias("s"), (c("s_suppkey") % 4 * 0.75).alias("dx"), (c("s_nationkey") % 5 * 0.5).alias("dy"))


@query(
    "WITH z AS (SELECT s_suppkey AS lago, (s_suppkey % 4) * 0.75::DOUBLE AS dx, (s_nationkey % 5) * 0.5::DOUBLE AS dy FROM supplier) "
    "SELECT lago, round(12 - greatest(2 - dx, 0) * greatest(3 - dy, 0) - 0.25::DOUBLE, 6) AS area, round(12 - 2 * greatest(2 - dx, 0) * greatest(3 - dy, 0) - 0.25::DOUBLE + 2 * greatest(0.625::DOUBLE - greatest(dx, 0.125::DOUBLE), 0) * greatest(0.625::DOUBLE - greatest(dy, 0.125::DOUBLE), 0), 6) AS area_par FROM z"
)
def united_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Two outer boxes that overlap, coincide or lie apart, less a hole of the first: their union, and their even-odd area."""
    z = _supplied(spark, sf)
    c = F.col
    box = lambda x, y, w, h: ((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    points = _corners(z, ("outer", box(c("w"), c("s"), 2, 3)), ("outer", box(c("w") + c("dx"), c("s") + c("dy"), 2, 3)), ("inner", box(c("w") + 0.125, c("s") + 0.125, 0.5, 0.5)))
    whole, parity = polygons.areas(points), polygons.areas(points, rule="parity").withColumnRenamed("area", "area_par")
    return _rounded(whole.join(parity, "lago"), "area", "area_par")


@query(
    "WITH z AS (SELECT s_suppkey AS lago, 2 + (s_nationkey % 5) * 0.5::DOUBLE AS w FROM supplier) SELECT lago, CAST(p AS INTEGER) AS part, CAST(3 AS BIGINT) AS puntos, round(w / 2, 6) AS area FROM z, range(2) t(p)"
)
def crossed_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Ways that cross themselves fall into two triangles each."""
    z = _supplied(spark, sf)
    x, y, w = F.col("w"), F.col("s"), 2 + F.col("dy")
    found = polygons.polygons(_corners(z, ("outer", ((x, y), (x + w, y + 2), (x + w, y), (x, y + 2)))))
    size = spatial.ring_area(found, ["lago", "part"])
    return found.where("k > 0").groupBy("lago", "part").agg(F.count(F.lit(1)).alias("puntos")).join(size, ["lago", "part"]).select("lago", "part", "puntos", r6("area"))


#: A box of degrees over the cells of ``tile``, whose upper left corner is _ORIGIN: 64 columns and 500 rows of 20 m.
_BOUNDS = (-91.3, -91.288, 14.32, 14.41)
_ORIGIN = (683200.0, 1593800.0)


_WARPED = (
    f", g AS (SELECT * FROM {utm_sql('(SELECT r AS row, c AS col, -91.3::DOUBLE + (c + 0.5::DOUBLE) * ((-91.288::DOUBLE + 91.3::DOUBLE) / 40) AS lon, 14.41::DOUBLE - (r + 0.5::DOUBLE) * ((14.41::DOUBLE - 14.32::DOUBLE) / 40) AS lat FROM range(40) r(r), range(40) c(c))')}), "
    f"q AS (SELECT row, col, ({_ORIGIN[1]!r}::DOUBLE - norte) / 20 - 0.5::DOUBLE AS y, (este - {_ORIGIN[0]!r}::DOUBLE) / 20 - 0.5::DOUBLE AS x FROM g), t AS (SELECT lago, row AS sr, col AS sc, v FROM tile), z AS (SELECT DISTINCT lago FROM t), "
    "n AS (SELECT z.lago, q.row, q.col, t.v, (1 - abs(q.y - t.sr)) * (1 - abs(q.x - t.sc)) AS w FROM z CROSS JOIN q LEFT JOIN t ON t.lago = z.lago AND t.sr IN (floor(q.y), floor(q.y) + 1) AND t.sc IN (floor(q.x), floor(q.x) + 1)) "
    ", d AS (SELECT lago, row, col, sum(w * v) / nullif(sum(w) FILTER (v IS NOT NULL), 0) AS v FROM n GROUP BY lago, row, col) "
)


@query(_WARPED + "SELECT lago, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(v, 5) AS v FROM d", "tile")
def warp_to_degrees(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tile(spark, sf).withColumn("row", F.col("row").cast("int"))
    out = spatial.warp_wgs84(t, ["lago"], _ORIGIN, 20.0, _BOUNDS, 40, 40)
    return out.select("lago", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("v", 5).alias("v"))


@query(
    "WITH s AS (SELECT label AS lago, vec_id AS sr, p - 1 AS sc, CAST(embedding[p] AS DOUBLE) AS v FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) WHERE embedding[p] >= -0.1), "
    "h AS (SELECT label AS lago, max(vec_id) + 1 AS n FROM embeddings GROUP BY label), g AS (SELECT lago, r, c, (r + 0.5::DOUBLE) * 2.5::DOUBLE + 0.75::DOUBLE - 0.5::DOUBLE AS y, (c + 0.5::DOUBLE) * 1.6::DOUBLE + 0.25::DOUBLE - 0.5::DOUBLE AS x FROM (SELECT lago, unnest(range(CAST(ceil(n / 2.5::DOUBLE) AS BIGINT))) AS r FROM h), range(40) t(c)), "
    "n AS (SELECT g.lago, r, c, v, (1 - abs(y - sr)) * (1 - abs(x - sc)) AS w FROM g JOIN s ON s.lago = g.lago AND sr IN (floor(y), floor(y) + 1) AND sc IN (floor(x), floor(x) + 1)) "
    "SELECT lago, r AS row, c AS col, round(sum(w * v) / sum(w), 6) AS v FROM n WHERE w > 0 GROUP BY lago, r, c"
)
def resampled_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Each zone's cells on a coarser, shifted grid; rows of cells become tiles, and only tiles are shuffled."""
    e = A.table(spark, sf, "embeddings").select(F.col("label").alias("lago"), F.col("vec_id").cast("int").alias("row"), F.lit(0).alias("col"), F.transform("embedding", lambda x: F.when(x >= -0.1, x.cast("double"))).alias("v"))
    made = tiles_.build(e, ["lago"])
    n = F.max("row") + 1
    grid = lambda x, y, px, py, w, h: F.struct(F.lit(32615).alias("crs"), *(F.lit(float(v)).alias(k) for k, v in zip(("x", "y", "px", "py"), (x, y, px, py), strict=True)), F.lit(w).alias("width"), h.cast("int").alias("height"))
    plan = e.groupBy("lago").agg(grid(0, 0, 1, 1, 64, n).alias("of"), grid(0.25, -0.75, 1.6, 2.5, 40, F.ceil(n / 2.5)).alias("to"))
    out = tiles_.cells(tiles_.resample(made, plan, ["lago"]), ["lago"]).where("v IS NOT NULL")
    return out.select("lago", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), r6("v"))


@query(", a AS (SELECT lago, row, col, v FROM tile WHERE row % 2 = 0) SELECT t.lago, t.row, t.col, round(a.v, 6) AS v FROM tile t LEFT JOIN a USING (lago, row, col)", "tile")
def align_equal_grids(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tile(spark, sf)
    grid = {"crs": 32615, "transform": (0.0, 0.0, 10.0, 10.0), "width": 64, "height": 500}
    out = spatial.align(t.where("row % 2 = 0"), t.select("lago", "row", "col"), ["lago"], grid, dict(grid))
    return out.select("lago", "row", F.col("col").cast("long").alias("col"), r6("v"))


# -- joins of tables ------------------------------------------------------------------------


@query("SELECT a.lago, a.row, a.col, round(a.v, 6) AS x, round(b.v, 6) AS y FROM tile a JOIN tile b ON a.lago = b.lago AND a.row = b.row AND a.col = b.col WHERE a.v > 0 AND b.v < 0.2", "tile")
def index_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tile(spark, sf)
    out = compare.join_indices(t.where("v > 0"), t.where("v < 0.2"), ("lago", "row", "col"))
    return out.select("lago", "row", F.col("col").cast("long").alias("col"), r6("x"), r6("y"))


@query(", e AS (SELECT lago, max(fecha) AS fecha, 'ultima' AS criterio_seleccion FROM obs GROUP BY lago), d AS (SELECT lago, fecha, count(v) AS n FROM obs WHERE v IS NOT NULL GROUP BY lago, fecha) SELECT d.lago, CAST(d.fecha AS VARCHAR) AS fecha, n AS n_pixeles, coalesce(criterio_seleccion, '') AS criterio_seleccion FROM d LEFT JOIN e USING (lago, fecha)", "obs")
def distribution_reasons(spark: SparkSession, sf: str) -> DataFrame:
    o = A.obs(spark, sf)
    why = o.groupBy("lago").agg(F.max("fecha").alias("fecha"), F.lit("ultima").alias("criterio_seleccion"))
    return compare.with_reasons(scenes.distribution(o), why).select("lago", text("fecha"), "n_pixeles", "criterio_seleccion")


@query(
    f", b AS (SELECT lago, fecha, round(max(v), 6) AS maximo FROM obs GROUP BY lago, fecha) SELECT lago, CAST(fecha AS VARCHAR) AS fecha, maximo, quality_flag AS marca, CASE WHEN quality_flag <> '{S.COMPUTED}' THEN 'advertencia: ' || replace(quality_flag, '_', ' ') ELSE '' END AS nota FROM b LEFT JOIN series USING (lago, fecha)",
    "obs", "series",
)
def flagged_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.obs(spark, sf).groupBy("lago", "fecha").agg(F.round(F.max("v"), 6).alias("maximo"))
    return render.flagged_dates(rows, A.series(spark, sf)).withColumn("fecha", text("fecha"))


@query(
    _LONG + ", z AS (SELECT lago, indice, metodo, count(*) AS n_fechas, quantile_cont(round(r, 8), 0.5) AS m FROM u WHERE r IS NOT NULL GROUP BY lago, indice, metodo), g AS (SELECT lago, indice, count(*) AS n, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS r FROM pairs GROUP BY lago, indice) "
    "SELECT z.lago, z.indice, n_fechas, round(m, 6) AS coef_mediana, round(round(g.r, 8), 6) AS coeficiente_agrupado, g.n AS n_pares_agrupado FROM z JOIN g USING (lago, indice) WHERE metodo = 'pearson'",
    *_PAIRS,
)
def dates_and_pooled(spark: SparkSession, sf: str) -> DataFrame:
    p = A.pairs(spark, sf)
    zones = correlate.by_zone(correlate.by_date(p)).where("metodo = 'pearson'")
    pooled = correlate.by_date(p, ["lago", "indice"]).where("metodo = 'pearson'").select("lago", "indice", F.col("coeficiente").alias("coeficiente_agrupado"), F.col("n_pares").alias("n_pares_agrupado"))
    return _rounded(zones.join(pooled, ["lago", "indice"]).select("lago", "indice", "n_fechas", "coef_mediana", "coeficiente_agrupado", "n_pares_agrupado"), "coef_mediana", "coeficiente_agrupado")


@query(
    ", i AS (SELECT lago, v FROM tile WHERE col < 32 AND row < 250 AND v IS NOT NULL) SELECT lago, count(v) AS n_pixeles, round(min(v), 6) AS min, round(quantile_cont(v, 0.5), 6) AS mediana, round(max(v), 6) AS max, round(avg(v), 6) AS media, round(stddev_pop(v), 6) AS desviacion_std FROM i GROUP BY lago",
    "tile",
)
def outlined_distribution(spark: SparkSession, sf: str) -> DataFrame:
    half = [[(0.0, 0.0), (32.0, 0.0), (32.0, 250.0), (0.0, 250.0)]]
    t = spatial.within(A.tile(spark, sf), spatial.scanlines(spatial.edge_table(spatial.outlines(spark, {"mitad": half})), ()), ())
    out = scenes.distribution(t, keys=("lago",)).select("lago", "n_pixeles", "min", "mediana", "max", "media", "desviacion_std")
    return _rounded(out, "min", "mediana", "max", "media", "desviacion_std")


@query("SELECT * REPLACE (CAST(fecha AS VARCHAR) AS fecha, round(cyano_promedio, 6) AS cyano_promedio) FROM series ORDER BY quality_flag, fecha DESC, lago", "obs", "series")
def composite_sort(spark: SparkSession, sf: str) -> DataFrame:
    out = A.series(spark, sf).orderBy("quality_flag", F.desc("fecha"), "lago")
    return out.select("lago", text("fecha"), r6("cyano_promedio"), "quality_flag")


# -- data of figures --------------------------------------------------------------------------


@query(
    ", q AS (SELECT lago, fecha, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM obs WHERE v IS NOT NULL GROUP BY lago, fecha) SELECT lago, CAST(fecha AS VARCHAR) AS fecha, round(a, 6) AS q25, round(m, 6) AS mediana, round(b, 6) AS q75, round(least(a, min(v) FILTER (v >= a - (b - a) * 1.5)), 6) AS bigote_bajo, round(greatest(b, max(v) FILTER (v <= b + (b - a) * 1.5)), 6) AS bigote_alto FROM obs JOIN q USING (lago, fecha) GROUP BY lago, fecha, a, m, b",
    "obs",
)
def box_plot(spark: SparkSession, sf: str) -> DataFrame:
    out = render.box_plot(A.obs(spark, sf), ["lago", "fecha"])
    return _rounded(out, "q25", "mediana", "q75", "bigote_bajo", "bigote_alto").withColumn("fecha", text("fecha"))


def _channel(k: int) -> str:
    (a, *_), (b, *_), (c, *_) = (s[:1] for s in render.STOPS)
    x, y, z = (s[k] for s in render.STOPS)
    return f"CAST(floor(CASE WHEN t <= {b} THEN {x} + (t - {a}) * ({y - x} / {b - a}::DOUBLE) ELSE {y} + (t - {b}) * ({z - y} / {c - b}::DOUBLE) END + 0.5) AS BIGINT)"


@query(f", n AS (SELECT lago, row, col, greatest(0, least(1, (v + 0.4) / 0.8::DOUBLE)) AS t FROM tile) SELECT lago, row, col, {_channel(1)} AS rojo, {_channel(2)} AS verde, {_channel(3)} AS azul, CAST(255 AS BIGINT) AS alfa FROM n", "tile")
def coloured_map(spark: SparkSession, sf: str) -> DataFrame:
    out = render.coloured(A.tile(spark, sf), -0.4, 0.4)
    return out.select("lago", "row", *(F.col(c).cast("long").alias(c) for c in ("col", "rojo", "verde", "azul", "alfa")))


@query(
    _WARPED + f", c AS (SELECT lago, greatest(0, least(1, (v + 0.4) / 0.8::DOUBLE)) AS t FROM d WHERE v IS NOT NULL), k AS (SELECT lago, {_channel(1)} AS rojo, {_channel(2)} AS verde, {_channel(3)} AS azul FROM c) SELECT lago, count(*) AS n, round(avg(rojo), 1) AS rojo, round(avg(verde), 1) AS verde, round(avg(azul), 1) AS azul FROM k GROUP BY lago",
    "tile",
)
def layered_map(spark: SparkSession, sf: str) -> DataFrame:
    """Each zone's cells as a coloured layer on a grid of degrees."""
    t = A.tile(spark, sf).withColumn("row", F.col("row").cast("int"))
    grid = {"transform": (*_ORIGIN, 20.0, 20.0), "width": 40, "height": 40}
    out = render.layers(t, ["lago"], grid, _BOUNDS, -0.4, 0.4).where("v IS NOT NULL")
    return out.groupBy("lago").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 1).alias(c) for c in ("rojo", "verde", "azul")))


@query(f"SELECT lago, CAST(fecha AS VARCHAR) AS fecha, porcentaje_alto, quality_flag = '{S.PARTIAL}' AS parcial FROM extent JOIN series USING (lago, fecha)", "obs", "series", "extent")
def extent_series(spark: SparkSession, sf: str) -> DataFrame:
    e = scenes.extent(A.obs(spark, sf)).join(A.series(spark, sf).select("lago", "fecha", "quality_flag"), ["lago", "fecha"])
    return render.extent_series(e).withColumn("fecha", text("fecha"))


@query(
    f"SELECT lago, CAST(fecha AS VARCHAR) AS fecha, 'cianobacteria' AS indice, 'mapa' AS tipo_mapa, lago || '_' || fecha || '_cianobacteria_mapa.png' AS archivo, 'png' AS formato, 0.0::DOUBLE AS vmin, round(greatest(max(v), 10), 6) AS vmax, {S.HIGH_UGL}::DOUBLE AS umbral_alto_ugl FROM obs GROUP BY lago, fecha",
    "obs",
)
def map_metadata(spark: SparkSession, sf: str) -> DataFrame:
    scales = A.obs(spark, sf).groupBy("lago", "fecha").agg(F.lit(0.0).alias("vmin"), F.round(F.greatest(F.max("v"), F.lit(10.0)), 6).alias("vmax"))
    return render.map_rows(scales, "cianobacteria", "mapa").drop("generado_en").withColumn("fecha", text("fecha"))


@query(
    f""", b AS (SELECT lago, fecha FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY quality_flag = '{S.COMPUTED}' DESC, cyano_promedio, fecha) AS k FROM series) WHERE k = 1),
 a AS (SELECT lago, fecha FROM (SELECT *, row_number() OVER (PARTITION BY lago ORDER BY cyano_promedio DESC, fecha) AS k FROM series) WHERE k = 1),
 d AS (SELECT lago, fecha, 0 AS lugar FROM b UNION ALL SELECT a.lago, a.fecha, 1 FROM a JOIN b ON a.lago = b.lago AND a.fecha <> b.fecha),
 p AS (SELECT lago, lugar, v FROM obs JOIN d USING (lago, fecha))
SELECT lago, CAST(lugar AS BIGINT) AS lugar, count(v) AS n, (SELECT round(greatest(quantile_cont(v, 0.98), 10), 6) FROM p) AS vmax FROM p GROUP BY lago, lugar""",
    "obs", "series",
)
def panel(spark: SparkSession, sf: str) -> DataFrame:
    dates = series.panel_dates(A.series(spark, sf), "1900-01-01")  # a common date without scenes
    pixels, scale = render.panel(A.obs(spark, sf), dates)
    top = round(scale.first()["vmax"], 6)
    return pixels.groupBy("lago", F.col("lugar").cast("long").alias("lugar")).agg(F.count("v").alias("n"), F.lit(top).alias("vmax"))
