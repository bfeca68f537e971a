"""The driver's tables as relations of scenes, pixels, bands and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: zone, date, pixel, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("lago"), F.to_date("ts").alias("fecha"), F.col("user_id").alias("pix"), F.col("value").alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each zone, date and pixel."""
    return obs(spark, sf_dir).groupBy("lago", "fecha", "pix").agg(F.avg("v").alias("v"))


def tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a raster: zone, row, col, value."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("lago"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bands and a class for each pixel of a zone and date."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("lago"), F.to_date("l_shipdate").alias("fecha"), F.col("l_linenumber").alias("scl"),
        F.col("l_quantity").alias("b1"), F.col("l_extendedprice").alias("b2"), F.col("l_discount").alias("b3"), F.col("l_tax").alias("b4"), F.col("l_partkey").alias("part"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by date; every seventh day of a month stands for partial cover."""
    flag = F.when(F.dayofmonth("fecha") % 7 == 0, S.PARTIAL).otherwise(S.COMPUTED)
    return obs(spark, sf_dir).groupBy("lago", "fecha").agg(F.avg("v").alias("cyano_promedio")).withColumn("quality_flag", flag)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two indices by zone and date: quantity against price and tax of the orders' lines."""
    b = bands(spark, sf_dir)
    long = F.explode(F.array(F.struct(F.lit("ndvi").alias("i"), F.col("b2").alias("y")), F.struct(F.lit("ndwi").alias("i"), F.col("b4").alias("y")))).alias("e")
    year = F.trunc("fecha", "year").alias("fecha")
    return b.select("id", "part", "scl", "lago", year, F.col("b1").alias("x"), long).select("id", "part", "scl", "lago", "fecha", "x", F.col("e.i").alias("indice"), F.col("e.y").alias("y"))


def obs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the observations' values with their pixel and their hour, by zone and month."""
    e = table(spark, sf_dir, "events")
    long = F.explode(F.array(F.struct(F.lit("ndvi").alias("i"), F.col("user_id").cast("double").alias("y")), F.struct(F.lit("ndwi").alias("i"), F.hour("ts").cast("double").alias("y")))).alias("e")
    return e.select(F.col("event_type").alias("lago"), F.to_date(F.trunc("ts", "month")).alias("fecha"), F.col("value").alias("x"), long).select("lago", "fecha", "x", F.col("e.i").alias("indice"), F.col("e.y").alias("y"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manifest rows: some pending, some without a path."""
    o = table(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderstatus") == "P", S.PENDING).when(F.col("o_orderstatus") == "F", S.PARTIAL).otherwise(S.COMPUTED)
    path = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("r/"), F.col("o_orderkey").cast("string"))).otherwise("")
    return o.select(
        F.col("o_orderpriority").alias("lago"), F.to_date("o_orderdate").alias("fecha"), F.element_at(F.array(*map(F.lit, S.INDICES)), (F.col("o_custkey") % 3 + 1).cast("int")).alias("indice"),
        flag.alias("quality_flag"), path.alias("ruta_raster"), F.col("o_orderkey").alias("id"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as official scenes of the two zones; some clouds are no percentage."""
    o, c = table(spark, sf_dir, "orders"), F.col
    return o.select(
        c("o_orderkey").alias("id"), F.when(c("o_custkey") % 2 == 0, "atitlan").otherwise("amatitlan").alias("lago"), F.to_date("o_orderdate").alias("fecha"), c("o_orderpriority").alias("satelite_oficial"),
        (c("o_orderkey") % 1300 / F.lit(10.0)).alias("nubosidad_oficial_pct"), F.when(c("o_orderkey") % 9 == 0, 57.1).alias("cobertura_valida_oficial_pct"),
    )


#: The same relations for the oracle.
SQL = {
    "escenas": "escenas AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'atitlan' ELSE 'amatitlan' END AS lago, CAST(o_orderdate AS DATE) AS fecha, o_orderpriority AS satelite_oficial, (o_orderkey % 1300) / 10.0::DOUBLE AS nubosidad_oficial_pct, CASE WHEN o_orderkey % 9 = 0 THEN 57.1::DOUBLE END AS cobertura_valida_oficial_pct FROM orders)",
    "obs": "obs AS (SELECT event_type AS lago, CAST(ts AS DATE) AS fecha, user_id AS pix, value AS v FROM events)",
    "pixels": "pixels AS (SELECT lago, fecha, pix, avg(v) AS v FROM obs GROUP BY ALL)",
    "tile": "tile AS (SELECT label AS lago, vec_id AS row, p - 1 AS col, CAST(embedding[p] AS DOUBLE) AS v FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))",
    "bands": "bands AS (SELECT l_orderkey AS id, l_returnflag AS lago, CAST(l_shipdate AS DATE) AS fecha, l_linenumber AS scl, l_quantity AS b1, l_extendedprice AS b2, l_discount AS b3, l_tax AS b4, l_partkey AS part FROM lineitem)",
    "series": f"series AS (SELECT lago, fecha, avg(v) AS cyano_promedio, CASE WHEN day(fecha) % 7 = 0 THEN '{S.PARTIAL}' ELSE '{S.COMPUTED}' END AS quality_flag FROM obs GROUP BY lago, fecha)",
    "pairs": "pairs AS (SELECT id, part, scl, lago, CAST(date_trunc('year', fecha) AS DATE) AS fecha, b1 AS x, 'ndvi' AS indice, b2 AS y FROM bands UNION ALL SELECT id, part, scl, lago, CAST(date_trunc('year', fecha) AS DATE), b1, 'ndwi', b4 FROM bands)",
    "obs_pairs": "obs_pairs AS (SELECT event_type AS lago, CAST(date_trunc('month', ts) AS DATE) AS fecha, value AS x, 'ndvi' AS indice, CAST(user_id AS DOUBLE) AS y FROM events UNION ALL SELECT event_type, CAST(date_trunc('month', ts) AS DATE), value, 'ndwi', CAST(hour(ts) AS DOUBLE) FROM events)",
    "manifest": f"manifest AS (SELECT o_orderpriority AS lago, CAST(o_orderdate AS DATE) AS fecha, (['ndvi', 'ndwi', 'cianobacteria'])[o_custkey % 3 + 1] AS indice, CASE o_orderstatus WHEN 'P' THEN '{S.PENDING}' WHEN 'F' THEN '{S.PARTIAL}' ELSE '{S.COMPUTED}' END AS quality_flag, CASE WHEN o_orderkey % 5 <> 0 THEN 'r/' || o_orderkey ELSE '' END AS ruta_raster, o_orderkey AS id FROM orders)",
    "extent": "extent AS (SELECT lago, fecha, 10.0::DOUBLE AS umbral_alto_ugl, 100.0::DOUBLE AS area_pixel_m2, count(v) AS pixeles_validos_lago, count(*) FILTER (v >= 10) AS pixeles_altos, count(v) * 100.0::DOUBLE AS area_valida_m2, count(*) FILTER (v >= 10) * 100.0::DOUBLE AS area_alta_m2, coalesce(round(100.0::DOUBLE * count(*) FILTER (v >= 10) / nullif(count(v), 0), 4), 0) AS porcentaje_alto FROM obs GROUP BY lago, fecha)",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
