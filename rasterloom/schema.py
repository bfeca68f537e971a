"""Table schemas and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)


# Fixed values of the domain.
HIGH_UGL = 10.0
OUTLIER_FRACTION = 0.10
PEAK_SIGMAS = 1.0
TARGET_M = 10
COMMON_DATE = "2026-04-13"
POOL_CAP = 10_000
FIGURE_CAP = 5_000
DRY_MONTHS = (11, 12, 1, 2, 3, 4)
WET_MONTHS = (5, 6, 7, 8, 9, 10)
CYANO_RANGE = (0.0, 500.0)
INDICES = ("ndvi", "ndwi", "cianobacteria")
SCL_EXCLUDED = (0, 1, 2, 3, 8, 9, 10, 11)
SCL_WATER = 6
PENDING, COMPUTED, PARTIAL, OUTLIERS = "pendiente_calculo", "calculado", "cobertura_parcial_oficial", "revisar_valores_atipicos"
REQUEST_LIMIT = 2500
METRES_PER_DEGREE = 111_320
#: west, east, south, north of each zone.
ZONES = {"atitlan": (-91.326256, -91.07151, 14.5948, 14.750979), "amatitlan": (-90.638065, -90.512924, 14.412347, 14.493799)}
#: zone, date, official cloud cover in percent, satellite, official valid cover in percent.
SCENES = (
    ("amatitlan", "2025-01-28", 0.06, "Sentinel-2B", None),
    ("amatitlan", "2025-04-15", 0.09, "Sentinel-2A", None),
    ("amatitlan", "2025-04-28", 1.03, "Sentinel-2B", None),
    ("amatitlan", "2025-11-24", 0.50, "Sentinel-2B", None),
    ("amatitlan", "2026-01-08", 0.77, "Sentinel-2C", None),
    ("amatitlan", "2026-02-02", 0.39, "Sentinel-2B", None),
    ("amatitlan", "2026-02-07", 0.02, "Sentinel-2C", 57.1),
    ("amatitlan", "2026-03-29", 0.01, "Sentinel-2C", None),
    ("amatitlan", "2026-04-13", 0.09, "Sentinel-2B", None),
    ("amatitlan", "2026-04-28", 4.96, "Sentinel-2C", None),
    ("amatitlan", "2026-06-19", 13.00, "Sentinel-2A", None),
    ("atitlan", "2025-01-18", 0.02, "Sentinel-2B", None),
    ("atitlan", "2025-04-13", 0.54, "Sentinel-2C", None),
    ("atitlan", "2025-05-13", 4.37, "Sentinel-2C", None),
    ("atitlan", "2025-07-17", 3.57, "Sentinel-2A", None),
    ("atitlan", "2025-11-21", 3.15, "Sentinel-2A", None),
    ("atitlan", "2025-12-29", 3.17, "Sentinel-2C", None),
    ("atitlan", "2026-02-12", 0.04, "Sentinel-2B", None),
    ("atitlan", "2026-03-24", 3.17, "Sentinel-2B", None),
    ("atitlan", "2026-04-13", 0.01, "Sentinel-2B", None),
    ("atitlan", "2026-04-28", 4.96, "Sentinel-2C", None),
    ("atitlan", "2026-07-22", 4.02, "Sentinel-2B", None),
)

# Fixed values of the domain: notes of scenes; how scenes are fetched, and their flag until then.
NOTES = {("amatitlan", "2026-02-07"): "Fecha oficial incluida para completar 11 observaciones; cobertura válida parcial aproximada de 57.1 %."}
PRODUCT, FETCHED_BY, NOT_FETCHED = "SENTINEL2_L2A", "openEO Copernicus Data Space", "pendiente_descarga"
LEAST_BANDS = ("B03", "B04", "B08", "SCL")

# Fixed values of the domain: columns of the tables, in their order.
_TEXT, _DAY, _REAL, _WHOLE = StringType(), DateType(), DoubleType(), LongType()
SCENE_MANIFEST = StructType([
    StructField("lago", _TEXT), StructField("fecha", _DAY), StructField("satelite_oficial", _TEXT), StructField("nubosidad_oficial_pct", _REAL),
    StructField("cobertura_valida_oficial_pct", _REAL), StructField("west", _REAL), StructField("east", _REAL), StructField("south", _REAL), StructField("north", _REAL),
    StructField("producto", _TEXT), StructField("bandas", _TEXT), StructField("metodo_descarga", _TEXT), StructField("id_adquisicion", _TEXT), StructField("estado", _TEXT),
    StructField("ruta_local", _TEXT), StructField("cobertura_valida_pct", _REAL), StructField("crs_salida", _TEXT), StructField("resolucion_salida", _TEXT),
    StructField("quality_flag", _TEXT), StructField("observaciones", _TEXT),
])
INDEX_MANIFEST = StructType([
    StructField("lago", _TEXT), StructField("fecha", _DAY), StructField("indice", _TEXT), StructField("ruta_raster", _TEXT), StructField("metodo", _TEXT),
    StructField("formula_version", _TEXT), StructField("unidad", _TEXT), StructField("dtype", _TEXT), StructField("nodata", _TEXT), StructField("crs", _TEXT),
    StructField("resolucion_m", _REAL), StructField("pixeles_validos", _WHOLE), StructField("pixeles_lago", _WHOLE), StructField("cobertura_valida_pct", _REAL),
    StructField("frac_valores_atipicos", _REAL), StructField("quality_flag", _TEXT),
])
TEMPORAL_SUMMARY = StructType([
    StructField("lago", _TEXT), StructField("fecha", _DAY), StructField("cyano_promedio", _REAL), StructField("cyano_mediana", _REAL), StructField("cyano_std", _REAL),
    StructField("pixeles_validos", _WHOLE), StructField("cobertura_valida_pct", _REAL), StructField("quality_flag", _TEXT),
])
BLOOM_EXTENT = StructType([
    StructField("lago", _TEXT), StructField("fecha", _DAY), StructField("umbral_alto_ugl", _REAL), StructField("resolucion_m", _REAL), StructField("area_pixel_m2", _REAL),
    StructField("pixeles_validos_lago", _WHOLE), StructField("pixeles_altos", _WHOLE), StructField("area_valida_m2", _REAL), StructField("area_alta_m2", _REAL),
    StructField("porcentaje_alto", _REAL), StructField("cobertura_valida_pct", _REAL), StructField("quality_flag", _TEXT),
])
CORRELATION_BY_DATE = StructType([
    StructField("lago", _TEXT), StructField("fecha", _DAY), StructField("indice", _TEXT), StructField("metodo", _TEXT), StructField("coeficiente", _REAL), StructField("p_value", _TEXT),
    StructField("n_pares", _WHOLE), StructField("direccion", _TEXT), StructField("magnitud", _TEXT), StructField("quality_flag_cianobacteria", _TEXT), StructField("quality_flag_indice", _TEXT),
    StructField("nota_inferencia", _TEXT),
])
CORRELATION_BY_ZONE = StructType([
    StructField("lago", _TEXT), StructField("indice", _TEXT), StructField("metodo", _TEXT), StructField("n_fechas", _WHOLE), StructField("n_pares_total", _WHOLE), StructField("coeficiente_medio_fechas", _REAL),
    StructField("coeficiente_mediano_fechas", _REAL), StructField("coeficiente_minimo_fecha", _REAL), StructField("coeficiente_maximo_fecha", _REAL), StructField("fraccion_fechas_positivas", _REAL),
    StructField("coeficiente_agrupado_estratificado", _REAL), StructField("p_value_agrupado", _TEXT), StructField("n_pares_agrupado", _WHOLE), StructField("magnitud_agrupada", _TEXT), StructField("nota_inferencia", _TEXT),
])
DATE_NOTE = "p_value_exploratorio_por_autocorrelacion_espacial"
ZONE_NOTE = "muestra_equilibrada_por_fecha; p_value_exploratorio_por_autocorrelacion_espacial"
PIXEL = StructType([
    StructField("lago", _TEXT), StructField("fecha", _DAY), StructField("row", IntegerType()), StructField("col", IntegerType()),
    StructField("cyano", FloatType()), StructField("ndvi", FloatType()), StructField("ndwi", FloatType()),
])
MAP_METADATA = StructType([
    StructField("lago", _TEXT), StructField("fecha", _DAY), StructField("indice", _TEXT), StructField("tipo_mapa", _TEXT), StructField("archivo", _TEXT), StructField("formato", _TEXT),
    StructField("vmin", _REAL), StructField("vmax", _REAL), StructField("umbral_alto_ugl", _REAL), StructField("generado_en", TimestampType()),
])
GRIDS = StructType([
    StructField("lago", _TEXT), StructField("crs", IntegerType()), StructField("x", _REAL), StructField("y", _REAL), StructField("resolucion", _REAL), StructField("ancho", IntegerType()), StructField("alto", IntegerType()),
])
