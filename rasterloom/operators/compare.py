"""Joins of scenes and tables: change maps, zone comparison, seasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions.indices import joined, season
from rasterloom.operators.series import first_of, half_split_trend


def join_indices(cyano: DataFrame, other: DataFrame, keys: Sequence[str] = ("lago", "fecha", "row", "col")) -> DataFrame:
    """Pairs of values of two index tables on one grid."""
    return cyano.select(*keys, F.col("v").alias("x")).join(other.select(*keys, F.col("v").alias("y")), list(keys))


def difference_map(pixels: DataFrame, first: str, second: str, keys: Sequence[str] = ("lago", "row", "col"), value: str = "v") -> DataFrame:
    """Later less earlier value of every pixel valid on both dates.

    One scan and one aggregation by pixel instead of a self-join.
    """
    on = lambda d: F.max(F.when(F.col("fecha") == F.lit(d).cast("date"), F.col(value)))
    both = pixels.where((F.col("fecha") == F.lit(first).cast("date")) | (F.col("fecha") == F.lit(second).cast("date")))
    out = both.groupBy(*keys).agg((on(second) - on(first)).alias("diferencia"))
    return out.where(F.col("diferencia").isNotNull())


def upper_median(value: str | Column) -> Column:
    """The upper of the two middle values, without interpolation."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def seasonal(series: DataFrame, value: str = "cyano_promedio") -> DataFrame:
    """Dates, mean, upper median, population deviation and list of dates of each zone and season."""
    rows = series.where(F.col(value).isNotNull()).withColumn("estacion", season(F.col("fecha")))
    return rows.groupBy("lago", "estacion").agg(
        F.count(F.lit(1)).alias("n_fechas"), F.avg(value).alias("cyano_promedio"), upper_median(value).alias("cyano_mediana"), F.stddev_pop(value).alias("cyano_std"),
        joined(F.collect_list(F.col("fecha").cast("string"))).alias("fechas"),
    )


def over_domain(rows: DataFrame, domain: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every combination of a fixed domain, with gaps where there is no row."""
    return domain.join(rows, list(keys), "left")


def zone_comparison(series: DataFrame, extents: DataFrame, persistent: DataFrame, correlations: DataFrame, threshold: float = S.HIGH_UGL) -> DataFrame:
    """One row a zone from the date tables; pixels are not read again. Missing parts stay NULL."""
    complete = series.where(F.col("quality_flag") == S.COMPUTED)
    v = F.col("cyano_promedio")
    general = complete.groupBy("lago").agg(
        F.count(F.lit(1)).alias("n_fechas_calculado"), F.avg(v).alias("cyano_promedio_general"), upper_median(v).alias("cyano_mediana_general"),
        F.count_if(v >= threshold).alias("frecuencia_fechas_sobre_umbral"), F.round(F.try_divide(100.0 * F.count_if(v >= threshold), F.count(F.lit(1))), 4).alias("pct_fechas_sobre_umbral"),
    )
    total = series.groupBy("lago").agg(F.count(F.lit(1)).alias("n_fechas_total"))
    known = extents.join(complete.select("lago", "fecha"), ["lago", "fecha"])
    area = known.groupBy("lago").agg(F.avg("porcentaje_alto").alias("porcentaje_alto_promedio"), F.max("porcentaje_alto").alias("porcentaje_alto_maximo"))
    largest = first_of(known, ["lago"], F.col("porcentaje_alto").desc(), F.col("fecha")).select("lago", F.col("fecha").alias("fecha_porcentaje_alto_maximo"))
    wide = correlations.groupBy("lago").agg(
        *(F.max(F.when((F.col("indice") == i) & (F.col("metodo") == "pearson"), F.col("coef_mediana"))).alias(f"correlacion_{i}_pearson_mediana") for i in ("ndvi", "ndwi"))
    )
    trend = half_split_trend(complete).select("lago", "tendencia_temporal")
    out = total
    for part in (general, area, largest, persistent, wide, trend):
        out = out.join(part, "lago", "left")
    return out


def pivot_methods(rows: DataFrame) -> DataFrame:
    """Coefficients of each zone and index by method, as columns."""
    return rows.groupBy("lago", "indice").pivot("metodo", ["pearson", "spearman"]).agg(F.first("coef_mediana"))


def with_reasons(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """Selection reasons of the dates that have any, else the empty text."""
    out = rows.join(reasons, ["lago", "fecha"], "left")
    return out.withColumn("criterio_seleccion", F.coalesce("criterio_seleccion", F.lit("")))


def update_rows(manifest: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The manifest with the changes' columns where a key has them; unknown columns or keys are errors."""
    unknown = set(changes.columns) - set(manifest.columns)
    if unknown:
        raise KeyError(f"unknown fields: {sorted(unknown)}")
    if not changes.join(manifest, list(keys), "left_anti").isEmpty():
        raise ValueError("changes for keys that the manifest does not have")
    new = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in new))
    out = manifest.join(marked, list(keys), "left")
    return out.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in manifest.columns))


def reference_grid(scenes: DataFrame, grid: str = "grid") -> DataFrame:
    """Scenes whose grid differs from that of their zone's first date."""
    first = F.first_value(grid).over(Window.partitionBy("lago").orderBy("fecha").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return scenes.withColumn("grid_referencia", first).where(~F.col(grid).eqNullSafe(F.col("grid_referencia")))
