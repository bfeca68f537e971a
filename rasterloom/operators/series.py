"""Operators that depend on an order: peaks, ranks, samples, chosen dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions.indices import joined, trend_label
from rasterloom.operators import ordering


def flag_peaks(series: DataFrame, value: str = "cyano_promedio", sigmas: float = S.PEAK_SIGMAS, key: str = "lago") -> DataFrame:
    """Dates above mean + k deviations of the zone's complete dates; at least two of these are needed."""
    of = Window.partitionBy(key)
    v = F.when(F.col("quality_flag") == S.COMPUTED, F.col(value))
    limit = F.when(F.count(v).over(of) >= 2, F.round(F.avg(v).over(of) + sigmas * F.stddev_pop(v).over(of), 4))
    exact = F.avg(v).over(of) + sigmas * F.stddev_pop(v).over(of)
    return series.withColumns({"umbral_pico": limit, "es_pico": F.coalesce((F.count(v).over(of) >= 2) & (F.col(value) > exact), F.lit(False))})


def first_of(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in a given order, ties included in the order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def select_dates(series: DataFrame, extents: DataFrame, common: str = S.COMMON_DATE) -> DataFrame:
    """First complete date, highest mean, largest extent and the common date, reasons merged by date."""
    complete = (F.col("quality_flag") == S.COMPUTED).cast("int").desc()
    pick = lambda df, why, *order: first_of(df, ["lago"], *order).select("lago", "fecha", F.lit(why).alias("motivo"))
    parts = [
        pick(series, "referencia_primera_fecha_completa", complete, F.col("fecha")),
        pick(series, "pico_promedio_temporal", F.col("cyano_promedio").desc(), F.col("fecha")),
        pick(extents, "mayor_extension", F.col("porcentaje_alto").desc(), F.col("fecha")),
        series.select("lago").distinct().select("lago", F.lit(common).cast("date").alias("fecha"), F.lit("fecha_comun_entre_lagos").alias("motivo")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("lago", "fecha").agg(joined(F.collect_list("motivo")).alias("criterio_seleccion"))


def half_split_trend(series: DataFrame, value: str = "cyano_promedio", key: str = "lago", flat: float = 0.5) -> DataFrame:
    """Means of the first and the second half of the dates, and the label of their difference."""
    w = Window.partitionBy(key)
    numbered = series.withColumns({"_k": F.row_number().over(w.orderBy("fecha")), "_n": F.count(F.lit(1)).over(w)})
    cut = F.expr("_n div 2")
    first = F.avg(F.when((F.col("_k") <= cut) | (F.col("_n") == 1), F.col(value)))
    second = F.avg(F.when(F.col("_k") > cut, F.col(value)))
    out = numbered.groupBy(key).agg(first.alias("primera_mitad"), second.alias("segunda_mitad"))
    return out.withColumn("tendencia_temporal", trend_label(F.col("primera_mitad"), F.col("segunda_mitad"), flat))


def systematic_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Evenly spaced rows of each group, both ends included; whole groups up to ``most`` rows.

    Row k of n stays if it is floor(i (n - 1) / (most - 1)) for some i.
    """
    numbered = ordering.numbered(df, keys, order)
    if most == 1:
        return numbered.where("_k = 0").drop("_k", "_n")
    # the smallest i whose place is k or more, in whole numbers; k is taken if that place is k
    i = f"((_k * {most - 1} + _n - 2) div greatest(_n - 1, 1))"
    exact = F.expr(f"({i} * (_n - 1)) div {most - 1} = _k")
    return numbered.where((F.col("_n") <= most) | exact).drop("_k", "_n")


def balanced_pool(pairs: DataFrame, order: Sequence[str] = ("row", "col"), most: int = S.POOL_CAP, keys: Sequence[str] = ("lago", "fecha", "indice")) -> DataFrame:
    """At most ``most`` pairs of every date, in row-major order."""
    return systematic_sample(pairs, keys, order, most)


def panel_dates(series: DataFrame, common: str = S.COMMON_DATE) -> DataFrame:
    """Lowest complete date, highest peak and the common date of each zone, in this order, without repeats."""
    complete = (F.col("quality_flag") == S.COMPUTED).cast("int").desc()
    low = first_of(series, ["lago"], complete, F.col("cyano_promedio"), F.col("fecha")).select("lago", F.col("fecha").alias("baja"))
    high = first_of(series, ["lago"], F.col("cyano_promedio").desc(), F.col("fecha")).select("lago", F.col("fecha").alias("alta"))
    return low.join(high, "lago").select("lago", F.array_distinct(F.array("baja", "alta", F.lit(common).cast("date"))).alias("fechas"))
