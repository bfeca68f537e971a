"""Guarded correlations, by scene and pooled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions.indices import correlation_direction, correlation_magnitude
from rasterloom.functions.pvalues import p_value_text
from rasterloom.operators.ordering import average_ranks


def pearson(x: str, y: str) -> Column:
    """Coefficient; NULL below three pairs or where a side is constant."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when((F.count(F.lit(1)) >= 3) & varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def complete_pairs(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def by_group(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Both coefficients and the pairs of every group; ranks are averaged over ties.

    Ranks come from counts of equal values in ranges, so no task sees a whole group.
    """
    pairs = complete_pairs(pairs, x, y)
    pairs = pairs.select(*dict.fromkeys([*keys, x, y]))
    ranked = average_ranks(average_ranks(pairs, keys, x, "_rx"), keys, y, "_ry", pairs)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pares"), pearson(x, y).alias("pearson"), pearson("_rx", "_ry").alias("spearman"))


def by_date(pairs: DataFrame, keys: Sequence[str] = ("lago", "fecha", "indice")) -> DataFrame:
    """A row for each group and method, with labels and the probability as text."""
    wide = by_group(pairs, keys)
    long = wide.unpivot([*keys, "n_pares"], ["pearson", "spearman"], "metodo", "_r")
    r = F.col("_r")
    return long.select(
        *keys, "metodo", F.round(r, 8).alias("coeficiente"), p_value_text(r, F.col("n_pares")).alias("p_value"), "n_pares",
        correlation_direction(r).alias("direccion"), correlation_magnitude(r).alias("magnitud"),
    )


def by_zone(rows: DataFrame, keys: Sequence[str] = ("lago", "indice", "metodo")) -> DataFrame:
    """Spread of the dates' coefficients of a zone; dates without one don't count."""
    c = F.col("coeficiente")
    return rows.where(c.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_fechas"), F.sum("n_pares").alias("n_pares_total"), F.avg(c).alias("coef_media"), F.percentile(c, F.lit(0.5)).alias("coef_mediana"),
        F.min(c).alias("coef_min"), F.max(c).alias("coef_max"), F.round(F.avg((c > 0).cast("double")), 4).alias("fraccion_fechas_positivas"),
    )


def dated_table(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """The table of coefficients by date: with the flags of both rasters, from manifest rows (lago, fecha, indice, quality_flag), and the note on inference."""
    own = flags.select("lago", "fecha", "indice", F.col("quality_flag").alias("quality_flag_indice"))
    cyano = flags.where("indice = 'cianobacteria'").select("lago", "fecha", F.col("quality_flag").alias("quality_flag_cianobacteria"))
    out = rows.join(own, ["lago", "fecha", "indice"], "left").join(cyano, ["lago", "fecha"], "left").withColumn("nota_inferencia", F.lit(S.DATE_NOTE))
    return out.select(*(F.col(c).cast(S.CORRELATION_BY_DATE[c].dataType).alias(c) for c in S.CORRELATION_BY_DATE.names))


def zoned_table(rows: DataFrame) -> DataFrame:
    """The table of coefficients by zone from ``by_zone`` beside the pooled ones (``..._agrupado``)."""
    named = {
        "coeficiente_medio_fechas": F.round("coef_media", 8), "coeficiente_mediano_fechas": F.round("coef_mediana", 8), "coeficiente_minimo_fecha": F.round("coef_min", 8), "coeficiente_maximo_fecha": F.round("coef_max", 8),
        "coeficiente_agrupado_estratificado": F.col("coeficiente_agrupado"), "magnitud_agrupada": F.col("magnitud_agrupado"), "nota_inferencia": F.lit(S.ZONE_NOTE),
    }
    return rows.withColumns(named).select(*(F.col(c).cast(S.CORRELATION_BY_ZONE[c].dataType).alias(c) for c in S.CORRELATION_BY_ZONE.names))


def strongest(rows: DataFrame, most: int = 12) -> DataFrame:
    """The largest absolute coefficients: a top-k report."""
    keys = [c for c in rows.columns if c != "coeficiente"]
    return rows.orderBy(F.abs("coeficiente").desc_nulls_last(), *keys).limit(most)
