"""Selections and aggregates over scenes of pixels.

Every function takes and returns DataFrames; ``keys`` name a scene. NULL is nodata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.operators import ordering

KEYS = ("lago", "fecha")


class InputDataError(ValueError):
    """The inputs of a step are missing or inconsistent."""


def select_scenes(df: DataFrame, lago: str | None = None, fecha: str | None = None) -> DataFrame:
    """Scenes of a zone and a date; an empty choice is an error."""
    if lago is not None and lago not in S.ZONES:
        raise InputDataError(f"unknown zone: {lago}")
    if lago is not None:
        df = df.where(F.col("lago") == lago)
    if fecha is not None:
        df = df.where(F.col("fecha") == F.lit(fecha).cast("date"))
    if df.isEmpty():
        raise InputDataError("no scene matches")
    return df


def is_ready(flag: str = "quality_flag", path: str = "ruta_raster") -> Column:
    return (F.col(flag) != S.PENDING) & (F.coalesce(F.col(path), F.lit("")) != "")


def split_ready(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ready = F.coalesce(is_ready(), F.lit(False))
    return rows.where(ready), rows.where(~ready)


def of_index(rows: DataFrame, indice: str) -> DataFrame:
    """Rows of one index; a name that isn't one is an error."""
    if indice not in S.INDICES:
        raise InputDataError(f"unknown index: {indice}")
    return rows.where(F.col("indice") == indice)


def ready_of(rows: DataFrame, lago: str, indice: str = "cianobacteria") -> DataFrame:
    """Ready rows of a zone and index by date; none is an error."""
    ready, _ = split_ready(of_index(rows, indice).where(F.col("lago") == lago))
    if ready.isEmpty():
        raise InputDataError(f"no ready dates of {indice} for {lago}")
    return ready.orderBy("fecha")


def lookup(rows: DataFrame, lago: str, fecha: str, indice: str = "cianobacteria") -> DataFrame:
    """The rows of one zone, date and index; none is an error, and so is one without a path."""
    found = of_index(rows, indice).where((F.col("lago") == lago) & (F.col("fecha") == F.lit(fecha).cast("date")))
    if found.isEmpty():
        raise InputDataError(f"no row of {indice} for {lago} {fecha}")
    if not found.where(F.coalesce("ruta_raster", F.lit("")) == "").isEmpty():
        raise InputDataError(f"{lago} {fecha} {indice} has no raster yet")
    return found


def distinct_sets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columna, valores): the sorted distinct values of each column, as text; for columns of few values."""
    sets = rows.agg(*(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns))
    return sets.select(F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), F.col(c).alias("valores")) for c in columns))).alias("e")).select("e.*")


def coerced_summary(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("indice",)) -> DataFrame:
    """(keys, columna, n, media, minimo, maximo) of columns of text: blanks and words that are no numbers don't count."""
    number = lambda c: F.expr(f"try_cast(nullif(trim(cast(`{c}` AS string)), '') AS double)")
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), number(c).alias("v")) for c in columns))).alias("e")).select(*keys, "e.*")
    return long.groupBy(*keys, "columna").agg(F.count("v").alias("n"), F.avg("v").alias("media"), F.min("v").alias("minimo"), F.max("v").alias("maximo"))


def suspicious(rows: DataFrame) -> DataFrame:
    """Rows whose flag is anything but computed, pending ones included."""
    return rows.where(F.col("quality_flag") != S.COMPUTED)


def summary_columns(value: str = "v") -> list[Column]:
    v = F.col(value)
    n = F.count(v)
    return [
        n.alias("pixeles_validos"),
        F.count(F.lit(1)).alias("pixeles_total"),
        F.round(100 * n / F.count(F.lit(1)), 4).alias("cobertura_valida_pct"),
        F.min(v).alias("minimo"),
        F.max(v).alias("maximo"),
        F.avg(v).alias("media"),
        F.percentile(v, F.lit(0.5)).alias("mediana"),
        F.stddev_pop(v).alias("desviacion"),
    ]


def summarize(pixels: DataFrame, value: str = "v", keys: Sequence[str] = KEYS) -> DataFrame:
    """Valid and total pixels, cover, extremes, mean, interpolated median, population deviation."""
    return pixels.groupBy(*keys).agg(*summary_columns(value))


def outlier_fraction(low: float, high: float, value: str = "v") -> Column:
    v = F.col(value)
    return F.avg(F.when(v.isNotNull(), ((v < low) | (v > high)).cast("double")))


def extent(pixels: DataFrame, threshold: float = S.HIGH_UGL, value: str = "v", keys: Sequence[str] = KEYS, resolution: float = S.TARGET_M) -> DataFrame:
    """Pixels and areas at or above the threshold; 0 percent where nothing is valid."""
    v, area = F.col(value), float(resolution) ** 2
    n, high = F.count(v), F.count_if(v >= threshold)
    return pixels.groupBy(*keys).agg(
        F.lit(float(threshold)).alias("umbral_alto_ugl"),
        F.lit(area).alias("area_pixel_m2"),
        n.alias("pixeles_validos_lago"),
        high.alias("pixeles_altos"),
        (n * area).alias("area_valida_m2"),
        (high * area).alias("area_alta_m2"),
        F.coalesce(F.round(F.try_divide(100.0 * high, n), 4), F.lit(0.0)).alias("porcentaje_alto"),
    )


def persistence(pixels: DataFrame, threshold: float = S.HIGH_UGL, least_dates: int = 3, value: str = "v", keys: Sequence[str] = ("lago", "row", "col")) -> DataFrame:
    """Valid and high dates of every pixel and their ratio, NULL below ``least_dates`` valid ones."""
    v = F.col(value)
    n, high = F.count(v), F.count_if(v >= threshold)
    out = pixels.groupBy(*keys).agg(n.alias("n_valido"), high.alias("n_alto"))
    return out.withColumn("proporcion", F.when(F.col("n_valido") >= least_dates, F.try_divide(F.col("n_alto"), F.col("n_valido"))))


def persistence_summary(pixels: DataFrame, keys: Sequence[str] = ("lago",)) -> DataFrame:
    """Percent of pixels ever high and persistently (half of the dates) high."""
    p = F.col("proporcion")
    share = lambda c: F.round(F.try_divide(100.0 * F.count_if(c), F.count(p)), 3)
    return pixels.groupBy(*keys).agg(share(p > 0).alias("pct_alguna_vez"), share(p >= 0.5).alias("pct_persistente"))


QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
QUANTILE_NAMES = ("p01", "p05", "q25", "mediana", "q75", "p95", "p99")


def distribution(pixels: DataFrame, value: str = "v", keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, extremes, exact interpolated percentiles, mean and population deviation.

    One aggregation: the percentiles' buffers hold counts of equal values and merge
    before the shuffle, the deviation merges means and centred squares.
    """
    v = F.col(value)
    agg = pixels.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n_pixeles"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("media"), F.percentile(v, F.array(*map(F.lit, QUANTILES))).alias("_q"), F.stddev_pop(v).alias("desviacion_std")
    )
    return agg.select(*keys, "n_pixeles", "min", *(F.get("_q", F.lit(k)).alias(c) for k, c in enumerate(QUANTILE_NAMES)), "media", "max", "desviacion_std")


BINS = ordering.BINS


def quantiles(df: DataFrame, value: str | Column, shares: Sequence[float]) -> list[float] | None:
    """Exact interpolated percentiles of a whole column, in a fixed number of passes; None without values."""
    from rasterloom.session import ship

    ship(df.sparkSession)
    return ordering.quantiles(df, value, shares, BINS)


def halves(pixels: DataFrame, height: int, value: str = "v", keys: Sequence[str] = ("lago",)) -> DataFrame:
    """Means of the upper and the lower half of the rows."""
    half = F.when(F.col("row") < height // 2, "norte").otherwise("sur").alias("mitad")
    return pixels.groupBy(*keys, half).agg(F.count(value).alias("n"), F.avg(value).alias("media"))


def comparison_scale(pixels: DataFrame, floor: float = S.HIGH_UGL, value: str = "v") -> DataFrame:
    """Common ends of a colour scale: 0 and the 98th percentile, at least the threshold. One row."""
    top = quantiles(pixels, value, [0.98]) or [floor]
    return pixels.sparkSession.createDataFrame([(0.0, max(float(floor), top[0]))], "vmin double, vmax double")


def difference_scale(differences: DataFrame, value: str = "diferencia") -> DataFrame:
    """Half-width of a change map's scale: the 98th percentile of absolute change, at least 1; and the number of changes."""
    top = quantiles(differences, F.abs(F.col(value)), [0.98]) or [1.0]
    return differences.agg(F.count(value).alias("n_pares")).withColumn("vmax", F.lit(max(1.0, top[0])))


def pending_report(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals of ready and pending rows of every scene, and the sorted indices of the pending ones."""
    ready = F.coalesce(is_ready(), F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(ready).alias("n_listas"), F.count_if(~ready).alias("n_pendientes"),
        F.array_join(F.array_sort(F.collect_set(F.when(~ready, F.col("indice")))), ";").alias("pendientes"),
    )


def file_coverage(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cover of several files together: valid over all pixels."""
    return files.groupBy(*keys).agg(F.round(F.try_divide(100.0 * F.sum("validos"), F.sum("total")), 4).alias("cobertura_valida_pct"))
