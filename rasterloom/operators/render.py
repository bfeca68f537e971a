"""Data of the figures: what would be drawn, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions.indices import scale_channel
from rasterloom.operators import scenes


def rgba(pixels: DataFrame, vmin: float, vmax: float, value: str = "v") -> DataFrame:
    """Grey channel of 255 and opacity: 0 where the pixel is invalid."""
    t = scale_channel(F.col(value), F.lit(float(vmin)), F.lit(float(vmax)))
    return pixels.withColumns({"nivel": F.coalesce(F.floor(t * 255), F.lit(0)).cast("int"), "alfa": F.when(F.col(value).isNotNull(), 255).otherwise(0)})


def map_rows(scales: DataFrame, indice: str, kind: str, fmt: str = "png") -> DataFrame:
    """A metadata row for each map of ``scales(lago, fecha, vmin, vmax)``."""
    name = F.concat_ws("_", "lago", F.col("fecha").cast("string"), F.lit(indice), F.lit(kind))
    return scales.select(
        "lago", "fecha", F.lit(indice).alias("indice"), F.lit(kind).alias("tipo_mapa"), F.concat(name, F.lit(f".{fmt}")).alias("archivo"), F.lit(fmt).alias("formato"),
        F.col("vmin").cast("double").alias("vmin"), F.col("vmax").cast("double").alias("vmax"), F.lit(S.HIGH_UGL).alias("umbral_alto_ugl"), F.current_timestamp().alias("generado_en"),
    )


def visible(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs between the 1st and the 99th percentile of both sides."""
    for c in (x, y):
        ends = scenes.quantiles(pairs, c, (0.01, 0.99))
        if ends is None:
            return pairs.limit(0)
        pairs = pairs.withColumn(f"_in_{c}", F.col(c).between(*ends))
    return pairs.where(F.col(f"_in_{x}") & F.col(f"_in_{y}")).drop(f"_in_{x}", f"_in_{y}")


def extent_series(extents: DataFrame) -> DataFrame:
    """Extent by date; dates of partial cover are marked."""
    partial = (F.col("quality_flag") == S.PARTIAL).alias("parcial")
    return extents.select("lago", "fecha", "porcentaje_alto", partial).orderBy("lago", "fecha")


def flagged_dates(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of dates with the flag of their scene, and a note where it isn't plainly computed."""
    out = rows.join(flags.select("lago", "fecha", F.col("quality_flag").alias("marca")), ["lago", "fecha"], "left")
    warn = F.concat(F.lit("advertencia: "), F.replace("marca", F.lit("_"), F.lit(" ")))
    return out.withColumn("nota", F.when(F.col("marca") != S.COMPUTED, warn).otherwise(F.lit("")))


def box_plot(values: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 quartile distances; nothing beyond is drawn."""
    v = F.col(value)
    q = values.where(v.isNotNull()).groupBy(*keys).agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*keys, *(F.get("_q", F.lit(k)).alias(c) for k, c in enumerate(("q25", "mediana", "q75"))))
    reach = (F.col("q75") - F.col("q25")) * 1.5
    met = values.where(v.isNotNull()).join(F.broadcast(q), list(keys))  # a row a group
    low = F.min(F.when(v >= F.col("q25") - reach, v))
    high = F.max(F.when(v <= F.col("q75") + reach, v))
    return met.groupBy(*keys, "q25", "mediana", "q75").agg(F.least(low, "q25").alias("bigote_bajo"), F.greatest(high, "q75").alias("bigote_alto"))


#: Stops of the default colour table: place on [0, 1], red, green, blue.
STOPS = ((0.0, 0, 32, 128), (0.5, 32, 160, 96), (1.0, 240, 224, 32))


def coloured(pixels: DataFrame, vmin: float, vmax: float, stops: Sequence[tuple[float, int, int, int]] = STOPS, value: str = "v") -> DataFrame:
    """Red, green, blue of each pixel by straight lines between the stops, and opacity: 0 where it is invalid."""
    t = scale_channel(F.col(value), F.lit(float(vmin)), F.lit(float(vmax)))

    def channel(k: int):
        out = F.lit(float(stops[-1][k]))
        for a, b in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(t <= b[0], a[k] + (t - a[0]) * ((b[k] - a[k]) / (b[0] - a[0]))).otherwise(out)
        return F.coalesce(F.floor(out + 0.5), F.lit(0)).cast("int")

    return pixels.withColumns({"rojo": channel(1), "verde": channel(2), "azul": channel(3), "alfa": F.when(F.col(value).isNotNull(), 255).otherwise(0)})


def panel(pixels: DataFrame, dates: DataFrame, floor: float = S.HIGH_UGL, value: str = "v") -> tuple[DataFrame, DataFrame]:
    """Pixels of the chosen dates (lago, fechas) with their place in the panel, and the common scale of them all."""
    chosen = dates.select("lago", F.posexplode("fechas").alias("lugar", "fecha"))
    out = pixels.join(F.broadcast(chosen), ["lago", "fecha"])
    return out, scenes.comparison_scale(out, floor, value)


def layers(pixels: DataFrame, keys: Sequence[str], grid: dict, bounds: tuple[float, float, float, float], vmin: float, vmax: float, most: int = 1000) -> DataFrame:
    """Scenes of a UTM grid as coloured cells of a longitude-latitude grid, for maps of layers."""
    from rasterloom.operators.spatial import warp_wgs84

    x, y, px, _ = grid["transform"]
    return coloured(warp_wgs84(pixels, keys, (x, y), px, bounds, grid["width"], grid["height"], most), vmin, vmax)


def change_map(pixels: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    from rasterloom.operators.compare import difference_map

    d = difference_map(pixels, first, second)
    return d, scenes.difference_scale(d)



