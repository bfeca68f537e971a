"""Checks as DataFrames of violations; an empty one passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.operators.scenes import InputDataError, is_ready


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_differences(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, and which side."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    missing = a.exceptAll(b).withColumn("lado", F.lit("falta"))
    return missing.unionByName(b.exceptAll(a).withColumn("lado", F.lit("sobra")))


def missing_rows(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present, list(keys), "left_anti")


def column_differences(df: DataFrame, wanted: Sequence[str]) -> dict[str, list[str]]:
    return {"faltan": sorted(set(wanted) - set(df.columns)), "sobran": sorted(set(df.columns) - set(wanted))}


def undeclared(rows: DataFrame, fields: Sequence[str] = ("unidad", "dtype", "cobertura_valida_pct", "pixeles_validos")) -> DataFrame:
    """Ready rows that leave one of the fields blank."""
    blank = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in fields]
    out = rows.where(is_ready()).withColumn("campos", F.array_compact(F.array(*blank)))
    return out.where(F.size("campos") > 0)


def incomplete_scenes(rows: DataFrame, indices: Sequence[str] = S.INDICES) -> DataFrame:
    """Scenes that lack a ready raster of some index."""
    have = rows.groupBy("lago", "fecha").agg(F.collect_set(F.when(is_ready(), F.col("indice"))).alias("_h"))
    return have.select("lago", "fecha", F.array_sort(F.array_except(F.array(*map(F.lit, indices)), "_h")).alias("faltan")).where(F.size("faltan") > 0)


def configuration() -> list[str]:
    """Violations of the static configuration."""
    out = []
    if len(S.SCENES) != 22 or len({(z, d) for z, d, *_ in S.SCENES}) != 22:
        out.append("scenes")
    for zone, (west, east, south, north) in S.ZONES.items():
        if not (west < east and south < north):
            out.append(f"box {zone}")
        if sum(z == zone for z, *_ in S.SCENES) != 11:
            out.append(f"dates {zone}")
    out += [f"cloud {z} {d}" for z, d, cloud, *_ in S.SCENES if not 0 <= cloud <= 100]
    if [x[4] for x in S.SCENES if x[4] is not None] != [57.1]:
        out.append("partial cover")
    if S.HIGH_UGL <= 0:
        out.append("threshold")
    return out


def guard_batch(n_scenes: int, confirmed: bool) -> None:
    if n_scenes > 1 and not confirmed:
        raise InputDataError("more than one scene needs a confirmation")


def manifest_violations(have: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(problema, clave): columns and keys that are missing or too many, repeated keys; an empty table passes."""
    spark = have.sparkSession
    wrong = column_differences(have, columns) if columns else {}
    rows = [(f"columna {side}", c) for side, names in wrong.items() for c in names]
    out = spark.createDataFrame(rows, "problema string, clave string")
    if set(keys) - set(have.columns):
        return out
    name = F.concat_ws(" ", *(F.col(k).cast("string") for k in keys)).alias("clave")
    twice = duplicate_keys(have, keys).select(F.lit("clave repetida").alias("problema"), name)
    differs = key_differences(expected, have, keys).select(F.concat(F.lit("clave "), "lado").alias("problema"), name)
    return out.unionByName(twice).unionByName(differs)


def flag_violations(rows: DataFrame, flags: Sequence[str] = (S.PENDING, S.COMPUTED, S.PARTIAL, S.OUTLIERS)) -> DataFrame:
    """Rows whose flag is none of the domain."""
    return rows.where(~F.coalesce(F.col("quality_flag").isin(*flags), F.lit(False)))


def require_none(violations: DataFrame, what: str) -> None:
    """An error that names up to five of the violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise InputDataError(f"{what}: " + "; ".join(" ".join(map(str, r)) for r in found))


def scene_rows(scenes: DataFrame) -> DataFrame:
    """Manifest rows of scenes (lago, fecha, cobertura_valida_oficial_pct, ...) as far as they are known before they are fetched."""
    note = F.lit(None).cast("string")
    for (zone, day), said in S.NOTES.items():
        note = F.when((F.col("lago") == zone) & (F.col("fecha") == F.lit(day).cast("date")), said).otherwise(note)
    flag = F.when(F.col("cobertura_valida_oficial_pct").isNull(), S.NOT_FETCHED).otherwise(S.PARTIAL)
    fixed = {"producto": F.lit(S.PRODUCT), "bandas": F.lit(";".join(S.LEAST_BANDS)), "metodo_descarga": F.lit(S.FETCHED_BY), "estado": F.lit("pendiente"), "quality_flag": flag, "observaciones": note}
    return scenes.withColumns(fixed)


def index_rows(scenes: DataFrame, indices: Sequence[str] = S.INDICES) -> DataFrame:
    """Pending manifest rows: scenes (lago, fecha) times indices."""
    return scenes.select("lago", "fecha", F.explode(F.array(*map(F.lit, indices))).alias("indice")).withColumn("quality_flag", F.lit(S.PENDING))


def expected_scenes(spark: SparkSession) -> DataFrame:
    """The manifest rows that the configuration expects."""
    rows = [(z, d, sat, cloud, cover, *S.ZONES[z]) for z, d, cloud, sat, cover in S.SCENES]
    names = "lago string, fecha string, satelite_oficial string, nubosidad_oficial_pct double, cobertura_valida_oficial_pct double, west double, east double, south double, north double"
    return scene_rows(spark.createDataFrame(rows, names).withColumn("fecha", F.to_date("fecha")))


def expected_indices(spark: SparkSession) -> DataFrame:
    return index_rows(expected_scenes(spark))


def configuration_problems(scenes: DataFrame, zones: DataFrame, dates: int) -> DataFrame:
    """(problema, clave): boxes (lago, west, east, south, north) that are no boxes, zones without one or with another number of dates, repeated scenes, clouds that are no percentage."""
    key = F.concat_ws(" ", "lago", F.col("fecha").cast("string"))
    row = lambda df, what, name: df.select(F.lit(what).alias("problema"), name.alias("clave"))
    per = scenes.groupBy("lago", "fecha").agg(F.count(F.lit(1)).alias("n"))
    found = [
        row(zones.where("NOT (west < east AND south < north)"), "caja", F.col("lago")),
        row(scenes.select("lago").distinct().join(zones, "lago", "left_anti"), "sin caja", F.col("lago")),
        row(per.groupBy("lago").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != dates), "fechas", F.col("lago")),
        row(per.where("n > 1"), "escena repetida", key),
        row(scenes.where("NOT coalesce(nubosidad_oficial_pct BETWEEN 0 AND 100, false)"), "nubosidad", key),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def uneven_grids(rasters: DataFrame, grid: str = "grid") -> DataFrame:
    """Scenes whose rasters do not share one grid, or lack an index."""
    found = rasters.groupBy("lago", "fecha").agg(F.collect_set(grid).alias("_g"), F.collect_set("indice").alias("_i"))
    return found.where((F.size("_g") != 1) | (F.size("_i") != len(S.INDICES))).select("lago", "fecha", F.size("_g").alias("n_mallas"), F.size("_i").alias("n_indices"))
