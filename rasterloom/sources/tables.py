"""Typed CSV tables and GeoJSON outlines through Spark's readers and writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.operators.scenes import InputDataError


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table with a header; blank fields are NULL; the header must hold exactly the schema's columns."""
    head = spark.read.option("header", True).csv(path)
    if set(head.columns) != set(schema.names):
        raise InputDataError(f"columns differ: {sorted(set(head.columns) ^ set(schema.names))}")
    typed = StructType([schema[c] for c in head.columns])
    return spark.read.schema(typed).option("header", True).option("nullValue", "").csv(path).select(*schema.names)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """CSV by Spark's commit protocol: readers see all of it or nothing."""
    out = df if files is None else df.coalesce(files)
    out.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_outlines(spark: SparkSession, path: str, flag: str = "is_lake_boundary") -> DataFrame:
    """(lago, ring, k, x, y) of the polygons marked as outlines; none is an error."""
    text = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", text).alias("j"))
    f = raw.select(F.explode("j.features").alias("f")).where(F.col("f.properties").getItem(flag) == "true")
    if f.isEmpty():
        raise InputDataError(f"no outline in {path}")
    shape = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(shape, "array<array<array<double>>>"))).otherwise(F.from_json(shape, "array<array<array<array<double>>>>"))
    parts = f.select(F.col("f.properties").getItem("lago").alias("lago"), F.posexplode(F.flatten(polygons)).alias("ring", "points"))
    return parts.select("lago", "ring", F.posexplode("points").alias("k", "p")).select("lago", "ring", "k", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def outline_geojson(lago: str, rings: Sequence[Sequence[tuple[float, float]]]) -> str:
    """A FeatureCollection with one outline."""
    shape = {"type": "Polygon", "coordinates": [[list(p) for p in r] for r in rings]}
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"lago": lago, "is_lake_boundary": True}, "geometry": shape}]})


def geojson(points: DataFrame) -> DataFrame:
    """(lago, geojson): a FeatureCollection of each zone's outline (lago, ring, k, x, y); of several parts where points tell theirs."""
    parts = [c for c in ("part",) if c in points.columns]
    ring = points.groupBy("lago", *parts, "ring").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    ring = ring.select("lago", *parts, "ring", F.transform("p", lambda p: F.array(p["x"], p["y"])).alias("p"))
    zone = ring.groupBy("lago", *parts).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "p"))), lambda r: r["p"]).alias("coordinates"))
    if parts:
        zone = zone.groupBy("lago").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "coordinates"))), lambda r: r["coordinates"]).alias("coordinates"))
    shape = F.struct(F.lit("MultiPolygon" if parts else "Polygon").alias("type"), "coordinates")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("lago", F.lit(True).alias("is_lake_boundary")).alias("properties"), shape.alias("geometry"))
    return zone.select("lago", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("geojson"))


#: An answer of the outline service: ways with their points, relations with their members'.
_POINT = "array<struct<lon:double,lat:double>>"
ELEMENTS = f"struct<elements:array<struct<type:string,id:long,geometry:{_POINT},members:array<struct<role:string,geometry:{_POINT}>>>>>"


def water_rings(answers: DataFrame, keys: Sequence[str] = ("lago",), text: str = "answer") -> DataFrame:
    """(keys, contorno, ring, role, k, x, y): closed rings of the ways and relations in answers of the outline service (keys, answer).

    The lines of a relation meet at their ends, each role by itself; open ones are left out, and so are ways of fewer than four points.
    """
    from rasterloom.sources.remote import chain

    keys = list(keys)
    e = answers.select(*keys, F.posexplode(F.from_json(text, ELEMENTS)["elements"]).alias("at", "e"))
    way = F.array(F.struct(F.lit("outer").alias("role"), F.col("e.geometry").alias("geometry")))
    lines = F.when(F.col("e.type") == "way", way).otherwise(F.filter("e.members", lambda m: m["role"].isin("outer", "inner")))
    e = e.select(*keys, F.concat_ws("/", "e.type", F.coalesce("e.id", "at").cast("string")).alias("contorno"), (F.col("e.type") == "way").alias("way"), F.posexplode(lines).alias("n", "l"))
    e = e.where("l.geometry IS NOT NULL").select(*keys, "contorno", "way", "n", "l.role", F.transform("l.geometry", lambda p: F.array(p["lon"], p["lat"])).alias("line"))

    def one(t: pa.Table) -> pa.Table:
        rows, ring = [], 0
        t = t.sort_by("n")
        for role in ("outer", "inner"):
            own = [[tuple(p) for p in line] for r, line in zip(t.column("role").to_pylist(), t.column("line").to_pylist(), strict=True) if r == role]
            if t.column("way")[0].as_py():
                found = [r for r in own if len(r) >= 4 and r[0] == r[-1]]
            else:
                found = chain(own)
            for points in found:
                rows += [(ring, role, k, *p) for k, p in enumerate(points)]
                ring += 1
        kinds = (("ring", pa.int32()), ("role", pa.string()), ("k", pa.int32()), ("x", pa.float64()), ("y", pa.float64()))
        head = {c: pa.array([t.column(c)[0].as_py()] * len(rows), t.schema.field(c).type) for c in [*keys, "contorno"]}
        return pa.table(head | {n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(kinds)})

    types = ", ".join(f"{k} {answers.schema[k].dataType.simpleString()}" for k in keys)
    return e.groupBy(*keys, "contorno").applyInArrow(one, f"{types}, contorno string, ring int, role string, k int, x double, y double")


def largest_water(answers: DataFrame, keys: Sequence[str] = ("lago",), text: str = "answer") -> DataFrame:
    """(keys, part, ring, k, x, y): the largest way or relation of each answer as clean polygons; the smallest name on ties."""
    from rasterloom.operators import polygons
    from rasterloom.operators.series import first_of

    keys = list(keys)
    rings = water_rings(answers, keys, text)
    sized = polygons.areas(rings, [*keys, "contorno"]).where("area > 0")
    best = first_of(sized, keys, F.col("area").desc(), F.col("contorno")).select(*keys, "contorno")
    return polygons.polygons(rings.join(best, [*keys, "contorno"], "left_semi"), keys)


def write_geojson(points: DataFrame, path: str) -> None:
    """One text file of GeoJSON for each zone below ``path``, never over another."""
    geojson(points).repartition("lago").write.mode("errorifexists").partitionBy("lago").text(path)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that is never overwritten."""
    df.write.mode("errorifexists").parquet(path)
