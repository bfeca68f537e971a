"""The engine's workflows over a work folder: each step reads tables and writes tables.

    <work>/scenes       manifest of scenes (CSV)          prepare
    <work>/boxes        query boxes of the zones (GeoJSON) prepare
    <work>/rasters      files that the manifest declares  input
    <work>/tiles        bands and layers as tiles (Parquet) compute
    <work>/bands        b02..b12, scl by pixel (Parquet)  input instead of rasters
    <work>/grids        grid of each zone (CSV)           input, for outlines
    <work>/outlines     outlines in degrees (GeoJSON)     input, where there are any
    <work>/pixels       indices by pixel (Parquet)        compute
    <work>/indices      manifest of indices (CSV)         compute
    <work>/<table>      temporal, extent, ... (CSV)       build steps

All steps work on every scene at once; the pixel table is partitioned by zone and date,
so a choice of scenes prunes files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions import indices as M
from rasterloom.operators import checks, compare, correlate, ordering, render, scenes, series, spatial
from rasterloom.operators import tiles as T
from rasterloom.operators.scenes import InputDataError
from rasterloom.sources import manifests, tables

KEYS = ["lago", "fecha"]
UNITS = {"ndvi": "adimensional", "ndwi": "adimensional", "cianobacteria": "ug/L"}
RANGES = {"ndvi": (-1.0, 1.0), "ndwi": (-1.0, 1.0), "cianobacteria": S.CYANO_RANGE}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)  # noqa: SLF001


def prepare(spark: SparkSession, work: str) -> DataFrame:
    """The manifest of scenes, written once; a manifest with other keys is an error."""
    wanted = checks.expected_scenes(spark)
    path = f"{work}/scenes"
    if not _exists(spark, path):
        full = wanted.select(*((F.col(c) if c in wanted.columns else F.lit(None)).cast(S.SCENE_MANIFEST[c].dataType).alias(c) for c in S.SCENE_MANIFEST.names))
        tables.write_csv(full, path, "errorifexists", 1)
    rings = spatial.boxes(wanted.select("lago", "west", "east", "south", "north").distinct()).withColumn("ring", F.lit(0))
    if not _exists(spark, f"{work}/boxes"):
        tables.write_geojson(rings, f"{work}/boxes")
    kept = spark.read.text(f"{work}/boxes")
    if not kept.select("lago", F.col("value").alias("geojson")).exceptAll(tables.geojson(rings)).isEmpty():
        raise InputDataError(f"other boxes are kept in {work}/boxes; they are not overwritten")
    have = manifests.read(spark, path, S.SCENE_MANIFEST)
    if not checks.key_differences(wanted, have, KEYS).isEmpty() or not checks.duplicate_keys(have, KEYS).isEmpty():
        raise InputDataError("the manifest of scenes does not hold the configured ones")
    return have


def plan(spark: SparkSession, work: str) -> DataFrame:
    """What is to be fetched: interval, box and size of each pending scene."""
    rows = prepare(spark, work).where("estado = 'pendiente'")
    begin, end = M.day_interval(F.col("fecha"))
    return rows.select(*KEYS, begin.alias("desde"), end.alias("hasta"), M.request_size(*map(F.col, ("west", "east", "south", "north"))).alias("tamano"))


BANDS = ("B02", "B03", "B04", "B05", "B08", "B11", "B12", "SCL")
#: Bands that the cyano index is derived from where no layer of it was fetched.
DERIVE = ("b02", "b03", "b04", "b05", "b08", "b11", "b12")
#: Fetched layers of the cyano index: <zone>/<date>/cyano....tif or <zone>_<date>_...cyano....tif
LAYER = r"([a-z]+)[/_](\d{4}-\d{2}-\d{2})[/_][^/]*cyano[^/]*[.]tiff?$"


def layers(spark: SparkSession, work: str) -> DataFrame:
    """(lago, fecha, path) of the fetched cyano layer of each scene that has one; the first by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*cyano*.tif*").load(f"{work}/rasters").select("path")
    found = files.select(F.regexp_extract("path", LAYER, 1).alias("lago"), F.to_date(F.nullif(F.regexp_extract("path", LAYER, 2), F.lit(""))).alias("fecha"), "path")
    return found.where("lago <> ''").groupBy(*KEYS).agg(F.min("path").alias("path"))


def scan(spark: SparkSession, work: str, rows: DataFrame) -> None:
    """Append the tiles of the scenes' rasters, and of their cyano layers, to ``tiles``: partitioned by scene, so that a scene scanned again replaces its own."""
    from rasterloom.sources import geotiff

    root = f"{work}/rasters"
    bands = geotiff.read_tiles(spark, geotiff.declared_files(rows, root), BANDS, root)
    layer = geotiff.read_tiles(spark, layers(spark, work).join(rows.select(*KEYS), KEYS, "left_semi"), ["cyano"], root)
    bands.unionByName(layer).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{work}/tiles")


def read_tiles(spark: SparkSession, work: str) -> DataFrame:
    return spark.read.parquet(f"{work}/tiles").withColumn("fecha", F.to_date("fecha"))


def scene_grids(tiles_: DataFrame) -> DataFrame:
    """(lago, fecha, grid) of the scenes' bands; only keys and grids are read."""
    return tiles_.where("band <> 'cyano'").groupBy(*KEYS).agg(F.min("grid").alias("grid"))


def aligned(tiles_: DataFrame) -> DataFrame:
    """Pixels of all bands on their scene's grid, with ``cyano`` from its own grid.

    B03, B04, B08 and the classes are needed; ``bandas`` tells which of the others the pixel's tile has.
    """
    bands, layer = tiles_.where("band <> 'cyano'"), tiles_.where("band = 'cyano'")
    plan_ = layer.groupBy(*KEYS).agg(F.min("grid").alias("of")).join(scene_grids(bands).withColumnRenamed("grid", "to"), KEYS)
    moved = T.resample(layer, plan_, KEYS).select(*KEYS, "tr", "tc", F.col("w").alias("lw"), "v")
    # every tile of a scene with a layer has the layer, if only without values
    each = bands.where("band = 'b03'").select(*KEYS, "tr", "tc", "h", "w", "grid").join(plan_.select(*KEYS), KEYS).join(moved, [*KEYS, "tr", "tc"], "left")
    each = each.select(*KEYS, F.lit("cyano").alias("band"), "grid", "tr", "tc", "h", F.coalesce("lw", "w").alias("w"), "v")
    every = bands.select(*KEYS, "band", "grid", "tr", "tc", "h", "w", "v").unionByName(each)
    names = [b.lower() for b in BANDS]
    return T.wide(every, KEYS, [*names, "cyano"], needed=[b.lower() for b in S.LEAST_BANDS], present="bandas")


def ingest(spark: SparkSession, work: str) -> DataFrame:
    """Bands by pixel from the rasters that the manifest of scenes declares (those without a file are left for later)."""
    rows = prepare(spark, work).where("coalesce(ruta_local, '') <> ''")
    if rows.isEmpty():
        raise InputDataError("no scene of the manifest declares a raster")
    if not _exists(spark, f"{work}/tiles"):
        scan(spark, work, rows)
    return _named(aligned(read_tiles(spark, work)))


def _named(pixels: DataFrame) -> DataFrame:
    """The columns of a band table: the layer, if any, and whether the cyano index can be had."""
    whole = F.size(F.array_intersect("bandas", F.array(*map(F.lit, DERIVE)))) == len(DERIVE)
    return pixels.withColumns({"scl": F.col("scl").cast("int"), "capa": F.array_contains("bandas", "cyano"), "derivable": whole}).withColumnRenamed("cyano", "cyano_capa").drop("bandas")


def validate(spark: SparkSession, work: str) -> DataFrame:
    """Violations of both manifests; those of the scenes alone where there is no manifest of indices yet."""
    have = spark.read.option("header", True).csv(manifests.location(spark, f"{work}/scenes"))
    out = checks.manifest_violations(have.withColumn("fecha", F.to_date("fecha")), checks.expected_scenes(spark), KEYS, S.SCENE_MANIFEST.names).withColumn("tabla", F.lit("scenes"))
    if _exists(spark, f"{work}/indices"):
        have = spark.read.option("header", True).csv(manifests.location(spark, f"{work}/indices")).withColumn("fecha", F.to_date("fecha"))
        more = checks.manifest_violations(have, checks.expected_indices(spark), [*KEYS, "indice"], S.INDEX_MANIFEST.names)
        flags = checks.flag_violations(have).select(F.lit("marca").alias("problema"), F.concat_ws(" ", "lago", F.col("fecha").cast("string"), "indice", "quality_flag").alias("clave"))
        out = out.unionByName(more.unionByName(flags).withColumn("tabla", F.lit("indices")))
    return out


def check_grid(spark: SparkSession, work: str) -> DataFrame:
    """Scenes whose grid (system, place, pixels and size) differs from that of their zone's first date; only sizes are known without tiles."""
    if _exists(spark, f"{work}/tiles"):
        found = compare.reference_grid(scene_grids(read_tiles(spark, work)))
        return found.select(*KEYS, F.to_json("grid").alias("rejilla"), F.to_json("grid_referencia").alias("rejilla_referencia"))
    size = read_pixels(spark, work).groupBy(*KEYS).agg(F.struct((F.max("row") + 1).alias("alto"), (F.max("col") + 1).alias("ancho")).alias("grid"))
    return compare.reference_grid(size).select(*KEYS, "grid.alto", "grid.ancho", F.col("grid_referencia.alto").alias("alto_referencia"), F.col("grid_referencia.ancho").alias("ancho_referencia"))


def grids(spark: SparkSession, work: str) -> dict[str, dict]:
    """Grid of each zone: upper left corner and pixel size in metres."""
    rows = tables.read_csv(spark, f"{work}/grids", S.GRIDS).collect()  # a row a zone
    return {r["lago"]: {"crs": r["crs"], "transform": (r["x"], r["y"], r["resolucion"], r["resolucion"]), "width": r["ancho"], "height": r["alto"]} for r in rows}


def zone_outlines(spark: SparkSession, work: str) -> dict[str, list] | None:
    """Outlines on the zones' grids; None where the work folder has none."""
    if not _exists(spark, f"{work}/outlines"):
        return None
    return spatial.rings_on_grid(tables.read_outlines(spark, f"{work}/outlines"), grids(spark, work))


def compute(bands: DataFrame, nodata: float | None = None) -> DataFrame:
    """ndvi, ndwi and cyano of every pixel of a wide band table; NULL outside their masks.

    ndvi and ndwi need water by class and data in their bands. cyano is the fetched layer where the scene has
    one (``capa``), else it is derived, with its own water test, where all its bands are there; ``con_cyano`` tells whether either is.
    """
    has = set(bands.columns)
    c = lambda b: M.number(F.col(b)) if b in has else F.lit(None).cast("double")
    lake = M.class_valid(F.col("scl")) & M.class_water(F.col("scl")) & M.bands_valid(c("b03"), c("b04"), c("b08"), nodata=nodata)
    water = M.water_body(c("b04"), c("b03"), c("b02"), c("b08"), c("b11"), c("b12"))
    fetched = F.col("capa") if "capa" in has else F.lit(False)
    derivable = F.col("derivable") if "derivable" in has else F.lit(has.issuperset(DERIVE))
    derived = M.masked(water, M.chlorophyll(M.ndci(c("b04"), c("b05"))))
    wide = {
        "ndvi": M.masked(lake, M.ndvi(c("b08"), c("b04"))), "ndwi": M.masked(lake, M.ndwi(c("b03"), c("b08"))),
        "cyano": F.when(fetched, c("cyano_capa")).when(derivable, derived), "lago_valido": lake, "con_cyano": fetched | derivable,
    }
    return bands.select(*KEYS, "row", "col", *(v.alias(k) for k, v in wide.items()))


def long_form(pixels: DataFrame) -> DataFrame:
    """One row for each pixel and index."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("indice"), F.col(c).alias("v")) for i, c in (("ndvi", "ndvi"), ("ndwi", "ndwi"), ("cianobacteria", "cyano"))))).alias("e")
    return pixels.select(*KEYS, "row", "col", "lago_valido", "con_cyano", parts).select(*KEYS, "row", "col", "lago_valido", "con_cyano", "e.indice", "e.v")


def index_manifest(pixels: DataFrame, scenes_table: DataFrame, root: str, grids_: DataFrame | None = None) -> DataFrame:
    """Manifest rows of the indices that scenes have, in one pass over the pixels.

    ``grids_(lago, fecha, grid)`` gives the system and resolution; without it they stay blank.
    """
    v = F.col("v")
    low, high = (F.element_at(F.create_map(*(F.lit(x) for i, r in RANGES.items() for x in (i, r[k]))), F.col("indice")) for k in (0, 1))
    out = long_form(pixels).where("indice <> 'cianobacteria' OR con_cyano").groupBy(*KEYS, "indice").agg(
        F.count(v).alias("pixeles_validos"), F.count_if("lago_valido").alias("pixeles_lago"), F.round(100 * F.count(v) / F.count(F.lit(1)), 4).alias("cobertura_valida_pct"),
        F.avg(F.when(v.isNotNull(), ((v < low) | (v > high)).cast("double"))).alias("frac_valores_atipicos"),
    )
    partial = scenes_table.select(*KEYS, F.col("cobertura_valida_oficial_pct").isNotNull().alias("parcial"))
    out = out.join(partial, KEYS, "left")
    if grids_ is not None:
        out = out.join(grids_.select(*KEYS, F.concat(F.lit("EPSG:"), F.col("grid.crs").cast("string")).alias("crs"), F.col("grid.px").alias("resolucion_m")), KEYS, "left")
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), F.col("indice"))
    added: dict[str, Column] = {
        "quality_flag": M.quality_flag(F.coalesce("parcial", F.lit(False)), F.col("frac_valores_atipicos")), "unidad": unit, "dtype": F.lit("float32"), "nodata": F.lit("nan"),
        "metodo": F.when(F.col("indice") == "cianobacteria", "capa recibida o NDCI derivado").otherwise("bandas y clases de la escena"), "formula_version": F.lit("1"),
        "ruta_raster": F.concat_ws("/", F.lit(root), F.concat(F.lit("lago="), "lago"), F.concat(F.lit("fecha="), F.col("fecha").cast("string"))),
    }
    out = out.withColumns(added)
    return out.select(*((F.col(c) if c in out.columns else F.lit(None)).cast(S.INDEX_MANIFEST[c].dataType).alias(c) for c in S.INDEX_MANIFEST.names))


def _by_scene(pixels: DataFrame, path: str) -> None:
    """Replace the partitions of these scenes alone; a scene's rows are dealt by stripes."""
    stripes = pixels.repartition(*KEYS, F.floor(F.col("row") / T.SIZE))
    stripes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def prepare_indices(spark: SparkSession, work: str) -> DataFrame:
    """The manifest of indices: pending rows of all scenes and indices, written once."""
    path = f"{work}/indices"
    if not _exists(spark, path):
        wanted = checks.expected_indices(spark)
        tables.write_csv(wanted.select(*((F.col(c) if c in wanted.columns else F.lit(None)).cast(S.INDEX_MANIFEST[c].dataType).alias(c) for c in S.INDEX_MANIFEST.names)), path, "errorifexists", 1)
    return manifests.read(spark, path, S.INDEX_MANIFEST)


#: Raster files of a scene: <zone>/<date>/<file> or <zone>_<date>/<file>.
SCENE_FILE = r"([a-z]+)[/_](\d{4}-\d{2}-\d{2})/[^/]+[.]tiff?$"


def register(spark: SparkSession, work: str) -> int:
    """Declare scenes whose files have come (by a download) and whose manifest row has no path yet: path, system, resolution, cover and state. Gives how many."""
    from rasterloom.sources import geotiff

    if not _exists(spark, f"{work}/rasters"):
        return 0
    waiting = prepare(spark, work).where("coalesce(ruta_local, '') = ''").select(*KEYS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(f"{work}/rasters")
    place = lambda k: F.regexp_extract("path", SCENE_FILE, k)
    found = files.where(place(1) != "").where(~F.lower(F.element_at(F.split("path", "/"), -1)).contains("cyano")).select("path", "content", place(1).alias("lago"), F.to_date(place(2)).alias("fecha")).join(waiting, KEYS, "left_semi")
    if found.select("path").isEmpty():
        return 0
    seen = geotiff.inspect(found).withColumns({"lago": place(1), "fecha": F.to_date(place(2))})
    rows = seen.groupBy(*KEYS).agg(
        F.array_join(F.array_sort(F.collect_list(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"))), ";").alias("ruta_local"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("EPSG:"), F.col("crs").cast("string")))), ";").alias("crs_salida"),
        F.array_join(F.array_sort(F.collect_set(M.general_text(F.col("resolution")))), ";").alias("resolucion_salida"),
        F.round(F.try_divide(100.0 * F.sum("validos"), F.sum("total")), 4).alias("cobertura_valida_pct"),
    ).withColumn("estado", F.lit("descargado"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # a row a scene that has just come
    manifests.update(spark, f"{work}/scenes", S.SCENE_MANIFEST, KEYS, rows, lambda new: checks.require_none(checks.manifest_violations(new, checks.expected_scenes(spark), KEYS), "manifest"))
    return rows.count()


def run_indices(spark: SparkSession, work: str) -> int:
    """Indices of the scenes that have rasters and none yet; scenes computed before stay untouched. Gives how many were computed.

    Pixels go to their scene's partition alone, by stripes of rows, and the scenes' rows
    of the manifest of indices replace the pending ones in its next version.
    """
    register(spark, work)
    manifest, done = prepare(spark, work), prepare_indices(spark, work)
    grids_, declared = None, manifest.where("coalesce(ruta_local, '') <> ''").select(*KEYS)
    rasters = _exists(spark, f"{work}/rasters") and not declared.isEmpty()
    read = lambda: spark.read.parquet(f"{work}/bands").withColumn("fecha", F.to_date("fecha"))
    if not rasters and not _exists(spark, f"{work}/bands"):
        raise InputDataError("no scene of the manifest declares a raster")
    todo = declared if rasters else read().select(*KEYS).distinct()
    # scenes without an index yet, and those whose layer has come since
    whole = done.where(F.col("quality_flag") != S.PENDING).groupBy(*KEYS).agg(F.count_if(F.col("indice") == "cianobacteria").alias("c"))
    if rasters:
        whole = whole.join(layers(spark, work).select(*KEYS, F.lit(1).alias("layer")), KEYS, "left").where("c > 0 OR layer IS NULL")
    todo = spark.createDataFrame(todo.join(whole, KEYS, "left_anti").collect(), "lago string, fecha date")  # a row a scene of the manifest
    n = todo.count()
    if not n:
        return 0
    if rasters:
        scan(spark, work, manifest.join(todo, KEYS, "left_semi"))
        tiles_ = read_tiles(spark, work).join(F.broadcast(todo), KEYS, "left_semi")
        grids_ = scene_grids(tiles_)
        _by_scene(_named(aligned(tiles_)), f"{work}/bands")
    _by_scene(compute(read().join(F.broadcast(todo), KEYS, "left_semi")), f"{work}/pixels")
    found = index_manifest(read_pixels(spark, work).join(F.broadcast(todo), KEYS, "left_semi"), manifest, f"{work}/pixels", grids_)
    found = spark.createDataFrame(found.collect(), found.schema)  # three rows a scene
    keys = [*KEYS, "indice"]
    manifests.update(spark, f"{work}/indices", S.INDEX_MANIFEST, keys, found, lambda new: checks.require_none(checks.manifest_violations(new, checks.expected_indices(spark), keys, S.INDEX_MANIFEST.names), "manifest of indices"))
    return n


def read_pixels(spark: SparkSession, work: str) -> DataFrame:
    df = spark.read.parquet(f"{work}/pixels")
    return df.withColumn("fecha", F.to_date("fecha"))


def _flags(spark: SparkSession, work: str) -> DataFrame:
    rows = manifests.read(spark, f"{work}/indices", S.INDEX_MANIFEST).where("indice = 'cianobacteria'")
    ready, _ = scenes.split_ready(rows)
    bad = checks.undeclared(rows)
    if not bad.isEmpty():
        raise InputDataError("ready rows leave fields blank")
    return ready.select(*KEYS, "quality_flag", "cobertura_valida_pct")


def temporal(spark: SparkSession, work: str) -> DataFrame:
    s = scenes.summarize(read_pixels(spark, work).withColumn("v", F.col("cyano"))).drop("cobertura_valida_pct")
    named = s.select(*KEYS, F.col("media").alias("cyano_promedio"), F.col("mediana").alias("cyano_mediana"), F.col("desviacion").alias("cyano_std"), "pixeles_validos")
    return named.join(_flags(spark, work), KEYS).select(*S.TEMPORAL_SUMMARY.names)


def zone_runs(spark: SparkSession, work: str, outlines: dict[str, list] | None = None) -> DataFrame | None:
    """Runs of cells within the zones' outlines: those given in pixels, else those of the work folder, made once and kept in ``runs``."""
    if outlines:
        return spatial.scanlines(spatial.edge_table(spatial.outlines(spark, outlines)))
    if not _exists(spark, f"{work}/outlines"):
        return None
    if not _exists(spark, f"{work}/runs"):
        points = tables.read_outlines(spark, f"{work}/outlines").join(F.broadcast(tables.read_csv(spark, f"{work}/grids", S.GRIDS).select("lago", F.col("x").alias("gx"), F.col("y").alias("gy"), "resolucion", "alto")), "lago")  # a row a zone
        e, n = spatial.to_utm(F.col("x"), F.col("y"))
        at = points.select("lago", "alto", "ring", "k", ((e - F.col("gx")) / F.col("resolucion")).alias("x"), ((F.col("gy") - n) / F.col("resolucion")).alias("y"))
        spatial.scanlines(spatial.edge_table(at, ("lago", "alto")), ("lago", "alto"), F.col("alto")).drop("alto").write.parquet(f"{work}/runs")
    return spark.read.parquet(f"{work}/runs")


def inside_outlines(pixels: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Pixels whose centres lie in their zone's outline; all of them without outlines."""
    return pixels if runs is None else spatial.within(pixels, runs)


def extent(spark: SparkSession, work: str, outlines: dict[str, list] | None = None) -> DataFrame:
    """Extent within the outlines given, or those of the work folder."""
    e = scenes.extent(inside_outlines(read_pixels(spark, work), zone_runs(spark, work, outlines)).withColumn("v", F.col("cyano")))
    return e.join(_flags(spark, work), KEYS).withColumn("resolucion_m", F.lit(float(S.TARGET_M))).select(*S.BLOOM_EXTENT.names)


def persistence(spark: SparkSession, work: str, least_dates: int = 3) -> DataFrame:
    return scenes.persistence(inside_outlines(read_pixels(spark, work), zone_runs(spark, work)).withColumn("v", F.col("cyano")), least_dates=least_dates)


def _rasters(rows: DataFrame, out: str) -> None:
    """Write rasters from (path, band, row, col, value, meta): strips by many tasks."""
    from rasterloom.sources import geotiff

    rows.sparkSession.dataSource.register(geotiff.GeoTiffSource)
    strip = F.floor(F.col("row") / geotiff.STRIP_ROWS)
    rows.repartition(F.col("path"), strip).sortWithinPartitions("path", "row").write.format("geotiff").mode("append").save(out)


def _meta(name: Column, grid: dict[str, Column], tags: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in grid.items()), name.alias("description"), F.struct(*(v.cast("string").alias(k) for k, v in tags.items())).alias("tags")))


def export_persistence(spark: SparkSession, work: str, out: str) -> None:
    """Two rasters for each zone: share of high dates, and valid dates; on a file system that all workers mount."""
    c = F.col
    grid = tables.read_csv(spark, f"{work}/grids", S.GRIDS).select("lago", *(c(a).alias(b) for a, b in (("crs", "_crs"), ("x", "_x"), ("y", "_y"), ("resolucion", "_step"), ("ancho", "_w"), ("alto", "_h"))))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(u).alias("unit"), c(v).cast("double").alias("value")) for n, v, u in (("proporcion_alto", "proporcion", "fraccion_0_1"), ("conteo_valido", "n_valido", "conteo_de_fechas"))))).alias("e")
    found = persistence(spark, work).join(F.broadcast(grid), "lago").select("*", each)  # a row a zone
    tags = {"lago": c("lago"), "indice": c("e.name"), "unidad": c("e.unit"), "fecha": F.lit("todas_las_fechas_listas"), "formula_version": F.lit("persistencia-v1")}
    meta = _meta(c("e.name"), {"crs": c("_crs"), "x": c("_x"), "y": c("_y"), "resolution": c("_step"), "width": c("_w"), "height": c("_h")}, tags)
    _rasters(found.select(F.concat_ws("_", "lago", F.concat("e.name", F.lit(".tif"))).alias("path"), F.lit(1).alias("band"), "row", "col", c("e.value").alias("value"), meta.alias("meta")), out)


def export_indices(spark: SparkSession, work: str, out: str) -> None:
    """A raster for each scene and index that was computed, on the grid of the scene's bands, with its tags."""
    c = F.col
    ready = manifests.read(spark, f"{work}/indices", S.INDEX_MANIFEST).where(c("quality_flag") != S.PENDING).select(*KEYS, "indice", "unidad", "formula_version")
    about = ready.join(scene_grids(read_tiles(spark, work)), KEYS)  # a row a raster
    found = long_form(read_pixels(spark, work)).join(about, [*KEYS, "indice"])
    tags = {"lago": c("lago"), "fecha": c("fecha"), "indice": c("indice"), "formula_version": c("formula_version"), "unidad": c("unidad")}
    meta = _meta(c("indice"), {"crs": c("grid.crs"), "x": c("grid.x"), "y": c("grid.y"), "resolution": c("grid.px"), "width": c("grid.width"), "height": c("grid.height")}, tags)
    name = F.concat(F.concat_ws("_", "lago", c("fecha").cast("string"), "indice"), F.lit(".tif"))
    _rasters(found.select(name.alias("path"), F.lit(1).alias("band"), "row", "col", c("v").cast("double").alias("value"), meta.alias("meta")), out)


def maps(spark: SparkSession, work: str) -> DataFrame:
    """Metadata of the maps of all scenes and indices; cyano's on the common scale."""
    top = scenes.comparison_scale(read_pixels(spark, work), value="cyano").first()
    each = read_pixels(spark, work).select(*KEYS).distinct()
    parts = [render.map_rows(each.select(*KEYS, F.lit(low).alias("vmin"), F.lit(high).alias("vmax")), i, "mapa") for i, low, high in (("ndvi", -1.0, 1.0), ("ndwi", -1.0, 1.0), ("cianobacteria", top["vmin"], top["vmax"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def layers_on_map(spark: SparkSession, work: str, most: int = 1000) -> DataFrame:
    """Coloured cells of every scene's cyano index on a grid of degrees over its zone's box, at most ``most`` a side: the layers of a map.

    All scenes at once, by tiles; cells without a value are left out.
    """
    pixels = read_pixels(spark, work).where("con_cyano")
    top = scenes.comparison_scale(pixels, value="cyano").first()
    c = F.col
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("grid.width", "grid.height"))
    w, h = (F.greatest(F.lit(1), F.round(c(f"grid.{n}") * share).cast("int")) for n in ("width", "height"))
    to = F.struct(F.lit(4326).alias("crs"), c("west").alias("x"), c("north").alias("y"), ((c("east") - c("west")) / w).alias("px"), ((c("north") - c("south")) / h).alias("py"), w.alias("width"), h.alias("height"))
    plan_ = scene_grids(read_tiles(spark, work)).join(prepare(spark, work).select(*KEYS, "west", "east", "south", "north"), KEYS).select(*KEYS, c("grid").alias("of"), to.alias("to"))
    found = T.cells(T.resample(T.from_cells(pixels.select(*KEYS, "row", "col", c("cyano").alias("v")), KEYS), plan_, KEYS), KEYS).where("v IS NOT NULL")
    return render.coloured(found, top["vmin"], top["vmax"])


def pairs(spark: SparkSession, work: str) -> DataFrame:
    p = read_pixels(spark, work)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("indice"), F.col(i).alias("y")) for i in ("ndvi", "ndwi")))).alias("e")
    return correlate.complete_pairs(p.select(*KEYS, "row", "col", F.col("cyano").alias("x"), each).select(*KEYS, "row", "col", "x", "e.indice", "e.y"))


def correlations(spark: SparkSession, work: str) -> tuple[DataFrame, DataFrame]:
    """By date, and by zone with the pooled balanced sample's coefficients."""
    every = pairs(spark, work)
    dates = correlate.by_date(every)
    pooled = correlate.by_date(series.balanced_pool(every), ["lago", "indice"])
    pooled = pooled.select("lago", "indice", "metodo", *(F.col(c).alias(f"{c}_agrupado") for c in ("coeficiente", "p_value", "n_pares", "magnitud")))
    return dates, correlate.by_zone(dates).join(pooled, ["lago", "indice", "metodo"], "left")


def correlation_tables(spark: SparkSession, work: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of coefficients as they are published: with flags and notes."""
    dates, zones = correlations(spark, work)
    flags = manifests.read(spark, f"{work}/indices", S.INDEX_MANIFEST).select("lago", "fecha", "indice", "quality_flag")
    return correlate.dated_table(dates, flags), correlate.zoned_table(zones)


def written(spark: SparkSession, work: str, name: str) -> DataFrame:
    """A table of the work folder: the one that was written, else made anew."""
    path = f"{work}/tables/{name}"
    return spark.read.parquet(path) if _exists(spark, path) else STEPS[name](spark, work)


def distributions(spark: SparkSession, work: str) -> DataFrame:
    full = inside_outlines(read_pixels(spark, work), zone_runs(spark, work)).where("cyano IS NOT NULL AND ndvi IS NOT NULL AND ndwi IS NOT NULL").withColumn("v", F.col("cyano"))
    table = scenes.distribution(full).join(_flags(spark, work).drop("cobertura_valida_pct"), KEYS, "left")
    return compare.with_reasons(table, series.select_dates(written(spark, work, "temporal"), written(spark, work, "extent")))


def comparison(spark: SparkSession, work: str) -> DataFrame:
    held = scenes.persistence_summary(written(spark, work, "persistence")).select("lago", F.col("pct_alguna_vez").alias("pct_area_alguna_vez_alta"), F.col("pct_persistente").alias("pct_area_persistente"))
    zones = written(spark, work, "zones").withColumnRenamed("coeficiente_mediano_fechas", "coef_mediana")
    return compare.zone_comparison(written(spark, work, "temporal"), written(spark, work, "extent"), held, zones)


def seasonal(spark: SparkSession, work: str) -> DataFrame:
    return compare.seasonal(written(spark, work, "temporal"))


STEPS = {
    "temporal": temporal, "peaks": lambda s, w: series.flag_peaks(written(s, w, "temporal")), "extent": extent, "persistence": persistence, "distributions": distributions,
    "correlations": lambda s, w: correlation_tables(s, w)[0], "zones": lambda s, w: correlation_tables(s, w)[1], "comparison": comparison, "seasonal": seasonal,
    "pending": lambda s, w: scenes.pending_report(manifests.read(s, f"{w}/indices", S.INDEX_MANIFEST)), "plan": plan, "prepare": prepare, "validate": validate,
    "check-grid": check_grid, "maps": maps, "layers": layers_on_map, "ingest": ingest,
}

#: Tables of the whole run, in order.
TABLES = ("temporal", "peaks", "extent", "persistence", "correlations", "zones", "distributions", "comparison", "seasonal", "pending", "maps")


def run_all(spark: SparkSession, work: str) -> list[str]:
    """Manifest, indices and every table of the work folder; tables stay as they are unless scenes were computed."""
    prepare(spark, work)
    checks.require_none(validate(spark, work), "manifest")
    new, done = run_indices(spark, work), []
    for name in TABLES:
        path = f"{work}/tables/{name}"
        if new or not _exists(spark, path):
            STEPS[name](spark, work).write.mode("overwrite").parquet(path)
            done.append(name)
    ordering.release()
    return done
