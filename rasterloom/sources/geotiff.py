"""GeoTIFF as a Spark data source, read and written with NumPy alone.

    spark.dataSource.register(GeoTiffSource)
    spark.read.format("geotiff").option("bands", "1,2").load("/scenes/*.tif")   # a row a valid pixel
    df.write.format("geotiff").mode("append").save("/out")                      # path, row, col, value

Supported: classic and big files, strips and tiles, no compression, LZW or deflate,
predictors 1 to 3, 8 to 64 bit integers and floats, one or several bands with their
descriptions, both byte orders, a nodata tag, the model pixel scale and tie point, and
the EPSG code of the geo keys.
"""

from __future__ import annotations

import fnmatch
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from rasterloom.operators.scenes import InputDataError

# Fixed values of the format: tags, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


@dataclass
class Raster:
    """Bands (band, row, column) and the grid they lie on."""

    data: np.ndarray
    crs: int | None = None
    origin: tuple[float, float] = (0.0, 0.0)
    pixel: tuple[float, float] = (1.0, 1.0)
    nodata: float | None = None
    description: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    bands: list[str] = field(default_factory=list)  # descriptions by position, where the file has them

    @property
    def grid(self) -> dict:
        return {"crs": self.crs, "transform": (*self.origin, *self.pixel), "width": self.data.shape[2], "height": self.data.shape[1]}

    def valid(self) -> np.ndarray:
        """Pixels whose every band is finite and not nodata."""
        d = self.data.astype(np.float64)
        ok = np.isfinite(d)
        if self.nodata is not None and not np.isnan(self.nodata):
            ok &= d != self.nodata
        return ok.all(axis=0)

    def values(self, band: int = 0) -> np.ndarray:
        """One band as doubles, NaN where it is nodata."""
        d = self.data[band].astype(np.float64)
        if self.nodata is not None and not np.isnan(self.nodata):
            d[d == self.nodata] = np.nan
        return d


def _directory(raw: bytes | Ranged) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    version = struct.unpack(order + "H", raw[2:4])[0] if order and len(raw) > 8 else 0
    if version not in (42, 43):
        raise InputDataError("not a TIFF file")
    big = version == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    room, head = struct.calcsize("=" + word), struct.calcsize("=" + count)
    at = struct.unpack(order + word, raw[8:16] if big else raw[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + count, raw[at : at + head])[0]):
        start = at + head + entry * k
        tag, kind, n = struct.unpack(order + "HH" + word, raw[start : start + 4 + room])
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * n
        start += 4 + room
        if size > room:
            start = struct.unpack(order + word, raw[start : start + room])[0]
        body = raw[start : start + size]
        out[tag] = (body.split(b"\0")[0].decode("utf-8", "replace"),) if code == "s" else struct.unpack(order + code * n if len(code) == 1 else order + code * n, body)
    return order, out


class Layout:
    """Where the blocks (strips or tiles) of a file lie, and how they are packed. ``raw`` gives bytes by slices: a whole file, or one that is read by ranges."""

    def __init__(self, raw: bytes | Ranged):
        order, self.tags = _directory(raw)
        tags = self.tags
        self.width, self.height, self.samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
        if self.width <= 0 or self.height <= 0:
            raise InputDataError("the raster has no pixels")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
        self.dtype = np.dtype(f"{order}{kind}{tags.get(BITS, (1,))[0] // 8}")
        self.tiled = TILES in tags
        self.w, self.h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if self.tiled else (self.width, min(self.height, tags.get(ROWS_PER_STRIP, (self.height,))[0]))
        self.planar = tags.get(PLANAR, (1,))[0] == 2
        self.starts, self.sizes = tags[TILES if self.tiled else STRIPS], tags[TILE_BYTES if self.tiled else STRIP_BYTES]
        self.across, self.down = -(-self.width // self.w), -(-self.height // self.h)

    def place(self, k: int) -> tuple[slice, int, int]:
        """Bands, first row and first column of block k."""
        band, at = divmod(k, self.across * self.down)
        return slice(band, band + 1) if self.planar else slice(0, self.samples), at // self.across * self.h, at % self.across * self.w

    def block(self, raw: bytes | Ranged, k: int) -> np.ndarray:
        """The values (bands, rows, columns) of block k, cut at the raster's edge."""
        _, y, x = self.place(k)
        body = raw[self.starts[k] : self.starts[k] + self.sizes[k]]
        compression = self.tags.get(COMPRESSION, (1,))[0]
        if compression in (8, 32946):
            body = zlib.decompress(body)
        elif compression == 5:
            body = unlzw(body)
        elif compression != 1:
            raise InputDataError(f"compression {compression} is not supported")
        rows = self.h if self.tiled else min(self.h, self.height - y)
        part = _unpredict(body, rows, self.w, 1 if self.planar else self.samples, self.dtype, self.tags.get(PREDICTOR, (1,))[0])
        return np.moveaxis(part[: self.height - y, : self.width - x], 2, 0)

    @property
    def nodata(self) -> float | None:
        try:
            text = self.tags.get(NODATA, (None,))[0]
            return None if text is None else float(text)
        except ValueError:
            return None


class Ranged:
    """A file by ranges: only the bytes of a slice are read."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        start, stop, _ = at.indices(self.size)
        return self.file.read_at(max(0, stop - start), start)


def decode(raw: bytes) -> Raster:
    """The raster in the bytes of a file; it must have positive dimensions."""
    f = Layout(raw)
    out = np.zeros((f.samples, f.height, f.width), f.dtype.newbyteorder("="))
    for k in range(len(f.starts)):
        bands, y, x = f.place(k)
        part = f.block(raw, k)
        out[bands, y : y + part.shape[1], x : x + part.shape[2]] = part
    tags = f.tags
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0)), tags.get(TIE_POINT, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    origin = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1])
    return Raster(out, codes.get(3072, codes.get(2048)), origin, (scale[0], scale[1]), f.nodata, tags.get(DESCRIPTION, ("",))[0], *_items(tags.get(METADATA, ("",))[0], f.samples))


def unlzw(body: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, the highest bit first, widened one code early."""
    out = bytearray()
    table: list[bytes] = []
    width, bits, held, last = 9, 0, 0, b""
    for byte in body:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table) or (code == len(table) and not last):
            raise InputDataError("broken LZW data")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def _unpredict(body: bytes, rows: int, width: int, inner: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    if predictor == 3:
        planes = np.frombuffer(body, np.uint8).reshape(rows, dtype.itemsize, width * inner)
        flat = np.cumsum(planes.reshape(rows, -1).reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, width * inner)
        return np.ascontiguousarray(np.moveaxis(flat, 1, 2)).view(dtype.newbyteorder(">")).reshape(rows, width, inner)
    part = np.frombuffer(body, dtype, rows * width * inner).reshape(rows, width, inner)
    return np.cumsum(part, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else part


def _items(text: str, samples: int) -> tuple[dict[str, str], list[str]]:
    """Tags of the file, and the descriptions of its bands if it has any."""
    import re
    from html import unescape

    tags: dict[str, str] = {}
    bands = [""] * samples
    for attributes, value in re.findall(r"<Item ([^>]*)>([^<]*)</Item>", text):
        a = dict(re.findall(r'(\w+)="([^"]*)"', attributes))
        if a.get("role") == "description" and a.get("sample", "").isdigit() and int(a["sample"]) < samples:
            bands[int(a["sample"])] = unescape(value)
        elif "name" in a and "sample" not in a:
            tags[a["name"]] = unescape(value)
    return tags, bands if any(bands) else []


#: Rows of a strip that is written.
STRIP_ROWS = 64


def encode(raster: Raster, rows_per_strip: int = STRIP_ROWS) -> bytes:
    """A deflated GeoTIFF, one strip after another."""
    data = np.ascontiguousarray(np.moveaxis(raster.data, 0, 2))
    data = data.astype(data.dtype.newbyteorder("<"))
    strips = [zlib.compress(data[y : y + rows_per_strip].tobytes(), 6) for y in range(0, data.shape[0], rows_per_strip)]
    sizes = [len(s) for s in strips]
    places = [sum(sizes[:k]) for k in range(len(sizes))]
    return header(raster, data.shape, data.dtype, sizes, places, rows_per_strip) + b"".join(strips)


def header(raster: Raster, shape: tuple[int, int, int], dtype: np.dtype, sizes: Sequence[int], places: Sequence[int], rows_per_strip: int = STRIP_ROWS, big: bool | None = None) -> bytes:
    """All of a file before its strips, which lie at ``places`` behind it; of the big format if 32 bits don't reach them."""
    height, width, samples = shape
    if big is None:
        big = max(map(sum, zip(sizes, places, strict=True))) + 16 * len(sizes) + (1 << 20) >= 1 << 32
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    fields: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (dtype.itemsize * 8,) * samples), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)),
        (SAMPLES, 3, (samples,)), (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_BYTES, 4, tuple(sizes)), (PLANAR, 3, (1,)), (FORMAT, 3, (kind,) * samples),
        (PIXEL_SCALE, 12, (*raster.pixel, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, *raster.origin, 0.0)),
    ]
    if raster.description:
        fields.append((DESCRIPTION, 2, raster.description.encode() + b"\0"))
    if raster.tags or raster.bands:
        from html import escape

        text = "".join(f'<Item name="{escape(k)}">{escape(v)}</Item>' for k, v in raster.tags.items())
        text += "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(v)}</Item>' for k, v in enumerate(raster.bands))
        fields.append((METADATA, 2, f"<GDALMetadata>{text}</GDALMetadata>".encode() + b"\0"))
    if raster.nodata is not None:
        fields.append((NODATA, 2, (b"nan" if np.isnan(raster.nodata) else f"{raster.nodata:g}".encode()) + b"\0"))
    if raster.crs is not None:
        flat = raster.crs == 4326
        fields.append((GEO_KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, raster.crs)))
    word, room = ("Q", 8) if big else ("I", 4)
    fields.append((STRIPS, 16 if big else 4, tuple(places)))
    fields.sort()
    head = 16 + 8 + 20 * len(fields) + 8 if big else 8 + 2 + 12 * len(fields) + 4
    bodies = {tag: value if isinstance(value, bytes) else struct.pack("<" + _TYPES[k] * len(value), *value) for tag, k, value in fields}
    total = head + sum(len(b) + len(b) % 2 for b in bodies.values() if len(b) > room)
    bodies[STRIPS] = struct.pack("<" + word * len(places), *(total + p for p in places))
    extra, entries = b"", []
    for tag, k, value in fields:
        body = bodies[tag]
        if len(body) > room:
            where = struct.pack("<" + word, head + len(extra))
            extra += body + b"\0" * (len(body) % 2)
        else:
            where = body.ljust(room, b"\0")
        entries.append(struct.pack("<HH" + word, tag, k, len(value)) + where)
    first = b"II+\0" + struct.pack("<HHQQ", 8, 0, 16, len(fields)) if big else b"II*\0" + struct.pack("<IH", 8, len(fields))
    return first + b"".join(entries) + b"\0" * room + extra


def load_bands(rasters: dict[str, Raster], wanted: Sequence[str]) -> dict[str, np.ndarray]:
    """Bands by name: by their descriptions, else one file with as many bands by position, else one file whose name holds the band's."""
    described = {b.upper(): (r, k) for r in rasters.values() for k, b in enumerate(r.bands)}
    if all(b.upper() in described for b in wanted):
        return {b: described[b.upper()][0].values(described[b.upper()][1]) for b in wanted}
    if len(rasters) == 1:
        (only,) = rasters.values()
        if only.data.shape[0] == len(wanted):
            return {b: only.values(k) for k, b in enumerate(wanted)}
        if len(wanted) != 1:
            raise InputDataError(f"{only.data.shape[0]} bands for {len(wanted)} names")
    out = {}
    for band in wanted:
        found = [r for name, r in rasters.items() if band.lower() in os.path.basename(name).lower()]
        if len(found) != 1:
            raise InputDataError(f"{len(found)} files for band {band}")
        out[band] = found[0].values()
    return out


def inspect_folder(spark: SparkSession, path: str) -> DataFrame:
    """Inspection of all raster files below ``path``; a folder without any is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", True).load(path)
    if files.isEmpty():
        raise InputDataError(f"no raster under {path}")
    return inspect(files)


def declared_files(rows: DataFrame, root: str, paths: str = "ruta_local") -> DataFrame:
    """(lago, fecha, path): the files that rows declare, parted by ``;``, below ``root``."""
    below = lambda c: F.when(c.rlike("^([a-z0-9]+:)?/"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))
    return rows.select("lago", "fecha", F.explode(F.split(paths, ";")).alias("p")).select("lago", "fecha", below(F.trim("p")).alias("path"))


def _plain(c: Column | str) -> Column:
    """A path without its scheme and double slashes."""
    return F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:/*", "/"), "/+", "/")


def read_tiles(spark: SparkSession, declared: DataFrame, wanted: Sequence[str], root: str) -> DataFrame:
    """(lago, fecha, band, grid, tr, tc, h, w, v) of the bands in the files ``declared(lago, fecha, path)`` below ``root``.

    Bands are known by their descriptions, else by position if a file has all of them,
    else by the file's name. A file that isn't there is an error. A task decodes one file.
    """
    from rasterloom.operators.tiles import GRID, SIZE
    from rasterloom.session import ship

    ship(spark)
    declared = declared.select("lago", "fecha", _plain("path").alias("_p"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(root)
    missing = declared.join(files.select(_plain("path").alias("_f")), F.col("_p") == F.col("_f"), "left_anti").limit(5).collect()
    if missing:
        raise InputDataError("no such raster: " + "; ".join(r["_p"] for r in missing))
    names = [b.lower() for b in wanted]
    fields = ["crs", "x", "y", "px", "py", "width", "height"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, raw) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                raster = decode(raw)
                shown = raster.bands or ([*names] if raster.data.shape[0] == len(names) else [])
                if not shown:
                    found = [b for b in names if b in os.path.basename(path).lower()]
                    shown = found if len(found) == raster.data.shape[0] else []
                g = raster.grid
                grid = pa.array([dict(zip(fields, (g["crs"], *g["transform"], g["width"], g["height"]), strict=True))], pa.struct([("crs", pa.int32()), *((n, pa.float64()) for n in fields[1:5]), *((n, pa.int32()) for n in fields[5:])]))
                for at, band in enumerate(b.lower() for b in shown):
                    if band not in names:
                        continue
                    v = raster.values(at)
                    for y in range(0, v.shape[0], SIZE):
                        for x in range(0, v.shape[1], SIZE):
                            part = v[y : y + SIZE, x : x + SIZE]
                            flat = pa.array(part.ravel(), mask=np.isnan(part.ravel()))
                            whole = [pa.array([n], pa.int32()) for n in (y // SIZE, x // SIZE, *part.shape)]
                            one = batch.slice(k, 1)
                            yield pa.RecordBatch.from_arrays([one.column("lago"), one.column("fecha"), pa.array([band]), grid, *whole, pa.ListArray.from_arrays(pa.array([0, part.size], pa.int32()), flat)], ["lago", "fecha", "band", "grid", "tr", "tc", "h", "w", "v"])

    met = files.join(declared, _plain("path") == F.col("_p")).select("lago", "fecha", "path", "content")
    return met.mapInArrow(cut, f"lago string, fecha date, band string, grid {GRID}, tr int, tc int, h int, w int, v array<double>")


def read_bands(spark: SparkSession, rows: DataFrame, wanted: Sequence[str], root: str, paths: str = "ruta_local") -> DataFrame:
    """(lago, fecha, row, col, the wanted bands in lower case) of scenes from the raster files that manifest rows declare.

    ``paths`` holds a scene's files, parted by ``;``, below ``root``. A blank or a file
    that isn't there is an error, and so is a scene without one of the bands or with bands on different grids. Files of a scene meet by tile.
    """
    from rasterloom.operators import tiles

    blank = rows.where(F.coalesce(F.col(paths), F.lit("")) == "").limit(5).collect()
    if blank:
        raise InputDataError("no raster declared for " + "; ".join(f"{r['lago']} {r['fecha']}" for r in blank))
    names = [b.lower() for b in wanted]
    return tiles.wide(read_tiles(spark, declared_files(rows, root, paths), wanted, root), ["lago", "fecha"], names, needed=names)


def inspect(df: DataFrame) -> DataFrame:
    """Dimensions, system, nodata and valid cover of ``binaryFile`` rows (path, content)."""
    from rasterloom.session import ship

    ship(df.sparkSession)
    schema = "path string, width int, height int, bands int, crs int, resolution double, dtype string, nodata double, validos long, total long, cobertura_valida_pct double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                r = decode(raw)
                if r.crs is None:
                    raise InputDataError(f"{path} declares no reference system")
                ok, total = int(r.valid().sum()), r.data.shape[1] * r.data.shape[2]
                rows.append((path, r.data.shape[2], r.data.shape[1], r.data.shape[0], r.crs, r.pixel[0], r.data.dtype.name, r.nodata, ok, total, round(100 * ok / total, 4)))
            names = [c.split()[0] for c in schema.split(", ")]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return df.select("path", "content").mapInArrow(run, schema)


def read_pixels(spark: SparkSession, path: str, band: int = 0) -> DataFrame:
    """(path, row, col, v) of every pixel of the files Spark finds under ``path``; v is NULL where it is nodata.

    Reads through Spark's file system, so any store that Spark reads will do.
    """
    from rasterloom.session import ship

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                v = decode(raw).values(band)
                for y in range(0, v.shape[0], 256):
                    part = v[y : y + 256]
                    rows, cols = np.divmod(np.arange(part.size), v.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * part.size), pa.array((rows + y).astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(part.ravel(), mask=np.isnan(part.ravel()))], ["path", "row", "col", "v"]
                    )

    files = spark.read.format("binaryFile").load(path)
    if files.isEmpty():
        raise InputDataError(f"no raster under {path}")
    return files.select("path", "content").mapInArrow(run, "path string, row int, col int, v double")


def scene_files(spark: SparkSession, path: str, without: Sequence[str] = ()) -> DataFrame:
    """Paths of the raster files under ``path`` whose names start with none of the prefixes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    for prefix in without:
        files = files.where(~name.startswith(prefix))
    return files.select("path", "length")


def encode_scenes(pixels: DataFrame, keys: Sequence[str], crs: int | None = None, origin: tuple[float, float] = (0.0, 0.0), pixel: tuple[float, float] = (10.0, 10.0), description: str = "", tags: dict[str, str] | None = None) -> DataFrame:
    """(keys, content) with one float32 GeoTIFF for each scene of (keys, row, col, v); its keys are tags, too. A task holds one scene."""
    from rasterloom.session import ship

    ship(pixels.sparkSession)
    schema = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys) + ", content binary"

    def one(table: pa.Table) -> pa.Table:
        rows, cols = table.column("row").to_numpy(), table.column("col").to_numpy()
        grid = np.full((1, rows.max() + 1, cols.max() + 1), np.nan, np.float32)
        grid[0, rows, cols] = table.column("v").to_numpy(zero_copy_only=False)
        named = {**(tags or {}), **{k: str(table.column(k)[0].as_py()) for k in keys}}
        return table.select(list(keys)).slice(0, 1).append_column("content", pa.array([encode(Raster(grid, crs, origin, pixel, float("nan"), description, named))], pa.binary()))

    return pixels.select(*keys, "row", "col", "v").groupBy(*keys).applyInArrow(one, schema)


#: Bytes of a file that one task reads, about.
SHARE = 64 << 20


@dataclass
class _Part(InputPartition):
    """Share k of n of a file's blocks."""

    path: str
    k: int
    n: int


class _Reader(DataSourceReader):
    """Blocks of files, by ranges: a large file is read by several tasks, each of which reads the directory and its own blocks."""

    def __init__(self, options: dict):
        self.options = options
        self.bands = [int(b) for b in str(options.get("bands", "1")).split(",")]
        self.rows = (0, 1 << 62)

    def partitions(self) -> list[_Part]:
        fs, path = _store(self.options.get("path", ""))
        found = fs.get_file_info(FileSelector(path)) if fs.get_file_info(path).type == FileType.Directory else [i for i in fs.get_file_info(FileSelector(os.path.dirname(path) or ".")) if fnmatch.fnmatch(i.base_name, os.path.basename(path))]
        files = sorted((i.path, i.size) for i in found if i.is_file and fnmatch.fnmatch(i.base_name.lower(), "*.tif*"))
        if not files:
            raise InputDataError(f"no raster under {path}")
        share = int(self.options.get("share", SHARE))
        return [_Part(f, k, n) for f, size in files for n in [max(1, -(-size // share))] for k in range(n)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.options.get("path", ""))
        with fs.open_input_file(partition.path) as file:
            raw = Ranged(file)
            f = Layout(raw)
            blocks = len(f.starts)
            for k in range(blocks * partition.k // partition.n, blocks * (partition.k + 1) // partition.n):
                bands, y, x = f.place(k)
                wanted = [b for b in self.bands if bands.start < b <= bands.stop]
                if not wanted or y + f.h <= self.rows[0] or y > self.rows[1]:
                    continue  # nothing of it is read
                part = f.block(raw, k)
                for b in wanted:
                    v = part[b - 1 - bands.start].astype(np.float64)
                    ok = ~np.isnan(v) if f.nodata is None or np.isnan(f.nodata) else ~np.isnan(v) & (v != f.nodata)
                    r, c = np.nonzero(ok)
                    keep = (r + y >= self.rows[0]) & (r + y <= self.rows[1])
                    r, c = r[keep], c[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.path] * len(r), pa.string()), pa.array([b] * len(r), pa.int32()), pa.array((r + y).astype(np.int32)), pa.array((c + x).astype(np.int32)), pa.array(v[r, c])],
                        ["path", "band", "row", "col", "value"],
                    )


class _PushingReader(_Reader):
    """The same with conditions on band and row, which leave blocks unread. Spark asks for them where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            low, high = self.rows
            if name == "band" and isinstance(f, EqualTo):
                self.bands = [b for b in self.bands if b == f.value]
            elif name == "band" and isinstance(f, In):
                self.bands = [b for b in self.bands if b in f.value]
            elif name == "row" and isinstance(f, EqualTo):
                self.rows = max(low, f.value), min(high, f.value)
            elif name == "row" and isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.rows = max(low, f.value + isinstance(f, GreaterThan)), high
            elif name == "row" and isinstance(f, LessThanOrEqual | LessThan):
                self.rows = low, min(high, f.value - isinstance(f, LessThan))
            elif not (isinstance(f, IsNotNull) and name in ("band", "row", "path", "col", "value")):
                yield f


def _store(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI that Arrow knows, and the path within it."""
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


@dataclass
class _Strip:
    """A compressed strip, in a task's own file."""

    name: str
    at: int
    file: str
    start: int
    size: int
    meta: str
    width: int
    height: int


@dataclass
class _Done(WriterCommitMessage):
    strips: list[_Strip]
    file: str


class _Writer(DataSourceArrowWriter):
    """Rasters from rows (path, band, row, col, value[, meta]), a file for each path.

    Tasks compress strips of STRIP_ROWS rows beside the target; the commit puts the files together from
    them, as bytes. Rows of a strip belong to one task (repartition by path and row div STRIP_ROWS; sorted by these,
    a task holds one strip at a time). Options, or the JSON in ``meta``: crs, x, y (upper left corner), resolution, width, height, description, tags.
    Without width and height a raster's rows belong to one task, and its size is that of its cells.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def _meta(self, text: str | None) -> dict:
        o = dict(self.options) | (json.loads(text) if text else {})
        o["tags"] = json.loads(o["tags"]) if isinstance(o.get("tags"), str) else o.get("tags", {})
        return o

    def _target(self, name: str) -> str:
        target = os.path.join(self.options["path"], os.path.basename(name))
        if os.path.exists(target) and not self.overwrite and self.options.get("replace", "false") != "true":
            raise InputDataError(f"{target} exists")
        return target

    def write(self, rows: Iterator) -> _Done:
        folder = os.path.join(self.options["path"], ".strips")
        os.makedirs(folder, exist_ok=True)
        own, done = os.path.join(folder, uuid.uuid4().hex), []
        open_: dict[tuple[str, int], list] = {}  # (path, strip): values, cells seen
        loose: dict[str, list] = {}  # rasters without a size
        metas: dict[str, tuple[str, int | None, int | None]] = {}
        with open(own, "wb") as out:

            def flush(name: str, at: int, values: np.ndarray) -> None:
                body = zlib.compress(values.astype("<f4").tobytes(), 6)
                text, width, height = metas[name]
                done.append(_Strip(name, at, own, out.tell(), len(body), text, width, height))
                out.write(body)

            for batch in rows:
                row, col, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "value"))
                texts = batch.column("meta") if "meta" in batch.schema.names else None
                place = batch.column("path").dictionary_encode()
                for k, name in enumerate(place.dictionary.to_pylist()):
                    at = np.flatnonzero(place.indices.to_numpy(zero_copy_only=False) == k)
                    if name not in metas:
                        self._target(name)
                        text = texts[int(at[0])].as_py() if texts is not None else ""
                        o = self._meta(text)
                        metas[name] = text or "", *(int(o[c]) if o.get(c) is not None else None for c in ("width", "height"))
                    width, height = metas[name][1:]
                    if width is None or height is None:
                        loose.setdefault(name, []).append((row[at], col[at], value[at]))
                        continue
                    strips = row[at] // STRIP_ROWS
                    for s in np.unique(strips).tolist():
                        if (name, s) not in open_:
                            open_[name, s] = [np.full((min(STRIP_ROWS, height - s * STRIP_ROWS), width), np.nan, np.float32), 0]
                        mine, held = at[strips == s], open_[name, s]
                        held[0][row[mine] - s * STRIP_ROWS, col[mine]] = value[mine]
                        held[1] += len(mine)
                        if held[1] >= held[0].size:
                            flush(name, s, open_.pop((name, s))[0])
            for (name, s), held in open_.items():
                flush(name, s, held[0])
            for name, parts in loose.items():
                row, col, value = (np.concatenate(c) for c in zip(*parts, strict=True))
                whole = np.full((int(row.max()) + 1, int(col.max()) + 1), np.nan, np.float32)
                whole[row, col] = value
                metas[name] = metas[name][0], whole.shape[1], whole.shape[0]
                for y in range(0, whole.shape[0], STRIP_ROWS):
                    flush(name, y // STRIP_ROWS, whole[y : y + STRIP_ROWS])
        return _Done(done, own)

    def commit(self, messages: list[_Done | None]) -> None:
        """Put the files together; what the driver moves are compressed bytes, a piece at a time."""
        by: dict[str, list[_Strip]] = {}
        for m in messages:
            for s in m.strips if m else []:
                by.setdefault(s.name, []).append(s)
        try:
            for name, strips in sorted(by.items()):
                self._assemble(name, {s.at: s for s in strips}, len(strips))
        finally:
            self.abort(messages)

    def _assemble(self, name: str, strips: dict[int, _Strip], n: int) -> None:
        target, one = self._target(name), next(iter(strips.values()))
        if n != len(strips) or len({(s.width, s.height) for s in strips.values()}) != 1:
            raise InputDataError(f"{name}: a strip, or a raster without a size, was written by several tasks; repartition by path and row div {STRIP_ROWS}")
        o, width, height = self._meta(one.meta), one.width, one.height
        crs, step = o.get("crs"), float(o.get("resolution") or 1)
        raster = Raster(np.zeros((1, 1, 1), np.float32), int(crs) if crs not in (None, "") else None, (float(o.get("x") or 0), float(o.get("y") or 0)), (step, step), float("nan"), o.get("description") or "", {k: str(v) for k, v in o["tags"].items()})
        empty = {h: zlib.compress(np.full((h, width), np.nan, "<f4").tobytes(), 6) for h in {STRIP_ROWS, height % STRIP_ROWS or STRIP_ROWS, height} if h}
        sizes, places, bodies, at = [], [], [], 0
        for k in range(-(-height // STRIP_ROWS)):  # a strip without rows has no values
            body = strips.get(k, empty[min(STRIP_ROWS, height - k * STRIP_ROWS)])
            sizes.append(body.size if isinstance(body, _Strip) else len(body))
            places.append(at)
            bodies.append(body)
            at += sizes[-1]
        with open(target + ".tmp", "wb") as out:
            out.write(header(raster, (height, width, 1), np.dtype("<f4"), sizes, places))
            for body in bodies:
                if isinstance(body, _Strip):
                    with open(body.file, "rb") as f:
                        f.seek(body.start)
                        out.write(f.read(body.size))
                else:
                    out.write(body)
        os.replace(target + ".tmp", target)

    def abort(self, messages: list[_Done | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.file):
                os.remove(m.file)


class GeoTiffSource(DataSource):
    """Rows of pixels from and to GeoTIFF files, on a store that Arrow reads and a file system that all workers mount.

    Option ``pushdown`` lets conditions on band and row reach the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "path string, band int, row int, col int, value double"

    def reader(self, schema) -> _Reader:
        push = str(self.options.get("pushdown", "false")).lower() == "true"
        return (_PushingReader if push else _Reader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)
