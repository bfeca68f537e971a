"""Rasters as tiles, and their resampling between grids.

A tile holds ``SIZE`` x ``SIZE`` cells of one raster as an array in row-major order (NULL where
there is no value): keys, tr, tc, h, w, v. Work on neighbours of cells is done on whole
arrays within a task, so a shuffle moves one row for 65,536 cells. A grid is a struct as in
``GRID``: reference system, upper left corner, pixel sizes, width and height.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.scenes import InputDataError
from rasterloom.operators.spatial import degree_arrays, utm_arrays

SIZE = 256
GRID = "struct<crs:int,x:double,y:double,px:double,py:double,width:int,height:int>"


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def build(strips: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Tiles from strips (keys, row, col, v: the values from ``col`` on); cells that no strip has are NULL.

    Strips are cut where they cross tiles; a task gathers one tile's.
    """
    keys = list(keys)
    c, last = F.col("col"), F.col("col") + F.size("v") - 1
    cut = strips.where(F.size("v") > 0).withColumn("tc", F.explode(F.sequence(F.floor(c / size).cast("int"), F.floor(last / size).cast("int"))))
    start = F.greatest(c, F.col("tc") * size)
    part = F.slice("v", (start - c + 1).cast("int"), (F.least(last, F.col("tc") * size + size - 1) - start + 1).cast("int"))
    cut = cut.select(*keys, F.floor(F.col("row") / size).cast("int").alias("tr"), "tc", (F.col("row") % size).cast("int").alias("r"), (start % size).cast("int").alias("c"), F.transform(part, lambda x: x.cast("double")).alias("v"))

    def one(t: pa.Table) -> pa.Table:
        out = np.full((size, size), np.nan)
        t = t.combine_chunks()
        v = t.column("v").chunk(0)
        n = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy(zero_copy_only=False)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        r, c = (np.repeat(t.column(k).to_numpy(), n) for k in "rc")
        out[r, c + at] = flat
        h, w = int(r.max()) + 1, int((c + at).max()) + 1
        return _tile(t.select([*keys, "tr", "tc"]).slice(0, 1), out[:h, :w])

    return cut.groupBy(*keys, "tr", "tc").applyInArrow(one, f"{_types(strips, keys)}, tr int, tc int, h int, w int, v array<double>")


def _tile(row: pa.Table, values: np.ndarray) -> pa.Table:
    h, w = values.shape
    for name, x in (("h", pa.array([h], pa.int32())), ("w", pa.array([w], pa.int32())), ("v", _list(values))):
        row = row.append_column(name, x)
    return row


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel(), mask=np.isnan(values.ravel())))


def from_cells(cells: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Tiles of a table of cells (keys, row, col, v)."""
    return build(cells.select(*keys, "row", "col", F.array("v").alias("v")), keys, size)


def cells(tiles: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Cells (keys, row, col, v) of tiles."""
    each = tiles.select(*keys, "tr", "tc", "w", F.posexplode("v").alias("p", "v"))
    return each.select(*keys, (F.col("tr") * size + F.floor(F.col("p") / F.col("w"))).cast("int").alias("row"), (F.col("tc") * size + F.col("p") % F.col("w")).cast("int").alias("col"), "v")


def positions(of: dict, to: dict, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the centres of cells of one grid lie among the pixel centres of the other: fractional rows and columns."""
    if of["crs"] == to["crs"]:
        r = (of["y"] - to["y"] + (rows + 0.5) * to["py"]) / of["py"] - 0.5
        c = (to["x"] - of["x"] + (cols + 0.5) * to["px"]) / of["px"] - 0.5
        return np.broadcast_to(r[:, None], (len(rows), len(cols))), np.broadcast_to(c[None], (len(rows), len(cols)))
    if to["crs"] == 4326 and of["crs"] and 32601 <= of["crs"] <= 32660:
        e, n = utm_arrays(*np.meshgrid(to["x"] + (cols + 0.5) * to["px"], to["y"] - (rows + 0.5) * to["py"]), of["crs"] - 32600)
        return (of["y"] - n) / of["py"] - 0.5, (e - of["x"]) / of["px"] - 0.5
    if of["crs"] == 4326 and to["crs"] and 32601 <= to["crs"] <= 32660:
        lon, lat = degree_arrays(*np.meshgrid(to["x"] + (cols + 0.5) * to["px"], to["y"] - (rows + 0.5) * to["py"]), to["crs"] - 32600)
        return (of["y"] - lat) / of["py"] - 0.5, (lon - of["x"]) / of["px"] - 0.5
    raise InputDataError(f"no way from system {of['crs']} to {to['crs']}")


def _corners(r: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and weight of the four neighbours of each position."""
    r0, c0 = np.floor(r).astype(np.int64), np.floor(c).astype(np.int64)
    for a in (0, 1):
        for b in (0, 1):
            yield r0 + a, c0 + b, (1 - np.abs(r - (r0 + a))) * (1 - np.abs(c - (c0 + b)))


def requests(scenes: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """(keys, of, to, tr, tc, sr, sc): which source tiles hold a neighbour of a cell of each target tile.

    ``scenes`` has the grids ``of`` the source and ``to`` the target of each raster.
    """
    keys = list(keys)
    last = lambda n: F.floor((F.col(n) - 1) / size).cast("int")
    wanted = scenes.where("to.width > 0 AND to.height > 0").select(*keys, F.col("of").cast(GRID).alias("of"), F.col("to").cast(GRID).alias("to"))
    wanted = wanted.withColumn("tr", F.explode(F.sequence(F.lit(0), last("to.height")))).withColumn("tc", F.explode(F.sequence(F.lit(0), last("to.width"))))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, place = [], []
            for k, (of, to, tr, tc) in enumerate(zip(*(b.column(n).to_pylist() for n in ("of", "to", "tr", "tc")), strict=True)):
                found = set()
                for r, c, w in _corners(*positions(of, to, *_span(to, tr, tc, size))):
                    ok = (w > 0) & (r >= 0) & (c >= 0) & (r < of["height"]) & (c < of["width"])
                    found |= set(np.unique(r[ok] // size * (1 << 31) + c[ok] // size).tolist())
                take += [k] * len(found)
                place += sorted(found)
            out = b.take(pa.array(take, pa.int64()))
            place = np.array(place, np.int64)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array((place >> 31).astype(np.int32)), pa.array((place & ((1 << 31) - 1)).astype(np.int32))], [*out.schema.names, "sr", "sc"])

    return wanted.mapInArrow(plan, f"{_types(scenes, keys)}, of {GRID}, to {GRID}, tr int, tc int, sr int, sc int")


def _span(grid: dict, tr: int, tc: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(tr * size, min(grid["height"], tr * size + size)), np.arange(tc * size, min(grid["width"], tc * size + size))


def resample(tiles: DataFrame, scenes: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Tiles of rasters on other grids, bilinearly: (keys, tr, tc, h, w, v).

    Invalid or missing neighbours lose their weight and the others share it; a cell
    without a valid neighbour is NULL, and target tiles without any neighbour are absent. Tiles of rasters whose two grids are
    equal stay as they are. Each source tile goes only to the target tiles that have a neighbour in
    it, and gives them the weighted sums of the cells concerned: a task never holds more
    than one source tile at a time, however much coarser the target is.
    """
    keys = list(keys)
    same = F.col("of").cast(GRID).eqNullSafe(F.col("to").cast(GRID))
    kept = tiles.join(scenes.where(same).select(*keys), keys, "left_semi").select(*keys, "tr", "tc", "h", "w", "v")
    wanted = requests(scenes.where(~same), keys, size)
    source = tiles.select(*keys, F.col("tr").alias("sr"), F.col("tc").alias("sc"), F.col("h").alias("sh"), F.col("w").alias("sw"), "v")
    met = wanted.join(source, [*keys, "sr", "sc"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                x = {n: b.column(n)[0].as_py() for n in ("of", "to", "tr", "tc", "sr", "sc", "sh", "sw")}
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(x["sh"], x["sw"])
                r, c = positions(x["of"], x["to"], *_span(x["to"], x["tr"], x["tc"], size))
                num, den = np.zeros(r.size), np.zeros(r.size)
                for i, j, w in _corners(r, c):
                    i, j, w = (i - x["sr"] * size).ravel(), (j - x["sc"] * size).ravel(), w.ravel()
                    at = np.flatnonzero((w > 0) & (i >= 0) & (j >= 0) & (i < x["sh"]) & (j < x["sw"]))
                    near = v[i[at], j[at]]
                    at, near = at[~np.isnan(near)], near[~np.isnan(near)]
                    num[at] += w[at] * near
                    den[at] += w[at]
                at = np.flatnonzero(den)
                if len(at):
                    one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t))
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in (*keys, "tr", "tc")), pa.array([r.shape[0]], pa.int32()), pa.array([r.shape[1]], pa.int32()), one(at, pa.int32()), one(num[at], pa.float64()), one(den[at], pa.float64())], [*keys, *names])

    def total(t: pa.Table) -> pa.Table:
        h, w = t.column("h")[0].as_py(), t.column("w")[0].as_py()
        num, den = np.zeros(h * w), np.zeros(h * w)
        for at, a, b in zip(*(t.column(n).combine_chunks() for n in ("at", "num", "den")), strict=True):
            at = at.values.to_numpy()
            num[at] += a.values.to_numpy()
            den[at] += b.values.to_numpy()
        out = np.full(h * w, np.nan)
        np.divide(num, den, out=out, where=den > 0)
        return _tile(t.select([*keys, "tr", "tc"]).slice(0, 1), out.reshape(h, w))

    names = ["tr", "tc", "h", "w", "at", "num", "den"]
    parts = met.mapInArrow(part, f"{_types(tiles, keys)}, tr int, tc int, h int, w int, at array<int>, num array<double>, den array<double>")
    done = parts.groupBy(*keys, "tr", "tc").applyInArrow(total, f"{_types(tiles, keys)}, tr int, tc int, h int, w int, v array<double>")
    return kept.unionByName(done)


def wide(tiles: DataFrame, keys: Sequence[str], names: Sequence[str], band: str = "band", size: int = SIZE, needed: Sequence[str] = (), present: str | None = None) -> DataFrame:
    """Pixels (keys, row, col, a column for each name) from tiles of bands on one grid: bands meet by tile, not by pixel.

    A band that a tile lacks is NULL, or an error if it is ``needed``; so are bands on different grids where tiles
    tell theirs (``grid``). ``present`` names a column with the bands that the tile has.
    """
    keys = list(keys)
    pick = [F.max_by(F.struct("w", "v"), F.when(F.col(band) == n, F.lit(1))).alias(n) for n in names]
    grids = F.size(F.collect_set("grid")) if "grid" in tiles.columns else F.max(F.lit(1))
    met = tiles.groupBy(*keys, "tr", "tc").agg(F.max("h").alias("h"), F.max("w").alias("w"), *pick, F.array_sort(F.collect_set(band)).alias("_have"), grids.alias("_grids"))
    scene = F.concat_ws(" ", *(F.col(k).cast("string") for k in keys))
    lack = F.array_except(F.array(*map(F.lit, needed)), F.col("_have")) if needed else F.array().cast("array<string>")
    wrong = F.when(F.size(lack) > 0, F.concat(scene, F.lit(": no band "), F.array_join(lack, ", "))).when(F.col("_grids") > 1, F.concat(scene, F.lit(": the bands lie on different grids")))
    # the message stands in the number of cells, so that no projection drops it
    n = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("int")).otherwise(F.col("h") * F.col("w"))
    at = met.select(*keys, "tr", "tc", "w", *names, "_have", F.explode(F.sequence(F.lit(0), n - 1)).alias("p"))
    r, c = F.floor(F.col("p") / F.col("w")).cast("int"), (F.col("p") % F.col("w")).cast("int")
    # a band's tile may be narrower than another's; cells beyond its width are not its own
    value = [F.when(c < F.col(f"{n}.w"), F.get(F.col(f"{n}.v"), r * F.col(f"{n}.w") + c)).alias(n) for n in names]
    more = [F.col("_have").alias(present)] if present else []
    return at.select(*keys, (F.col("tr") * size + r).alias("row"), (F.col("tc") * size + c).alias("col"), *value, *more)
