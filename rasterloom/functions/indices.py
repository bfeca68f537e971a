"""Map algebra, classes, labels and other scalar functions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom import schema as S


def number(c: Column) -> Column:
    """NaN becomes NULL: comparisons and aggregates then ignore nodata."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def finite(c: Column) -> Column:
    """Neither missing nor NaN nor infinite."""
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def fixed_text(c: Column, digits: int) -> Column:
    """A number with that many digits behind the point; the empty text for none."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double"))).otherwise(F.lit(""))


def general_text(c: Column) -> Column:
    """C's ``%g``: six significant digits, no zeros at the end, an exponent below 1e-4 and from 1e6 on; the empty text for none.

    What the double holds is rounded once, ties to even. The JVM's formats round the shortest decimal text, half up.
    """

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array(["%g" % v if v is not None else "" for v in x.to_pylist()], pa.string())

    return text(c.cast("double"))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); NULL where the sum is zero."""
    return F.try_divide(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def ndci(red: Column, edge: Column) -> Column:
    return normalized_difference(edge, red)


def chlorophyll(x: Column) -> Column:
    """Cubic of the chlorophyll index, in Horner's form."""
    return ((826.57 * x - 176.43) * x + 19.0) * x + 4.071


def _ratio(a: Column, b: Column) -> Column:
    """Division with infinities for a zero denominator and NULL for 0 / 0."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, inf).when(a < 0, -inf)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def water_body(red: Column, green: Column, blue: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    """Water by any of six thresholds, unless built-up or bare ground vetoes it; a missing operand meets no threshold."""
    vegetation = _ratio(nir - red, nir + red)
    mndwi = _ratio(green - swir1, green + swir1)
    water = _ratio(green - nir, green + nir)
    leaves = _ratio(nir - swir1, nir + swir1)
    shadow = blue + 2.5 * green - 1.5 * (nir + swir1) - 0.25 * swir2
    bright = 4 * (green - swir1) - (0.25 * nir + 2.75 * swir1)
    soil = number(_ratio(swir1 - green, swir1 + green) - vegetation)
    terms = [mndwi > 0.42, water > 0.4, bright > 0.1879, shadow > 0.1112, vegetation < -0.2, leaves > 1]
    wet = reduce(lambda x, y: x | y, map(_true, terms))
    return wet & ~(_true(bright <= -0.03) | _true(soil > 0))


def masked(mask: Column, value: Column) -> Column:
    return F.when(mask, value)


def floating_algae(red: Column, edge3: Column, nir2: Column) -> Column:
    return edge3 - red - (nir2 - red) * (783 - 665) / (865 - 665)


# Upper ends of the chlorophyll classes and their colours (red, green, blue of 255).
PALETTE = (
    (0.5, (0, 0, 255)), (1, (0, 0, 255)), (2.5, (0, 59, 255)), (3.5, (0, 98, 255)), (5, (15, 113, 141)), (7, (14, 141, 120)),
    (8, (13, 141, 103)), (10, (30, 226, 28)), (14, (42, 226, 28)), (18, (68, 226, 28)), (20, (68, 226, 28)), (24, (134, 247, 0)),
    (28, (140, 247, 0)), (30, (205, 237, 0)), (38, (208, 240, 0)), (45, (208, 240, 0)), (50, (251, 210, 3)), (75, (248, 207, 2)),
    (90, (134, 247, 0)), (100, (245, 164, 9)), (150, (240, 159, 8)), (250, (237, 157, 7)), (300, (239, 118, 15)), (350, (239, 101, 15)),
    (450, (239, 100, 14)), (500, (233, 72, 21)),
)
TOP_COLOUR = (233, 72, 21)
FLOATING_LIMIT = 0.08


def colour_class(chl: Column, algae: Column | None = None) -> Column:
    """Number of the chlorophyll class, from 0; the last one also for floating vegetation."""
    out = F.lit(len(PALETTE))
    for k in range(len(PALETTE) - 1, -1, -1):
        out = F.when(chl < PALETTE[k][0], F.lit(k)).otherwise(out)
    if algae is not None:
        out = F.when(algae > FLOATING_LIMIT, F.lit(len(PALETTE))).otherwise(out)
    return F.when(chl.isNotNull(), out)


def colour(number_of_class: Column) -> Column:
    """[red, green, blue] of a class."""
    table = F.array(*(F.array(*map(F.lit, rgb)) for rgb in (*(c for _, c in PALETTE), TOP_COLOUR)))
    return F.get(table, number_of_class)


def scale_channel(value: Column, low: Column, high: Column) -> Column:
    """Value on [0, 1] between two ends, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, high - low)))


def pixel_area(resolution: Column | None) -> Column:
    res = F.coalesce(resolution, F.lit(float(S.TARGET_M))) if resolution is not None else F.lit(float(S.TARGET_M))
    return res * res


def class_valid(scl: Column) -> Column:
    return ~scl.isin(*S.SCL_EXCLUDED)


def class_water(scl: Column) -> Column:
    return scl == S.SCL_WATER


def bands_valid(*bands: Column, nodata: float | None = None) -> Column:
    """No band is missing or equals the nodata value."""
    tests = [b.isNotNull() if nodata is None else (b.isNotNull() & (b != nodata)) for b in bands]
    return reduce(lambda x, y: x & y, tests)


def quality_flag(partial: Column, outlier_fraction: Column) -> Column:
    return F.when(partial, S.PARTIAL).when(outlier_fraction > S.OUTLIER_FRACTION, S.OUTLIERS).otherwise(S.COMPUTED)


def correlation_direction(r: Column) -> Column:
    r = number(r)
    return F.when(r.isNull(), "indeterminada").when(r > 0, "positiva").when(r < 0, "negativa").otherwise("nula")


def correlation_magnitude(r: Column) -> Column:
    r = F.abs(number(r))
    bands = F.when(r.isNull(), "indeterminada").when(r < 0.10, "muy_debil").when(r < 0.30, "debil")
    return bands.when(r < 0.50, "moderada").when(r < 0.70, "fuerte").otherwise("muy_fuerte")


def trend_label(first: Column, second: Column, flat: float = 0.5) -> Column:
    d = second - first
    return F.when(F.abs(d) < flat, "estable").when(d > 0, "creciente").when(d < 0, "decreciente")


def season(date: Column) -> Column:
    return F.when(F.month(date).isin(*S.DRY_MONTHS), "seca").when(date.isNotNull(), "lluviosa")


def day_interval(date: Column) -> tuple[Column, Column]:
    return date, F.date_add(date, 1)


def day_range(date: Column) -> tuple[Column, Column]:
    """First and last second of a day, as request texts."""
    day = F.date_format(date, "yyyy-MM-dd")
    return F.concat(day, F.lit("T00:00:00Z")), F.concat(day, F.lit("T23:59:59Z"))


def band_name(text: Column) -> Column:
    """A band's name from a free text: trimmed, upper case, one digit padded (b3 is B03)."""
    name = F.upper(F.trim(text))
    return F.regexp_replace(name, "^B([0-9])$", "B0$1")


def request_size(west: Column, east: Column, south: Column, north: Column, resolution: float = S.TARGET_M, limit: int = S.REQUEST_LIMIT) -> Column:
    """struct(width, height) of a request in pixels, scaled so that neither side is over the limit."""
    side = lambda a, b: F.greatest(F.lit(1.0), F.bround((b - a) * float(S.METRES_PER_DEGREE) / float(resolution)))
    w, h = side(west, east), side(south, north)
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(w, h))
    fit = lambda x: F.greatest(F.lit(1.0), F.bround(x * scale)).cast("int")
    return F.struct(fit(w).alias("width"), fit(h).alias("height"))


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def joined(values: Column, separator: str = ";") -> Column:
    """Sorted distinct values as one text."""
    return F.array_join(F.array_sort(F.array_distinct(values)), separator)


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; unchanged elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


#: Per-pixel formulas by name: the bands they take, in order, and the function of these columns.
FORMULAS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "ndvi": (("b08", "b04"), ndvi),
    "ndwi": (("b03", "b08"), ndwi),
    "ndci": (("b04", "b05"), ndci),
    "clorofila": (("b04", "b05"), lambda red, edge: chlorophyll(ndci(red, edge))),
    "agua": (("b04", "b03", "b02", "b08", "b11", "b12"), water_body),
    "algas": (("b04", "b07", "b8a"), floating_algae),
}


def register(name: str, bands: Sequence[str], function: Callable[..., Column]) -> None:
    """Add a formula; a name that is taken is an error."""
    if name in FORMULAS:
        raise ValueError(f"formula {name} exists")
    FORMULAS[name] = (tuple(bands), function)


def formula(name: str, where: Callable[[str], Column] = F.col) -> Column:
    """The column of a formula over the bands that ``where`` gives by name; NaN in a band counts as missing."""
    bands, function = FORMULAS[name]
    return function(*(number(where(b)) for b in bands))
