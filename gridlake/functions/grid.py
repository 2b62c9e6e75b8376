"""Tile-grid algebra as Columns: spherical mercator, geodetic and raster profiles.

Tiles count from the lower left (TMS) unless a name says xyz.  All functions take and return Columns, so
they stay inside generated code and need no shuffle.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137
ORIGIN_SHIFT = 2 * pi * RADIUS / 2.0
MAX_ZOOM = 19  # exclusive
WORLD_EDGE = 20037508.3427892

Pair = tuple[Column, Column]


def power_of_two(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


# mercator


def lonlat_to_meters(lon: Column, lat: Column) -> Pair:
    return lon * ORIGIN_SHIFT / 180.0, F.log(F.tan((90 + lat) * pi / 360.0)) / (pi / 180.0) * ORIGIN_SHIFT / 180.0


def meters_to_lonlat(mx: Column, my: Column) -> Pair:
    lat = my / ORIGIN_SHIFT * 180.0
    return mx / ORIGIN_SHIFT * 180.0, 180 / pi * (2 * F.atan(F.exp(lat * pi / 180.0)) - pi / 2.0)


def resolution(z: Column, tile_size: int = 256) -> Column:
    """Metres a pixel at the equator."""
    return F.lit(2 * pi * RADIUS / tile_size) / power_of_two(z)


def pixels_to_meters(px: Column, py: Column, z: Column, tile_size: int = 256) -> Pair:
    return px * resolution(z, tile_size) - ORIGIN_SHIFT, py * resolution(z, tile_size) - ORIGIN_SHIFT


def meters_to_pixels(mx: Column, my: Column, z: Column, tile_size: int = 256) -> Pair:
    return (mx + ORIGIN_SHIFT) / resolution(z, tile_size), (my + ORIGIN_SHIFT) / resolution(z, tile_size)


def pixels_to_tile(px: Column, py: Column, tile_size: int = 256) -> Pair:
    """A point on a tile's edge belongs to the lower tile, so -1 is possible."""
    return tuple((F.ceil(p / float(tile_size)) - 1).cast("int") for p in (px, py))


def pixels_to_raster(px: Column, py: Column, z: Column, tile_size: int = 256) -> Pair:
    return px, F.lit(tile_size) * power_of_two(z) - py


def meters_to_tile(mx: Column, my: Column, z: Column, tile_size: int = 256) -> Pair:
    return pixels_to_tile(*meters_to_pixels(mx, my, z, tile_size), tile_size)


def tile_bounds(tx: Column, ty: Column, z: Column, tile_size: int = 256) -> tuple[Column, ...]:
    """minx, miny, maxx, maxy in metres."""
    low = pixels_to_meters(tx * tile_size, ty * tile_size, z, tile_size)
    return *low, *pixels_to_meters((tx + 1) * tile_size, (ty + 1) * tile_size, z, tile_size)


def tile_lonlat_bounds(tx: Column, ty: Column, z: Column, tile_size: int = 256) -> tuple[Column, ...]:
    """min_lat, min_lon, max_lat, max_lon."""
    x0, y0, x1, y1 = tile_bounds(tx, ty, z, tile_size)
    (w, s), (e, n) = meters_to_lonlat(x0, y0), meters_to_lonlat(x1, y1)
    return s, w, n, e


def flip_y(ty: Column, z: Column) -> Column:
    """Between TMS and XYZ rows."""
    return (power_of_two(z) - 1 - ty).cast("int")


def quadkey(tx: Column, ty: Column, z: Column) -> Column:
    """Quadrant digits from the coarsest zoom on; empty at zoom 0."""
    row = (power_of_two(z) - 1 - ty).cast("long")
    digits = F.transform(F.sequence(z - 1, F.lit(0), F.lit(-1)), lambda i: (_bit(tx, i) + 2 * _bit(row, i)).cast("string"))
    return F.when(z <= 0, F.lit("")).otherwise(F.array_join(digits, ""))


def _bit(value: Column, i: Column) -> Column:
    return F.pmod(F.floor(value / F.pow(F.lit(2.0), i)), F.lit(2)).cast("int")


def zoom_for_pixel_size(size: Column, resolutions: list[float]) -> Column:
    """The zoom before the first whose resolution is finer than size (0 at least); null if none is."""
    first = F.lit(None).cast("int")
    for i in reversed(range(len(resolutions))):
        first = F.when(size > resolutions[i], F.lit(max(i - 1, 0))).otherwise(first)
    return first


def mercator_resolutions(tile_size: int = 256) -> list[float]:
    return [2 * pi * RADIUS / tile_size / 2**i for i in range(MAX_ZOOM)]


def tile_envelope(x: Column, y: Column, z: Column, margin: float = 0.0) -> tuple[Column, ...]:
    """xmin, ymin, xmax, ymax in metres of an XYZ tile, widened by margin tiles."""
    size = F.lit(2 * WORLD_EDGE) / power_of_two(z)
    return size * (x - margin) - WORLD_EDGE, F.lit(WORLD_EDGE) - size * (y + 1 + margin), size * (x + 1 + margin) - WORLD_EDGE, F.lit(WORLD_EDGE) - size * (y - margin)


def densified_edge(low: Column, high: Column, parts: int = 4) -> Column:
    """Vertices of one side of an envelope cut into parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: low + (high - low) / parts * i)


def simplify_tolerance(z: Column, extent: int = 4096) -> Column:
    """Metres: the pixel of the tile's own grid above zoom 11, the map's pixel up to it."""
    return F.when(z > 11, F.lit(40075016.68557849) / (extent * power_of_two(z))).otherwise(F.lit(RADIUS * 2 * pi) / F.pow(F.lit(2.0), z + 8))


# geodetic


def geodetic_resolution(z: Column, tms: bool = True, tile_size: int = 256) -> Column:
    return F.lit((180.0 if tms else 360.0) / tile_size) / power_of_two(z)


def lonlat_to_geodetic_tile(lon: Column, lat: Column, z: Column, tms: bool = True, tile_size: int = 256) -> Pair:
    res = geodetic_resolution(z, tms, tile_size)
    return pixels_to_tile((180 + lon) / res, (90 + lat) / res, tile_size)


def geodetic_tile_bounds(tx: Column, ty: Column, z: Column, tms: bool = True, tile_size: int = 256) -> tuple[Column, ...]:
    res = geodetic_resolution(z, tms, tile_size)
    return tx * tile_size * res - 180, ty * tile_size * res - 90, (tx + 1) * tile_size * res - 180, (ty + 1) * tile_size * res - 90


def geodetic_tile_range(x0: Column, y0: Column, x1: Column, y1: Column, z: Column, tms: bool = True) -> tuple[Column, ...]:
    """tminx, tminy, tmaxx, tmaxy of a box in degrees, cropped to the world."""
    low, high = lonlat_to_geodetic_tile(x0, y0, z, tms), lonlat_to_geodetic_tile(x1, y1, z, tms)
    side = power_of_two(z)
    return *(F.greatest(t, F.lit(0)) for t in low), F.least(high[0], (2 * side - 1).cast("int")), F.least(high[1], (side - 1).cast("int"))


def tile_range(x0: Column, y0: Column, x1: Column, y1: Column, z: Column) -> tuple[Column, ...]:
    """tminx, tminy, tmaxx, tmaxy (TMS) of a box in metres, within the grid."""
    last = (power_of_two(z) - 1).cast("int")
    return tuple(F.least(F.greatest(t, F.lit(0)), last) for pair in (meters_to_tile(x0, y0, z), meters_to_tile(x1, y1, z)) for t in pair)


# raster profile


def bounds_of_geotransform(gt: Column, xsize: Column, ysize: Column) -> tuple[Column, ...]:
    """minx, miny, maxx, maxy of a raster with square pixels; a rotated or skewed one raises an error."""
    at = lambda i: F.get(gt, F.lit(i))
    left = F.when((at(2) != 0) | (at(4) != 0), F.raise_error(F.lit("raster is rotated or skewed")).cast("double")).otherwise(at(0))
    return left, at(3) - ysize * at(1), left + xsize * at(1), at(3)


def ceil_log2(x: Column) -> Column:
    """ceil(log2(x)) without the last-bit error of a logarithm."""
    e = F.floor(F.log2(x))
    return (e - F.when(F.pow(F.lit(2.0), e) >= x, 1).otherwise(0) + 1 + F.when(F.pow(F.lit(2.0), e + 1) < x, 1).otherwise(0)).cast("int")


def native_zoom(xsize: Column, ysize: Column, tile_size: int = 256) -> Column:
    return F.greatest(ceil_log2(xsize / float(tile_size)), ceil_log2(ysize / float(tile_size)))


def overview_levels(xsize: Column, ysize: Column, tile_size: int = 256) -> Column:
    """Factors 2, 4, ... of the overviews of a raster."""
    n = ceil_log2(F.greatest(F.floor(xsize / tile_size), F.floor(ysize / tile_size), F.lit(1)).cast("double"))
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.pow(F.lit(2.0), i).cast("int")))


def raster_tile_span(z: Column, native: Column, tile_size: int = 256) -> Column:
    """Source pixels along one tile of a zoom."""
    return F.pow(F.lit(2.0), native - z) * tile_size


def stride(start: Column, end: Column, step: int = 3) -> Column:
    """start, start + step, ... below end, and always end."""
    return F.when(start >= end, F.array(end)).otherwise(F.concat(F.sequence(start, end - 1, F.lit(step)), F.array(end)))


def stride_down(start: Column, end: Column, step: int = 3) -> Column:
    return F.when(start <= end, F.array(end)).otherwise(F.concat(F.sequence(start, end + 1, F.lit(-step)), F.array(end)))


def read_window(start: Column, length: Column, size: Column, query: int) -> tuple[Column, ...]:
    """Along one axis: place and length to read, place and length to write, for a window that may leave the raster.

    Lengths shrink in proportion and are truncated, first at the lower border, then at the upper one."""
    shift = F.greatest(-start, F.lit(0))
    low = F.when(length > 0, shift / length).otherwise(F.lit(0.0))
    w = (query * low).cast("int")
    wlen, rlen, r = F.lit(query) - w, length - (length * low).cast("int"), F.greatest(start, F.lit(0))
    over = r + rlen > size
    return r, F.when(over, size - r).otherwise(rlen), w, F.when(over, (wlen * ((size - r) / rlen)).cast("int")).otherwise(wlen)
