"""Rasters as rows of pixels: pixel selection over mosaics, merges, overviews, resampling, windows.

A mosaic is the union of its assets with an order column; a pixel's value is an aggregate over the assets
that have it, so any number of assets meets in one grouping whose partial sums form before the shuffle.
Null is nodata.  Columns that identify a pixel are given by the caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid

SELECTIONS = ("first", "highest", "lowest", "mean", "median", "stdev", "count")
MERGES = ("first", "last", "min", "max", "mean", "sum", "count")
KERNELS = ("nearest", "average", "min", "max", "med", "mode", "rms")


def selection(method: str, value: Column, order: Column) -> Column:
    """Aggregate of a pixel's values over its assets; nulls are assets without it."""
    valid = value.isNotNull()
    if method == "first":
        return F.min_by(value, F.when(valid, order))
    return {
        "last": lambda: F.max_by(value, F.when(valid, order)),
        "highest": lambda: F.max(value),
        "lowest": lambda: F.min(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "mean": lambda: F.avg(value),
        "median": lambda: F.median(value),
        "stdev": lambda: F.stddev_pop(value),
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
    }[method]()


def select_pixels(assets: DataFrame, method: str, keys: Sequence[str], value: str = "iv", order: str = "asset_ord") -> DataFrame:
    """keys and value: the mosaic by a pixel-selection method."""
    if method not in SELECTIONS:
        raise ValueError(f"unknown pixel selection {method!r}; known: {', '.join(SELECTIONS)}")
    return assets.groupBy(*keys).agg(selection(method, F.col(value), F.col(order)).alias("value"))


def select_by_last_band(assets: DataFrame, keys: Sequence[str], bands: Sequence[str], order: str = "asset_ord", high: bool = True) -> DataFrame:
    """All bands of the asset whose last band is highest (or lowest); ties go to the first asset."""
    last = F.col(bands[-1])
    rank = F.struct(last, -F.col(order)) if high else F.struct(last, F.col(order))
    best = (F.max_by if high else F.min_by)(F.struct(*bands), F.when(last.isNotNull(), rank)).alias("__b")
    return assets.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__b.{b}").alias(b) for b in bands))


def merge_pixels(assets: DataFrame, method: str, keys: Sequence[str], value: str = "iv", order: str = "asset_ord", compat: bool = False) -> DataFrame:
    """One raster out of a mosaic.  compat=True lets the last asset win under "first", as older merges did."""
    if method not in MERGES:
        raise ValueError(f"a merge by {method!r} is not possible; known: {', '.join(MERGES)}")
    if compat and method == "first":
        method = "last"
    return assets.groupBy(*keys).agg(selection(method, F.col(value), F.col(order)).alias("value"))


def overview(pixels: DataFrame, keys: Sequence[str] = (), x: str = "px", y: str = "py", value: str = "iv", factor: int = 2, kernel: str = "average") -> DataFrame:
    """The next coarser level: one pixel out of factor x factor."""
    return resample(pixels, factor, kernel, keys, x, y, value)


def resample(pixels: DataFrame, factor: int, kernel: str, keys: Sequence[str] = (), x: str = "px", y: str = "py", value: str = "iv") -> DataFrame:
    """Downsampling by a whole factor; nulls take no part."""
    v, cell = F.col(value), [(F.floor(F.col(c) / factor)).cast("int").alias(c) for c in (x, y)]
    middle = factor // 2
    kernels = {
        "nearest": lambda: F.max(F.when((F.col(x) % factor == middle) & (F.col(y) % factor == middle), v)),
        "average": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "med": lambda: F.median(v),
        "mode": lambda: F.mode(v, deterministic=True),
        "rms": lambda: F.sqrt(F.avg((v * v).cast("double"))),
    }
    if kernel not in kernels:
        raise ValueError(f"unknown kernel {kernel!r}; known: {', '.join(kernels)}")
    # computed cells are named before the grouping, so nothing reads the old pixel place after it
    return pixels.withColumns({"__x": cell[0], "__y": cell[1]}).groupBy(*keys, "__x", "__y").agg(kernels[kernel]().alias("value")).withColumnsRenamed({"__x": x, "__y": y})


WEIGHTS = {
    "bilinear": (1, lambda d: 1 - d),
    "cubic": (2, lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2),
    "cubicspline": (2, lambda d: 2 / 3 - d * d + d**3 / 2 if d <= 1 else (2 - d) ** 3 / 6),
    "lanczos": (3, lambda d: 1.0 if d == 0 else 3 * _sin_pi(d) * _sin_pi(d / 3) / (9.869604401089358 * d * d)),
}


def _sin_pi(x: float) -> float:
    from math import pi, sin

    return sin(pi * x)


def phase_weights(kernel: str, factor: int) -> list[tuple[int, float]]:
    """Steps from a source pixel's first target to the targets it reaches, and its weight there."""
    reach, weight = WEIGHTS[kernel]
    steps = ((s, abs((s + 0.5) / factor - 0.5)) for s in range(-reach * factor, (reach + 1) * factor))
    return [(s, float(w)) for s, d in steps if d < reach and (w := weight(d))]


def interpolate(pixels: DataFrame, factor: int, kernel: str, keys: Sequence[str] = (), x: str = "px", y: str = "py", value: str = "iv") -> DataFrame:
    """Upsampling by a whole factor: every source pixel adds to the targets it reaches, and weights are normalised.

    The weights of each phase are literals, so this is one generator and one grouping.  Next to nodata the weights of a
    kernel with negative lobes can cancel out; such a target has no value (null)."""
    taps = [F.struct(F.lit(step).alias("s"), F.lit(w).alias("w")) for step, w in phase_weights(kernel, factor)]
    across, down = F.explode(F.array(*taps)).alias("__a"), F.explode(F.array(*taps)).alias("__d")
    wide = pixels.where(F.col(value).isNotNull()).select(*keys, x, y, value, across).select("*", down)
    size = pixels.groupBy(*keys).agg(F.max(x).alias("__mx"), F.max(y).alias("__my"))
    wide = wide.select(*keys, (F.col(x) * factor + F.col("__a.s")).alias("__x"), (F.col(y) * factor + F.col("__d.s")).alias("__y"), (F.col("__a.w") * F.col("__d.w")).alias("__w"), F.col(value).alias("__v"))
    weights = F.sum("__w")
    out = wide.groupBy(*keys, "__x", "__y").agg(F.when(F.abs(weights) > 1e-9, F.sum(F.col("__w") * F.col("__v")) / weights).alias("value"))
    out = out.join(size, list(keys)) if keys else out.crossJoin(F.broadcast(size))  # one row of bounds
    inside = (F.col("__x") >= 0) & (F.col("__y") >= 0) & (F.col("__x") < (F.col("__mx") + 1) * factor) & (F.col("__y") < (F.col("__my") + 1) * factor)
    return out.where(inside).select(*keys, F.col("__x").cast("int").alias(x), F.col("__y").cast("int").alias(y), "value")


def masked(value: Column, nodata: float) -> Column:
    """Null where a value is nodata or not a number."""
    return F.when(F.isnan(value.cast("double")) | (value == nodata), F.lit(None)).otherwise(value)


def non_empty_tiles(pixels: DataFrame, tile: Sequence[str], value: str = "iv") -> DataFrame:
    """Tiles with at least one valid pixel, and how many they have."""
    return pixels.groupBy(*tile).agg(F.count(value).alias("valid")).where("valid > 0")


def mosaic_extent(assets: DataFrame, left: str, bottom: str, right: str, top: str, res: str) -> DataFrame:
    """Extent of all assets at the coarsest resolution, and the raster's size there."""
    e = assets.agg(F.min(left).alias("left"), F.min(bottom).alias("bottom"), F.max(right).alias("right"), F.max(top).alias("top"), F.max(res).alias("res"))
    return e.withColumns({"width": F.ceil((F.col("right") - F.col("left")) / F.col("res")).cast("int"), "height": F.ceil((F.col("top") - F.col("bottom")) / F.col("res")).cast("int")})


def union_of_ranges(ranges: DataFrame, zoom: str = "z") -> DataFrame:
    """Tile ranges of a mosaic out of its assets' ranges, zoom by zoom."""
    return ranges.groupBy(zoom).agg(F.min("tminx").alias("tminx"), F.max("tmaxx").alias("tmaxx"), F.min("tminy").alias("tminy"), F.max("tmaxy").alias("tmaxy"))


def merge_window(asset: tuple[Column, ...], target: tuple[Column, ...], pixel: Column) -> tuple[Column, ...]:
    """Overlap of an asset with a target, both (ulx, uly, lrx, lry): target offset and size, source offset and size, in pixels."""
    (sx, sy, ex, ey), (tx, ty, ux, uy) = asset, target
    left, right, top, bottom = F.greatest(sx, tx), F.least(ex, ux), F.least(sy, ty), F.greatest(ey, uy)
    whole = lambda c: F.floor(c).cast("int")
    out = [whole((left - tx) / pixel + 0.1), whole((ty - top) / pixel + 0.1)]
    out += [whole((right - tx) / pixel + 0.5) - out[0], whole((ty - bottom) / pixel + 0.5) - out[1]]
    out += [whole((left - sx) / pixel + 0.1), whole((sy - top) / pixel + 0.1)]
    out += [whole((right - sx) / pixel + 0.5) - out[4], whole((sy - bottom) / pixel + 0.5) - out[5]]
    meet = (left < right) & (bottom < top)
    return tuple(F.when(meet, c) for c in out)


def base_tile_plan(rasters: DataFrame, key: str) -> DataFrame:
    """key, z, tx, ty (TMS) of the base tiles of each raster and zoom (minx, miny, maxx, maxy in metres, z), three apart in
    both directions, and place: the order of work, from the highest zoom down, rows downwards, columns upwards."""
    x0, y0, x1, y1 = grid.tile_range(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy")), F.col("z"))
    lines = rasters.select(key, "z", grid.stride(x0, x1).alias("__xs"), grid.stride_down(y1, y0).alias("__ys"))
    above = Window.partitionBy(key).orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, -1)  # a raster's zooms, not its tiles
    tiles = F.size("__xs").cast("long") * F.size("__ys")
    lines = lines.withColumn("__before", F.coalesce(F.sum(tiles).over(above), F.lit(0)))
    rows = lines.select(key, "z", "__xs", "__before", F.posexplode("__ys").alias("__row", "ty"))
    cells = rows.select(key, "z", "ty", (F.col("__before") + F.col("__row").cast("long") * F.size("__xs")).alias("__start"), F.posexplode("__xs").alias("__col", "tx"))
    return cells.select(key, "z", "tx", "ty", (F.col("__start") + F.col("__col") + 1).alias("place"))


#: Side of the cells of tiles_with_assets in tiles: their bits fit a long.
_CELL = 7


def tiles_with_assets(plan: DataFrame, assets: DataFrame, zooms: Iterable[int], keys: Sequence[str]) -> DataFrame:
    """Rows of plan (keys, z, tx, ty) whose tile or one of its eight neighbours meets a box of assets (keys, minx ... maxy).

    Boxes, a tile wider on each side, become bits of cells of seven tiles by seven.  A cell's bits are one number over all
    assets, whose parts form before the shuffle, so a tile meets one row however many assets lie there.  Neither side is
    broadcast: what Spark knows of their size is that of the files, before they list their tiles."""
    x0, y0, x1, y1 = grid.tile_range(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy")), F.col("z"))
    wide = {"__x0": F.greatest(x0 - 1, F.lit(0)), "__y0": F.greatest(y0 - 1, F.lit(0)), "__x1": x1 + 1, "__y1": y1 + 1}
    held = assets.withColumn("z", F.explode(F.array(*(F.lit(int(i)) for i in zooms)))).select(*keys, "z", *(v.alias(n) for n, v in wide.items()))
    for axis in "xy":
        held = held.withColumn(f"__c{axis}", F.explode(F.expr(f"sequence(__{axis}0 div {_CELL}, __{axis}1 div {_CELL})")))
    inner = lambda axis, end: f"least(greatest(__{axis}{end} - __c{axis} * {_CELL}, 0), {_CELL - 1})"
    span = lambda axis, unit: f"(shiftleft(1L, cast(({inner(axis, 1)} + 1) * {unit} as int)) - shiftleft(1L, cast({inner(axis, 0)} * {unit} as int)))"
    every_row = sum(1 << _CELL * row for row in range(_CELL))
    bits = F.bit_or(F.expr(f"({span('x', 1)} * {every_row}L) & {span('y', _CELL)}")).alias("__bits")
    held = held.groupBy(*keys, "z", "__cx", "__cy").agg(bits)
    near = plan.withColumns({f"__c{axis}": F.expr(f"t{axis} div {_CELL}") for axis in "xy"})
    meets = F.expr(f"shiftright(__bits, cast(tx % {_CELL} + ty % {_CELL} * {_CELL} as int)) & 1") == 1
    return near.join(held.hint("merge"), [*keys, "z", "__cx", "__cy"]).where(meets).select(*plan.columns)
