"""Merging rasters into one by the rules of a copy: later assets overwrite, invalid pixels do not.

Assets' pixels are placed on the target's grid and meet in one grouping: the value of the last asset that has a valid
pixel stays.  The pre-initialised target is one more asset, before all others, so nothing is scanned twice and no
pixel of the target needs a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isnan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import raster

BOX = ("ulx", "uly", "lrx", "lry")


def target_grid(assets: DataFrame, res: float, aligned: bool = False) -> DataFrame:
    """One row: ulx, uly, lrx, lry, xsize, ysize of the union of assets (ulx, uly, lrx, lry); aligned moves its borders
    outwards to multiples of the pixel size."""
    box = assets.agg(F.min("ulx").alias("ulx"), F.max("uly").alias("uly"), F.max("lrx").alias("lrx"), F.min("lry").alias("lry"))
    if aligned:
        out = {"ulx": F.floor, "uly": F.ceil, "lrx": F.ceil, "lry": F.floor}
        box = box.select(*((f(F.col(n) / res) * F.lit(res)).alias(n) for n, f in out.items()))
    size = lambda a, b: F.floor((F.col(a) - F.col(b)) / res + 0.5).cast("int")
    return box.withColumns({"xsize": size("lrx", "ulx"), "ysize": size("uly", "lry")})


def placed(pixels: DataFrame, assets: DataFrame, target: Sequence[float], res: float, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """pixels (keys, px, py, ...) at their places on a target (ulx, uly, lrx, lry) with pixels of size res.

    assets: keys, ulx, uly, lrx, lry and res of each.  Where an asset's pixels are larger or smaller than the target's,
    each target pixel takes the source pixel under its centre."""
    own = tuple(F.col(c) for c in BOX)
    goal = tuple(F.lit(float(v)) for v in target)
    at = raster.merge_window(own, goal, F.lit(float(res)))
    source = raster.merge_window(own, goal, F.col("res"))
    names = ("dx", "dy", "dw", "dh", "ox", "oy", "ow", "oh")
    windows = assets.select(*keys, *(c.alias(n) for c, n in zip((*at[:4], *source[4:]), names, strict=True))).where("dw > 0 and dh > 0 and ow > 0 and oh > 0")
    # target pixels t with floor((t + 1/2) * ow / dw) = s, in whole numbers
    first = lambda s, d, o: F.expr(f"cast(ceil(({s} * 2.0 * {d} - {o}) / (2.0 * {o})) as int)")
    span = lambda s, d, o: F.filter(F.sequence(first(s, d, o), F.greatest(first(f"({s} + 1)", d, o), first(s, d, o))), lambda t: (t >= first(s, d, o)) & (t < first(f"({s} + 1)", d, o)) & (t < F.col(d)))
    held = pixels.join(windows, list(keys)).where("px >= ox and py >= oy and px < ox + ow and py < oy + oh")
    held = held.withColumn("px", F.explode(span("(px - ox)", "dw", "ow"))).withColumn("py", F.explode(span("(py - oy)", "dh", "oh")))
    return held.withColumns({"px": F.col("px") + F.col("dx"), "py": F.col("py") + F.col("dy")}).drop(*names)


def valid(value: Column, nodata: float | None = None, mask: Column | None = None) -> Column:
    """Whether a pixel is copied: by nodata, if one is given, else by the mask (0 hides), else always."""
    if nodata is not None:
        return F.coalesce(~F.isnan(value.cast("double")) if isnan(nodata) else value != nodata, F.lit(False))
    return F.lit(True) if mask is None else F.coalesce(mask != 0, F.lit(True))


def stacked_bands(assets: DataFrame, order: str = "asset_ord", bands: str = "bands") -> DataFrame:
    """assets with first_band: bands are numbered on through all assets in their order.

    Assets are files of a mosaic, thousands at most, so one window holds them."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return assets.withColumn("first_band", (F.coalesce(F.sum(bands).over(before), F.lit(0)) + 1).cast("int"))


def filled(xsize: int, ysize: int, bands: int, init: Sequence[float], pixels: DataFrame) -> DataFrame:
    """band, px, py, value of a pre-initialised target: a value for each band, or one for all; anything else fills nothing (0)."""
    values = list(init) if len(init) >= bands else [init[0]] * bands if len(init) == 1 else [0.0] * bands
    rows = pixels.sparkSession.range(ysize).select(F.col("id").cast("int").alias("py"))
    across = rows.select("py", F.explode(F.sequence(F.lit(0), F.lit(xsize - 1))).alias("px"))
    return across.select(F.posexplode(F.array(*(F.lit(float(v)) for v in values[:bands]))).alias("band", "value"), "px", "py").select((F.col("band") + 1).alias("band"), "px", "py", "value")


def copied(pixels: DataFrame, keys: Sequence[str] = ("band", "px", "py"), order: str = "asset_ord", value: str = "value", nodata: float | None = None, mask: str | None = None, base: DataFrame | None = None) -> DataFrame:
    """keys, value: the last valid pixel in the order of assets; base: what the target holds before."""
    good = valid(F.col(value), nodata, None if mask is None else F.col(mask))
    rows = pixels.where(good).select(*keys, F.col(order).cast("long").alias("__o"), F.col(value).cast("double").alias("value"))
    if base is not None:
        rows = rows.unionByName(base.select(*keys, F.lit(-(2**63)).cast("long").alias("__o"), F.col("value").cast("double").alias("value")))
    return rows.groupBy(*keys).agg(F.max_by("value", "__o").alias("value"))
