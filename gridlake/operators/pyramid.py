"""Base tiles of a pyramid: pixels of one or many assets become one image for each tile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.encoding import float_to_rgba
from ..functions.png import render_tiles
from . import raster


def base_tiles(pixels: DataFrame, method: str = "first", tile: Sequence[str] = ("z", "x", "y"), size: int = 256, value: str = "iv", order: str = "asset_ord", nodata: float = -9999999.0, with_sign: bool = True) -> DataFrame:
    """tile, data: an image of each tile that has a valid pixel.

    pixels: a row for each asset, tile and place (px, py).  Values that are nodata (within a millionth) or no numbers
    do not count; what the pixel-selection method makes of the others is encoded to four bytes, and places without a
    value are transparent.  One grouping takes any number of assets; tiles without a valid pixel give no row."""
    own = F.col(value).cast("double")
    valid = pixels.withColumn(value, F.when(F.isnan(own) | (F.abs(own - nodata) < 1e-6), F.lit(None)).otherwise(own))
    chosen = raster.select_pixels(valid, method, (*tile, "px", "py"), value, order).where("value is not null")
    bands = float_to_rgba(F.col("value").cast("double"), nodata, with_sign)
    return render_tiles(chosen.select(*tile, "px", "py", *(b.alias(n) for b, n in zip(bands, "rgba", strict=True))), size, tuple(tile))


def tile_details(plan: DataFrame, rasters: DataFrame, key: str, query: int = 1024, tile_size: int = 256) -> DataFrame:
    """plan (key, z, tx, ty from below) with what to read of each raster (key, left, top, res, xsize, ysize) and where it
    goes in a square of `query` pixels: rx, ry, rxsize, rysize, wx, wy, wxsize, wysize.

    Tiles that only their neighbours' pixels fill keep a row, with sizes of 0 or less."""
    x0, y0, x1, y1 = grid.tile_bounds(F.col("tx"), F.col("ty"), F.col("z"), tile_size)
    joined = plan.join(rasters.select(key, "left", "top", "res", "xsize", "ysize"), key)
    joined = joined.withColumns({"__x0": x0, "__y0": y0, "__x1": x1, "__y1": y1})
    start = {"__rx": (F.col("__x0") - F.col("left")) / F.col("res"), "__ry": (F.col("top") - F.col("__y1")) / F.col("res")}
    size = {"__rw": (F.col("__x1") - F.col("__x0")) / F.col("res"), "__rh": (F.col("__y1") - F.col("__y0")) / F.col("res")}
    cells = joined.withColumns({**{n: (v + 0.001).cast("int") for n, v in start.items()}, **{n: (v + 0.5).cast("int") for n, v in size.items()}})
    across = grid.read_window(F.col("__rx"), F.col("__rw"), F.col("xsize"), query)
    down = grid.read_window(F.col("__ry"), F.col("__rh"), F.col("ysize"), query)
    names = (("rx", "rxsize", "wx", "wxsize"), ("ry", "rysize", "wy", "wysize"))
    windows = {n: v for axis, values in zip(names, (across, down), strict=True) for n, v in zip(axis, values, strict=True)}
    return cells.select(*plan.columns, *(v.cast("int").alias(n) for n, v in windows.items()))


def zoom_ranges(plan: DataFrame, key: str) -> DataFrame:
    """key, z, tminx, tminy, tmaxx, tmaxy of a plan's tiles, with the least and greatest zoom of each key."""
    ranges = plan.groupBy(key, "z").agg(*(f(t).alias(f"t{n}{t[1]}") for n, f in (("min", F.min), ("max", F.max)) for t in ("tx", "ty")))
    own = Window.partitionBy(key)  # a key's zooms, not its tiles
    return ranges.withColumns({"tminz": F.min("z").over(own), "tmaxz": F.max("z").over(own)})


def write_plan(folder: str, plan: DataFrame, details: DataFrame, jobs: DataFrame, key: str) -> None:
    """The tables of a pyramid's jobs, replaced as a whole: tiles in detail (by zoom), zoom ranges, one row for each job."""
    details.write.mode("overwrite").partitionBy("z").parquet(f"{folder}/tiles_detail")
    zoom_ranges(plan, key).write.mode("overwrite").parquet(f"{folder}/tminmax")
    jobs.write.mode("overwrite").parquet(f"{folder}/tile_job")


def job_of(spark: SparkSession, folder: str, key: str, value: object) -> DataFrame:
    """The job of one key with its zoom ranges (an array of structs); no row for an unknown key."""
    job = spark.read.parquet(f"{folder}/tile_job").where(F.col(key) == value)
    ranges = spark.read.parquet(f"{folder}/tminmax").where(F.col(key) == value)
    held = ranges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("z", "tminx", "tminy", "tmaxx", "tmaxy"))).alias("ranges"))
    return job.join(held, key, "left")
