"""Preparing rasters for tiling: warp, blocks of one size and overviews, as stages that are committed and skipped.

All overview levels come out of one pass over the blocks: a block whose side is a power of two halves itself down to a
single pixel, and the pieces of a coarser level's block meet in one row.  Only rasters of more than block x block
blocks along a side need the next pass, over the last level's blocks.

A stage's rows are written under the target folder and then entered in its manifest; a stage that the manifest names
is read back instead of computed.  A run that was lost in mid-stage leaves no entry, and its rows are overwritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid
from . import reading

PIECE = "asset string, level int, bx int, by int, ox int, oy int, w int, bw int, bh int, piece array<double>"


def overview_count(width: Column, height: Column, block: int) -> Column:
    """Levels until the longer side fits a block: the ceiling of the logarithm of how often a block fits into it."""
    return F.size(grid.overview_levels(width, height, block))


def halved(values: np.ndarray) -> np.ndarray:
    """Means of two by two pixels, at odd borders of what is there; nodata (nan) takes no part."""
    h, w = values.shape
    wide = np.full((h + h % 2, w + w % 2), np.nan)
    wide[:h, :w] = values
    parts = np.stack([wide[i::2, j::2] for i in (0, 1) for j in (0, 1)])
    there = ~np.isnan(parts)
    n = there.sum(axis=0)
    return np.where(n > 0, np.where(there, parts, 0.0).sum(axis=0) / np.maximum(n, 1), np.nan)


def _pieces(size: int, start: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("asset", "bx", "by", "width", "height", "levels")]
            for i, (asset, bx, by, width, height, levels) in enumerate(zip(*columns, strict=True)):
                values = batch.column("values")[i].values.to_numpy(zero_copy_only=False).astype(float)
                held = values.reshape(-1, min(size, width - bx * size))
                for k in range(1, min(levels - start, size.bit_length() - 1) + 1):
                    held = halved(held)
                    side = size >> k
                    x, y = bx & ((1 << k) - 1), by & ((1 << k) - 1)
                    whole = (min(size, -(-n >> k) - (b >> k) * size) for n, b in ((width, bx), (height, by)))  # the coarser block's own size
                    rows.append((asset, start + k, bx >> k, by >> k, x * side, y * side, held.shape[1], *whole, held.ravel()))
            kinds = [pa.string(), *[pa.int32()] * 8]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            pieces = pa.array([pa.array(p, pa.float64(), from_pandas=True) for p in columns[9]], pa.list_(pa.float64())) if rows else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=False)), pieces], ["asset", "level", "bx", "by", "ox", "oy", "w", "bw", "bh", "piece"])

    return run


def _assembled(rows: pa.Table) -> pa.Table:
    """A block out of its pieces."""
    first = rows.slice(0, 1).to_pylist()[0]
    ox, oy, w = (rows.column(c).to_numpy() for c in ("ox", "oy", "w"))
    pieces = [p.values.to_numpy(zero_copy_only=False).astype(float) for c in rows.column("piece").chunks for p in c]
    out = np.full((first["bh"], first["bw"]), np.nan)  # a base block may be missing
    for x, y, n, p in zip(ox, oy, w, pieces, strict=True):
        p = p.reshape(-1, n)
        out[y : y + len(p), x : x + n] = p
    full = bool(~np.isnan(out).any())
    return pa.table({"asset": [first["asset"]], "level": pa.array([first["level"]], pa.int32()), "bx": pa.array([first["bx"]], pa.int32()), "by": pa.array([first["by"]], pa.int32()), "values": pa.array([pa.array(out.ravel(), pa.float64(), from_pandas=True)], pa.list_(pa.float64())), "full": [full]})


def overviews(blocks: DataFrame, rasters: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """asset, level (from 1), bx, by, values, full of all overview levels of rasters (asset, width, height).

    size: the blocks' side, a power of two.  A level's pixel is the mean of the valid ones among four of the level
    below.  most: the highest level that occurs, if known; else it is looked up."""
    if size & (size - 1) or size < 2:
        raise ValueError("the side of blocks must be a power of two")
    sized = rasters.select(F.col("asset").cast("string").alias("asset"), "width", "height", overview_count(F.col("width"), F.col("height"), size).alias("levels"))
    most = (sized.agg(F.max("levels")).first()[0] or 0) if most is None else most
    step, out, start = size.bit_length() - 1, None, 0
    here = blocks.select(F.col("asset").cast("string").alias("asset"), "bx", "by", F.col("values").cast("array<double>").alias("values"))
    schema = "asset string, level int, bx int, by int, values array<double>, full boolean"
    while start < most:
        shrunk = [F.ceil(F.col(c) / F.lit(float(1 << start))).cast("int").alias(c) for c in ("width", "height")]
        asked = here.join(sized.where(F.col("levels") > start), "asset").select("asset", "bx", "by", "values", *shrunk, "levels")
        pieces = asked.mapInArrow(_pieces(size, start), PIECE)
        made = pieces.groupBy("asset", "level", "bx", "by").applyInArrow(_assembled, schema)  # size x size pixels at most
        out = made if out is None else out.unionByName(made)
        start += step
        here = made.where(F.col("level") == start).select("asset", "bx", "by", "values")
    return out if out is not None else blocks.sparkSession.createDataFrame([], schema)


def levels_of(rasters: DataFrame, size: int) -> DataFrame:
    """A row for each raster and level, 0 being the raster itself: res, width and height there."""
    count = overview_count(F.col("width"), F.col("height"), size)
    rows = rasters.withColumn("level", F.explode(F.sequence(F.lit(0), count)))
    times = grid.power_of_two(F.col("level"))
    return rows.withColumns({"res": F.col("res") * times, "width": F.ceil(F.col("width") / times).cast("int"), "height": F.ceil(F.col("height") / times).cast("int")})


def read_pyramid(windows: DataFrame, rasters: DataFrame, blocks: DataFrame, keys: Sequence[str], size: int, kernel: str = "nearest") -> DataFrame:
    """read_windows() with the coarsest level whose pixels are not larger than the window's, so a coarse window reads few blocks.

    blocks: asset, level, bx, by, values of level 0 and all overviews; rasters: in metres."""
    named = rasters.withColumn("asset", F.col("asset").cast("string"))
    pairs = reading.windows_over_rasters(windows, named.select("asset", *reading._RASTER), keys)
    step = F.least((F.col("xmax") - F.col("xmin")) / F.col("cols"), (F.col("ymax") - F.col("ymin")) / F.col("rows"))
    depth = overview_count(F.col("width"), F.col("height"), size)
    level = F.least(F.greatest(F.floor(F.log2(step / F.col("res")) + 1e-9), F.lit(0)), depth).cast("int")
    pairs = pairs.withColumn("level", level)
    times = grid.power_of_two(F.col("level"))
    pairs = pairs.withColumns({"res": F.col("res") * times, "width": F.ceil(F.col("width") / times).cast("int"), "height": F.ceil(F.col("height") / times).cast("int")})
    at = F.concat_ws("/", "asset", F.col("level").cast("string"))  # a level is a raster of its own
    pairs = pairs.withColumn("asset", at).drop("level")
    held = blocks.select(at.alias("asset"), "bx", "by", "values")
    out = reading.read_windows(windows, named, held, keys, kernel, pairs=pairs)
    parts = F.split("asset", "/(?=[^/]*$)")
    return out.withColumns({"level": F.get(parts, F.lit(1)).cast("int"), "asset": F.get(parts, F.lit(0))})


def warped(rasters: DataFrame, blocks: DataFrame, size: int, kernel: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """Rasters in degrees as rasters in metres, in blocks of one size: pixels as wide as at the raster's middle latitude
    along its columns; rasters that are in metres keep their grid.

    Each block of the target is a window of its own, so a warp is a read."""
    right, bottom = F.col("left") + F.col("res") * F.col("width"), F.col("top") - F.col("res") * F.col("height")
    (x0, y0), (x1, y1) = reading._metres(F.col("left"), bottom, F.col("degrees")), reading._metres(right, F.col("top"), F.col("degrees"))
    boxed = rasters.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})
    pixel = (F.col("x1") - F.col("x0")) / F.col("width")
    count = lambda a, b: F.greatest(F.ceil((F.col(a) - F.col(b)) / F.col("new_res") - 1e-9), F.lit(1)).cast("int")
    goal = boxed.withColumn("new_res", pixel).withColumns({"new_width": count("x1", "x0"), "new_height": count("y1", "y0")})
    cells = lambda n: F.sequence(F.lit(0), F.expr(f"({n} - 1) div {size}").cast("int"))
    wanted = goal.withColumn("tx", F.explode(cells("new_width"))).withColumn("ty", F.explode(cells("new_height")))
    cols, rows = F.least(F.lit(size), F.col("new_width") - F.col("tx") * size), F.least(F.lit(size), F.col("new_height") - F.col("ty") * size)
    left, top = F.col("x0") + F.col("tx") * size * F.col("new_res"), F.col("y1") - F.col("ty") * size * F.col("new_res")
    box = {"xmin": left, "ymin": top - rows * F.col("new_res"), "xmax": left + cols * F.col("new_res"), "ymax": top, "cols": cols, "rows": rows}
    pairs = wanted.withColumns(box)
    pixels = reading.read_windows(pairs, rasters, blocks, ("tx", "ty"), kernel, pairs=pairs.select("asset", "tx", "ty", *reading._WINDOW, *reading._RASTER))
    full = pairs.select("asset", "tx", "ty", "cols", "rows")
    places = pixels.groupBy("asset", "tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct((F.col("py") * size + F.col("px")).alias("k"), "value"))).alias("held"))
    values = F.transform(F.sequence(F.lit(0), F.col("cols") * F.col("rows") - 1), lambda i: F.try_element_at("held", (F.floor(i / F.col("cols")) * size + i % F.col("cols")).cast("int")))
    made = full.join(places, ["asset", "tx", "ty"], "left").select("asset", F.col("tx").alias("bx"), F.col("ty").alias("by"), values.alias("values"))
    meta = {"left": F.col("x0"), "top": F.col("y1"), "res": F.col("new_res"), "width": F.col("new_width"), "height": F.col("new_height"), "block": F.lit(size), "degrees": F.lit(False)}
    return goal.select("asset", *(c.alias(n) for n, c in meta.items())), made.withColumn("full", ~F.exists("values", lambda v: v.isNull()))


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def stage(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a stage: read back if the folder's manifest names it, else made, written and entered."""
    manifest, path = f"{folder}/manifest", f"{folder}/{name}"
    entries = _there(spark, manifest)
    if entries is None or entries.where(F.col("stage") == name).isEmpty():
        make().write.mode("overwrite").parquet(path)
        spark.range(1).select(F.lit(name).alias("stage"), F.current_timestamp().alias("made_at")).write.mode("append").parquet(manifest)
    return spark.read.parquet(path)


def prepared(spark: SparkSession, folder: str, rasters: DataFrame, blocks: DataFrame, size: int = 256, kernel: str = "nearest", merging: bool = False) -> tuple[DataFrame, DataFrame]:
    """rasters (in metres) and blocks of all levels, made by stages that a second run finds done.

    Assets that are merged into one raster afterwards (merging) get no overviews of their own."""
    warp = lambda k: warped(rasters, blocks, size, kernel)[k]
    grids = stage(spark, folder, "rasters", lambda: warp(0))
    base = stage(spark, folder, "blocks", lambda: warp(1))
    own = base.select(F.col("asset").cast("string").alias("asset"), F.lit(0).alias("level"), "bx", "by", "values", "full")
    if merging:
        return grids, own
    coarse = stage(spark, folder, "overviews", lambda: overviews(base, grids, size))
    return grids, own.unionByName(coarse)
