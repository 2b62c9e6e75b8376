"""Rules of raster jobs and tile requests, as Columns: nodata lists, bands, read sizes, extents, answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of pyramid requests.
RESAMPLING = ("average", "antialias", "nearest", "bilinear", "cubic", "cubicspline", "lanczos", "min", "max", "med")
PIXEL_SELECTION = ("FirstMethod", "HighestMethod", "LowestMethod", "MeanMethod", "MedianMethod", "StdevMethod", "LastBandHighMethod", "LastBandLowMethod", "CountMethod")
#: Inputs of more bytes than this are written as large, well compressed files: 4 GiB less 300 MiB.
LARGE_BYTES = 4 * 2**30 - 300 * 2**20


def nodata_list(given: Column, own: Column, bands: Column) -> Column:
    """Nodata values: those given as comma-separated text, repeated to the number of bands, else the bands' own that are set."""
    numbers = F.transform(F.split(given, ","), lambda v: v.cast("double"))
    repeated = F.slice(F.flatten(F.array_repeat(numbers, bands)), F.lit(1), bands)
    chosen = F.when(F.size(numbers) < bands, repeated).otherwise(numbers)
    return F.when(given.isNotNull() & (given != ""), chosen).otherwise(F.filter(own, lambda v: v.isNotNull()))


def data_bands(bands: Column, alpha_mask: Column) -> Column:
    """Bands without the alpha band, which a mask tells or a count of two or four."""
    return F.when(alpha_mask | bands.isin(2, 4), bands - 1).otherwise(bands)


def query_size(resampling: Column, tile_size: Column) -> Column:
    """Pixels to read along a side for one tile: as many for nearest, twice for bilinear, four times else."""
    return tile_size * F.when(resampling == "nearest", 1).when(resampling == "bilinear", 2).otherwise(4)


def merge_extent(assets: DataFrame, keys: Sequence[str], size: float | None = None) -> DataFrame:
    """keys, ulx, uly, lrx, lry of the union of assets; with size, borders move outwards to multiples of it."""
    box = assets.groupBy(*keys).agg(F.min("ulx").alias("ulx"), F.max("uly").alias("uly"), F.max("lrx").alias("lrx"), F.min("lry").alias("lry"))
    if size is None:
        return box
    out = {"ulx": F.floor, "uly": F.ceil, "lrx": F.ceil, "lry": F.floor}
    return box.select(*keys, *((f(F.col(n) / size) * F.lit(size)).alias(n) for n, f in out.items()))


def creation(assets: DataFrame, keys: Sequence[str], size: str = "size") -> DataFrame:
    """keys, bytes, big and compress of a merge of files, by their total size."""
    total = assets.groupBy(*keys).agg(F.sum(size).alias("bytes"))
    big = F.col("bytes") > LARGE_BYTES
    return total.withColumns({"big": big, "compress": F.when(big, "LZW").otherwise("PACKBITS")})


def tile_status(z: Column, minzoom: Column, maxzoom: Column, prepared: Column, size: Column) -> Column:
    """The answer to a tile request: 400 beyond the datasource's zooms (all are, where it is unknown) and for an empty
    stored tile, 523 while it is being prepared, 204 without a tile, else 200."""
    outside = minzoom.isNull() | maxzoom.isNull() | (z < minzoom) | (z > maxzoom)
    return F.when(outside, 400).when(~prepared, 523).when(size.isNull(), 204).when(size == 0, 400).otherwise(200)


def pyramid_checks(processors: int) -> dict[str, str]:
    """Name and condition of each error of a pyramid request; null options are left to their defaults."""
    names = lambda values: ", ".join(f"'{v}'" for v in values)
    return {
        "resampling": f"resampling not in ({names(RESAMPLING)})",
        "resampling_warp": f"resampling_warp not in ({names(RESAMPLING)})",
        "tiledriver": "tiledriver <> 'PNG'",
        "tile_size": "tile_size > 512 or tile_size < 128",
        "count_processes": f"count_processes > {processors} or count_processes < 1",
        "zoom": "low < 0 or high > 18",
        "pixel_selection_method": f"pixel_selection_method not in ({names(PIXEL_SELECTION)})",
    }
