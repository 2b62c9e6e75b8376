"""Vector layers and the tile-feature join.

A tile pyramid is not probed tile by tile: every feature's box is turned into the tiles it covers at each
zoom (a generator, no shuffle), so the spatial join is an equi-join key (z, x, y) by construction, and one
grouping makes all tiles of all zooms.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid
from ..plans.filters import BOX, Box, Filters, overlaps

BUFFER, EXTENT, MINZOOM, MAXZOOM = 64, 4096, 0, 20


@dataclass(frozen=True)
class Field:
    """name is used in filters, column in the table; encode puts it into tiles."""

    name: str
    column: str | None = None
    encode: bool = True

    @property
    def physical(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class SqlQuery:
    minzoom: int
    maxzoom: int
    sql: str

    def text(self, zoom: int) -> str:
        return " ".join(self.sql.replace("$zoom", str(zoom)).replace(";", "").split())


@dataclass(frozen=True)
class Layer:
    id: str
    table: str = ""
    minzoom: int = MINZOOM
    maxzoom: int = MAXZOOM
    simplify: bool = False
    filter: list | None = None
    fields: Sequence[Field] = ()
    queries: Sequence[SqlQuery] = ()
    geometry: Sequence[str] = BOX
    functions: Mapping = field(default_factory=dict)

    def at(self, zoom: int) -> bool:
        return self.minzoom <= zoom <= self.maxzoom


def layer_frame(spark: SparkSession, layer: Layer, zoom: int, tables: Mapping[str, DataFrame] | None = None) -> DataFrame | None:
    """Rows of a layer at a zoom, or None where it has none.  A filter counts only if fields are declared."""
    if not layer.at(zoom):
        return None
    if layer.queries:
        active = [spark.sql(q.text(zoom)) for q in layer.queries if q.minzoom <= zoom <= q.maxzoom]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), active) if active else None
    df = tables[layer.table] if tables and layer.table in tables else spark.table(layer.table)
    if not layer.fields:
        return df.select(*layer.geometry)
    if layer.filter:
        df = df.where(Filters({f.name: f.physical for f in layer.fields}, functions=layer.functions).compile(layer.filter))
    return df.select(*layer.geometry, *(F.col(f.physical).alias(f.name) for f in layer.fields if f.encode))


def layers_at(layers: Iterable[Layer], zoom: int) -> list[Layer]:
    return [x for x in layers if x.at(zoom)]


def at_zooms(layers: DataFrame, zooms: Iterable[int]) -> DataFrame:
    """Layers (minzoom, maxzoom) of a table at each zoom where they are drawn."""
    low, high = F.coalesce("minzoom", F.lit(MINZOOM)), F.coalesce("maxzoom", F.lit(MAXZOOM))
    drawn = F.filter(F.array(*(F.lit(int(z)) for z in zooms)), lambda z: (z >= low) & (z <= high))
    return layers.withColumn("z", F.explode(drawn))


def in_tile(df: DataFrame, z: int, x: int, y: int, margin: float = BUFFER / EXTENT) -> DataFrame:
    """Features whose box meets an XYZ tile widened by margin; plain comparisons, so Parquet can skip by them."""
    env = tuple(F.lit(v) for v in envelope(z, x, y, margin))
    return df.where(F.col(BOX[0]).isNotNull() & overlaps(tuple(F.col(c) for c in BOX), env))


def envelope(z: int, x: int, y: int, margin: float = 0.0) -> tuple[float, float, float, float]:
    """Box of a tile, or arrays of them."""
    size = 2 * grid.WORLD_EDGE / 2.0**z
    return size * (x - margin) - grid.WORLD_EDGE, grid.WORLD_EDGE - size * (y + 1 + margin), size * (x + 1 + margin) - grid.WORLD_EDGE, grid.WORLD_EDGE - size * (y - margin)


def tile_cover(df: DataFrame, zooms: Iterable[int], margin: float = 0.0, box: Sequence[str] = BOX, max_tiles: int | None = None, spread: int | None = None) -> DataFrame:
    """df with one row for each XYZ tile (z, x, y) that a feature's box meets.

    Tiles come out of a generator, row by row.  With `spread`, a feature of more tiles than that at a zoom is first
    cut into blocks of 256 columns and rows, which are dealt over all tasks (the table is then read twice).  With
    `max_tiles`, such a feature raises an error."""
    edge = grid.WORLD_EDGE
    z, zooms = F.col("z"), [int(i) for i in zooms]
    x0, y0, x1, y1 = (F.col(c) for c in box)

    def ends(z: Column) -> dict[str, Column]:
        size, last = F.lit(2 * edge) / grid.power_of_two(z), grid.power_of_two(z) - 1
        clamp = lambda c: F.least(F.greatest(F.floor(c).cast("double"), F.lit(0.0)), last).cast("int")
        return {"__x0": clamp((x0 + edge) / size - margin), "__y0": clamp((edge - y1) / size - margin), "__x1": clamp((x1 + edge) / size + margin), "__y1": clamp((edge - y0) / size + margin)}

    def number(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return (x1 - x0 + 1).cast("long") * (y1 - y0 + 1)

    names = ("__x0", "__y0", "__x1", "__y1")
    spanned = lambda rows: rows.withColumn("z", F.explode(F.array(*map(F.lit, zooms)))).withColumns(ends(z))
    spans, tiles = spanned(df.where(x0.isNotNull())), number(*(F.col(n) for n in names))

    def cells(rows: DataFrame) -> DataFrame:
        end = F.col("__x1")
        if max_tiles is not None:
            end = F.when(tiles > max_tiles, F.raise_error(F.concat(F.lit("feature covers too many tiles at zoom "), z.cast("string")))).otherwise(end).cast("int")
        rows = rows.withColumn("x", F.explode(F.sequence("__x0", end))).withColumn("y", F.explode(F.sequence("__y0", "__y1")))
        return rows.drop("__x0", "__y0", "__x1", "__y1")

    if spread is None:
        return cells(spans)
    cut = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b), F.lit(256)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # a number given is not coalesced: the rows are few, what they unroll is not
    # told from the box before the zooms are unrolled, so that no other column of a small feature is made twice
    large = reduce(Column.__or__, (number(*(ends(F.lit(i))[n] for n in names)) > spread for i in zooms), F.lit(False))
    blocks = spanned(df.where(x0.isNotNull() & large)).where(tiles > spread).withColumn("__bx", cut("__x0", "__x1")).withColumn("__by", cut("__y0", "__y1")).repartition(parts, *box, "z", "__bx", "__by")
    within = {"__x0": F.col("__bx"), "__x1": F.least(F.col("__x1"), F.col("__bx") + 255), "__y0": F.col("__by"), "__y1": F.least(F.col("__y1"), F.col("__by") + 255)}
    return cells(spans.where(tiles <= spread)).unionByName(cells(blocks.withColumns(within).drop("__bx", "__by")))


def neighbours(tiles: DataFrame) -> DataFrame:
    """Each tile (z, x, y) with its up to eight neighbours (nx, ny) inside the grid."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy))
    out = tiles.withColumn("__s", F.explode(steps)).withColumns({"nx": F.col("x") + F.col("__s.dx"), "ny": F.col("y") + F.col("__s.dy")}).drop("__s")
    side = grid.power_of_two(F.col("z"))
    return out.where((F.col("nx") >= 0) & (F.col("ny") >= 0) & (F.col("nx") < side) & (F.col("ny") < side))


def layer_counts(df: DataFrame, zooms: Iterable[int], by: Sequence[str] = ()) -> DataFrame:
    """Features by tile: the pyramid's load, with partial sums before the shuffle."""
    return tile_cover(df, zooms).groupBy("z", "x", "y", *by).agg(F.count("*").alias("features"))


def latest_positions(points: DataFrame, device: str, at: str, value: Sequence[str]) -> DataFrame:
    """The last row of each device (ties: the larger values), by a struct maximum that combines before the shuffle."""
    best = F.max(F.struct(F.col(at), *(F.col(v) for v in value))).alias("__last")
    return points.groupBy(device).agg(best).select(device, F.col(f"__last.{at}").alias(at), *(F.col(f"__last.{v}").alias(v) for v in value))


def tracks(points: DataFrame, device: str, at: str, x: str, y: str, window: str) -> DataFrame:
    """Points of a device within each time window in order: start, line (array of points)."""
    item = F.struct(F.col(at).alias("at"), F.col(x).alias("x"), F.col(y).alias("y"))
    out = points.groupBy(device, F.window(at, window).alias("__w")).agg(F.array_sort(F.collect_list(item)).alias("line"))
    return out.select(device, F.col("__w.start").alias("start"), F.transform("line", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("line"))


def box_columns(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Points as boxes without extent."""
    return df.withColumns({"xmin": x, "ymin": y, "xmax": x, "ymax": y})


__all__ = ["Box", "Field", "Layer", "SqlQuery"]
