"""Queries of the raster read path: embeddings are the blocks, 8 x 8, of seven rasters that overlap on the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid
from ..operators import reading
from ..sources.derived import view
from .registry import milli, milli_sql, query, real

c = F.col
SIZE, ZOOMS = 16, (10, 12)
_PIXELS = {"asset": "cast(asset_ord % 7 as int)", "px": "cast(floor(asset_ord / 7) % 8 * 8 + px as int)", "py": "cast(floor(floor(asset_ord / 7) / 8) * 8 + py as int)", "iv": "iv"}
_METRES = {"left": "-9000000.0 + asset * 20000.0", "top": "6000000.0 - asset * 15000.0", "res": "1000.0 + asset * 37.0"}
_DEGREES = {"left": "-80.0 + asset * 0.2", "top": "48.0 - asset * 0.13", "res": "0.01 + asset * 0.0007"}


def _source(spark, sf_dir, degrees=False):
    """rasters, blocks and the tiles that cover the rasters at two zooms."""
    pixels = view(spark, sf_dir, "fx_pixels").selectExpr(*(f"{e} as {n}" for n, e in _PIXELS.items()))
    placed = {n: F.expr(e).cast("double") for n, e in (_DEGREES if degrees else _METRES).items()}
    rasters = pixels.groupBy("asset").agg((F.max("py") + 1).alias("height")).withColumns({**placed, "width": F.lit(64), "block": F.lit(8), "degrees": F.lit(degrees), "asset_ord": c("asset")})
    ends = (c("left") + c("res") * c("width"), c("top") - c("res") * c("height"))
    if degrees:
        (x0, y0), (x1, y1) = grid.lonlat_to_meters(c("left"), ends[1]), grid.lonlat_to_meters(ends[0], c("top"))
    else:
        x0, y0, x1, y1 = c("left"), ends[1], ends[0], c("top")
    sized = rasters.select(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.explode(F.array(*(F.lit(z) for z in ZOOMS))).alias("z"))
    side = F.lit(2 * grid.WORLD_EDGE) / grid.power_of_two(c("z"))
    span = lambda a, b: F.explode(F.sequence(F.floor(a / side).cast("int"), F.floor(b / side).cast("int")))
    tiles = sized.withColumn("x", span(c("x0") + grid.WORLD_EDGE, c("x1") + grid.WORLD_EDGE)).withColumn("y", span(grid.WORLD_EDGE - c("y1"), grid.WORLD_EDGE - c("y0"))).select("z", "x", "y").distinct()
    return rasters, reading.as_blocks(pixels, 8, "iv"), tiles


def _sql(degrees=False):
    """Common tables: rp (pixels), r (rasters), tiles, p (places of each tile's pixels on each raster)."""
    edge, shift = real(grid.WORLD_EDGE), real(grid.ORIGIN_SHIFT)
    placed = ", ".join(f"cast({e} as double) as \"{n}\"" for n, e in (_DEGREES if degrees else _METRES).items())
    x0, x1, y0, y1 = '"left"', '"left" + res * 64', "top - res * height", "top"
    if degrees:
        x0, x1 = (f"({v}) * {shift} / 180.0" for v in (x0, x1))
        y0, y1 = (f"ln(tan((90 + ({v})) * pi() / 360.0)) / (pi() / 180.0) * {shift} / 180.0" for v in (y0, y1))
    sx = f"(({{}}) * (180.0 / {shift}) - \"left\") / res" if degrees else "(({}) - \"left\") / res"
    sy = f"(top - 180 / pi() * (2 * atan(exp(({{}}) / {shift} * pi())) - pi() / 2.0)) / res" if degrees else "(top - ({})) / res"
    mx, my = (lambda d: f"xmin + (xmax - xmin) * (px + {d}) / {SIZE}"), (lambda d: f"ymax + (ymin - ymax) * (py + {d}) / {SIZE}")
    snap = lambda e: f"floor(({e}) * {reading.SNAP} + 0.5) / {reading.SNAP}"
    return f"""with rp as (select {', '.join(f'{e} as {n}' for n, e in _PIXELS.items())} from fx_pixels),
r as (select asset, height, {placed} from (select asset, max(py) + 1 as height from rp group by asset)),
tiles as (select distinct z, cast(x as int) as x, cast(y as int) as y from (select z, {x0} as x0, {x1} as x1, {y0} as y0, {y1} as y1, 2 * {edge} / pow(2.0, z) as side from r, (values {', '.join(f'({z})' for z in ZOOMS)}) zs(z)),
  unnest(range(cast(floor((x0 + {edge}) / side) as bigint), cast(floor((x1 + {edge}) / side) as bigint) + 1)) a(x), unnest(range(cast(floor(({edge} - y1) / side) as bigint), cast(floor(({edge} - y0) / side) as bigint) + 1)) b(y)),
boxes as (select z, x, y, side * x - {edge} as xmin, {edge} - side * (y + 1) as ymin, side * (x + 1) - {edge} as xmax, {edge} - side * y as ymax from (select *, 2 * {edge} / pow(2.0, z) as side from (select * from tiles union select z, x + i, y + j from tiles, range(-1, 2) i(i), range(-1, 2) j(j)))),
places as (select z, x, y, asset, height, cast(a.px as int) as px, cast(b.py as int) as py, {snap(sx.format(mx('0.5')))} as sx, {snap(sy.format(my('0.5')))} as sy,
  abs({sx.format(mx(1))} - {sx.format(mx(0))}) as wx, abs({sy.format(my(1))} - {sy.format(my(0))}) as wy from boxes, r, range({SIZE}) a(px), range({SIZE}) b(py)),
around as (select * exclude (height) from places where sx >= 0 and sx < 64 and sy >= 0 and sy < height),
p as (select around.* from around semi join tiles on around.z = tiles.z and around.x = tiles.x and around.y = tiles.y)"""


_NEAREST = "select p.z, p.x, p.y, p.asset, p.px, p.py, cast(rp.iv as double) as value from {} p join rp on rp.asset = p.asset and rp.px = floor(sx) and rp.py = floor(sy) where rp.iv is not null"
_TENT = "greatest(0.0, 1 - abs({0} + 0.5 - s{1}) / greatest(1.0, w{1}))"
_COVER = "greatest(0.0, least(s{1} + w{1} / 2, {0} + 1) - greatest(s{1} - w{1} / 2, {0}))"
_TAPS = """, taps as (select p.*, j, i from p, unnest(range(cast(floor(sx - greatest(1.0, wx) - 1) as bigint), cast(ceil(sx + greatest(1.0, wx) + 1) as bigint))) a(j),
  unnest(range(cast(floor(sy - greatest(1.0, wy) - 1) as bigint), cast(ceil(sy + greatest(1.0, wy) + 1) as bigint))) b(i)),
weighed as (select z, x, y, taps.asset, taps.px, taps.py, {wx} * {wy} as w, iv from taps join rp on rp.asset = taps.asset and rp.px = j and rp.py = i where iv is not null)
select z, x, y, asset, px, py, {value} as value from weighed where w > 0 group by z, x, y, asset, px, py having sum(w) > 1e-9"""


def _weighed(weight, value="sum(w * iv) / sum(w)", scale=100):
    return _TAPS.format(wx=weight.format("j", "x"), wy=weight.format("i", "y"), value=milli_sql(value, scale) if scale else value)


def _read(name, kernel, tail, degrees=False, scale=100):
    @query(_sql(degrees) + tail, name=name)
    def run(spark, sf_dir):
        rasters, blocks, tiles = _source(spark, sf_dir, degrees)
        out = reading.read_tiles(tiles, rasters, blocks, SIZE, kernel)
        return out.withColumn("value", milli(c("value"), scale)) if scale else out


_read("read_tiles_nearest", "nearest", " " + _NEAREST.format("p"), scale=None)
_read("read_tiles_bilinear", "bilinear", _weighed(_TENT))
_read("read_tiles_average", "average", _weighed(_COVER))
_read("read_tiles_rms", "rms", _weighed(_COVER, "sqrt(sum(w * iv * iv) / sum(w))"))
_read("read_tiles_max", "max", _weighed(_COVER, "cast(max(iv) as double)", None), scale=None)
_read("warp_degrees_nearest", "nearest", " " + _NEAREST.format("p"), degrees=True, scale=None)
_read("warp_degrees_bilinear", "bilinear", _weighed(_TENT), degrees=True)


@query(_sql() + f""", near as ({_NEAREST.format('around')})
select t.z, t.x, t.y, n.x as tile_x, n.y as tile_y, n.asset, n.px, n.py, n.value from tiles t join near n on n.z = t.z and n.x between t.x - 1 and t.x + 1 and n.y between t.y - 1 and t.y + 1""")
def read_meta_tiles(spark, sf_dir):
    rasters, blocks, tiles = _source(spark, sf_dir)
    return reading.read_meta_tiles(tiles, rasters, blocks, SIZE)


def _mosaic(name, method, sql, exact=True):
    @query(_sql() + f", near as ({_NEAREST.format('p')}) select z, x, y, px, py, {sql if exact else milli_sql(sql)} as value from near group by z, x, y, px, py", name=name)
    def run(spark, sf_dir):
        rasters, blocks, tiles = _source(spark, sf_dir)
        out = reading.mosaic_tiles(tiles, rasters, blocks, method, SIZE)
        return out if exact else out.withColumn("value", milli(c("value")))


_mosaic("mosaic_tiles_first", "first", "arg_min(value, asset)")
_mosaic("mosaic_tiles_mean", "mean", "cast(sum(cast(value as bigint)) as double) / count(value)", exact=False)
_mosaic("mosaic_tiles_highest", "highest", "max(value)")

_POINTS = {"id": "event_id", "mx": "-9000000.0 + event_id * 7919 % 150000", "my": "6000000.0 - event_id * 104729 % 130000"}
_AT = f"""{_sql()}, points as (select {', '.join(f'cast({e} as {"bigint" if n == "id" else "double"}) as {n}' for n, e in _POINTS.items())} from events),
at_points as (select id, asset, floor(floor((mx - "left") / res * {reading.SNAP} + 0.5) / {reading.SNAP}) as px, floor(floor((top - my) / res * {reading.SNAP} + 0.5) / {reading.SNAP}) as py from points, r
  where mx >= "left" and mx < "left" + res * 64 and my <= top and my > top - res * height)"""


def _points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*(f"cast({e} as {'bigint' if n == 'id' else 'double'}) as {n}" for n, e in _POINTS.items()))


@query(f"{_AT} select id, a.asset, cast(rp.iv as double) as value from at_points a left join rp on rp.asset = a.asset and rp.px = a.px and rp.py = a.py")
def read_points(spark, sf_dir):
    rasters, blocks, _ = _source(spark, sf_dir)
    return reading.read_points(_points(spark, sf_dir), rasters, blocks, ("id",))


@query(f"{_AT} select id, arg_min(cast(rp.iv as double), a.asset) as value from at_points a left join rp on rp.asset = a.asset and rp.px = a.px and rp.py = a.py group by id")
def mosaic_points_first(spark, sf_dir):
    rasters, blocks, _ = _source(spark, sf_dir)
    return reading.mosaic_points(_points(spark, sf_dir), rasters, blocks, ("id",))


_DEEP = 10  # levels the oracle writes out: rasters of up to 2^10 blocks
_LEVELS = f"""with rp as (select {', '.join(f'{e} as {n}' for n, e in _PIXELS.items())} from fx_pixels),
sizes as (select asset, greatest(cast(ceil(log2(greatest(64 // 8, (max(py) + 1) // 8, 1))) as int), 0) as levels from rp group by asset),
l0 as (select asset, px, py, cast(iv as double) as v from rp),
{', '.join(f'l{k} as (select l.asset, l.px // 2 as px, l.py // 2 as py, avg(l.v) as v from l{k - 1} l join sizes s on s.asset = l.asset and s.levels >= {k} group by 1, 2, 3)' for k in range(1, _DEEP + 1))}
select cast(asset as varchar) as asset, level, cast(px as int) as px, cast(py as int) as py, {milli_sql('v + 1e-6', 100)} as value from ({' union all '.join(f'select {k} as level, * from l{k}' for k in range(1, _DEEP + 1))}) where v is not null"""


@query(_LEVELS)
def overview_levels_all(spark, sf_dir):
    from ..operators import preparing

    rasters, blocks, _ = _source(spark, sf_dir)
    made = preparing.overviews(blocks, rasters, 8)
    wide = made.join(preparing.levels_of(rasters, 8).select(c("asset").cast("string").alias("asset"), "level", "width"), ["asset", "level"])
    cells = wide.select("asset", "level", "bx", "by", F.least(F.lit(8), c("width") - c("bx") * 8).alias("w"), F.posexplode("values").alias("i", "v")).where("v is not null")
    return cells.select("asset", "level", (c("bx") * 8 + c("i") % c("w")).alias("px"), (c("by") * 8 + F.expr("i div w").cast("int")).alias("py"), milli(c("v") + 1e-6, 100).alias("value"))  # means of thirds lie on the rounding border


_FILES = f"""with rp as (select {', '.join(f'{e} as {n}' for n, e in _PIXELS.items())} from fx_pixels)
"""


def _written(spark, sf_dir):
    """The rasters of _source() as files in blocks of 16 pixels: folder and what was written."""
    from ..sources import raster_files, tile_files

    pixels = view(spark, sf_dir, "fx_pixels").selectExpr(*(f"{e} as {n}" for n, e in _PIXELS.items()))
    rasters, _, _ = _source(spark, sf_dir)
    grid_ = rasters.select("asset", F.explode(F.sequence(F.lit(0), c("height") - 1)).alias("py")).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(63))))
    whole = grid_.join(pixels, ["asset", "px", "py"], "left")
    blocks = reading.as_blocks(whole, 16, "iv")
    meta = rasters.withColumns({"bands": F.lit(1), "nodata": F.lit(-99999.0)})
    folder = tile_files.shared_folder(spark)
    raster_files.write_blocks(blocks.withColumn("asset", c("asset").cast("string")), meta.withColumn("asset", c("asset").cast("string")), folder, 16)
    return folder


@query(_FILES + "select asset || '.tif' as asset, px, py, cast(iv as double) as value from rp where iv is not null")
def raster_files_read(spark, sf_dir):
    from ..sources import raster_files

    blocks = raster_files.read_blocks(spark, _written(spark, sf_dir), 32)
    cells = blocks.select("asset", "bx", "by", F.posexplode("values").alias("i", "value")).where("value is not null")
    wide = F.least(F.lit(32), F.lit(64) - c("bx") * 32)
    return cells.select("asset", (c("bx") * 32 + c("i") % wide).alias("px"), (c("by") * 32 + F.floor(c("i") / wide).cast("int")).alias("py"), "value")


@query(_FILES + """select asset || '.tif' as asset, 64 as width, max(py) + 1 as height, 1 as bands, 'float64' as dtype, -9000000.0 + asset * 20000.0 as "left", 6000000.0 - asset * 15000.0 as top, 1000.0 + asset * 37.0 as res, false as degrees, cast(-99999 as double) as nodata, false as alpha, 256 as block from rp group by asset""")
def raster_files_metadata(spark, sf_dir):
    from ..sources import raster_files

    return raster_files.read_metadata(spark, _written(spark, sf_dir)).drop("path", "bytes")
