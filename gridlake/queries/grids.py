"""Queries of the tile-grid algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid
from ..operators import raster
from ..operators.vector import neighbours, tile_cover
from ..sources.derived import view
from .registry import at_zooms, milli, milli_sql, query, real, zooms_sql

O, RES, EDGE = real(grid.ORIGIN_SHIFT), real(grid.mercator_resolutions()[0]), real(grid.WORLD_EDGE)
TX = f"cast(ceil((mx + {O}) / ({RES} / pow(2.0, z)) / 256) - 1 as int)"
TY = f"cast(ceil((my + {O}) / ({RES} / pow(2.0, z)) / 256) - 1 as int)"
c = F.col


def _tiles(spark, sf_dir, *zooms):
    return at_zooms(view(spark, sf_dir, "fx_points_m"), *zooms).select("id", "z", *(t.alias(n) for t, n in zip(grid.meters_to_tile(c("mx"), c("my"), c("z")), ("tx", "ty"))))


def _tiles_sql(*zooms):
    return f"(select id, z, {TX} as tx, {TY} as ty from fx_points_m, {zooms_sql(*zooms)})"


@query(f"select id, {milli_sql(f'lng * {O} / 180')} as mx_mm, {milli_sql(f'ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * {O} / 180')} as my_mm from fx_points")
def latlon_to_meters(spark, sf_dir):
    mx, my = grid.lonlat_to_meters(c("lng"), c("lat"))
    return view(spark, sf_dir, "fx_points").select("id", milli(mx).alias("mx_mm"), milli(my).alias("my_mm"))


@query(f"select id, {milli_sql(f'mx / {O} * 180', 10**7)} as lon_e7, {milli_sql(f'180 / pi() * (2 * atan(exp(my / {O} * 180 * pi() / 180)) - pi() / 2)', 10**7)} as lat_e7 from fx_points_m")
def meters_to_latlon(spark, sf_dir):
    lon, lat = grid.meters_to_lonlat(c("mx"), c("my"))
    return view(spark, sf_dir, "fx_points_m").select("id", milli(lon, 10**7).alias("lon_e7"), milli(lat, 10**7).alias("lat_e7"))


@query(f"select id, z, tx, ty from {_tiles_sql(0, 5, 11, 18)}")
def meters_to_tile(spark, sf_dir):
    return _tiles(spark, sf_dir, 0, 5, 11, 18)


@query(f"select id, z, {milli_sql(f'(mx + {O}) / ({RES} / pow(2.0, z))')} as px, {milli_sql(f'256 * pow(2.0, z) - (my + {O}) / ({RES} / pow(2.0, z))')} as py from fx_points_m, {zooms_sql(0, 7)}")
def meters_to_raster_pixels(spark, sf_dir):
    px, py = grid.pixels_to_raster(*grid.meters_to_pixels(c("mx"), c("my"), c("z")), c("z"))
    return at_zooms(view(spark, sf_dir, "fx_points_m"), 0, 7).select("id", "z", milli(px).alias("px"), milli(py).alias("py"))


_BOUNDS = [f"(t{a} + {d}) * 256 * ({RES} / pow(2.0, z)) - {O}" for d in (0, 1) for a in "xy"]


@query(f"select distinct z, tx, ty, {', '.join(f'{milli_sql(b)} as {n}' for b, n in zip(_BOUNDS, ('minx', 'miny', 'maxx', 'maxy')))} from {_tiles_sql(3, 9)}")
def tile_bounds(spark, sf_dir):
    t = _tiles(spark, sf_dir, 3, 9).select("z", "tx", "ty").distinct()
    return t.select("z", "tx", "ty", *(milli(b).alias(n) for b, n in zip(grid.tile_bounds(c("tx"), c("ty"), c("z")), ("minx", "miny", "maxx", "maxy"))))


_LAT = [f"180 / pi() * (2 * atan(exp(({b}) / {O} * 180 * pi() / 180)) - pi() / 2)" for b in (_BOUNDS[1], _BOUNDS[3])]
_LON = [f"({b}) / {O} * 180" for b in (_BOUNDS[0], _BOUNDS[2])]


@query(f"select distinct z, tx, ty, {milli_sql(_LAT[0], 10**7)} as s, {milli_sql(_LON[0], 10**7)} as w, {milli_sql(_LAT[1], 10**7)} as n, {milli_sql(_LON[1], 10**7)} as e from {_tiles_sql(3, 9)}")
def tile_latlon_bounds(spark, sf_dir):
    t = _tiles(spark, sf_dir, 3, 9).select("z", "tx", "ty").distinct()
    return t.select("z", "tx", "ty", *(milli(b, 10**7).alias(n) for b, n in zip(grid.tile_lonlat_bounds(c("tx"), c("ty"), c("z")), "swne")))


@query(f"""select id, z, coalesce(array_to_string(list_transform(range(z - 1, -1, -1), lambda i: cast(((tx >> i) & 1) + 2 * (((cast(pow(2, z) as int) - 1 - ty) >> i) & 1) as varchar)), ''), '') as quadkey
from {_tiles_sql(0, 5, 11)} where tx >= 0 and ty >= 0""")
def quadkey(spark, sf_dir):
    return _tiles(spark, sf_dir, 0, 5, 11).where("tx >= 0 and ty >= 0").select("id", "z", grid.quadkey(c("tx"), c("ty"), c("z")).alias("quadkey"))


@query(f"select id, z, tx, cast(pow(2, z) - 1 - ty as int) as y from {_tiles_sql(5, 11)}")
def xyz_flip(spark, sf_dir):
    return _tiles(spark, sf_dir, 5, 11).select("id", "z", "tx", grid.flip_y(c("ty"), c("z")).alias("y"))


_ZOOM = lambda size: "cast(case " + " ".join(f"when {size} > {real(r)} then {max(i - 1, 0)}" for i, r in enumerate(grid.mercator_resolutions())) + " end as int)"


@query(f"select o_orderkey, {_ZOOM('size')} as zoom from (select o_orderkey, cast(o_totalprice as double) / (1 + o_orderkey % 100000) as size from orders)")
def zoom_for_pixel_size(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    size = c("o_totalprice").cast("double") / (1 + c("o_orderkey") % 100000)
    return orders.select("o_orderkey", grid.zoom_for_pixel_size(size, grid.mercator_resolutions()).alias("zoom"))


@query(f"select id, cast(id % 19 as int) as z, {milli_sql(f'{RES} / pow(2.0, id % 19)', 10**6)} as mercator, {milli_sql(f'{real(180 / 256)} / pow(2.0, id % 19)', 10**9)} as geodetic from fx_rasters")
def resolution(spark, sf_dir):
    z = view(spark, sf_dir, "fx_rasters").select("id", (c("id") % 19).cast("int").alias("z"))
    return z.select("id", "z", milli(grid.resolution(c("z")), 10**6).alias("mercator"), milli(grid.geodetic_resolution(c("z")), 10**9).alias("geodetic"))


_GEO = lambda axis, shift, f: f"cast(ceil(({shift} + {axis}) / ({real(f / 256)} / pow(2.0, z)) / 256) - 1 as int)"


@query(f"select id, z, {_GEO('lng', 180, 180.0)} as tx, {_GEO('lat', 90, 180.0)} as ty, {_GEO('lng', 180, 360.0)} as wx, {_GEO('lat', 90, 360.0)} as wy from fx_points, {zooms_sql(0, 4, 10)}")
def geodetic_tile(spark, sf_dir):
    p = at_zooms(view(spark, sf_dir, "fx_points"), 0, 4, 10)
    tms, wmts = (grid.lonlat_to_geodetic_tile(c("lng"), c("lat"), c("z"), tms=t) for t in (True, False))
    return p.select("id", "z", tms[0].alias("tx"), tms[1].alias("ty"), wmts[0].alias("wx"), wmts[1].alias("wy"))


_CLAMP = lambda axis, what: f"cast(least(greatest(ceil(({what} + {O}) / ({RES} / pow(2.0, z)) / 256) - 1, 0), pow(2, z) - 1) as int)"


@query(f"""with b as (select place, min(mx) as x0, max(mx) as x1, min(my) as y0, max(my) as y1 from fx_points_m group by place)
select place, cast(z as int) as z, {_CLAMP('x', 'x0')} as tminx, {_CLAMP('x', 'x1')} as tmaxx, {_CLAMP('y', 'y0')} as tminy, {_CLAMP('y', 'y1')} as tmaxy from b, range(0, 19) t(z)""")
def tile_range_by_zoom(spark, sf_dir):
    b = view(spark, sf_dir, "fx_points_m").groupBy("place").agg(F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1"))
    b = at_zooms(b, *range(grid.MAX_ZOOM))
    last = (grid.power_of_two(c("z")) - 1).cast("int")
    low, high = grid.meters_to_tile(c("x0"), c("y0"), c("z")), grid.meters_to_tile(c("x1"), c("y1"), c("z"))
    held = lambda t: F.least(F.greatest(t, F.lit(0)), last)
    return b.select("place", "z", held(low[0]).alias("tminx"), held(high[0]).alias("tmaxx"), held(low[1]).alias("tminy"), held(high[1]).alias("tmaxy"))


_NATIVE = "cast(greatest(ceil(log2(xsize / 256.0)), ceil(log2(ysize / 256.0))) as int)"
_RANGES = f"(select id, xsize, ysize, native, cast(z as int) as z, cast(ceil(xsize / (pow(2.0, native - z) * 256)) - 1 as int) as tmaxx, cast(ceil(ysize / (pow(2.0, native - z) * 256)) - 1 as int) as tmaxy from (select *, {_NATIVE} as native from fx_rasters) r, range(0, 19) t(z) where z <= native)"


def _ranges(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters").withColumn("native", grid.native_zoom(c("xsize"), c("ysize")))
    r = r.withColumn("z", F.explode(F.expr("case when native >= 0 then sequence(0, native) else array() end")))
    span = grid.raster_tile_span(c("z"), c("native"))
    return r.withColumns({"tmaxx": (F.ceil(c("xsize") / span) - 1).cast("int"), "tmaxy": (F.ceil(c("ysize") / span) - 1).cast("int")})


@query(f"select id, native, z, tmaxx, tmaxy from {_RANGES}")
def raster_profile_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir).select("id", "native", "z", "tmaxx", "tmaxy")


@query(f"select id, cast(sum((1 + tmaxx) * (1 + tmaxy)) as bigint) as tiles from {_RANGES} where z < native group by id")
def overview_tile_count(spark, sf_dir):
    return _ranges(spark, sf_dir).where("z < native").groupBy("id").agg(F.sum((1 + c("tmaxx")) * (1 + c("tmaxy"))).cast("long").alias("tiles"))


@query(f"select id, z, cast(unnest(case when tmaxx <= 0 then [tmaxx] else list_concat(range(0, tmaxx, 3), [tmaxx]) end) as int) as tx from {_RANGES}")
def stride3_plan(spark, sf_dir):
    return _ranges(spark, sf_dir).select("id", "z", F.explode(grid.stride(F.lit(0), c("tmaxx"))).alias("tx"))


@query(f"select id, z, cast(unnest(case when tmaxy <= -1 then [-1] else list_concat(range(tmaxy, -1, -3), [-1]) end) as int) as ty from {_RANGES}")
def stride3_plan_down(spark, sf_dir):
    return _ranges(spark, sf_dir).select("id", "z", F.explode(grid.stride_down(c("tmaxy"), F.lit(-1))).alias("ty"))


@query("""select id, cast(n as int) as n_levels, coalesce(array_to_string(list_transform(range(1, cast(n as bigint) + 1), lambda i: cast(cast(pow(2, i) as int) as varchar)), ','), '') as levels
from (select id, ceil(log2(greatest(floor(xsize / 256.0), floor(ysize / 256.0), 1))) as n from fx_rasters)""")
def overview_levels(spark, sf_dir):
    levels = grid.overview_levels(c("xsize"), c("ysize"))
    return view(spark, sf_dir, "fx_rasters").select("id", F.size(levels).alias("n_levels"), F.array_join(levels.cast("array<string>"), ",").alias("levels"))


@query(f"select id, {_ZOOM('px * greatest(xsize, ysize) / 256')} as minz, {_ZOOM('px')} as maxz from fx_rasters")
def raster_zoom_limits(spark, sf_dir):
    res = grid.mercator_resolutions()
    return view(spark, sf_dir, "fx_rasters").select("id", grid.zoom_for_pixel_size(c("px") * F.greatest("xsize", "ysize") / 256, res).alias("minz"), grid.zoom_for_pixel_size(c("px"), res).alias("maxz"))


_WINDOWS = "(select id, xsize as size, cast((id * 37) % (xsize + 600) - 300 as int) as r0, cast(100 + (id * 13) % 700 as int) as len from fx_rasters)"


@query(f"""with a as (select *, greatest(-r0, 0) / cast(len as double) as low from {_WINDOWS}),
b as (select *, cast(trunc(512 * low) as int) as w, len - cast(trunc(len * low) as int) as rl, greatest(r0, 0) as r from a)
select id, r, case when r + rl > size then size - r else rl end as r_size, w, case when r + rl > size then cast(trunc((512 - w) * (cast(size - r as double) / rl)) as int) else 512 - w end as w_size from b""")
def geo_query_windows(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters").select("id", "xsize", ((c("id") * 37) % (c("xsize") + 600) - 300).cast("int").alias("r0"), (100 + (c("id") * 13) % 700).cast("int").alias("len"))
    return r.select("id", *(w.alias(n) for w, n in zip(grid.read_window(c("r0"), c("len"), c("xsize"), 512), ("r", "r_size", "w", "w_size"))))


@query(f"""select id, z, cast(tmaxx * span as int) as rx, cast(case when xsize % span = 0 then span else xsize % span end as int) as rxsize,
cast(trunc(case when xsize % span = 0 then 1.0 else cast(xsize % span as double) / span end * 256) as int) as wxsize
from (select *, cast(ceil(pow(2.0, native - z) * 256) as int) as span from {_RANGES})""")
def raster_edge_windows(spark, sf_dir):
    r = _ranges(spark, sf_dir).withColumn("span", F.ceil(grid.raster_tile_span(c("z"), c("native"))).cast("int"))
    rest = F.when(c("xsize") % c("span") == 0, c("span")).otherwise(c("xsize") % c("span"))
    return r.select("id", "z", (c("tmaxx") * c("span")).cast("int").alias("rx"), rest.cast("int").alias("rxsize"), (rest / c("span").cast("double") * 256).cast("int").alias("wxsize"))


@query("""with p as (select req_id, string_split(path, '/') as parts from fx_requests),
q as (select req_id, parts[4] as ds, try_cast(parts[5] as int) as z, try_cast(parts[6] as int) as x, try_cast(string_split(parts[7], '.')[1] as int) as y, lower(string_split(parts[7], '.')[2]) as ext from p),
r as (select *, coalesce(ext in ('png', 'mvt', 'pbf') and z between 0 and 255 and x >= 0 and y >= 0, false) as ok from q)
select req_id, ok, case when ok then ds end as datasource, case when ok then z end as z, case when ok then x end as x, case when ok then y end as y, case when ok then ext end as ext from r""")
def uri_parse(spark, sf_dir):
    from ..operators.store import parse_request

    return view(spark, sf_dir, "fx_requests").select("req_id", *(v.alias(k) for k, v in parse_request(c("path")).items()))


_ENV = [f"2 * {EDGE} / pow(2.0, z) * (x) - {EDGE}", f"{EDGE} - 2 * {EDGE} / pow(2.0, z) * (y + 1)", f"2 * {EDGE} / pow(2.0, z) * (x + 1) - {EDGE}", f"{EDGE} - 2 * {EDGE} / pow(2.0, z) * (y)"]


@query(f"select distinct z, x, y, {', '.join(f'{milli_sql(b)} as {n}' for b, n in zip(_ENV, ('xmin', 'ymin', 'xmax', 'ymax')))} from (select z, tx as x, cast(pow(2, z) - 1 - ty as int) as y from {_tiles_sql(5, 8)})")
def tile_envelope(spark, sf_dir):
    t = _tiles(spark, sf_dir, 5, 8).select("z", c("tx").alias("x"), grid.flip_y(c("ty"), c("z")).alias("y")).distinct()
    return t.select("z", "x", "y", *(milli(b).alias(n) for b, n in zip(grid.tile_envelope(c("x"), c("y"), c("z")), ("xmin", "ymin", "xmax", "ymax"))))


@query(f"select id, z, {milli_sql(f'case when z > 11 then {real(40075016.68557849)} / (4096 * pow(2.0, z)) else 6378137 * 2 * pi() / pow(2.0, z + 8) end', 10**6)} as micro from (select id, cast(id % 21 as int) as z from fx_polygons)")
def simplify_tolerance(spark, sf_dir):
    z = view(spark, sf_dir, "fx_polygons").select("id", (c("id") % 21).cast("int").alias("z"))
    return z.select("id", "z", milli(grid.simplify_tolerance(c("z")), 10**6).alias("micro"))


@query(f"select id, cast(i as int) as vertex, {milli_sql('xmin + (xmax - xmin) / 4.0 * i')} as x, {milli_sql('ymin + (ymax - ymin) / 4.0 * i')} as y from fx_polygons, range(0, 5) u(i)")
def densified_bounds(spark, sf_dir):
    p = view(spark, sf_dir, "fx_polygons")
    both = p.select("id", grid.densified_edge(c("xmin"), c("xmax")).alias("xs"), grid.densified_edge(c("ymin"), c("ymax")).alias("ys"))
    return both.select("id", F.posexplode(F.arrays_zip("xs", "ys")).alias("vertex", "v")).select("id", "vertex", milli(c("v.xs")).alias("x"), milli(c("v.ys")).alias("y"))


_SPAN = lambda v: f"cast(least(greatest(floor(({v}) / (2 * {EDGE} / pow(2.0, z))), 0), pow(2, z) - 1) as int)"
COVER_SQL = lambda zooms: f"""(select id, landuse, building, z, x, cast(unnest(range(y0, y1 + 1)) as int) as y from (
  select *, cast(unnest(range(x0, x1 + 1)) as int) as x from (
    select id, landuse, building, z, {_SPAN(f'xmin + {EDGE}')} as x0, {_SPAN(f'xmax + {EDGE}')} as x1, {_SPAN(f'{EDGE} - ymax')} as y0, {_SPAN(f'{EDGE} - ymin')} as y1
    from fx_polygons, {zooms_sql(*zooms)})))"""  # noqa: E731


@query(f"select id, z, x, y from {COVER_SQL((0, 2, 5, 9))}", name="tile_cover")
def tile_cover_query(spark, sf_dir):
    return tile_cover(view(spark, sf_dir, "fx_polygons"), (0, 2, 5, 9)).select("id", "z", "x", "y")


@query(f"""with t as (select distinct z, tx as x, cast(pow(2, z) - 1 - ty as int) as y from {_tiles_sql(1, 5)} where tx >= 0 and ty >= 0)
select z, x, y, cast(x + dx as int) as nx, cast(y + dy as int) as ny from t, range(-1, 2) a(dx), range(-1, 2) b(dy)
where (dx <> 0 or dy <> 0) and x + dx between 0 and pow(2, z) - 1 and y + dy between 0 and pow(2, z) - 1""")
def neighbors(spark, sf_dir):
    t = _tiles(spark, sf_dir, 1, 5).where("tx >= 0 and ty >= 0").select("z", c("tx").alias("x"), grid.flip_y(c("ty"), c("z")).alias("y")).distinct()
    return neighbours(t)


_BOX = "select id, ulx as minx, uly - ysize * px as miny, ulx + xsize * px as maxx, uly as maxy from fx_rasters"


@query(_BOX)
def output_bounds(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters").withColumn("gt", F.array(c("ulx"), c("px"), F.lit(0.0), c("uly"), F.lit(0.0), -c("px")))
    return r.select("id", *(v.alias(n) for v, n in zip(grid.bounds_of_geotransform(c("gt"), c("xsize"), c("ysize")), ("minx", "miny", "maxx", "maxy"))))


_GRES = "(180.0::double / 256 / pow(2.0, z))"
_GCLAMP = lambda v, shift, top: f"cast(least(greatest(ceil(({shift} + {v}) / {_GRES} / 256) - 1, 0), {top}) as int)"


@query(f"""with b as (select place, min(lng) as x0, max(lng) as x1, min(lat) as y0, max(lat) as y1 from fx_points group by place)
select place, cast(z as int) as z, cast(greatest(ceil((180 + x0) / {_GRES} / 256) - 1, 0) as int) as tminx, cast(greatest(ceil((90 + y0) / {_GRES} / 256) - 1, 0) as int) as tminy,
  cast(least(ceil((180 + x1) / {_GRES} / 256) - 1, pow(2, z + 1) - 1) as int) as tmaxx, cast(least(ceil((90 + y1) / {_GRES} / 256) - 1, pow(2, z) - 1) as int) as tmaxy from b, range(0, 19) t(z)""")
def geodetic_range_by_zoom(spark, sf_dir):
    b = view(spark, sf_dir, "fx_points").groupBy("place").agg(F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    ranges = grid.geodetic_tile_range(c("x0"), c("y0"), c("x1"), c("y1"), c("z"))
    return at_zooms(b, *range(19)).select("place", "z", *(v.alias(n) for v, n in zip(ranges, ("tminx", "tminy", "tmaxx", "tmaxy"))))


_M = f"select id, xsize, ysize, px, ulx * 100 as minx, (uly - ysize * px) * 100 as miny, (ulx + xsize * px) * 100 as maxx, uly * 100 as maxy, cast(id % 3 + 4 as int) as lowz from fx_rasters"
_TILE = lambda v: f"cast(least(greatest(ceil(({v} + {O}) / ({RES} / pow(2.0, z)) / 256) - 1, 0), pow(2, z) - 1) as int)"
_PLAN = f"""with r as ({_M}),
b as (select id, cast(z as int) as z, {_TILE('minx')} as x0, {_TILE('maxx')} as x1, {_TILE('miny')} as y0, {_TILE('maxy')} as y1 from r, range(0, 3) s(k), lateral (select lowz + k as z) q),
xs as (select id, z, unnest(list_distinct(list_concat(range(x0, x1, 3), [x1]))) as tx from b),
ys as (select id, z, unnest(list_distinct(list_concat(range(y1, y0, -3), [y0]))) as ty from b)
select id, z, tx, ty, row_number() over (partition by id order by z desc, ty desc, tx) as place from xs join ys using (id, z)"""


def _plan(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters")
    r = r.withColumn("gt", F.array(c("ulx") * 100, c("px") * 100, F.lit(0.0), c("uly") * 100, F.lit(0.0), c("px") * -100))
    box = grid.bounds_of_geotransform(c("gt"), c("xsize"), c("ysize"))
    r = r.select("id", *(v.alias(n) for v, n in zip(box, ("minx", "miny", "maxx", "maxy"))), F.explode(F.sequence((c("id") % 3 + 4).cast("int"), (c("id") % 3 + 6).cast("int"))).alias("z"))
    return raster.base_tile_plan(r, "id")


@query(_PLAN)
def base_tile_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"""with p as ({_PLAN.replace("with r as", "with r as", 1)}), n as (select id, z, tx, ty, place, tx + dx as nx, ty + dy as ny from p, range(-1, 2) a(dx), range(-1, 2) e(dy)),
e as (select distinct n.id, n.z, n.tx, n.ty, n.place from n join (select id, cast(z as int) as z, {_TILE('minx')} as x0, {_TILE('maxx')} as x1, {_TILE('miny')} as y0, {_TILE('maxy')} as y1 from ({_M}), range(4, 9) s(z)) b
  on n.z = b.z and nx between b.x0 and b.x1 and ny between b.y0 and b.y1 and n.id % 5 = b.id % 5)
select id % 5 as mosaic, z, tx, ty, count(*) as jobs from e group by 1, 2, 3, 4""")
def base_tiles_with_assets(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters")
    assets = r.select((c("id") % 5).alias("mosaic"), *((v * 100).alias(n) for v, n in zip((c("ulx"), c("uly") - c("ysize") * c("px"), c("ulx") + c("xsize") * c("px"), c("uly")), ("minx", "miny", "maxx", "maxy"))))
    jobs = _plan(spark, sf_dir).withColumn("mosaic", c("id") % 5).groupBy("mosaic", "z", "tx", "ty").agg(F.count("*").alias("jobs"))
    return raster.tiles_with_assets(jobs, assets, range(4, 9), ("mosaic",))


_AXIS = """{p}r0, {p}len, {p}size, greatest(-{p}r0, 0) / cast({p}len as double) as {p}low"""
_CUT = "cast(trunc(1024 * {p}low) as int) as {p}w, {p}len - cast(trunc({p}len * {p}low) as int) as {p}rl, greatest({p}r0, 0) as {p}r"
_OUT = "{p}r as r{n}, cast(case when {p}r + {p}rl > {p}size then {p}size - {p}r else {p}rl end as int) as r{n}size, {p}w as w{n}, cast(case when {p}r + {p}rl > {p}size then trunc((1024 - {p}w) * (cast({p}size - {p}r as double) / {p}rl)) else 1024 - {p}w end as int) as w{n}size"
_DETAILS = f"""with plan as ({_PLAN}), m as ({_M}),
edges as (select p.*, m.xsize, m.ysize, m.px * 100 as res, m.minx, m.maxy, 256 * {RES} / pow(2.0, p.z) as side from plan p join m using (id)),
boxes as (select *, tx * 256 * ({RES} / pow(2.0, z)) - {O} as x0, (tx + 1) * 256 * ({RES} / pow(2.0, z)) - {O} as x1, ty * 256 * ({RES} / pow(2.0, z)) - {O} as y0, (ty + 1) * 256 * ({RES} / pow(2.0, z)) - {O} as y1 from edges),
cells as (select *, cast(trunc((x0 - minx) / res + 0.001) as int) as ar0, cast(trunc((x1 - x0) / res + 0.5) as int) as alen, xsize as asize, cast(trunc((maxy - y1) / res + 0.001) as int) as br0, cast(trunc((y1 - y0) / res + 0.5) as int) as blen, ysize as bsize from boxes),
a as (select id, z, tx, ty, place, {_AXIS.format(p='a')}, {_AXIS.format(p='b')} from cells), b as (select *, {_CUT.format(p='a')}, {_CUT.format(p='b')} from a)
select id, z, tx, ty, place, {_OUT.format(p='a', n='x')}, {_OUT.format(p='b', n='y')} from b"""


@query(_DETAILS)
def tile_details(spark, sf_dir):
    from ..operators import pyramid

    r = view(spark, sf_dir, "fx_rasters").select("id", (c("ulx") * 100).alias("left"), (c("uly") * 100).alias("top"), (c("px") * 100).alias("res"), "xsize", "ysize")
    return pyramid.tile_details(_plan(spark, sf_dir), r, "id")


@query(f"""with plan as ({_PLAN}), r as (select id, z, min(tx) as tminx, min(ty) as tminy, max(tx) as tmaxx, max(ty) as tmaxy from plan group by id, z)
select *, min(z) over (partition by id) as tminz, max(z) over (partition by id) as tmaxz from r""")
def plan_zoom_ranges(spark, sf_dir):
    from ..operators import pyramid

    return pyramid.zoom_ranges(_plan(spark, sf_dir), "id")
