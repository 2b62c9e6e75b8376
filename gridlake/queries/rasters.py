"""Queries of the raster operators, over embeddings read as 8 x 8 blocks of a mosaic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.encoding import float_to_rgba, nodata_of_type, rgba_to_float
from ..operators import pyramid, raster
from ..sources.derived import view
from .registry import milli, milli_sql, query, real

KEYS = ("cell", "px", "py")
PIXEL = "select cell, px, py, {} as value from fx_pixels group by cell, px, py"
c = F.col


def _pixels(spark, sf_dir):
    return view(spark, sf_dir, "fx_pixels")


def _method(name, sql, method, make, exact=True):
    @query(PIXEL.format(sql if exact else milli_sql(sql)), name=name)
    def run(spark, sf_dir):
        out = make(_pixels(spark, sf_dir), method, KEYS)
        return out if exact else out.withColumn("value", milli(c("value")))


for _m, _s in {"first": "arg_min(iv, asset_ord)", "highest": "max(iv)", "lowest": "min(iv)", "count": "count(iv)"}.items():
    _method(f"mosaic_{_m}", _s, _m, raster.select_pixels)
for _m, _s in {"mean": "cast(cast(sum(iv) as bigint) as double) / count(iv)", "median": "median(iv)", "stdev": "stddev_pop(iv)"}.items():
    _method(f"mosaic_{_m}", _s, _m, raster.select_pixels, exact=False)
for _m, _s in {"last": "arg_max(iv, asset_ord)", "min": "min(iv)", "max": "max(iv)", "count": "count(iv)", "sum": "cast(sum(iv) as bigint)"}.items():
    _method(f"merge_{_m}", _s, _m, raster.merge_pixels)
_method("merge_sum_count_mean", "cast(cast(sum(iv) as bigint) as double) / count(iv)", "mean", raster.merge_pixels, exact=False)
_method("merge_first_intent", "arg_min(iv, asset_ord)", "first", raster.merge_pixels)
_method("merge_first_compat", "arg_max(iv, asset_ord)", "first", lambda a, m, k: raster.merge_pixels(a, m, k, compat=True))


def _last_band(name, high):
    fun, sign = ("arg_max", "-") if high else ("arg_min", "")

    @query(f"select cell, px, py, {fun}(b1, (b2, {sign}asset_ord)) as b1, {fun}(b2, (b2, {sign}asset_ord)) as b2 from (select *, iv as b1, abs(iv) % 1000 as b2 from fx_pixels where iv is not null) group by cell, px, py", name=name)
    def run(spark, sf_dir):
        p = _pixels(spark, sf_dir).where("iv is not null").withColumns({"b1": c("iv"), "b2": F.abs("iv") % 1000})
        return raster.select_by_last_band(p, KEYS, ("b1", "b2"), high=high)


_last_band("mosaic_lastband_high", True)
_last_band("mosaic_lastband_low", False)

_EXTENT = "select min(ulx) as \"left\", min(uly - ysize * px) as bottom, max(ulx + xsize * px) as \"right\", max(uly) as top, max(px) as res from fx_rasters"


@query(f"select *, cast(ceil((\"right\" - \"left\") / res) as int) as width, cast(ceil((top - bottom) / res) as int) as height from ({_EXTENT})")
def mosaic_extent(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters").select("ulx", "uly", (c("uly") - c("ysize") * c("px")).alias("low"), (c("ulx") + c("xsize") * c("px")).alias("far"), "px")
    return raster.mosaic_extent(r, "ulx", "low", "far", "uly", "px")


@query("select cast(id % 12 as int) as z, min(xsize % 40) as tminx, max(xsize % 40 + 5) as tmaxx, min(ysize % 40) as tminy, max(ysize % 40 + 5) as tmaxy from fx_rasters group by 1")
def zoom_union(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters").select((c("id") % 12).cast("int").alias("z"), (c("xsize") % 40).alias("tminx"), (c("xsize") % 40 + 5).alias("tmaxx"), (c("ysize") % 40).alias("tminy"), (c("ysize") % 40 + 5).alias("tmaxy"))
    return raster.union_of_ranges(r)


_BLOCK = "select asset_ord, cast(floor(px / {f}) as int) as px, cast(floor(py / {f}) as int) as py, {v} as value from fx_pixels group by asset_ord, 2, 3"


def _resample(name, kernel, sql, factor=2, exact=True):
    @query(_BLOCK.format(f=factor, v=sql if exact else milli_sql(sql)), name=name)
    def run(spark, sf_dir):
        out = raster.resample(_pixels(spark, sf_dir), factor, kernel, ("asset_ord",))
        return out if exact else out.withColumn("value", milli(c("value")))


_MEAN = "cast(cast(sum(iv) as bigint) as double) / count(iv)"
_resample("overview_average", "average", _MEAN, exact=False)
_resample("resample_average", "average", _MEAN, factor=4, exact=False)
_resample("resample_nearest", "nearest", "max(case when px % 4 = 2 and py % 4 = 2 then iv end)", factor=4)
_resample("resample_min", "min", "min(iv)", factor=4)
_resample("resample_max", "max", "max(iv)", factor=4)
_resample("resample_med", "med", "median(iv)", factor=4, exact=False)
_resample("resample_rms", "rms", "sqrt(cast(cast(sum(iv * iv) as bigint) as double) / count(iv))", factor=4, exact=False)


@query("""with q as (select asset_ord, cast(floor(px / 4) as int) as px, cast(floor(py / 4) as int) as py, cast(floor(iv / 5000.0) as bigint) as v from fx_pixels),
n as (select asset_ord, px, py, v, count(*) as k from q where v is not null group by all)
select g.asset_ord, g.px, g.py, arg_min(v, (-k, v)) as value from (select distinct asset_ord, px, py from q) g left join n on g.asset_ord = n.asset_ord and g.px = n.px and g.py = n.py group by all""")
def resample_mode(spark, sf_dir):
    p = _pixels(spark, sf_dir).withColumn("iv", F.floor(c("iv") / 5000.0).cast("long"))
    return raster.resample(p, 4, "mode", ("asset_ord",))


def _interpolated(name, kernel):
    taps = f"(values {', '.join(f'({s}, {real(w)})' for s, w in raster.phase_weights(kernel, 2))})"
    wide = f"select asset_ord, px * 2 + a.s as px, py * 2 + d.s as py, a.w * d.w as w, iv from fx_pixels, {taps} a(s, w), {taps} d(s, w) where iv is not null"

    @query(f"select asset_ord, cast(px as int) as px, cast(py as int) as py, {milli_sql('sum(w * iv) / sum(w)', 10)} as value from ({wide}) where px between 0 and 15 and py between 0 and 15 group by asset_ord, px, py", name=name)
    def run(spark, sf_dir):
        out = raster.interpolate(_pixels(spark, sf_dir), 2, kernel, ("asset_ord",))
        return out.withColumn("value", milli(c("value"), 10))


for _k in raster.WEIGHTS:
    _interpolated(f"resample_{_k}", _k)


@query("select cell, asset_ord, px, py, case when iv = 0 or iv % 10 = 3 then null else iv end as value from (select *, iv from fx_pixels)")
def nodata_mask(spark, sf_dir):
    p = _pixels(spark, sf_dir).withColumn("iv", F.when(c("iv") % 10 == 3, 0).otherwise(c("iv")))
    return p.select("cell", "asset_ord", "px", "py", raster.masked(c("iv"), 0).alias("value"))


@query("select asset_ord, px, count(case when iv > 9000 then iv end) as valid from fx_pixels group by asset_ord, px having count(case when iv > 9000 then iv end) > 0")
def empty_tiles(spark, sf_dir):
    return raster.non_empty_tiles(_pixels(spark, sf_dir).withColumn("iv", F.when(c("iv") > 9000, c("iv"))), ("asset_ord", "px"))


_RGBA = """with a as (select event_id as id, value, case when event_id % 50 = 0 then cast(-999999 as double) when event_id % 7 = 0 then -value when event_id % 11 = 0 then 0.0 else value end as v from events),
b as (select *, case when v > -999999 then floor(log2(abs(v) + 1 - sign(v) * sign(v))) end as e from a),
m as (select *, case when v > -999999 then 8388608 + sign(v) + sign(v) * 8388608 * (abs(v) / pow(2.0, e) - 1) end as m from b),
q as (select id, v, coalesce(cast(floor(m / 65536) as int), 0) as r, coalesce(cast(floor((m - floor(m / 65536) * 65536) / 256) as int), 0) as g,
  coalesce(cast(floor(m - floor(m / 65536) * 65536 - floor((m - floor(m / 65536) * 65536) / 256) * 256) as int), 0) as b, coalesce(cast(e + 128 as int), 0) as a from m)"""


def _values(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.when(c("event_id") % 50 == 0, F.lit(-999999.0)).when(c("event_id") % 7 == 0, -c("value")).when(c("event_id") % 11 == 0, F.lit(0.0)).otherwise(c("value"))
    e = e.select(c("event_id").alias("id"), v.alias("v"))
    return e.select("id", "v", *(x.alias(n) for x, n in zip(float_to_rgba(c("v"), -999999.0), "rgba")))


@query(f"{_RGBA} select id, r, g, b, a from q")
def rgba_encode(spark, sf_dir):
    return _values(spark, sf_dir).drop("v")


@query(f"{_RGBA} select id, case when v > -999999 then {milli_sql('v', 100)} end as cents from q")
def rgba_decode(spark, sf_dir):
    return _values(spark, sf_dir).select("id", milli(rgba_to_float(c("r"), c("g"), c("b"), c("a")), 100).alias("cents"))


@query("""select p_partkey, t, cast(case when t like 'uint%' then 0 when t = 'int8' then -128 when t = 'int16' then -32000 when t = 'float16' then -65000 else -99999 end as int) as nodata
from (select p_partkey, ['uint8', 'uint16', 'int8', 'int16', 'int32', 'float16', 'float32', 'float64'][cast(p_partkey % 8 + 1 as int)] as t from part)""")
def nodata_by_dtype(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in ("uint8", "uint16", "int8", "int16", "int32", "float16", "float32", "float64")))
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.get(names, (c("p_partkey") % 8).cast("int")).alias("t"))
    return t.withColumn("nodata", nodata_of_type(c("t")))


@query("""with a as (select id, px, ulx as sx, uly as sy, ulx + xsize * px as ex, uly - ysize * px as ey, -20000.0::double as tx, 30000.0::double as ty, 25000.0::double as ux, -40000.0::double as uy from fx_rasters),
w as (select *, greatest(sx, tx) as l, least(ex, ux) as r, least(sy, ty) as t, greatest(ey, uy) as b from a),
o as (select *, l < r and b < t as ok, cast(floor((l - tx) / px + 0.1) as int) as dx, cast(floor((ty - t) / px + 0.1) as int) as dy, cast(floor((l - sx) / px + 0.1) as int) as ox, cast(floor((sy - t) / px + 0.1) as int) as oy from w)
select id, case when ok then dx end as dx, case when ok then dy end as dy, case when ok then cast(floor((r - tx) / px + 0.5) as int) - dx end as dw, case when ok then cast(floor((ty - b) / px + 0.5) as int) - dy end as dh,
case when ok then ox end as ox, case when ok then oy end as oy, case when ok then cast(floor((r - sx) / px + 0.5) as int) - ox end as ow, case when ok then cast(floor((sy - b) / px + 0.5) as int) - oy end as oh from o""")
def gdal_merge_window(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters")
    asset = (c("ulx"), c("uly"), c("ulx") + c("xsize") * c("px"), c("uly") - c("ysize") * c("px"))
    parts = raster.merge_window(asset, tuple(F.lit(v) for v in (-20000.0, 30000.0, 25000.0, -40000.0)), c("px"))
    return r.select("id", *(p.alias(n) for p, n in zip(parts, ("dx", "dy", "dw", "dh", "ox", "oy", "ow", "oh"))))


@query("select id % 25 as mosaic, min(id % 6) as minz, max(id % 6 + xsize % 7) as maxz from fx_rasters group by 1")
def zoom_range_union(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters").select((c("id") % 25).alias("mosaic"), (c("id") % 6).alias("lo"), (c("id") % 6 + c("xsize") % 7).alias("hi"))
    return r.groupBy("mosaic").agg(F.min("lo").alias("minz"), F.max("hi").alias("maxz"))


@query()
def render_png(spark, sf_dir):
    from ..functions.png import render_tiles

    p = _pixels(spark, sf_dir).withColumn("v", c("iv").cast("double"))
    p = p.select("cell", c("asset_ord").alias("asset"), "px", "py", *(x.alias(n) for x, n in zip(float_to_rgba(c("v"), -999999.0), "rgba")))
    return render_tiles(p, 8, ("cell", "asset"))


_PIXEL_RGBA = """with v as (select cell, asset_ord as asset, cast(px as int) as px, cast(py as int) as py, cast(iv as double) as v from fx_pixels),
e as (select *, case when v > -999999 then floor(log2(abs(v) + 1 - sign(v) * sign(v))) end as e from v),
m as (select *, case when v > -999999 then 8388608 + sign(v) + sign(v) * 8388608 * (abs(v) / pow(2.0, e) - 1) end as m from e)
select cell, asset, px, py, coalesce(cast(floor(m / 65536) as int), 0) as r, coalesce(cast(floor((m - floor(m / 65536) * 65536) / 256) as int), 0) as g,
  coalesce(cast(floor(m - floor(m / 65536) * 65536 - floor((m - floor(m / 65536) * 65536) / 256) * 256) as int), 0) as b, coalesce(cast(e + 128 as int), 0) as a from m"""


@query(_PIXEL_RGBA)
def render_png_decoded(spark, sf_dir):
    from ..functions.png import drawn_pixels

    return drawn_pixels(render_png(spark, sf_dir), ("cell", "asset"))


_BASE_TILES = """with p as (select cell, asset_ord, cast(px as int) as px, cast(py as int) as py, case when iv % 10 <> 3 and iv > 2000 then iv end as iv from fx_pixels),
v as (select cell, px, py, {} as v from p group by cell, px, py),
t as (select * from v where cell in (select cell from v where v is not null)),
e as (select *, case when v > -9999999 then floor(log2(abs(v) + 1 - sign(v) * sign(v))) end as e from t),
m as (select *, case when v > -9999999 then 8388608 + {} + sign(v) * 8388608 * (abs(v) / pow(2.0, e) - 1) end as m from e)
select 5 as z, cast(cell % 4 as int) as x, cast(floor(cell / 4) as int) as y, px, py, coalesce(cast(floor(m / 65536) as int), 0) as r, coalesce(cast(floor((m - floor(m / 65536) * 65536) / 256) as int), 0) as g,
  coalesce(cast(floor(m - floor(m / 65536) * 65536 - floor((m - floor(m / 65536) * 65536) / 256) * 256) as int), 0) as b, coalesce(cast(e + 128 as int), 0) as a from m"""


def _base_tiles(name, method, sql, with_sign=True):
    @query(_BASE_TILES.format(sql, "sign(v)" if with_sign else "0"), name=name)
    def run(spark, sf_dir):
        from ..functions.png import drawn_pixels

        p = _pixels(spark, sf_dir).withColumn("iv", F.when(c("iv") % 10 == 3, F.lit(-9999999)).when(c("iv") > 2000, c("iv")))
        p = p.select(F.lit(5).alias("z"), (c("cell") % 4).cast("int").alias("x"), F.floor(c("cell") / 4).cast("int").alias("y"), "asset_ord", "px", "py", "iv")
        return drawn_pixels(pyramid.base_tiles(p, method, size=8, with_sign=with_sign))


_base_tiles("base_tiles_first", "first", "cast(arg_min(iv, asset_ord) as double)")
_base_tiles("base_tiles_mean", "mean", "cast(cast(sum(iv) as bigint) as double) / count(iv)")
_base_tiles("base_tiles_lowest_without_sign", "lowest", "cast(min(iv) as double)", with_sign=False)
