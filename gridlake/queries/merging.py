"""Queries of merges by copy: seven overlapping rasters made of embeddings, on one target grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging
from ..sources.derived import view
from .reading import _PIXELS
from .registry import query

c = F.col
RES, TARGET = 1000.0, (-9005000.0, 6003000.0, -8890000.0, 5900000.0)  # 115 x 103 pixels
_BOX = {"ulx": "-9000000.0 + asset * 7000.0", "uly": "6000000.0 - asset * 5000.0", "res": "case when asset % 3 = 0 then 1000.0 when asset % 3 = 1 then 500.0 else 1500.0 end"}


def _source(spark, sf_dir):
    """pixels (asset, band, px, py, value, mask) and assets (box, res, bands)."""
    pixels = view(spark, sf_dir, "fx_pixels").selectExpr(*(f"{e} as {n}" for n, e in _PIXELS.items()))
    pixels = pixels.select("asset", F.explode(F.array(F.lit(1), F.lit(2))).alias("band"), "px", "py", F.coalesce("iv", F.lit(-7)).alias("iv"))
    pixels = pixels.where("band <= 1 + asset % 2").select("asset", "band", "px", "py", (c("iv") * c("band")).cast("double").alias("value"), (c("iv") % 5 + F.when(c("iv") < 0, 5).otherwise(0)).alias("mask"), c("asset").alias("asset_ord"))
    assets = pixels.groupBy("asset").agg((F.max("py") + 1).alias("height"), F.max("band").alias("bands")).withColumns({n: F.expr(e).cast("double") for n, e in _BOX.items()})
    return pixels, assets.withColumns({"lrx": c("ulx") + c("res") * 64, "lry": c("uly") - c("res") * c("height"), "asset_ord": c("asset")})


_RP = f"""with rp as (select {', '.join(f'{e} as {n}' for n, e in _PIXELS.items())} from fx_pixels),
pixels as (select asset, band, px, py, coalesce(iv, -7) * band as value, coalesce(iv, -7) % 5 + case when coalesce(iv, -7) < 0 then 5 else 0 end as mask from rp, (values (1), (2)) b(band) where band <= 1 + asset % 2),
assets as (select *, ulx + res * 64 as lrx, uly - res * height as lry from (select asset, height, 1 + asset % 2 as bands, {', '.join(f'cast({e} as double) as {n}' for n, e in _BOX.items())} from (select asset, max(py) + 1 as height from rp group by asset))),
o as (select *, greatest(ulx, {TARGET[0]}) as l, least(lrx, {TARGET[2]}) as r, least(uly, {TARGET[1]}) as t, greatest(lry, {TARGET[3]}) as b from assets),
w as (select asset, bands, cast(floor((l - {TARGET[0]}) / {RES} + 0.1) as int) as dx, cast(floor(({TARGET[1]} - t) / {RES} + 0.1) as int) as dy, cast(floor((r - {TARGET[0]}) / {RES} + 0.5) as int) as ex, cast(floor(({TARGET[1]} - b) / {RES} + 0.5) as int) as ey,
  cast(floor((l - ulx) / res + 0.1) as int) as ox, cast(floor((uly - t) / res + 0.1) as int) as oy, cast(floor((r - ulx) / res + 0.5) as int) as fx, cast(floor((uly - b) / res + 0.5) as int) as fy from o where l < r and b < t),
placed as (select w.asset, w.bands, w.dx + i as px, w.dy + j as py, w.ox + (2 * i + 1) * (fx - ox) // (2 * (ex - dx)) as sx, w.oy + (2 * j + 1) * (fy - oy) // (2 * (ey - dy)) as sy
  from w, unnest(range(ex - dx)) a(i), unnest(range(ey - dy)) b(j)),
at_target as (select p.asset, q.band, cast(p.px as int) as px, cast(p.py as int) as py, cast(q.value as double) as value, q.mask from placed p join pixels q on q.asset = p.asset and q.px = p.sx and q.py = p.sy)"""


def _copy(name, where, **rules):
    @query(f"{_RP} select band, px, py, arg_max(value, asset) as value from at_target where {where} group by band, px, py", name=name)
    def run(spark, sf_dir):
        pixels, assets = _source(spark, sf_dir)
        return merging.copied(merging.placed(pixels, assets, TARGET, RES), **rules)


_copy("merge_copy_plain", "true")
_copy("merge_copy_nodata", "value <> -7", nodata=-7.0)
_copy("merge_copy_mask", "mask <> 0", mask="mask")
_copy("merge_copy_nodata_beats_mask", "value <> -7", nodata=-7.0, mask="mask")


@query(f"""{_RP}, stacked as (select asset, coalesce(sum(bands) over (order by asset rows between unbounded preceding and 1 preceding), 0) as before from assets)
select cast(before + band as int) as band, px, py, value from at_target join stacked using (asset) where value <> -7""")
def merge_copy_separate(spark, sf_dir):
    pixels, assets = _source(spark, sf_dir)
    numbered = merging.stacked_bands(assets)
    rows = merging.placed(pixels, assets, TARGET, RES).join(numbered.select("asset", "first_band"), "asset").withColumn("band", c("first_band") + c("band") - 1)
    return merging.copied(rows, nodata=-7.0)


@query(f"""{_RP}, base as (select band, cast(px as int) as px, cast(py as int) as py, case when band = 1 then 5.0 else -1.0 end as value from (values (1), (2)) b(band), range(115) a(px), range(103) c(py))
select b.band, b.px, b.py, coalesce(m.value, cast(b.value as double)) as value from base b left join (select band, px, py, arg_max(value, asset) as value from at_target where value <> -7 group by band, px, py) m on m.band = b.band and m.px = b.px and m.py = b.py""")
def merge_copy_filled(spark, sf_dir):
    pixels, assets = _source(spark, sf_dir)
    rows = merging.placed(pixels, assets, TARGET, RES)
    return merging.copied(rows, nodata=-7.0, base=merging.filled(115, 103, 2, (5.0, -1.0), rows))


@query(f"""{_RP}, e as (select floor(min(ulx) / 3000) * 3000.0 as ulx, ceil(max(uly) / 3000) * 3000.0 as uly, ceil(max(lrx) / 3000) * 3000.0 as lrx, floor(min(lry) / 3000) * 3000.0 as lry from assets)
select *, cast(floor((lrx - ulx) / 3000 + 0.5) as int) as xsize, cast(floor((uly - lry) / 3000 + 0.5) as int) as ysize from e""")
def merge_target_grid(spark, sf_dir):
    return merging.target_grid(_source(spark, sf_dir)[1], 3000.0, aligned=True)
