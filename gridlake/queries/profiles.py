"""Queries of the rules of raster jobs and tile requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, store
from ..sources.derived import view
from .registry import query

c = F.col
_R = "(select *, ['nearest', 'bilinear', 'cubic', 'average'][cast(id % 4 as int) + 1] as kernel, cast(1 + id % 5 as int) as bands from fx_rasters)"


def _rasters(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters")
    kernels = F.array(*(F.lit(k) for k in ("nearest", "bilinear", "cubic", "average")))
    return r.withColumns({"kernel": F.get(kernels, (c("id") % 4).cast("int")), "bands": (1 + c("id") % 5).cast("int")})


_GIVEN = "case id % 3 when 0 then '-1' when 1 then '0,-9999,7' end"


@query(f"""with r as (select id, bands, {_GIVEN} as given from {_R}), n as (select *, list_transform(string_split(given, ','), lambda v: cast(v as double)) as vs from r)
select id, array_to_string(list_transform(case when given is null then list_transform(list_filter(range(0, bands), lambda b: (id + b) % 2 = 0), lambda b: -b)
  when len(vs) < bands then list_transform(range(0, bands), lambda b: cast(vs[b % len(vs) + 1] as bigint)) else list_transform(vs, lambda v: cast(v as bigint)) end, lambda v: cast(v as varchar)), ' ') as nodata from n""")
def nodata_list(spark, sf_dir):
    own = F.transform(F.sequence(F.lit(0), c("bands") - 1), lambda b: F.when((c("id") + b) % 2 == 0, -b.cast("double")))
    values = profile.nodata_list(F.expr(_GIVEN), own, c("bands"))
    return _rasters(spark, sf_dir).select("id", F.array_join(F.transform(values, lambda v: v.cast("long").cast("string")), " ").alias("nodata"))


@query(f"select id, case when id % 7 = 0 or bands in (2, 4) then bands - 1 else bands end as data_bands, 256 * case kernel when 'nearest' then 1 when 'bilinear' then 2 else 4 end as query_size from {_R}")
def read_profile(spark, sf_dir):
    return _rasters(spark, sf_dir).select("id", profile.data_bands(c("bands"), c("id") % 7 == 0).alias("data_bands"), profile.query_size(c("kernel"), F.lit(256)).alias("query_size"))


@query("""select id % 25 as mosaic, floor(min(ulx) / 64) * 64.0::double as ulx, ceil(max(uly) / 64) * 64.0::double as uly, ceil(max(ulx + xsize * px) / 64) * 64.0::double as lrx, floor(min(uly - ysize * px) / 64) * 64.0::double as lry
from fx_rasters group by 1""")
def merge_extent_aligned(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters").select((c("id") % 25).alias("mosaic"), "ulx", "uly", (c("ulx") + c("xsize") * c("px")).alias("lrx"), (c("uly") - c("ysize") * c("px")).alias("lry"))
    return profile.merge_extent(r, ("mosaic",), 64.0)


@query("select id % 40 as mosaic, sum(cast(xsize as bigint) * ysize * 4) as bytes, sum(cast(xsize as bigint) * ysize * 4) > 3980394496 as big, case when sum(cast(xsize as bigint) * ysize * 4) > 3980394496 then 'LZW' else 'PACKBITS' end as compress from fx_rasters group by 1")
def merge_creation(spark, sf_dir):
    r = view(spark, sf_dir, "fx_rasters").select((c("id") % 40).alias("mosaic"), (c("xsize").cast("long") * c("ysize") * 4).alias("size"))
    return profile.creation(r, ("mosaic",))


@query("""with r as (select event_id as req_id, event_id % 120 as datasource_id, cast(event_id % 14 as int) as z, event_id % 9 <> 0 as prepared, case when event_id % 5 <> 0 then event_id % 4 end as size from events)
select req_id, case when d.datasource_id is null or z < minzoom or z > maxzoom then 400 when not prepared then 523 when size is null then 204 when size = 0 then 400 else 200 end as status from r left join fx_datasource d using (datasource_id)""")
def tile_status(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = F.when(c("event_id") % 5 != 0, c("event_id") % 4)
    r = e.select(c("event_id").alias("req_id"), (c("event_id") % 120).alias("datasource_id"), (c("event_id") % 14).cast("int").alias("z"), (c("event_id") % 9 != 0).alias("prepared"), size.alias("size"))
    d = view(spark, sf_dir, "fx_datasource").select("datasource_id", "minzoom", "maxzoom")
    return r.join(d, "datasource_id", "left").select("req_id", profile.tile_status(c("z"), c("minzoom"), c("maxzoom"), c("prepared"), c("size")).alias("status"))


_REQUEST = """select id as datasource_id, ['average', 'cubic', 'gauss', null][cast(id % 4 as int) + 1] as resampling, ['med', 'mode'][cast(id % 2 as int) + 1] as resampling_warp, ['PNG', 'png', 'PNG'][cast(id % 3 as int) + 1] as tiledriver,
  cast(64 + id % 9 * 64 as int) as tile_size, cast(id % 10 as int) as count_processes, cast(id % 6 - 1 as int) as low, cast(15 + id % 5 as int) as high, ['FirstMethod', 'MeanMethod', 'Other'][cast(id % 3 as int) + 1] as pixel_selection_method from fx_rasters"""


@query(" union all ".join(f"select datasource_id, '{name}' as error from ({_REQUEST}) where {rule}" for name, rule in profile.pyramid_checks(8).items()))
def pyramid_request_errors(spark, sf_dir):
    pick = lambda n, *values: F.get(F.array(*(F.lit(v) for v in values)), (c("id") % n).cast("int"))
    r = view(spark, sf_dir, "fx_rasters").select(
        c("id").alias("datasource_id"), pick(4, "average", "cubic", "gauss", None).alias("resampling"), pick(2, "med", "mode").alias("resampling_warp"), pick(3, "PNG", "png", "PNG").alias("tiledriver"),
        (64 + c("id") % 9 * 64).cast("int").alias("tile_size"), (c("id") % 10).cast("int").alias("count_processes"), (c("id") % 6 - 1).cast("int").alias("low"), (15 + c("id") % 5).cast("int").alias("high"), pick(3, "FirstMethod", "MeanMethod", "Other").alias("pixel_selection_method"),
    )
    return store.errors(r, profile.pyramid_checks(8)).select("datasource_id", "error")
