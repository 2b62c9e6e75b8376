"""Queries of tile files and of options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import options
from ..sources import tile_files
from ..sources.derived import view
from .registry import query

c = F.col
_TILES = {"z": "5 + id % 2", "x": "id % 19", "y": "floor(id / 19) % 23"}
_REQUESTS = {"z": "5 + req_id % 3", "x": "req_id % 25", "y": "floor(req_id / 25) % 25"}


@query(f"""with t as (select id, {', '.join(f'cast({e} as int) as {n}' for n, e in _TILES.items())} from fx_polygons), f as (select z, x, y, arg_min(case when id % 7 = 0 then 0 else 1 end, id) as full from t group by z, x, y),
r as (select req_id, {', '.join(f'cast({e} as int) as {n}' for n, e in _REQUESTS.items())} from fx_requests)
select req_id, z, x, y, case when f.full is null then 204 when f.full = 0 then 400 else 200 end as status from r left join f using (z, x, y)""")
def tile_file_answers(spark, sf_dir):
    """Tiles written as files and asked for; the same tiles written once more change nothing."""
    tiles = view(spark, sf_dir, "fx_polygons").select("id", *(F.expr(e).cast("int").alias(n) for n, e in _TILES.items()))
    tiles = tiles.withColumn("data", F.when(c("id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("tile "), c("id").cast("string"))).cast("binary"))
    root = tile_files.shared_folder(spark)
    tile_files.write_files(tiles, root, [c("id")])
    tile_files.write_files(tiles.withColumn("data", F.lit(b"again")), root, [c("id")])
    asked = view(spark, sf_dir, "fx_requests").select("req_id", *(F.expr(e).cast("int").alias(n) for n, e in _REQUESTS.items()))
    return tile_files.answers(asked, tile_files.read_files(spark, root, (5, 6), "png", content=False))


def _json(name):
    return f"json_type(request, '$.{name}')"


_WRONG = {
    "verbose": f"{_json('verbose')} <> 'BOOLEAN'",
    "resampling": f"{_json('resampling')} <> 'VARCHAR' or json_extract_string(request, '$.resampling') not in ({', '.join(repr(r) for r in options.RESAMPLING)})",
    "tiledriver": f"{_json('tiledriver')} <> 'VARCHAR' or lower(json_extract_string(request, '$.tiledriver')) <> 'png'",
    "tile_size": f"{_json('tile_size')} not in ('UBIGINT', 'BIGINT') or try_cast(json_extract_string(request, '$.tile_size') as bigint) not in {options.TILE_SIZES}",
    "count_processes": f"{_json('count_processes')} not in ('UBIGINT', 'BIGINT') or try_cast(json_extract_string(request, '$.count_processes') as bigint) not between 0 and 16",
    "zoom": f"{_json('zoom')} <> 'ARRAY' or json_array_length(request, '$.zoom') <> 2",
}


@query(f"""with r as (select id, request from fx_options where json_valid(request) and json_type(request) = 'OBJECT')
select id, 'json' as error from fx_options where id not in (select id from r) union all {' union all '.join(f"select id, '{n}' as error from r where {_json(n)} is not null and ({w})" for n, w in _WRONG.items())}""")
def legacy_option_errors(spark, sf_dir):
    return options.legacy_errors(view(spark, sf_dir, "fx_options"), "request", 8).select("id", "error")


_SET = """select datasource_id, mosaics, case when resampling is null or resampling = '' then 'average' else resampling end as resampling, case when coalesce(tile_size, 0) = 0 then 256 else tile_size end as tile_size,
case when coalesce(count_processes, 0) = 0 then 8 else count_processes end as count_processes, coalesce(minzoom, 0) as minzoom, coalesce(maxzoom, 0) as maxzoom, coalesce(mbtiles, true) as mbtiles, coalesce(merge, true) as merge,
coalesce(mosaic_merge, false) as mosaic_merge, coalesce(pixel_selection_method, 'FirstMethod') as pixel_selection_method, cast(-999999 as double) as nodata_default from fx_settings"""


@query(_SET)
def option_defaults(spark, sf_dir):
    done = options.with_defaults(view(spark, sf_dir, "fx_settings"), 8)
    return done.select("datasource_id", "mosaics", "resampling", "tile_size", "count_processes", "minzoom", "maxzoom", "mbtiles", "merge", "mosaic_merge", "pixel_selection_method", "nodata_default")


@query(f"""select datasource_id, case when mosaics then 'mosaic' else 'tiles' end as kind, least(minzoom, maxzoom) as low, greatest(minzoom, maxzoom) as high, lower(resampling) as resampling, tile_size, count_processes,
case when mosaics then merge else mosaic_merge end as merged, case when mosaics then pixel_selection_method end as pixel_selection,
case when mbtiles then '/data/tiles/' || datasource_id || '/' || datasource_id || '.mbtiles' else '/data/tiles/' || datasource_id end as store from ({_SET})""")
def job_options(spark, sf_dir):
    jobs = options.job_options(options.with_defaults(view(spark, sf_dir, "fx_settings"), 8), "/data")
    return jobs.select("datasource_id", "kind", c("zoom")[0].alias("low"), c("zoom")[1].alias("high"), "resampling", "tile_size", "count_processes", "merged", "pixel_selection", "store")


@query(f"""select datasource_id, to_json(struct_pack(count_processes := count_processes, mbtiles := mbtiles, minzoom := minzoom, resampling := resampling, tile_size := tile_size)) as options,
substr(sha256(concat_ws(chr(31), cast(datasource_id as varchar), resampling, cast(tile_size as varchar))), 1, 32) as id from ({_SET})""")
def option_texts(spark, sf_dir):
    done = options.with_defaults(view(spark, sf_dir, "fx_settings"), 8)
    text = options.sorted_text(done, ["tile_size", "resampling", "minzoom", "mbtiles", "count_processes"])
    return done.select("datasource_id", text.alias("options"), options.stable_id(c("datasource_id"), c("resampling"), c("tile_size")).alias("id"))
