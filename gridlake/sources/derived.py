"""Feature, raster and service tables derived from the driver's tables.

Each is one SELECT text that Spark and DuckDB accept unchanged ($name stands for a table), but for pixels,
whose array access differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_points": """
select event_id as id,
  cast((event_id * 7919) % 36000 as double) / 100 - 180 as lng,
  cast((event_id * 104729) % 17000 as double) / 100 - 85 as lat,
  event_type as place, user_id, ts, value, props
from $events""",
    "fx_points_m": """
select p.*, lng * cast('20037508.342789244' as double) / 180 as mx,
  ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * cast('20037508.342789244' as double) / 180 as my
from $fx_points p""",
    "fx_polygons": """
select id, cx - h as xmin, cy - h as ymin, cx + h as xmax, cy + h as ymax, 'ST_Polygon' as geom_type,
  case o_orderstatus when 'F' then 'yes' when 'O' then 'no' end as building,
  case when id % 7 = 0 then 'terminal' end as aeroway,
  case id % 5 when 0 then 'forest' when 1 then 'water' when 2 then 'cemetery' end as landuse, id % 10 as admin_level
from (select o_orderkey as id, o_orderstatus,
        cast((o_orderkey * 15485863) % 40000 as double) * 1000 - 20000000 as cx,
        cast((o_orderkey * 32452843) % 40000 as double) * 1000 - 20000000 as cy,
        500 + cast(floor(o_totalprice) as double) / 10 as h
      from $orders) o""",
    "fx_tags": """
select event_id as id, concat('{', concat_ws(',',
  case when event_id % 2 = 0 then '"building":"yes"' end,
  case when event_id % 11 = 0 then '"building:part":"roof"' end,
  case when event_id % 3 = 0 then concat('"height":"', cast(event_id % 40 as string), case when event_id % 9 = 0 then ' m' else '' end, '"') end,
  case when event_id % 5 = 0 then concat('"building:levels":"', cast(event_id % 12 as string), '"') end,
  case when event_id % 7 = 0 then concat('"min_height":"', cast(event_id % 6 as string), '"') end,
  case when event_id % 13 = 0 then concat('"layer":"', cast(event_id % 3 - 1 as string), '"') end), '}') as tags
from $events""",
    "fx_queue": """
select o_orderkey as job_id, o_orderdate as scheduled_for, cast(o_orderkey % 5 as int) as failed_attempts,
  case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end as status, o_custkey as datasource_id
from $orders""",
    "fx_datasource": """
select s_suppkey as datasource_id, s_name as identifier,
  case when s_suppkey % 2 = 0 then 'vector' else 'raster' end as data_type,
  case when s_suppkey % 3 = 0 then concat('10.0.0.', cast(s_nationkey as string)) end as host,
  case when s_suppkey % 3 = 0 then 8000 end as port,
  cast(s_suppkey % 6 as int) as minzoom, cast(s_suppkey % 6 + s_suppkey % 10 as int) as maxzoom
from $supplier""",
    "fx_requests": """
select event_id as req_id, ts, concat('/api/tile/', cast(event_id % 110 as string), '/',
  case when event_id % 97 = 0 then 'x' else cast(event_id % 12 as string) end, '/',
  cast(event_id % 31 as string), '/', cast(event_id % 17 as string),
  case event_id % 4 when 0 then '.png' when 1 then '.mvt' when 2 then '.PBF' else '.jpg' end) as path
from $events""",
    "fx_pyramids": """
select event_id as id, user_id as datasource_id, ts as start_time,
  case when event_id % 10 = 0 then 1 else 0 end as running, case when event_id % 10 = 0 then 0 else 1 end as complete
from $events""",
    "fx_options": """
select o_orderkey as id, case when o_orderkey % 29 = 0 then 'no json' when o_orderkey % 31 = 0 then '[1]' else concat('{', concat_ws(',',
  case o_orderkey % 5 when 0 then '"verbose":true' when 1 then '"verbose":"yes"' end,
  case o_orderkey % 7 when 0 then '"resampling":"bilinear"' when 1 then '"resampling":"best"' when 2 then '"resampling":3' end,
  case o_orderkey % 6 when 0 then '"tiledriver":"png"' when 1 then '"tiledriver":"JPEG"' end,
  case o_orderkey % 8 when 0 then '"tile_size":512' when 1 then '"tile_size":300' when 2 then '"tile_size":"256"' when 3 then '"tile_size":256.5' when 4 then '"tile_size":null' end,
  case o_orderkey % 9 when 0 then '"count_processes":16' when 1 then '"count_processes":17' when 2 then '"count_processes":-1' end,
  case o_orderkey % 11 when 0 then '"zoom":[3,9]' when 1 then '"zoom":[3]' when 2 then '"zoom":"3,9"' when 3 then '"zoom":[1,2,3]' end), '}') end as request
from $orders""",
    "fx_settings": """
select o_orderkey as datasource_id, o_orderkey % 3 = 0 as mosaics, case o_orderkey % 4 when 0 then 'CUBIC' when 1 then '' end as resampling,
  case o_orderkey % 5 when 0 then 512 when 1 then 0 end as tile_size, case o_orderkey % 6 when 0 then 4 when 1 then 0 end as count_processes,
  case o_orderkey % 7 when 0 then cast(9 as int) end as minzoom, case o_orderkey % 8 when 0 then cast(5 as int) end as maxzoom,
  case o_orderkey % 3 when 0 then false when 1 then true end as mbtiles, case o_orderkey % 4 when 0 then false when 1 then true end as merge, case when o_orderkey % 10 = 0 then true end as mosaic_merge,
  case when o_orderkey % 9 = 0 then 'MeanMethod' end as pixel_selection_method
from $orders""",
    "fx_rasters": """
select p_partkey as id, cast(200 + (p_partkey * 7919) % 9000 as int) as xsize, cast(150 + (p_partkey * 104729) % 7000 as int) as ysize,
  cast((p_partkey * 31) % 300 as double) * 1000 - 150000 as ulx, cast((p_partkey * 53) % 300 as double) * 1000 - 150000 as uly,
  cast(1 + p_partkey % 40 as double) as px
from $part""",
}
PIXELS = {
    "spark": """
select label as cell, vec_id as asset_ord, pos % 8 as px, cast(floor(pos / 8) as int) as py, case when iv < -15000 then null else iv end as iv
from (select label, vec_id, pos, cast(floor(cast(x as double) * 100000 + 0.5) as bigint) as iv
      from $embeddings lateral view posexplode(embedding) e as pos, x) q""",
    "duckdb": """
select label as cell, vec_id as asset_ord, pos % 8 as px, cast(floor(pos / 8) as int) as py, case when iv < -15000 then null else iv end as iv
from (select label, vec_id, cast(i - 1 as int) as pos, cast(floor(cast(embedding[i] as double) * 100000 + 0.5) as bigint) as iv
      from $embeddings, range(1, 65) t(i)) q""",
}


def _expand(text: str, table) -> str:
    def one(m: re.Match) -> str:
        return f"({_expand(VIEWS[m[1]], table)})" if m[1] in VIEWS else table(m[1])

    return re.sub(r"\$(\w+)", one, text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet tables of sf_dir."""
    text = PIXELS["spark"] if name == "fx_pixels" else VIEWS[name]
    return spark.sql(_expand(text, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def oracle(sql: str) -> str:
    """SQL with the derived tables it names as common table expressions, for DuckDB."""
    names, todo = [], set(re.findall(r"\bfx_\w+", sql))
    while todo:
        name = todo.pop()
        if name not in names:
            names.append(name)
            if name in VIEWS:
                todo |= set(re.findall(r"\$(fx_\w+)", VIEWS[name]))
    text = lambda n: PIXELS["duckdb"] if n == "fx_pixels" else VIEWS[n]
    parts = ", ".join(f"{n} as ({_expand(text(n), lambda t: t)})" for n in names)
    return re.sub(r"^\s*(with\s+)?", f"with {parts}" + r", " if re.match(r"\s*with\s", sql, re.I) else f"with {parts} ", sql, count=1, flags=re.I) if names else sql
