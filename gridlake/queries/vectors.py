"""Queries of vector layers, tags, the tile-feature join and vector tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import grid
from ..functions import tags as T
from ..operators import geometry, mvt, relations
from ..operators import vector as V
from ..plans.filters import Filters
from ..sources.derived import view
from .grids import COVER_SQL, EDGE
from .registry import query, real, zooms_sql

c = F.col
FILTER = ["all", ["==", ["get", "building"], "yes"], ["any", ["has", "aeroway"], ["in", ["get", "use"], "forest", "water"]]]
WHERE = "building = 'yes' and (aeroway is not null or landuse in ('forest', 'water'))"
FIELDS = (V.Field("id"), V.Field("building", encode=False), V.Field("aeroway"), V.Field("use", "landuse"))


@query(f"select xmin, ymin, xmax, ymax, id, aeroway, landuse as \"use\" from fx_polygons where {WHERE}")
def layer_select(spark, sf_dir):
    layer = V.Layer("buildings", "fx_polygons", filter=FILTER, fields=FIELDS)
    return V.layer_frame(spark, layer, 12, {"fx_polygons": view(spark, sf_dir, "fx_polygons")})


@query("select xmin, ymin, xmax, ymax from fx_polygons")
def layer_geometry_only(spark, sf_dir):
    return V.layer_frame(spark, V.Layer("plain", "fx_polygons", filter=FILTER), 3, {"fx_polygons": view(spark, sf_dir, "fx_polygons")})


@query("select datasource_id, identifier, cast(z as int) as z from fx_datasource, (values (0), (4), (9), (15)) t(z) where z between minzoom and maxzoom")
def layer_zoom_prune(spark, sf_dir):
    return V.at_zooms(view(spark, sf_dir, "fx_datasource"), (0, 4, 9, 15)).select("datasource_id", "identifier", "z")


@query("select id, 'ways' as kind, 7 as zoom from fx_tags where id % 2 = 0 union all select id, 'relations' as kind, 7 as zoom from fx_tags where id % 3 = 0")
def layer_sql_union(spark, sf_dir):
    view(spark, sf_dir, "fx_tags").createOrReplaceTempView("fx_tags_layer")
    queries = (
        V.SqlQuery(0, 10, "SELECT id, 'ways' AS kind, $zoom AS zoom FROM fx_tags_layer\n WHERE id % 2 = 0;"),
        V.SqlQuery(5, 20, "SELECT id, 'relations' AS kind, $zoom AS zoom FROM fx_tags_layer WHERE id % 3 = 0"),
        V.SqlQuery(8, 20, "SELECT id, 'late' AS kind, $zoom AS zoom FROM fx_tags_layer"),
    )
    return V.layer_frame(spark, V.Layer("mixed", queries=queries), 7)


_J = lambda k: f"json_extract_string(tags, '$.\"{k}\"')"


@query(f"select id, {_J('height')} as height, tags <> '{{}}' as tagged from fx_tags where {_J('building')} is not null and {_J('layer')} is null and ({_J('building:levels')} in ('5', '10') or {_J('min_height')} <> '3')")
def tags_exists(spark, sf_dir):
    t = c("tags")
    keep = T.has_tag(t, "building") & ~T.has_tag(t, "layer") & (T.tag(t, "building:levels").isin("5", "10") | (T.tag(t, "min_height") != "3"))
    return view(spark, sf_dir, "fx_tags").where(keep).select("id", T.tag(t, "height").alias("height"), (~T.no_tags(t)).alias("tagged"))


@query(f"select id, concat('{{', concat_ws(',', case when {_J('building')} is not null then concat('\"building\":\"', {_J('building')}, '\"') end, case when {_J('height')} is not null then concat('\"height\":\"', {_J('height')}, '\"') end), '}}') as tags from fx_tags")
def tags_build(spark, sf_dir):
    t = c("tags")
    return view(spark, sf_dir, "fx_tags").select("id", T.build(building=T.tag(t, "building"), height=T.tag(t, "height")).alias("tags"))


@query(f"select id, {_J('building')} as building, {_J('min_height')} as min_height, case when id % 2 = 0 then 'new' else {_J('height')} end as height from fx_tags")
def tags_minus_id(spark, sf_dir):
    left = T.without(c("tags"), "layer")
    right = F.when(c("id") % 2 == 0, F.create_map(F.lit("height"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    both = T.merged(left, right)
    return view(spark, sf_dir, "fx_tags").select("id", *(F.element_at(both, k).alias(k) for k in ("building", "min_height", "height")))


_N = lambda k, d: f"coalesce(try_cast({_J(k)} as double), {d})"


@query(f"""select id, cast(case when {_J('min_height')} is not null then {_N('min_height', 0)} when {_J('building:min_height')} is not null then {_N('building:min_height', 0)} when {_J('building:min_level')} is not null then {_N('building:min_level', 0)} * 3 else 0 end as double) as base,
cast(case when {_J('height')} is not null then {_N('height', 6)} when {_J('building:height')} is not null then {_N('building:height', 6)} when {_J('building:levels')} is not null then {_N('building:levels', 2)} * 3 else 6 end as double) as height
from fx_tags where ({_J('building')} is not null or {_J('building:part')} is not null) and ({_J('layer')} is null or {_N('layer', 0)} >= 0)""")
def building_extrusion(spark, sf_dir):
    t = c("tags")
    return view(spark, sf_dir, "fx_tags").where(T.is_building(t)).select("id", T.extrusion_base(t).alias("base"), T.extrusion_height(t).alias("height"))


_E = [real(v) for v in V.envelope(4, 9, 6, V.BUFFER / V.EXTENT)]


@query(f"select id from fx_polygons where xmin <= {_E[2]} and xmax >= {_E[0]} and ymin <= {_E[3]} and ymax >= {_E[1]}")
def bbox_overlap(spark, sf_dir):
    return V.in_tile(view(spark, sf_dir, "fx_polygons"), 4, 9, 6).select("id")


@query(f"select z, x, y, count(*) as features, min(id) as first_id, max(id) as last_id from {COVER_SQL(range(7))} where building = 'yes' group by z, x, y")
def tile_feature_join(spark, sf_dir):
    p = view(spark, sf_dir, "fx_polygons").where("building = 'yes'")
    return V.tile_cover(p, range(7)).groupBy("z", "x", "y").agg(F.count("*").alias("features"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"select z, x, y, landuse, count(*) as features from {COVER_SQL(range(6))} group by z, x, y, landuse")
def tile_layer_counts(spark, sf_dir):
    return V.layer_counts(view(spark, sf_dir, "fx_polygons"), range(6), ("landuse",))


@query("select user_id, max(ts) as ts, arg_max(lng, (ts, lng, lat)) as lng, arg_max(lat, (ts, lng, lat)) as lat from fx_points group by user_id")
def last_position(spark, sf_dir):
    return V.latest_positions(view(spark, sf_dir, "fx_points"), "user_id", "ts", ("lng", "lat"))


@query("select user_id, time_bucket(interval '1 day', ts) as start, count(*) as points, arg_min(lng, (ts, lng)) as first_lng, arg_max(lat, (ts, lng)) as last_lat from fx_points group by 1, 2")
def device_tracks(spark, sf_dir):
    t = V.tracks(view(spark, sf_dir, "fx_points"), "user_id", "ts", "lng", "lat", "1 day")
    return t.select("user_id", "start", F.size("line").cast("long").alias("points"), c("line")[0]["x"].alias("first_lng"), F.element_at("line", -1)["y"].alias("last_lat"))


def with_shapes(boxes):
    """WKB rectangles of the box columns, one Arrow batch at a time."""
    @F.pandas_udf("binary")
    def shape(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([geometry.write((3, [np.array([(p, q), (r, q), (r, s), (p, s), (p, q)])])) for p, q, r, s in zip(a, b, x, y, strict=True)])

    return boxes.withColumn("wkb", shape(*V.BOX))


def _tiles(spark, sf_dir, layer, where, zooms):
    return mvt.tiles(with_shapes(view(spark, sf_dir, "fx_polygons").where(where)), zooms, layer, ("building", "landuse", "admin_level"))


@query()
def mvt_tile(spark, sf_dir):
    return _tiles(spark, sf_dir, "buildings", "building = 'yes'", (6, 8))


@query()
def mvt_concat(spark, sf_dir):
    both = mvt.concat_layers([_tiles(spark, sf_dir, "land", "landuse is not null", (7,)), _tiles(spark, sf_dir, "aero", "aeroway is not null", (7,))])
    return mvt.compressed(both).withColumn("raw_bytes", F.length("data"))


_SIZE, _TO = f"({real(2 * grid.WORLD_EDGE)} / pow(2.0, z))", f"cast(4096 as double)"
_SIDE = lambda v, edge: f"greatest(least(({v} - ({edge})) * ({_TO} / (e1 - e0)), 4160.0), -64.0)"
_DOWN = lambda v: f"greatest(least(({v} - n1) * (-{_TO} / (n1 - n0)), 4160.0), -64.0)"
_LAST = lambda v: f"cast(greatest(least(floor({v}), pow(2.0, z) - 1), 0) as int)"
#: Boxes on the grid of each tile that their widened tile meets, clipped to the buffered tile.
_DRAWN = lambda zooms: f"""(select *, cast(round_even({_SIDE('xmin', 'e0')}, 0) as int) as l, cast(round_even({_SIDE('xmax', 'e0')}, 0) as int) as r, cast(round_even({_DOWN('ymax')}, 0) as int) as t, cast(round_even({_DOWN('ymin')}, 0) as int) as b from (
  select *, {_SIZE} * x - {EDGE} as e0, {EDGE} - {_SIZE} * (y + 1) as n0, {_SIZE} * (x + 1) - {EDGE} as e1, {EDGE} - {_SIZE} * y as n1 from (
    select *, cast(unnest(range(y0, y1 + 1)) as int) as y from (select *, cast(unnest(range(x0, x1 + 1)) as int) as x from (
      select *, {_LAST(f'(xmin + {EDGE}) / {_SIZE} - 0.015625')} as x0, {_LAST(f'(xmax + {EDGE}) / {_SIZE} + 0.015625')} as x1, {_LAST(f'({EDGE} - ymax) / {_SIZE} - 0.015625')} as y0, {_LAST(f'({EDGE} - ymin) / {_SIZE} + 0.015625')} as y1
      from fx_polygons, {zooms_sql(*zooms)})))))"""  # noqa: E731


@query(f"select z, x, y, id, 3 as type, 4 as points, l as \"left\", t as top, r as \"right\", b as bottom, building, landuse, cast(admin_level as varchar) as admin_level from {_DRAWN((6, 8))} where building = 'yes' and r > l and b > t")
def mvt_tile_decoded(spark, sf_dir):
    d = mvt.decoded(mvt_tile(spark, sf_dir))
    a = c("attributes")
    return d.select("z", "x", "y", "id", "type", F.size("xs").alias("points"), F.array_min("xs").alias("left"), F.array_min("ys").alias("top"), F.array_max("xs").alias("right"), F.array_max("ys").alias("bottom"), *(a[k].alias(k) for k in ("building", "landuse", "admin_level")))


@query(f"""select z, x, y, layer, count(*) as features, sum(id) as ids from (
  select 'land' as layer, * from {_DRAWN((7,))} where landuse is not null union all select 'aero' as layer, * from {_DRAWN((7,))} where aeroway is not null) where r > l and b > t group by 1, 2, 3, 4""")
def mvt_concat_decoded(spark, sf_dir):
    return mvt.decoded(mvt_concat(spark, sf_dir)).groupBy("z", "x", "y", "layer").agg(F.count("*").alias("features"), F.sum("id").alias("ids"))


_SHAPE = (3, [np.array([(-2.00005e6, -1.50005e6), (3.00005e6, -1.50005e6), (3.00005e6, 2.50005e6), (-2.00005e6, 2.50005e6), (-2.00005e6, -1.50005e6)])])


@query("select id from fx_polygons where xmin <= 3000050 and xmax >= -2000050 and ymin <= 2500050 and ymax >= -1500050")
def geom_intersects(spark, sf_dir):
    return relations.related(with_shapes(view(spark, sf_dir, "fx_polygons")), "intersects", _SHAPE).select("id")


@query("select id from fx_polygons where xmin >= -2000050 and xmax <= 3000050 and ymin >= -1500050 and ymax <= 2500050")
def geom_within(spark, sf_dir):
    return relations.related(with_shapes(view(spark, sf_dir, "fx_polygons")), "within", _SHAPE).select("id")


@query("select landuse, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from fx_polygons group by landuse")
def bbox_union(spark, sf_dir):
    p = view(spark, sf_dir, "fx_polygons")
    return p.groupBy("landuse").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


#: Squares of 4 km whose corners lie on a grid of 2 km, so that every relation to one of them occurs.
_SQUARES = "(select id, cast(id % 9 as double) * 2000 as xmin, cast(floor(id / 9) % 9 as double) * 2000 as ymin, cast(id % 9 as double) * 2000 + 4000 + case when id % 2 = 0 then 4000 else 0 end as xmax, cast(floor(id / 9) % 9 as double) * 2000 + 4000 as ymax from fx_polygons)"
_EXACT = {
    "intersects": "xmin <= 12000 and xmax >= 8000 and ymin <= 10000 and ymax >= 6000",
    "touches": "xmin <= 12000 and xmax >= 8000 and ymin <= 10000 and ymax >= 6000 and not (xmin < 12000 and xmax > 8000 and ymin < 10000 and ymax > 6000)",
    "overlaps": "xmin < 12000 and xmax > 8000 and ymin < 10000 and ymax > 6000 and not (xmin >= 8000 and xmax <= 12000 and ymin >= 6000 and ymax <= 10000) and not (xmin <= 8000 and xmax >= 12000 and ymin <= 6000 and ymax >= 10000)",
    "equals": "xmin = 8000 and xmax = 12000 and ymin = 6000 and ymax = 10000",
    "disjoint": "not (xmin <= 12000 and xmax >= 8000 and ymin <= 10000 and ymax >= 6000)",
}


def _squares(spark, sf_dir):
    p = view(spark, sf_dir, "fx_polygons").select("id", (c("id") % 9 * 2000.0).alias("xmin"), (F.floor(c("id") / 9) % 9 * 2000.0).alias("ymin"))
    p = p.withColumns({"xmax": c("xmin") + 4000 + F.when(c("id") % 2 == 0, 4000).otherwise(0), "ymax": c("ymin") + 4000})
    return with_shapes(p)


def _exact(name, condition):
    @query(f"select id from {_SQUARES} where {condition}", name=f"filter_{name}_shape")
    def run(spark, sf_dir):
        text = "POLYGON((8000 6000, 12000 6000, 12000 8000, 12000 10000, 8000 10000, 8000 6000))"
        return _squares(spark, sf_dir).where(Filters({"id": "id"}).compile([name, text])).select("id")


for _n, _w in _EXACT.items():
    _exact(_n, _w)


@query(f"select id from {_SQUARES} where xmin < 16000 and xmax > 6000 and ymin < 5000 and ymax > 5000 and not (xmin <= 6000 and xmax >= 16000)")
def filter_crosses_line(spark, sf_dir):
    return _squares(spark, sf_dir).where(Filters({"id": "id"}).compile(["crosses", "LINESTRING(6000 5000, 16000 5000)"])).select("id")
