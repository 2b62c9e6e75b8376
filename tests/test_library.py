import gzip
import json
import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlake.functions import encoding, grid, png, tags
from gridlake.operators import geometry, mvt, raster, store, vector, relations
from gridlake.plans.filters import Filters, like_pattern
from gridlake.queries import rasters, vectors
from gridlake.sources import datasources
from gridlake.sources.derived import view
from gridlake.streaming import tracking

c = F.col


def values(spark, *columns):
    row = spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(columns))).first()
    return tuple(row)


# grid: constants computed from the formulas


@pytest.mark.parametrize("lat, lon, z, tile, y, key", [(55.755829, 37.617627, 5, (19, 21), 10, "12031"), (55.755829, 37.617627, 11, (1238, 1407), 640, "12031010110"), (44.798176, 20.45676, 11, (1140, 1309), 738, "12023310120"), (0, 0, 5, (15, 15), 16, "21111"), (85, -179.9, 11, (0, 2044), 3, "00000000022")])
def test_tile_of_a_point(spark, lat, lon, z, tile, y, key):
    mx, my = grid.lonlat_to_meters(F.lit(float(lon)), F.lit(float(lat)))
    tx, ty = grid.meters_to_tile(mx, my, F.lit(z))
    assert values(spark, tx, ty, grid.flip_y(ty, F.lit(z)), grid.quadkey(tx, ty, F.lit(z))) == (*tile, y, key)


def test_meters_round_trip(spark):
    mx, my = grid.lonlat_to_meters(F.lit(37.617627), F.lit(55.755829))
    x, y, lon, lat = values(spark, mx, my, *grid.meters_to_lonlat(mx, my))
    assert x == pytest.approx(4187575.082491) and y == pytest.approx(7509960.879222) and (lon, lat) == pytest.approx((37.617627, 55.755829))


@pytest.mark.parametrize("size, zoom", [(200000.0, 0), (156543.03392804062, 0), (100.0, 10), (30.0, 12), (10.0, 13), (1.0, 17), (0.5, None)])
def test_zoom_for_pixel_size(spark, size, zoom):
    assert values(spark, grid.zoom_for_pixel_size(F.lit(size), grid.mercator_resolutions())) == (zoom,)


def test_strides(spark):
    up = [grid.stride(F.lit(a), F.lit(b)) for a, b in ((10, 17), (10, 16), (10, 10))]
    down = [grid.stride_down(F.lit(a), F.lit(b)) for a, b in ((17, 9), (10, 9))]
    assert values(spark, *up, *down) == ([10, 13, 16, 17], [10, 13, 16], [10], [17, 14, 11, 9], [10, 9])


def test_envelope_and_tolerance(spark):
    env = values(spark, *grid.tile_envelope(F.lit(17), F.lit(11), F.lit(5)))
    assert env == pytest.approx((1252344.2714243233, 5009377.085697301, 2504688.5428486504, 6261721.357121624))
    assert vector.envelope(5, 17, 11) == pytest.approx(env)
    assert values(spark, *(grid.simplify_tolerance(F.lit(z)) for z in (12, 14, 0, 5, 11))) == pytest.approx((2.388657133911758, 0.5971642834779395, 156543.03392804097, 4891.96981025128, 76.43702828517625))


def test_powers_of_two_are_exact(spark):
    rows = spark.range(-60, 61).select("id", encoding.floor_log2(F.pow(F.lit(2.0), c("id"))).alias("f"), grid.ceil_log2(F.pow(F.lit(2.0), c("id"))).alias("c")).collect()
    assert all(r.id == r.f == r.c for r in rows)


def test_cover_of_a_box_is_every_tile_it_meets(spark):
    rng = random.Random(1)
    boxes = [(i, *(x := (rng.uniform(-2e7, 1.9e7), rng.uniform(-2e7, 1.9e7))), x[0] + rng.uniform(0, 4e6), x[1] + rng.uniform(0, 4e6)) for i in range(40)]
    df = spark.createDataFrame(boxes + [(99, None, None, None, None)], "id long, xmin double, ymin double, xmax double, ymax double")
    got = {(r.id, r.z, r.x, r.y) for r in vector.tile_cover(df, (0, 3, 4)).collect()}
    expected = set()
    for i, x0, y0, x1, y1 in boxes:
        for z in (0, 3, 4):
            for x in range(2**z):
                for y in range(2**z):
                    e = vector.envelope(z, x, y)
                    if x0 < e[2] and x1 >= e[0] and y0 <= e[3] and y1 > e[1]:
                        expected.add((i, z, x, y))
    assert got == expected
    for spread in (1, 20):
        assert sorted((r.id, r.z, r.x, r.y) for r in vector.tile_cover(df, (0, 3, 4), spread=spread).collect()) == sorted(expected)
    world = spark.createDataFrame([(-2e7, -2e7, 2e7, 2e7)], "xmin double, ymin double, xmax double, ymax double")
    assert vector.tile_cover(world, (9,)).count() == vector.tile_cover(world, (9,), spread=1000).count() == 4**9
    with pytest.raises(Exception, match="too many tiles"):
        vector.tile_cover(df, (12,), max_tiles=10).collect()


# encoding


@pytest.mark.parametrize("v, rgba", [(0.0, (128, 0, 0, 128)), (1.0, (128, 0, 1, 128)), (-1.0, (127, 255, 255, 128)), (2.0, (128, 0, 1, 129)), (0.5, (128, 0, 1, 127)), (-85.5, (84, 255, 255, 134)), (-110.25, (35, 127, 255, 134)), (100.0, (200, 0, 1, 134)), (3.14159, (201, 15, 208, 129)), (0.001, (131, 18, 111, 118)), (65536.0, (128, 0, 1, 144)), (-999999.0, (0, 0, 0, 0))])
def test_float_as_rgba(spark, v, rgba):
    parts = encoding.float_to_rgba(F.lit(v), -999999.0)
    assert values(spark, *parts) == rgba
    back = values(spark, encoding.rgba_to_float(*(F.lit(x) for x in rgba)))[0]
    assert back is None if v == -999999 else back == pytest.approx(v, rel=2**-21)


def test_png_round_trip(spark):
    image = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert (png.read_png(png.png(image)) == image).all()
    rows = spark.createDataFrame([(1, 0, 0, 0, 0, 9, 8, 7, 255), (1, 0, 0, 1, 1, 1, 2, 3, 4)], "z int, x int, y int, px int, py int, r int, g int, b int, a int")
    tile = png.read_png(png.render_tiles(rows, 2).first()["data"])
    assert tile.tolist() == [[[9, 8, 7, 255], [0, 0, 0, 0]], [[0, 0, 0, 0], [1, 2, 3, 4]]]


def rgba(v):
    if v is None:
        return 0, 0, 0, 0
    e = math.floor(math.log2(abs(v))) if v else 0
    sign = (v > 0) - (v < 0)
    m = 8388608 + sign + sign * 8388608 * (abs(v) / 2**e - 1)
    return int(m // 65536), int(m % 65536 // 256), int(m % 256), e + 128


def test_render_png_draws_every_cell_and_asset(spark, tmp_path):
    rng = np.random.default_rng(6)
    vectors = [(i, (rng.integers(-20000, 20000, 64) / 100000).tolist(), i % 10) for i in range(20)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.cell, r.asset): bytes(r.data) for r in rasters.render_png(spark, str(tmp_path)).collect()}
    assert len(got) == 20
    for i, vector_, label in vectors:
        ints = [math.floor(x * 100000 + 0.5) for x in vector_]
        image = np.array([rgba(None if n < -15000 else float(n)) for n in ints], np.uint8).reshape(8, 8, 4)
        assert got[label, i] == png.png(image)


# filters


def test_filters_reject_mistakes():
    f = Filters({"a": "a"})
    for bad in (["==", ["get", "b"], 1], ["nothing", 1], ["all"], ["!", True, False], ["==", "a"], [], [1, 2], ["like", "a"]):
        with pytest.raises(ValueError):
            f.compile(bad)
    assert like_pattern("*x.y", "*") == "%x_y"


def test_filters_on_rows(spark):
    df = spark.createDataFrame([(1, "yes", 3), (2, None, 5), (3, "no'; drop", None)], "id int, kind string, level int")
    f = Filters({"k": "kind", "level": "level"}, cast_types=True)
    ids = lambda e: [r.id for r in df.where(f.compile(e)).orderBy("id").collect()]
    assert ids(["!=", ["get", "k"], "yes"]) == [3]
    assert ids(["==", "k", "no'; drop"]) == [3]
    assert ids(["any", ["!has", "level"], [">", ["^", ["get", "level"], 2], 20]]) == [2, 3]
    assert ids(["==", ["to-number", ["to-string", ["get", "level"]]], 3.0]) == [1]


def test_tag_operations(spark):
    df = spark.createDataFrame([('{"height":"7 m","building":"yes"}',), ('{"building:levels":"3","layer":"-1","building:part":"x"}',), ("{}",)], "tags string")
    t = c("tags")
    got = df.select(tags.extrusion_height(t), tags.extrusion_base(t), tags.is_building(t), tags.no_tags(t)).collect()
    assert [tuple(r) for r in got] == [(6.0, 0.0, True, False), (9.0, 0.0, False, False), (6.0, 0.0, False, True)]


# vector tiles


def test_mvt_primitives():
    assert [mvt.zigzag(n) for n in (0, -1, 1, 25, 17, -17, 4096)] == [0, 1, 2, 50, 34, 33, 8192]
    assert (mvt.command(mvt.MOVE, 1), mvt.command(mvt.LINE, 2), mvt.command(mvt.CLOSE, 1)) == (9, 18, 15)
    assert mvt.geometry_commands((1, [np.array([[25.0, 17.0]])])) == [9, 50, 34]
    assert mvt.geometry_commands((3, [np.array([[3.0, 6], [8, 12], [20, 34]])])) == [9, 6, 12, 18, 10, 12, 24, 44, 15]


def test_mvt_layer_round_trip():
    features = [(7, (1, [np.array([[1.0, 2.0]])]), {"a": "x", "n": 5, "m": -3, "f": 1.5, "t": True, "none": None}), (None, (2, [np.array([[0.0, 0], [5, 5], [9, 2]])]), {"a": "x"})]
    layer = mvt.decode_tile(mvt.encode_layer("roads", features))["roads"]
    assert layer["version"] == 2 and layer["extent"] == 4096
    assert layer["features"][0]["attributes"] == {"a": "x", "n": 5, "m": -3, "f": 1.5, "t": True}
    assert layer["features"][0]["id"] == 7 and layer["features"][1]["id"] is None and layer["features"][1]["type"] == 2
    assert mvt.encode_layer("empty", []) == b""


def test_tiles_of_shapes(spark):
    square = lambda x, y, h: geometry.write((3, [np.array([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)])]))
    rows = [(i, bytearray(square(x, y, 3e5)), x - 3e5, y - 3e5, x + 3e5, y + 3e5, k) for i, x, y, k in ((1, 0.0, 0.0, "a"), (2, 5e6, 5e6, None), (3, 5.1e6, 5e6, "b"))]
    df = spark.createDataFrame(rows, "id long, wkb binary, xmin double, ymin double, xmax double, ymax double, kind string")
    made = mvt.tiles(df, (1, 4), "squares", ("kind",), buffer=0)
    got = {(r.z, r.x, r.y): mvt.decode_tile(bytes(r.data))["squares"]["features"] for r in made.collect()}
    assert {k for k in got if k[0] == 1} == {(1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1)}
    assert sorted(f["id"] for f in got[1, 1, 0]) == [1, 2, 3]
    assert [f["attributes"] for f in sorted(got[1, 1, 0], key=lambda f: f["id"])] == [{"kind": "a"}, {}, {"kind": "b"}]
    both = mvt.concat_layers([made, made.withColumn("data", F.lit(b"!"))])
    packed = mvt.compressed(mvt.compressed(both)).first()
    assert packed["data"][:2] == b"\x1f\x8b"


def test_mvt_concat_holds_every_feature(spark, tmp_path):
    orders = [(i, "FOP"[i % 3], 1000.0 * i) for i in range(1, 81)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    boxes = {r.id: r for r in view(spark, str(tmp_path), "fx_polygons").collect()}
    found = {"land": set(), "aero": set()}
    for r in vectors.mvt_concat(spark, str(tmp_path)).collect():
        layers = mvt.decode_tile(gzip.decompress(bytes(r.data)))
        x0, y0, x1, y1 = vector.envelope(r.z, r.x, r.y)
        for name, layer in layers.items():
            for f in layer["features"]:
                b = boxes[f["id"]]
                assert b.xmin < x1 + 2e4 and b.xmax > x0 - 2e4 and b.ymin < y1 + 2e4 and b.ymax > y0 - 2e4
                assert f["attributes"] == {k: v for k in ("building", "landuse", "admin_level") if (v := b[k]) is not None}
                found[name].add((f["id"], r.x, r.y))
    for name, column in (("land", "landuse"), ("aero", "aeroway")):
        tile = lambda v: math.floor((v + 20037508.342789244) / (40075016.68557849 / 128))
        inside = {(i, x, 127 - y) for i, b in boxes.items() if b[column] is not None for x in range(tile(b.xmin), tile(b.xmax) + 1) for y in range(tile(b.ymin), tile(b.ymax) + 1)}
        assert inside <= found[name] and {i for i, _, _ in found[name]} == {i for i, b in boxes.items() if b[column] is not None}


def test_areas_are_drawn_together_as_they_are_alone():
    rng, areas, envelopes = np.random.default_rng(5), [], []
    for case in range(400):
        angle = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(1, 20))))
        ring = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(0.2, 3, len(angle))[:, None] * 10.0 ** rng.integers(-5, 3)
        ring = ring[::-1] if case % 3 else ring
        ring = np.concatenate([ring, ring[:1]]) if case % 4 else ring
        areas.append([[ring], [ring, ring * 0.3, ring * 0.001, ring[::-1] * 0.1 + 0.2], [], [np.array([(0.0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]][case % 7 % 4])
        envelopes.append((*(low := rng.uniform(-1, 1, 2)), *(low + rng.uniform(0.1, 2))))
    drawn = [mvt.to_tile((3, rings), env) for rings, env in zip(areas, envelopes, strict=True)]
    wanted = [d and mvt.geometry_fields(d) for d in drawn]
    assert 100 < sum(w is None for w in wanted) < 300
    assert mvt.area_fields(areas, np.array(envelopes)) == wanted
    assert mvt.area_fields([], np.zeros((0, 4))) == [] and mvt.area_fields([[]], np.zeros((1, 4))) == [None]


def test_tiles_draw_areas_of_a_batch_in_one_call(spark, monkeypatch):
    """Drawing one by one is left to points and lines; a shape is made once, not for large features again."""
    square = geometry.write((3, [np.array([(0.0, 0), (9e4, 0), (9e4, 9e4), (0, 9e4), (0, 0)])]))
    made = F.udf(lambda i: square, "binary")
    boxes = spark.range(20).selectExpr("id", "id * 1e3 as xmin", "id * 1e3 as ymin", "id * 1e3 + 9e4 as xmax", "id * 1e3 + 9e4 as ymax").withColumn("wkb", made("id"))
    plan = mvt.tiles(boxes, (6, 8), "a")._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("BatchEvalPython")  # one for each of the two ways of large and small features
    assert len(below) == 3 and "65536" in below[-1]
    monkeypatch.setattr(mvt, "to_tile", None)  # not called for areas
    assert mvt.area_fields([geometry.read(square)[1]] * 3, np.array([vector.envelope(8, 128, 127)] * 3))[2] is not None


def test_geometry():
    ring = np.array([(0.0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
    area = (3, [ring])
    for shape in (area, (1, [np.array([[1.0, 2.0]])]), (2, [ring[:3]]), (2, [ring[:2], ring[2:]])):
        kind, parts = geometry.read(geometry.write(shape))
        assert kind == shape[0] and all((a == b).all() for a, b in zip(parts, shape[1]))
    assert geometry.type_name(geometry.write(area)) == "ST_Polygon" and geometry.type_name(struct.pack(">BI2d", 0, 1, 1, 2)) == "ST_Point"
    assert geometry.contains_points([ring], np.array([[1.0, 1], [5, 1]])).tolist() == [True, False]
    other = (3, [ring + 2])
    true = lambda name, a, b: bool(relations.holds(name, relations.matrix(a, b), a[0], b[0]))
    assert true("intersects", area, other) and not true("intersects", area, (3, [ring + 9]))
    assert true("within", (3, [ring / 4 + 1]), area) and not true("within", other, area)
    assert true("intersects", (3, [ring / 4 + 1]), area)
    clipped = geometry.clip_ring(ring[:-1], np.array([2.0, 2]), np.array([9.0, 9]))
    assert abs(geometry.area(clipped)) == 4
    assert [p.tolist() for p in geometry.clip_line(np.array([(-1.0, 1), (5, 1)]), np.zeros(2), np.full(2, 4.0))] == [[[0, 1], [4, 1]]]
    assert len(geometry.simplify(np.array([(0.0, 0), (1, 0.01), (2, 0), (3, 3)]), 0.1)) == 3


# raster


def test_interpolation_keeps_a_constant_and_fills_the_grid(spark):
    px = spark.createDataFrame([(x, y, 7) for x in range(4) for y in range(4)], "px int, py int, iv long")
    for kernel in raster.WEIGHTS:
        got = raster.interpolate(px, 3, kernel).collect()
        assert len(got) == 144 and all(abs(r.value - 7) < 1e-9 for r in got)
    with pytest.raises(ValueError):
        raster.resample(px, 2, "sharp")
    with pytest.raises(ValueError):
        raster.select_pixels(px, "best", ("px",))
    with pytest.raises(ValueError):
        raster.merge_pixels(px, "median", ("px",))


# store, sources, streams


def test_append_tiles_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/tiles"
    rows = spark.createDataFrame([(0, 0, 0, 2, "b"), (0, 0, 0, 1, "a"), (1, 1, 0, 3, "c")], "z int, x int, y int, seq int, data string")
    store.append_tiles(rows, path, [c("seq")])
    store.append_tiles(rows.withColumn("data", F.lit("late")), path, [c("seq")])
    got = sorted((r.z, r.x, r.y, r.data) for r in spark.read.parquet(path).collect())
    assert got == [(0, 0, 0, "a"), (1, 1, 0, "c")]
    assert store.lookup(spark.read.parquet(path), 1, 1, 0).first().data == "c"


def test_datasource_documents(spark, tmp_path):
    base = {"type": "vector", "dataStore": {"type": "internal", "store": "internal"}, "minzoom": 0, "maxzoom": 14, "bounds": {"lng_w": -10, "lat_s": -10, "lng_e": 10, "lat_n": 10}, "center": [0, 0, 3]}
    docs = {"good": {**base, "id": "good"}, "zoom": {**base, "id": "zoom", "minzoom": 15}, "center": {**base, "id": "center", "center": [50, 0]}, "raster": {"id": "raster", "type": "raster", "dataStore": {"store": "internal", "file": "a.tif"}}, "both": {"id": "both", "type": "raster", "dataStore": {"store": "internal", "file": "a.tif", "folder": "b"}}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text("{nope")
    (tmp_path / "readme.txt").write_text("x")
    read = datasources.read_documents(spark, str(tmp_path))
    errors = {(r.path.split("/")[-1], r.error) for r in datasources.document_errors(read).collect()}
    assert errors == {("zoom.json", "zoom"), ("center.json", "center in bounds"), ("both.json", "raster file"), ("broken.json", "json")}
    rows = datasources.catalog_rows(read)
    assert sorted((r.identifier, r.maxzoom) for r in rows.collect()) == [("good", 14), ("raster", 13)]
    catalog = spark.createDataFrame(rows.where("identifier = 'good'").withColumn("name", F.lit("old")).collect(), rows.schema)
    names = lambda df: sorted((r.identifier, r.name) for r in df.collect())
    assert names(datasources.loaded(catalog, rows)) == [("good", "old"), ("raster", None)]
    assert names(datasources.loaded(catalog, rows, ["good"])) == [("good", None), ("raster", None)]
    assert names(datasources.deleted(catalog, "good")) == []
    layers = datasources.layers_of({"layers": [{"id": "l", "storeLayer": "t", "fields": [{"name": "a", "name_in_db": "b"}], "filter": ["has", "a"]}]})
    assert datasources.missing_columns(spark.createDataFrame([(1.0, 2.0)], "xmin double, ymin double"), layers[0]) == ["xmax", "ymax", "b"]
    with pytest.raises(ValueError):
        datasources.layers_of({"layers": [{"id": "l", "fields": [{"name": "a"}], "filter": ["has", "z"]}]})


def test_raster_assets(spark, tmp_path):
    for n in ("a.tif", "b.TIFF", "a.tif.ovr", "a_warp_tr_ov.tif", "all_MEAN.tif", "x.png"):
        (tmp_path / n).write_bytes(b"0")
    assert sorted(r.name for r in datasources.raster_assets(spark, str(tmp_path)).collect()) == ["a.tif", "b.TIFF"]


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"device": [1, 1, 2, 1], "ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:04", "2024-01-01 00:02", "2024-01-01 00:07"]), "x": [1.0, 2, 3, 4], "y": [5.0, 6, 7, 8], "z": [0] * 4, "seq": range(4)})
    spark.createDataFrame(rows).withColumn("z", c("z").cast("int")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    last = tracking.last_positions(stream(), "device", "ts", ("x",))
    q = last.writeStream.format("memory").queryName("last_pos").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.device, r.x) for r in spark.table("last_pos").collect()) == [(1, 4.0), (2, 3.0)]
    q = tracking.tracks(stream(), "device", "ts", "x", "y").writeStream.format("memory").queryName("tracks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.device, len(r.line)) for r in spark.table("tracks").collect()) == [(1, 1), (1, 2), (2, 1)]
    tiles = stream().select("z", c("x").cast("int").alias("x"), c("y").cast("int").alias("y"), "seq")
    for n in (1, 2):
        tracking.tile_sink(tiles, f"{tmp_path}/tiles", f"{tmp_path}/ck{n}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/tiles").count() == 4


def test_exact_relations_of_areas():
    read = geometry.from_text
    square, right = read("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), read("POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))")
    ring, hole = read("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"), read("POLYGON((3 3, 6 3, 6 6, 3 6, 3 3))")
    twice, corner = read("SRID=3857;POLYGON((0 0, 2 0, 4 0, 4 4, 0 4, 0 2, 0 0))"), read("POLYGON((4 4, 6 4, 6 6, 4 4))")
    triangle, wide = read("POLYGON((2 -2, 6 2, 2 6, 2 -2))"), read("POLYGON((-1 1, 5 1, 5 3, -1 3, -1 1))")
    true = lambda a, b: {n for n in ("touches", "overlaps", "equals", "crosses") if relations.holds(n, relations.matrix(a, b), a[0], b[0])}
    assert true(square, right) == true(ring, hole) == true(square, corner) == {"touches"}
    assert true(square, twice) == {"equals"}
    assert true(square, triangle) == true(square, wide) == {"overlaps"}
    assert true(square, read("POLYGON((1 1, 2 1, 2 2, 1 1))")) == true(square, read("POLYGON((9 9, 10 9, 10 10, 9 9))")) == set()
    assert true(read("LINESTRING(-1 2, 5 2)"), square) == true(square, read("LINESTRING(1 1, 1 9)")) == {"crosses"}
    assert true(read("LINESTRING(1 1, 2 2)"), square) == set()
    assert geometry.contains_points(ring[1], np.array([[1.0, 1], [4, 4], [10, 1]])).tolist() == [True, False, False]


def test_rules_of_requests():
    from gridlake.operators import profile

    assert set(profile.pyramid_checks(4)) == {"resampling", "resampling_warp", "tiledriver", "tile_size", "count_processes", "zoom", "pixel_selection_method"}


def test_base_tile_of_a_rotated_raster_is_an_error(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.5, 0.0, 0.0, -1.0],)], "gt array<double>")
    with pytest.raises(Exception, match="rotated"):
        df.select(*grid.bounds_of_geotransform(F.col("gt"), F.lit(10), F.lit(10))).collect()


def test_load_counts_of_a_group_named_like_a_check(spark):
    df = spark.createDataFrame([("vector", 1, 2, None, None, "a"), ("raster", 3, 2, None, None, ""), ("other", 1, 25, None, None, "b")], "data_type string, minzoom int, maxzoom int, host string, port int, identifier string")
    counts = store.load_counts(df, ("data_type",))
    assert counts.columns == ["data_type", "rows", "good", "zoom_order", "zoom_range", "data_type_1", "host_without_port", "identifier"]
    assert sorted(map(tuple, counts.collect())) == [("other", 1, 0, 0, 1, 1, 0, 0), ("raster", 1, 0, 1, 0, 0, 0, 1), ("vector", 1, 1, 0, 0, 0, 0, 0)]


def test_interpolation_where_weights_cancel_out_has_no_value(spark):
    held = {(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3), (2, 0), (2, 3), (3, 0), (3, 1)}
    px = spark.createDataFrame([(x, y, 7 if (x, y) in held else None) for x in range(4) for y in range(4)], "px int, py int, iv int")
    got = {(r["px"], r["py"]): r["value"] for r in raster.interpolate(px, 2, "cubic").collect()}
    assert len(got) == 64 and got[3, 3] is None and got[0, 2] == pytest.approx(7)


def test_tiles_near_assets_come_from_one_row_a_cell(spark):
    rng = random.Random(3)
    side = grid.WORLD_EDGE / 16
    boxes = [(m, x, y, x + rng.uniform(1, 6) * side, y + rng.uniform(1, 6) * side) for m in (0, 1) for x, y in ((rng.uniform(-1, 0.7) * grid.WORLD_EDGE, rng.uniform(-1, 0.7) * grid.WORLD_EDGE) for _ in range(4))]
    plan = spark.createDataFrame([(m, z, x, y) for m in (0, 1) for z in (4, 5) for x in range(2**z) for y in range(2**z)], "m int, z int, tx int, ty int")
    assets = spark.createDataFrame(boxes, "m int, minx double, miny double, maxx double, maxy double")
    near = raster.tiles_with_assets(plan, assets, (4, 5), ("m",))
    ranges = assets.crossJoin(spark.createDataFrame([(4,), (5,)], "z int")).select("m", "z", *grid.tile_range(*map(c, ("minx", "miny", "maxx", "maxy")), c("z"))).collect()
    meets = lambda m, z, x, y: any((m, z) == r[:2] and r[2] - 1 <= x <= r[4] + 1 and r[3] - 1 <= y <= r[5] + 1 for r in ranges)
    assert sorted(map(tuple, near.collect())) == sorted(tuple(r) for r in plan.collect() if meets(*r))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_zoom_ranges_broadcast_nothing(spark):
    from gridlake.operators import pyramid

    plan = spark.createDataFrame([(1, 4, 2, 3), (1, 4, 5, 1), (1, 6, 7, 7), (2, 3, 0, 0)], "id int, z int, tx int, ty int")
    got = pyramid.zoom_ranges(plan, "id")
    assert got.columns == ["id", "z", "tminx", "tminy", "tmaxx", "tmaxy", "tminz", "tmaxz"]
    assert sorted(map(tuple, got.collect())) == [(1, 4, 2, 1, 5, 3, 4, 6), (1, 6, 7, 7, 7, 7, 4, 6), (2, 3, 0, 0, 0, 0, 3, 3)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_large_tile_is_decoded_feature_by_feature(spark):
    import tracemalloc

    body, drawn = mvt.LayerBody(), mvt.geometry_fields((3, [np.array([(0, 0), (9, 0), (9, 9), (0, 9)])]))
    for i in range(12_000):
        body.add(i, drawn, [("kind", "road"), ("n", i % 5)])
    data = body.layer("big", 4096)

    def peak(work):
        tracemalloc.start()
        n = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most

    (n, one), (m, all_) = peak(lambda: sum(1 for _ in mvt.features_of(data))), peak(lambda: len(mvt.decode_tile(data)["big"]["features"]))
    assert n == m == 12_000 and one < all_ / 5
    rows = mvt.decoded(spark.createDataFrame([(1, 0, 0, bytearray(data))], "z int, x int, y int, data binary"))
    assert rows.select("id").distinct().count() == 12_000 > mvt.DECODED


def test_pixels_of_many_images_make_one_table():
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (n % 3 + 1, 8, 4), dtype=np.uint8) for n in range(300)]
    tables = list(png.pixels_of(pd.DataFrame({"cell": range(300), "data": [png.png(m) for m in images]}), ("cell",)))
    assert len(tables) == 1
    rows = tables[0]
    for n, image in enumerate(images):
        own = rows[rows["cell"] == n]
        assert (image[own["py"], own["px"]] == own[list("rgba")].to_numpy()).all() and len(own) == image.shape[0] * 8
