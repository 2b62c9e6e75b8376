"""Tile files: publishing on commit, insert or ignore, truncation, answers; options of requests; load counters."""

import os

import pytest
from pyspark.sql import functions as F

from gridlake.operators import options, store, vector
from gridlake.sources import tile_files

TILES = "z int, x int, y int, data binary"


def held(root):
    return {os.path.relpath(os.path.join(at, f), root) for at, _, files in os.walk(root) for f in files}


def test_files_are_published_once(spark, tmp_path):
    root = str(tmp_path / "tiles")
    tiles = spark.createDataFrame([(3, 1, 2, b"a"), (3, 1, 2, b"b"), (4, 0, 0, b""), (4, 9, 1, None)], TILES)
    tile_files.write_files(tiles, root, [F.col("data")])
    assert held(root) == {"3/1/2.png", "4/0/0.png", "4/9/1.png"}
    tile_files.write_files(spark.createDataFrame([(3, 1, 2, b"c"), (3, 1, 3, b"d")], TILES), root, [F.col("data")])
    rows = {(r.z, r.x, r.y): (r.length, bytes(r.data)) for r in tile_files.read_files(spark, root).collect()}
    assert rows == {(3, 1, 2): (1, b"a"), (3, 1, 3): (1, b"d"), (4, 0, 0): (0, b""), (4, 9, 1): (0, b"")}
    asked = spark.createDataFrame([(3, 1, 2), (4, 0, 0), (7, 7, 7)], "z int, x int, y int")
    found = tile_files.answers(asked, tile_files.read_files(spark, root, content=False))
    assert {(r.z, r.x, r.y): r.status for r in found.collect()} == {(3, 1, 2): 200, (4, 0, 0): 400, (7, 7, 7): 204}
    assert {r.z for r in tile_files.read_files(spark, root, [4, 12]).collect()} == {4}
    assert tile_files.read_files(spark, root, [12]).count() == 0 and tile_files.read_files(spark, root, ext="pbf").count() == 0
    assert tile_files.read_files(spark, str(tmp_path / "nothing")).count() == 0


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "tiles")
    bad = spark.range(8, numPartitions=4).select(F.lit(1).alias("z"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"x")).alias("data"))
    spark.dataSource.register(tile_files.TileFiles)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("tile_files").mode("append").option("path", root).save()
    assert not os.path.exists(root) or held(root) == set()


def test_save_goes_to_the_table_if_there_is_one(spark, tmp_path):
    table, root = str(tmp_path / "table"), str(tmp_path / "files")
    tiles = spark.createDataFrame([(1, 0, 0, b"a"), (1, 1, 0, b"b")], TILES)
    assert tile_files.save(tiles, table, root, [F.col("data")]) == "files" and len(held(root)) == 2
    tile_files.create_table(spark, table)
    assert tile_files.save(tiles, table, root, [F.col("data")]) == "table"
    assert tile_files.save(tiles, table, root, [F.col("data")]) == "table" and spark.read.parquet(table).count() == 2
    tile_files.truncate(spark, table, root)
    assert held(root) == set() and tile_files.is_table(spark, table) and spark.read.parquet(table).count() == 0
    assert tile_files.save(tiles, table, root, [F.col("data")]) == "table" and spark.read.parquet(table).count() == 2


def test_legacy_errors(spark):
    cases = {
        '{"verbose": true, "tile_size": 256, "zoom": [1, 2], "tiledriver": "PNG", "resampling": "med", "count_processes": 0}': set(),
        '{"verbose": 1, "tile_size": "256", "zoom": [1], "tiledriver": "jpg", "resampling": "x", "count_processes": 17}': {"verbose", "tile_size", "zoom", "tiledriver", "resampling", "count_processes"},
        '{"tile_size": null}': {"tile_size"}, "{}": set(), "[]": {"json"}, "": {"json"}, '{"a"': {"json"}, "3": {"json"},
    }
    df = spark.createDataFrame([*cases.items(), (None, None)] if False else [(k,) for k in [*cases, None]], "text string")
    found: dict = {}
    for r in options.legacy_errors(df, "text", 8).collect():
        found.setdefault(r.text, set()).add(r.error)
    assert found == {k: v for k, v in cases.items() if v} | {None: {"json"}}


def test_ids_and_texts_depend_on_values_alone(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "", 1), (None, "a", 1), ("a", None, 1)], "x string, y string, n int")
    rows = df.select(options.stable_id(F.col("x"), F.col("y")).alias("i"), options.sorted_text(df, ["y", "x", "n"]).alias("t")).collect()
    assert len({r.i for r in rows}) == 3 and rows[0] == rows[3] and rows[0].t == '{"n":1,"x":"a","y":null}'


def test_counters_come_with_the_write(spark, tmp_path):
    rows = [("a", 1, 2, "vector", None, None), ("b", 3, 2, "vector", None, None), (None, 0, 30, "x", "h", None)]
    df = spark.createDataFrame(rows, "identifier string, minzoom int, maxzoom int, data_type string, host string, port int")
    counts = store.write_good(df, str(tmp_path / "good"))
    assert counts == {"rows": 3, "good": 1, "zoom order": 1, "zoom range": 1, "data type": 1, "host without port": 1, "identifier": 1}
    assert [r.identifier for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"]


def test_a_world_wide_feature_is_dealt_over_tasks(spark):
    world = spark.createDataFrame([(1, -2.1e7, -2.1e7, 2.1e7, 2.1e7)], "id int, xmin double, ymin double, xmax double, ymax double")
    cover = vector.tile_cover(world, (10,), spread=65_536)
    counts = [r.n for r in cover.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 4**10 and len(counts) > 1 and max(counts) < 4**10


def test_numbers_of_a_group_that_holds_most_rows(spark):
    rows = [("hot" if i % 10 else None, (i * 7919) % 5003) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, seq int").repartition(7)
    numbered = store.numbered(df, ["g"], ["seq"])
    found = {(r.g, r.seq): r.number for r in numbered.collect()}
    for g in ("hot", None):
        ordered = sorted(s for k, s in rows if k == g)
        assert [found[g, s] for s in ordered] == list(range(len(ordered)))
    batches = store.batched(df, 100, ["g"], ["seq"]).groupBy("g", "batch").count().collect()
    assert {r["count"] for r in batches} == {100} and len(batches) == 50
    assert store.dealt(df.limit(0), 3, ["g"], ["seq"]).count() == 0


def test_prepared_assets_of_a_folder(spark, tmp_path):
    from gridlake.sources import datasources

    for name in ("a_WARP_TR_OV.tif", "b_warp_tr_ov.TIFF", "c_WARP_TR_OV.tif.ovr", "d.tif", "e_FIRST_warp_tr_ov.tif"):
        (tmp_path / name).write_bytes(b"x")
    assert {r.name for r in datasources.warped_assets(spark, str(tmp_path)).collect()} == {"a_WARP_TR_OV.tif", "b_warp_tr_ov.TIFF"}
