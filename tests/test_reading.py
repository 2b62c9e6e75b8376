"""The raster read path: windows against a plain reading of whole arrays, neighbourhoods, mosaics, levels and stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import grid
from gridlake.operators import merging, preparing, reading

SCHEMA = "asset int, left double, top double, res double, width int, height int, block int, degrees boolean, asset_ord int"
RASTERS = [(1, 0.0, 100_000.0, 700.0, 45, 37, 8, False, 1), (2, -20_000.0, 90_000.0, 1300.0, 20, 61, 8, False, 2), (3, 0.05, 0.85, 0.011, 51, 33, 8, True, 3)]
DEGREES_A_METRE = 180.0 / grid.ORIGIN_SHIFT


def arrays(seed=0, holes=0.2):
    rng = np.random.default_rng(seed)
    out = {}
    for asset, _, _, _, w, h, *_ in RASTERS:
        a = np.round(rng.normal(size=(h, w)) * 100)
        a[rng.random((h, w)) < holes] = np.nan
        out[asset] = a
    return out


def tables(spark, data):
    rows = []
    for asset, *_, size, _, _ in RASTERS:
        a = data[asset]
        for by in range(0, a.shape[0], size):
            for bx in range(0, a.shape[1], size):
                part = a[by : by + size, bx : bx + size].ravel()
                rows.append((asset, bx // size, by // size, [None if np.isnan(v) else float(v) for v in part]))
    return spark.createDataFrame(RASTERS, SCHEMA), spark.createDataFrame(rows, "asset int, bx int, by int, values array<double>").repartition(4)


def plain(raster, a, box, cols, rows, kernel):
    """Window of one raster, pixel by pixel over the whole array."""
    asset, left, top, res, w, h, _, degrees, _ = raster
    x0, y0, x1, y1 = box
    lat = lambda y: 180 / np.pi * (2 * np.arctan(np.exp(y / grid.ORIGIN_SHIFT * np.pi)) - np.pi / 2)
    at_x = (lambda x: (x * DEGREES_A_METRE - left) / res) if degrees else (lambda x: (x - left) / res)
    at_y = (lambda y: (top - lat(y)) / res) if degrees else (lambda y: (top - y) / res)
    sx, wx = reading.positions(x0, x1, cols, at_x)
    sy, wy = reading.positions(y1, y0, rows, at_y)
    ax, ay = reading.axis_weights(kernel, sx, wx, 0, w, w), reading.axis_weights(kernel, sy, wy, 0, h, h)
    out = {}
    for j in range(rows):
        for i in range(cols):
            weights = ay[j][:, None] * ax[i][None, :]
            on = (weights != 0) & ~np.isnan(a)
            total = weights[on].sum()
            if kernel in ("min", "max"):
                on = (ay[j][:, None] > 0) & (ax[i][None, :] > 0) & ~np.isnan(a)
                if on.any():
                    out[i, j] = a[on].min() if kernel == "min" else a[on].max()
            elif abs(total) > 1e-9:
                v = (weights[on] * (a[on] ** 2 if kernel == "rms" else a[on])).sum() / total
                out[i, j] = np.sqrt(v) if kernel == "rms" else v
    return out


@pytest.mark.parametrize("kernel", list(reading.REACH))
def test_windows_agree_with_whole_arrays(spark, kernel):
    data = arrays()
    rasters, blocks = tables(spark, data)
    boxes = [(1, -5_000.0, 60_000.0, 30_000.0, 95_000.0, 13, 11), (2, 3_000.0, 88_000.0, 9_000.0, 91_500.0, 9, 7), (3, -1e6, -1e6, 1e6, 1e6, 5, 5), (4, 2e6, 2e6, 3e6, 3e6, 4, 4)]
    windows = spark.createDataFrame(boxes, "id int, xmin double, ymin double, xmax double, ymax double, cols int, rows int")
    found = {}
    for r in reading.read_windows(windows, rasters, blocks, ("id",), kernel).collect():
        found.setdefault((r.id, r.asset), {})[r.px, r.py] = r.value
    for w, *box, cols, rows in boxes:
        for raster in RASTERS:
            wanted = plain(raster, data[raster[0]], box, cols, rows, kernel)
            got = found.get((w, raster[0]), {})
            assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-6 for k in wanted), (w, raster)


def test_neighbourhoods_equal_single_tiles(spark):
    rasters, blocks = tables(spark, arrays())
    tiles = spark.createDataFrame([(10, 511, 509), (10, 513, 510), (1, 0, 0), (0, 0, 0)], "z int, x int, y int")
    around = tiles.collect()
    every = spark.createDataFrame({(t.z, t.x + i, t.y + j) for t in around for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= t.x + i < 2**t.z and 0 <= t.y + j < 2**t.z}, "z int, x int, y int")
    for kernel in ("nearest", "bilinear"):
        single = {}
        for r in reading.read_tiles(every, rasters, blocks, 16, kernel).collect():
            single.setdefault((r.z, r.x, r.y), set()).add((r.asset, r.px, r.py, round(r.value, 6)))
        meta = {}
        for r in reading.read_meta_tiles(tiles, rasters, blocks, 16, kernel).collect():
            meta.setdefault((r.z, r.x, r.y), {}).setdefault((r.z, r.tile_x, r.tile_y), set()).add((r.asset, r.px, r.py, round(r.value, 6)))
        for t in around:
            wanted = {(t.z, t.x + i, t.y + j): single[t.z, t.x + i, t.y + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (t.z, t.x + i, t.y + j) in single}
            assert meta.get((t.z, t.x, t.y), {}) == wanted


def test_neighbourhoods_beyond_the_grid(spark):
    edge = grid.WORLD_EDGE
    side = 2 * edge / 2**10
    placed = [(1, 0.0, -edge + 1.5 * side, side / 8, 8, 40, 8, False, 1), (2, -edge - side, 0.0, side / 8, 24, 8, 8, False, 2), (3, 0.0, 86.0, 0.05, 8, 40, 8, True, 3)]
    rasters = spark.createDataFrame(placed, SCHEMA)
    cells = [(asset, bx, by, [float(1000 * by + 100 * bx + i) for i in range(64)]) for asset, *_, w, h, _, _, _ in placed for bx in range(w // 8) for by in range(h // 8)]
    blocks = spark.createDataFrame(cells, "asset int, bx int, by int, values array<double>")
    tiles = [(10, 512, 1022), (10, 512, 1023), (10, 512, 1024), (10, 512, 1026), (10, 513, 1030), (10, 0, 512), (10, -1, 511), (10, 512, 0)]
    around = sorted({(z, x + i, y + j) for z, x, y in tiles for i in (-1, 0, 1) for j in (-1, 0, 1)})
    single, found = {}, {}
    for r in reading.read_tiles(spark.createDataFrame(around, "z int, x int, y int"), rasters, blocks, 4).collect():
        single.setdefault((r.z, r.x, r.y), set()).add((r.asset, r.px, r.py, r.value))
    for r in reading.read_meta_tiles(spark.createDataFrame(tiles, "z int, x int, y int"), rasters, blocks, 4).collect():
        found.setdefault((r.z, r.x, r.y), set()).add((r.tile_x, r.tile_y, r.asset, r.px, r.py, r.value))
    ends = lambda asset, y: asset == 3 and y < 0  # noqa: E731  degrees end where the square world does
    wanted = {(z, x, y): {(x + i, y + j, *p) for i in (-1, 0, 1) for j in (-1, 0, 1) for p in single.get((z, x + i, y + j), ()) if not ends(p[0], y + j)} for z, x, y in tiles}
    assert found == {t: v for t, v in wanted.items() if v}
    assert {y for z, x, y in single if x == 512 and y > 1000} == set(range(1022, 1028)) and (10, -1, 512) in single and (10, 512, 0) in single


def test_nearest_does_not_shuffle_pixels(spark):
    rasters, blocks = tables(spark, arrays())
    tiles = spark.createDataFrame([(10, 511, 509)], "z int, x int, y int")
    plan = lambda kernel: reading.read_meta_tiles(tiles, rasters, blocks, 16, kernel)._jdf.queryExecution().optimizedPlan().toString()
    above = lambda kernel: plan(kernel).split("MapInArrow")[0].count("Aggregate")
    assert above("nearest") == 0 and above("bilinear") == 1


def test_first_leaves_out_assets_behind_a_full_one(spark):
    data = arrays(holes=0.0)
    rasters, blocks = tables(spark, data)
    windows = reading.tile_windows(spark.createDataFrame([(12, 2049, 2038), (12, 2047, 2039), (9, 256, 254)], "z int, x int, y int"), 16)
    keys = ("z", "x", "y")
    pairs = reading.windows_over_rasters(windows, rasters.select("asset", "asset_ord", *reading._RASTER), keys)
    held = reading._until_full(pairs, blocks, keys, "nearest", "asset_ord")
    assert held.count() < pairs.count()
    pixels = reading.read_windows(windows, rasters, blocks, keys, carry=("asset_ord",))
    all_of = {(r.z, r.x, r.y, r.px, r.py): r.value for r in pixels.groupBy(*keys, "px", "py").agg(F.min_by("value", "asset_ord").alias("value")).collect()}
    mine = {(r.z, r.x, r.y, r.px, r.py): r.value for r in reading.mosaic_tiles(windows, rasters, blocks, "first", 16).collect()}
    assert mine == all_of and mine


def test_points(spark):
    data = arrays()
    rasters, blocks = tables(spark, data)
    rng = np.random.default_rng(3)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-30_000, 0], [60_000, 110_000], (200, 2)))]
    found = {(r.id, r.asset): r.value for r in reading.read_points(spark.createDataFrame(points, "id int, mx double, my double"), rasters, blocks, ("id",)).collect()}
    wanted = {}
    for i, x, y in points:
        for raster in RASTERS:
            got = plain(raster, data[raster[0]], (x, y, x, y), 1, 1, "nearest")
            asset, left, top, res, w, h, _, degrees, _ = raster
            px = (x * DEGREES_A_METRE - left) / res if degrees else (x - left) / res
            py = (top - 180 / np.pi * (2 * np.arctan(np.exp(y / grid.ORIGIN_SHIFT * np.pi)) - np.pi / 2)) / res if degrees else (top - y) / res
            if 0 <= px < w and 0 <= py < h:
                wanted[i, asset] = got.get((0, 0))
    assert found == wanted


def test_levels_read_few_blocks_and_agree_with_means(spark):
    data = arrays()
    rasters, blocks = tables(spark, data)
    own = rasters.where("not degrees")
    made = preparing.overviews(blocks, own, 8)
    levels = {(r.asset, r.level): r for r in preparing.levels_of(own, 8).collect()}
    found = {}
    for r in made.collect():
        meta = levels[int(r.asset), r.level]
        w = min(8, meta.width - r.bx * 8)
        for i, v in enumerate(r["values"]):
            found[int(r.asset), r.level, r.bx * 8 + i % w, r.by * 8 + i // w] = v
    for asset in (1, 2):
        a, level = data[asset], 0
        while (asset, level + 1) in levels:
            a, level = preparing.halved(a), level + 1
            assert a.shape == (levels[asset, level].height, levels[asset, level].width)
            for y in range(a.shape[0]):
                for x in range(a.shape[1]):
                    got = found[asset, level, x, y]
                    assert (got is None) == np.isnan(a[y, x]) and (got is None or abs(got - a[y, x]) < 1e-9)
    pyramid = blocks.select(F.col("asset").cast("string").alias("asset"), F.lit(0).alias("level"), "bx", "by", "values").unionByName(made.drop("full"))
    windows = spark.createDataFrame([(1, 0.0, 60_000.0, 30_000.0, 90_000.0, 9, 9)], "id int, xmin double, ymin double, xmax double, ymax double, cols int, rows int")
    got = preparing.read_pyramid(windows, own, pyramid, ("id",), 8, "average").collect()
    assert {r.asset: r.level for r in got} == {"1": 2, "2": 1}


def test_stages_are_made_once(spark, tmp_path):
    data = arrays()
    rasters, blocks = tables(spark, data)
    grids, made = preparing.prepared(spark, f"{tmp_path}/p", rasters, blocks, 8)
    first = sorted(map(str, made.collect()))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    _, again = preparing.prepared(spark, f"{tmp_path}/p", rasters, blocks, 8)
    assert sorted(map(str, again.collect())) == first and first
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()} == files
    assert not grids.where("degrees").count() and grids.count() == 3
    own = {r.asset: r for r in grids.collect()}
    assert own[1].left == 0.0 and own[1].res == 700.0
    base = {(r.bx, r.by): r["values"] for r in made.where("asset = '1' and level = 0").collect()}
    for (bx, by), values in base.items():
        want = data[1][by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8].ravel()
        assert [None if np.isnan(v) else v for v in want] == values


def test_copies_of_scaled_assets(spark):
    """A target of 3 x 3 pixels over sources with halved and doubled pixels, by nodata that is no number."""
    pixels = [(a, 1, x, y, float(10 * a + x + y) if (x + y) % 2 else float("nan"), a) for a, n in ((1, 6), (2, 2)) for x in range(n) for y in range(n)]
    pixels = spark.createDataFrame(pixels, "asset int, band int, px int, py int, value double, asset_ord int")
    assets = spark.createDataFrame([(1, 0.0, 6.0, 6.0, 0.0, 1.0), (2, 0.0, 6.0, 8.0, -2.0, 4.0)], "asset int, ulx double, uly double, lrx double, lry double, res double")
    rows = merging.placed(pixels, assets, (0.0, 6.0, 6.0, 0.0), 2.0)
    got = {(r.px, r.py): r.value for r in merging.copied(rows, nodata=float("nan"), base=merging.filled(3, 3, 1, [-1.0], rows)).collect()}
    fine = {(x, y): 10.0 + 2 * x + 1 + 2 * y + 1 for x in range(3) for y in range(3)}
    assert len(got) == 9
    for (x, y), v in got.items():
        sx, sy = (2 * x + 1) * 2 // (2 * 3), (2 * y + 1) * 2 // (2 * 3)
        wide = 20.0 + sx + sy if (sx + sy) % 2 else None
        assert v == (wide if wide is not None else -1.0 if (2 * x + 1 + 2 * y + 1) % 2 == 0 else fine[x, y])


def test_plan_tables_are_written_and_found(spark, tmp_path):
    from gridlake.operators import pyramid

    plan = spark.createDataFrame([("a", 3, 1, 2), ("a", 4, 2, 5), ("a", 4, 3, 5), ("b", 3, 0, 0)], "id string, z int, tx int, ty int")
    rasters = spark.createDataFrame([("a", 0.0, 1e7, 5000.0, 900, 700), ("b", -2.1e7, 2.1e7, 9000.0, 100, 100)], "id string, left double, top double, res double, xsize int, ysize int")
    jobs = spark.createDataFrame([("a", "average"), ("b", "nearest")], "id string, resampling string")
    for _ in range(2):
        pyramid.write_plan(str(tmp_path), plan, pyramid.tile_details(plan, rasters, "id"), jobs, "id")
    job = pyramid.job_of(spark, str(tmp_path), "id", "a").collect()
    assert [(j.resampling, [tuple(r) for r in j.ranges]) for j in job] == [("average", [(3, 1, 2, 1, 2), (4, 2, 5, 3, 5)])]
    assert pyramid.job_of(spark, str(tmp_path), "id", "zzz").count() == 0
    assert spark.read.parquet(f"{tmp_path}/tiles_detail").count() == 4
