"""Raster files: what other programs write (strips, tiles, compressions, interleaving), round trips, refusals, commits."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.sources import raster_files


def packed(data):
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part), part[0]]) if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out


def tiff(path, a, tile=None, rows=5, compression=1, planar=1, end="<", predictor=1, extra=()):
    """A classic TIFF of bands x height x width."""
    bands, h, w = a.shape
    pieces = []
    th, tw = tile or (rows, w)
    for plane in range(bands if planar == 2 else 1):
        part = a[plane : plane + 1] if planar == 2 else a
        for y in range(0, h, th):
            for x in range(0, w, tw):
                p = part[:, y : y + th, x : x + tw]
                if tile:
                    p = np.pad(p, ((0, 0), (0, th - p.shape[1]), (0, tw - p.shape[2])))
                p = p.transpose(1, 2, 0)
                if predictor == 2:
                    p = np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1)
                raw = p.astype(a.dtype.newbyteorder(end)).tobytes()
                pieces.append({1: lambda r: r, 8: zlib.compress, 32773: packed}[compression](raw))
    at, offsets = 8, []
    for p in pieces:
        offsets.append(at)
        at += len(p)
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8] * bands), (259, 3, [compression]), (262, 3, [1]), (277, 3, [bands]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind] * bands), (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 50.0, 0.0]), (34735, 3, [1, 1, 0, 1, 1024, 0, 1, 2]), (42113, 2, b"7\0"), *extra]
    fields += [(322, 4, [tw]), (323, 4, [th]), (324, 4, offsets), (325, 4, list(map(len, pieces)))] if tile else [(273, 4, offsets), (278, 4, [rows]), (279, 4, list(map(len, pieces)))]
    code = {3: "H", 4: "I", 12: "d"}
    body, entries, after = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, k, v in sorted(fields):
        data = v if k == 2 else struct.pack(f"{end}{len(v)}{code[k]}", *v)
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{end}I", after + len(body))
        body += data if len(data) > 4 else b""
        entries += struct.pack(f"{end}HHI", tag, k, len(v)) + place
    with open(path, "wb") as f:
        f.write((b"II" if end == "<" else b"MM") + struct.pack(f"{end}HI", 42, at) + b"".join(pieces) + struct.pack(f"{end}H", len(fields)) + entries + struct.pack(f"{end}I", 0) + body)


CASES = {
    "strips": {}, "tiles": {"tile": (16, 32)}, "deflate": {"tile": (16, 16), "compression": 8, "planar": 2}, "packed": {"compression": 32773}, "big_end": {"end": ">", "tile": (16, 16)},
    "differences": {"compression": 8, "predictor": 2}, "planar_strips": {"planar": 2, "rows": 7},
}


def pixels(blocks, size, width):
    out = {}
    for r in blocks.collect():
        w = min(size, width - r.bx * size)
        for i, v in enumerate(r["values"]):
            out[r.band, r.by * size + i // w, r.bx * size + i % w] = v
    return out


@pytest.mark.parametrize("case", list(CASES))
def test_files_of_many_kinds(spark, tmp_path, case):
    rng = np.random.default_rng(1)
    kind = {"big_end": "f4", "packed": "u1", "differences": "u2"}.get(case, "i2")
    a = rng.integers(0, 100, (3, 45, 37)).astype(kind)
    a[:, :10] = 9
    tiff(str(tmp_path / "a.tif"), a, **CASES[case])
    found = pixels(raster_files.read_blocks(spark, str(tmp_path), 16), 16, 37)
    assert found == {(b + 1, y, x): None if a[b, y, x] == 7 else float(a[b, y, x]) for b in range(3) for y in range(45) for x in range(37)}
    meta = raster_files.read_metadata(spark, str(tmp_path)).collect()
    assert [(m.asset, m.width, m.height, m.bands, m.left, m.top, m.res, m.degrees, m.nodata, m.alpha, m.dtype) for m in meta] == [("a.tif", 37, 45, 3, 100.0, 50.0, 2.0, True, 7.0, False, np.dtype(kind).name)]


def test_refusals(spark, tmp_path):
    a = np.zeros((1, 4, 4), "u1")
    for name, tags in {"palette": [(320, 3, [0] * 6)], "compressed": []}.items():
        path = str(tmp_path / f"{name}.tif")
        tiff(path, a, extra=tags)
        if name == "compressed":
            data = bytearray(open(path, "rb").read())
            at = data.index(struct.pack("<HHI", 259, 3, 1)) + 8
            data[at : at + 2] = struct.pack("<H", 7)
            open(path, "wb").write(data)
        with pytest.raises(ValueError, match=name[:7]):
            raster_files.Header(path)
    (tmp_path / "text.tif").write_bytes(b"hello")
    with pytest.raises(ValueError, match="no TIFF"):
        raster_files.Header(str(tmp_path / "text.tif"))


def test_written_files_come_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2, 21, 35))
    a[0, 3, 4] = np.nan
    rows = [("one", b + 1, bx, by, [None if np.isnan(v) else float(v) for v in a[b, by * 16 : by * 16 + 16, bx * 16 : bx * 16 + 16].ravel()]) for b in range(2) for by in range(2) for bx in range(3)]
    blocks = spark.createDataFrame(rows, "asset string, band int, bx int, by int, values array<double>").repartition(5)
    meta = spark.createDataFrame([("one", 35, 21, 2, 10.0, 20.0, 0.5, True, None)], "asset string, width int, height int, bands int, left double, top double, res double, degrees boolean, nodata double")
    raster_files.write_blocks(blocks, meta, str(tmp_path / "out"), 16)
    assert os.listdir(tmp_path / "out") == ["one.tif"]
    found = pixels(raster_files.read_blocks(spark, str(tmp_path / "out"), 8), 8, 35)
    assert found == {(b + 1, y, x): None if np.isnan(a[b, y, x]) else float(a[b, y, x]) for b in range(2) for y in range(21) for x in range(35)}
    m = raster_files.read_metadata(spark, str(tmp_path / "out")).first()
    assert (m.left, m.top, m.res, m.degrees, m.width, m.height, m.bands) == (10.0, 20.0, 0.5, True, 35, 21, 2)
    with pytest.raises(Exception, match="missing or repeated"):
        raster_files.write_blocks(blocks.where("bx < 2"), meta.withColumn("asset", F.lit("one")), str(tmp_path / "bad"), 16)
    assert os.listdir(tmp_path / "bad") == []
    assert raster_files.read_metadata(spark, str(tmp_path / "bad")).count() == 0 and raster_files.read_blocks(spark, str(tmp_path / "bad")).count() == 0
