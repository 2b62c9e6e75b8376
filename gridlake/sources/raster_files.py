"""Raster files (TIFF, BigTIFF) as block tables, and block tables as raster files; headers and tiles in numpy.

Reading.  format("raster_files") gives a row for each block of each band; a partition is a stretch of block rows of a
file, so one file is read by many tasks and a task holds one row of blocks.  Files in tiles or strips, of whole numbers
or floats, pixel- or band-interleaved, uncompressed, deflated or as packed bits, with or without horizontal differences,
are read; others (palettes too) are refused by name of what they have.

Writing.  Tiles are stored uncompressed, so each has its place before anything is written: every task writes its blocks
straight into the file, and a repeated task writes the same bytes.  Files stand in a hidden folder until the job commits,
and a job that leaves a file incomplete fails.  The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .tile_files import removed, staged

BLOCKS = "asset string, band int, bx int, by int, values array<double>, full boolean"
META = "asset string, path string, width int, height int, bands int, dtype string, left double, top double, res double, degrees boolean, nodata double, alpha boolean, block int, bytes long"
#: Fixed values of the format: tags, sizes of field types, kinds of samples.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 284: "planar", 317: "predictor", 320: "palette", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "counts", 338: "extra", 339: "format", 33550: "scale", 33922: "tie", 34735: "geo", 42113: "nodata"}
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SAMPLES = {1: "u", 2: "i", 3: "f"}


class Header:
    """What the first directory of a TIFF file says."""

    def __init__(self, path: str) -> None:
        self.path, self.tags = path, {}
        with open(path, "rb") as f:
            start = f.read(16)
            self.end = {b"II": "<", b"MM": ">"}.get(start[:2])
            version = struct.unpack(f"{self.end}H", start[2:4])[0] if self.end else 0
            if version not in (42, 43):
                raise ValueError(f"{path} is no TIFF file")
            big = version == 43
            at = struct.unpack(f"{self.end}Q", start[8:16])[0] if big else struct.unpack(f"{self.end}I", start[4:8])[0]
            f.seek(at)
            count = struct.unpack(f"{self.end}{'Q' if big else 'H'}", f.read(8 if big else 2))[0]
            size, room = (20, 8) if big else (12, 4)
            entries = f.read(size * count)
            for i in range(count):
                entry = entries[size * i : size * (i + 1)]
                tag, kind = struct.unpack(f"{self.end}HH", entry[:4])
                n = struct.unpack(f"{self.end}{'Q' if big else 'I'}", entry[4 : 4 + room])[0]
                if tag in TAGS and kind in FIELD:
                    code = FIELD[kind]
                    length = n * struct.calcsize(f"={code}")
                    data = entry[4 + room :][:length]
                    if length > room:
                        f.seek(struct.unpack(f"{self.end}{'Q' if big else 'I'}", entry[4 + room :])[0])
                        data = f.read(length)
                    self.tags[TAGS[tag]] = data if code == "s" else struct.unpack(f"{self.end}{n * len(code)}{code[0]}", data)
        one = lambda name, default: self.tags.get(name, (default,))[0]
        self.width, self.height, self.bands = one("width", 0), one("height", 0), one("samples", 1)
        self.compression, self.planar, self.predictor = one("compression", 1), one("planar", 1), one("predictor", 1)
        self.tiled = "tile_width" in self.tags
        self.tile = (one("tile_height", 0), one("tile_width", 0)) if self.tiled else (min(one("rows", self.height), self.height), self.width)
        if "palette" in self.tags or one("photometric", 1) == 3:
            raise ValueError(f"{path} has a palette; convert it to RGB or RGBA")
        bits, form = set(self.tags.get("bits", (1,))), set(self.tags.get("format", (1,)))
        if len(bits) > 1 or len(form) > 1 or next(iter(form)) not in SAMPLES or next(iter(bits)) not in (8, 16, 32, 64):
            raise ValueError(f"{path} has samples that cannot be read: bits {sorted(bits)}, formats {sorted(form)}")
        self.dtype = np.dtype(f"{self.end}{SAMPLES[form.pop()]}{bits.pop() // 8}")
        if self.compression not in (1, 8, 32946, 32773) or self.predictor not in (1, 2):
            raise ValueError(f"{path} is compressed in a way that cannot be read: {self.compression}, predictor {self.predictor}")
        scale, tie = self.tags.get("scale", (1.0, 1.0)), self.tags.get("tie", (0.0,) * 6)
        if abs(scale[0] - scale[1]) > 1e-9 * abs(scale[0]):
            raise ValueError(f"{path} has pixels that are not square")
        self.res, self.left, self.top = scale[0], tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        keys = self.tags.get("geo", ())
        self.degrees = any(keys[i] == 1024 and keys[i + 3] == 2 for i in range(4, len(keys) - 3, 4))
        text = bytes(self.tags.get("nodata", b"")).split(b"\0")[0].strip()
        self.nodata = float(text) if text else None
        self.alpha = any(e in (1, 2) for e in self.tags.get("extra", ()))

    def block_row(self, by: int, block: int) -> np.ndarray:
        """bands x rows x width of one row of blocks; nodata is nan."""
        top, bottom = by * block, min((by + 1) * block, self.height)
        out = np.full((self.bands, bottom - top, self.width), np.nan)
        h, w = self.tile
        across = -(-self.width // w)
        down = -(-self.height // h)
        with open(self.path, "rb") as f:
            for ty in range(top // h, -(-bottom // h)):
                for tx in range(across):
                    for plane in range(self.bands if self.planar == 2 else 1):
                        tile = self._tile(f, (plane * down + ty) * across + tx, h if self.tiled else min(h, self.height - ty * h))
                        a, b = max(top, ty * h), min(bottom, ty * h + tile.shape[0])
                        c = min(self.width, (tx + 1) * w)
                        part = tile[a - ty * h : b - ty * h, : c - tx * w]
                        if self.planar == 2:
                            out[plane, a - top : b - top, tx * w : c] = part[:, :, 0]
                        else:
                            out[:, a - top : b - top, tx * w : c] = part.transpose(2, 0, 1)
        if self.nodata is not None:
            out[out == self.nodata] = np.nan
        return out

    def _tile(self, f, i: int, rows: int) -> np.ndarray:
        samples, w = 1 if self.planar == 2 else self.bands, self.tile[1]
        f.seek(self.tags["offsets"][i])
        data = f.read(self.tags["counts"][i])
        size = rows * w * samples * self.dtype.itemsize
        if not data:  # a tile that was never written
            return np.full((rows, w, samples), np.nan if self.nodata is None else self.nodata)
        if self.compression in (8, 32946):
            data = zlib.decompress(data)
        elif self.compression == 32773:
            data = unpacked(data, size)
        values = np.frombuffer(data, self.dtype, rows * w * samples).reshape(rows, w, samples)
        if self.predictor == 2:
            values = np.cumsum(values.astype(self.dtype.newbyteorder("=")), axis=1, dtype=self.dtype.newbyteorder("="))
        return values.astype(float)


def unpacked(data: bytes, size: int) -> bytes:
    """Packed bits: a count below 128 precedes so many bytes and one, a count above 128 one byte to be repeated."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _files(path: str) -> list[str]:
    names = [path] if os.path.isfile(path) else [os.path.join(path, n) for n in sorted(os.listdir(path))]
    return [n for n in names if n.lower().endswith((".tif", ".tiff")) and os.path.isfile(n)]


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class RasterFiles(DataSource):
    """format("raster_files"): options path (a file or folder), block, rows (block rows of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(self.options["path"], int(self.options.get("block", 256)), int(self.options.get("rows", 4)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BlockWriter(self.options["path"], int(self.options.get("block", 256)), overwrite)


class BlockReader(DataSourceReader):
    def __init__(self, path: str, block: int, rows: int) -> None:
        self.path, self.block, self.rows = path, block, rows

    def partitions(self) -> Sequence[Rows]:
        out = []
        for path in _files(self.path):
            down = -(-Header(path).height // self.block)
            out += [Rows(path, k, min(k + self.rows, down)) for k in range(0, down, self.rows)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        header = Header(partition.path) if partition.path else None
        for by in range(partition.first, partition.last):
            values = header.block_row(by, self.block)
            for band in range(header.bands):
                for bx in range(-(-header.width // self.block)):
                    part = values[band, :, bx * self.block : (bx + 1) * self.block].ravel()
                    bad = np.isnan(part)
                    yield os.path.basename(partition.path), band + 1, bx, by, [None if b else v for v, b in zip(part.tolist(), bad.tolist(), strict=True)], not bad.any()


def layout(width: int, height: int, bands: int, block: int, left: float, top: float, res: float, degrees: bool, nodata: float | None) -> tuple[bytes, int]:
    """Header of a BigTIFF file of uncompressed tiles of doubles, band by band, and the size of a tile."""
    tile = block * block * 8
    tiles = -(-width // block) * -(-height // block) * bands
    text = (repr(float("nan")) if nodata is None else repr(float(nodata))).encode() + b"\0"
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, 4326 if degrees else 3857)
    fields = [(256, "I", (width,)), (257, "I", (height,)), (258, "H", (64,) * bands), (259, "H", (1,)), (262, "H", (1,)), (277, "H", (bands,)), (284, "H", (2,)), (322, "I", (block,)), (323, "I", (block,)), (324, "Q", None), (325, "Q", (tile,) * tiles), (339, "H", (3,) * bands), (33550, "d", (res, res, 0.0)), (33922, "d", (0.0, 0.0, 0.0, left, top, 0.0)), (34735, "H", keys), (42113, "s", text)]
    codes = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    after = 16 + 8 + 20 * len(fields) + 8
    extra = sum(n for _, c, v in fields if (n := struct.calcsize(c if c != "s" else "B") * (tiles if v is None else len(v))) > 8)
    start = -(-(after + extra) // 4096) * 4096
    entries, held = b"", b""
    for tag, code, values in fields:
        values = tuple(start + tile * i for i in range(tiles)) if values is None else values
        data = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        place = data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", after + len(held))
        held += data if len(data) > 8 else b""
        entries += struct.pack("<HHQ", tag, codes[code], len(values)) + place
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", 0) + held
    return head.ljust(start, b"\0"), tile


@dataclass
class Filled(WriterCommitMessage):
    counts: dict[str, int]
    wanted: dict[str, int]


class BlockWriter(DataSourceWriter):
    def __init__(self, folder: str, block: int, overwrite: bool) -> None:
        self.folder, self.block, self.overwrite, self.staging = folder, block, overwrite, staged(folder)

    def _part(self, asset: str) -> str:
        return os.path.join(self.staging, asset)

    def write(self, iterator: Iterator[Row]) -> Filled:
        counts, wanted, open_files = Counter(), {}, {}
        try:
            for r in iterator:
                asset = str(r["asset"])
                if asset not in open_files:
                    head, tile = layout(r["width"], r["height"], r["bands"], self.block, r["left"], r["top"], r["res"], bool(r["degrees"]), r["nodata"])
                    across, down = -(-r["width"] // self.block), -(-r["height"] // self.block)
                    wanted[asset] = across * down * r["bands"]
                    file = os.open(self._part(asset), os.O_RDWR | os.O_CREAT)
                    os.pwrite(file, head, 0)
                    open_files[asset] = file, len(head), tile, across, down
                file, start, tile, across, down = open_files[asset]
                w, h = min(self.block, r["width"] - r["bx"] * self.block), min(self.block, r["height"] - r["by"] * self.block)
                empty = float("nan") if r["nodata"] is None else float(r["nodata"])
                values = np.full((self.block, self.block), empty)
                values[:h, :w] = np.array([empty if v is None else v for v in r["values"]], float).reshape(h, w)
                os.pwrite(file, values.astype("<f8").tobytes(), start + tile * (((r["band"] - 1) * down + r["by"]) * across + r["bx"]))
                counts[asset] += 1
        finally:
            for file, *_ in open_files.values():
                os.close(file)
        return Filled(dict(counts), wanted)

    def commit(self, messages: list[Filled | None]) -> None:
        counts, wanted = Counter(), {}
        for m in messages:
            if m is not None:
                counts.update(m.counts)
                wanted |= m.wanted
        short = [a for a, n in wanted.items() if counts[a] != n]
        if short:
            self.abort(messages)
            raise ValueError(f"blocks are missing or repeated in {', '.join(sorted(short)[:5])}")
        for asset in wanted:
            goal = os.path.join(self.folder, asset if asset.lower().endswith((".tif", ".tiff")) else f"{asset}.tif")
            if self.overwrite or not os.path.exists(goal):
                os.replace(self._part(asset), goal)
        removed(self.staging)

    def abort(self, messages: list[Filled | None]) -> None:
        removed(self.staging)


def read_blocks(spark: SparkSession, path: str, block: int = 256) -> DataFrame:
    """asset (the file's name), band, bx, by, values, full of all raster files of a folder, or of one file."""
    spark.dataSource.register(RasterFiles)
    return spark.read.format("raster_files").option("path", path).option("block", block).load()


def read_metadata(spark: SparkSession, path: str, block: int = 256) -> DataFrame:
    """META of every raster file; headers alone are read, by tasks."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                h = Header(name)
                rows.append({"asset": os.path.basename(name), "path": name, "width": h.width, "height": h.height, "bands": h.bands, "dtype": h.dtype.newbyteorder("=").name, "left": h.left, "top": h.top, "res": h.res, "degrees": h.degrees, "nodata": h.nodata, "alpha": h.alpha, "block": block, "bytes": os.path.getsize(name)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("asset", pa.string()), ("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bands", pa.int32()), ("dtype", pa.string()), ("left", pa.float64()), ("top", pa.float64()), ("res", pa.float64()), ("degrees", pa.bool_()), ("nodata", pa.float64()), ("alpha", pa.bool_()), ("block", pa.int32()), ("bytes", pa.int64())]))

    names = _files(path)
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    return rows.repartition(max(1, min(len(names), 1000))).mapInArrow(read, META)


def write_blocks(blocks: DataFrame, rasters: DataFrame, folder: str, block: int = 256, overwrite: bool = False) -> None:
    """A file for each asset of rasters (asset, width, height, bands, left, top, res, degrees, nodata) out of its blocks."""
    blocks.sparkSession.dataSource.register(RasterFiles)
    meta = rasters.select("asset", "width", "height", "bands", "left", "top", "res", "degrees", F.col("nodata").cast("double").alias("nodata"))
    band = F.col("band") if "band" in blocks.columns else F.lit(1).alias("band")
    rows = blocks.select("asset", band, "bx", "by", "values").join(meta, "asset")
    rows.write.format("raster_files").mode("overwrite" if overwrite else "append").option("path", folder).option("block", block).save()
