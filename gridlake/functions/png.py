"""PNG bytes of RGBA tiles, by the standard library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def png(pixels: np.ndarray) -> bytes:
    """An image of (rows, columns, 4) bytes."""
    rows = np.ascontiguousarray(pixels, np.uint8)
    height, width = rows.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def render_tiles(pixels: DataFrame, size: int, keys: tuple[str, ...] = ("z", "x", "y")) -> DataFrame:
    """keys, data: a PNG of each tile's pixels (px, py, r, g, b, a); pixels without a row are transparent."""
    schema = ", ".join([*(f"{k} {dict(pixels.dtypes)[k]}" for k in keys), "data binary"])

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((size, size, 4), np.uint8)
        image[rows["py"], rows["px"]] = rows[["r", "g", "b", "a"]].to_numpy(np.uint8)
        return pd.DataFrame({**{k: rows[k][:1] for k in keys}, "data": [png(image)]})

    return pixels.groupBy(*keys).applyInPandas(draw, schema)  # a tile has size * size pixels at most


#: Pixels that drawn_pixels() puts into one table.
PIXELS = 1 << 18


def pixels_of(images: pd.DataFrame, keys: Sequence[str], data: str = "data") -> Iterator[pd.DataFrame]:
    """keys, px, py, r, g, b, a of every pixel of the images, about PIXELS rows at a time."""
    held: list[np.ndarray] = []
    start = pixels = 0
    for i, raw in enumerate(images[data]):
        held.append(read_png(bytes(raw)))
        pixels += held[-1].shape[0] * held[-1].shape[1]
        if pixels >= PIXELS or i + 1 == len(images):
            own = images[list(keys)].iloc[np.repeat(np.arange(start, i + 1), [m.shape[0] * m.shape[1] for m in held])].reset_index(drop=True)
            py, px = (np.concatenate([np.indices(m.shape[:2])[axis].ravel() for m in held]) for axis in (0, 1))
            bands = np.concatenate([m.reshape(-1, 4) for m in held]).astype(np.int32)
            yield own.assign(px=px.astype(np.int32), py=py.astype(np.int32), **{n: bands[:, k] for k, n in enumerate("rgba")})
            held, start, pixels = [], i + 1, 0


def drawn_pixels(tiles: DataFrame, keys: tuple[str, ...] = ("z", "x", "y"), data: str = "data") -> DataFrame:
    """keys, px, py, r, g, b, a of every pixel of images written by render_tiles()."""
    kinds = dict(tiles.dtypes)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield from pixels_of(rows, keys, data)

    return tiles.select(*keys, data).mapInPandas(read, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "px int, py int, r int, g int, b int, a int"]))


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an image written by png()."""
    parts: dict[bytes, bytes] = {}
    for kind, body in _chunks(data):
        parts[kind] = parts.get(kind, b"") + body
    width, height = struct.unpack(">2I", parts[b"IHDR"][:8])
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + 4 * width)
    return raw[:, 1:].reshape(height, width, 4)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n
