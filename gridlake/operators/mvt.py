"""Vector tiles: the byte format of the public vector-tile specification 2.1, and its aggregate.

tiles() clips, scales and encodes features before the shuffle, so what travels is the bytes of a tile; the rows
of a tile are then only strung together, with the tables of keys and values.  A tile is one value and must fit
in memory by its nature; layers that would overfill coarse tiles start at a finer minzoom.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry
from .vector import BUFFER, EXTENT, envelope, tile_cover

MOVE, LINE, CLOSE = 1, 2, 7
_TILE_COLUMNS = ["z", "x", "y", "layer", "data"]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def command(kind: int, count: int) -> int:
    return count << 3 | kind


def to_tile(shape: geometry.Shape, env: Sequence[float], extent: int = EXTENT, buffer: int = BUFFER) -> geometry.Shape | None:
    """A shape on the tile's integer grid (y downwards), clipped to the buffered tile; None if nothing is left."""
    scale = np.array([extent / (env[2] - env[0]), -extent / (env[3] - env[1])])
    origin, low, high = np.array([env[0], env[3]]), np.full(2, -buffer, float), np.full(2, extent + buffer, float)
    kind, out = shape[0], []
    for part in shape[1]:
        p = (part - origin) * scale
        if kind == 1:
            p = np.round(p[((p >= low) & (p <= high)).all(1)])
            if len(p):
                out.append(p)
        elif kind == 2:
            for line in geometry.clip_line(p, low, high):
                line = np.round(line)
                line = line[np.r_[True, (np.diff(line, axis=0) != 0).any(1)]]
                if len(line) > 1:
                    out.append(line)
        else:
            ring = p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p
            ring = np.round(geometry.clip_ring(ring, low, high))
            if len(ring):
                ring = ring[np.r_[True, (np.diff(ring, axis=0) != 0).any(1)]]
                ring = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
            if len(ring) > 2 and geometry.area(ring):
                outer = not out
                if (geometry.area(ring) > 0) != outer:  # outer rings turn right on the screen
                    ring = ring[::-1]
                out.append(ring)
            elif not out:
                return None  # without its outer ring a shape has no holes
    return (kind, out) if out else None


def geometry_commands(shape: geometry.Shape) -> list[int]:
    kind, parts = shape
    out, at = [], np.zeros(2, np.int64)
    if kind == 1:
        points = np.concatenate(parts).astype(np.int64)
        out.append(command(MOVE, len(points)))
        for p in points:
            out += [zigzag(int(v)) for v in p - at]
            at = p
        return out
    for part in parts:
        points = part.astype(np.int64)
        out += [command(MOVE, 1), *(zigzag(int(v)) for v in points[0] - at), command(LINE, len(points) - 1)]
        at = points[0]
        for p in points[1:]:
            out += [zigzag(int(v)) for v in p - at]
            at = p
        if kind == 3:
            out.append(command(CLOSE, 1))
    return out


def _value(v) -> bytes:
    if isinstance(v, (bool, np.bool_)):
        return bytes([7 << 3, int(v)])
    if isinstance(v, (int, np.integer)):
        return _varint(5 << 3) + _varint(int(v)) if v >= 0 else _varint(6 << 3) + _varint(zigzag(int(v)))
    if isinstance(v, (float, np.floating)):
        return bytes([3 << 3 | 1]) + np.float64(v).tobytes()
    return _field(1, str(v).encode())


def geometry_fields(shape: geometry.Shape) -> bytes:
    """Type and geometry of a feature message."""
    return _varint(3 << 3) + _varint(shape[0]) + _field(4, b"".join(map(_varint, geometry_commands(shape))))


def _clip(x: np.ndarray, y: np.ndarray, of: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of rings (points one ring after the other, ring of each) between low and high on both axes."""
    for axis in (0, 1):
        for bound, keep in ((low, np.greater_equal), (high, np.less_equal)):
            inside = keep((x, y)[axis], bound)
            if inside.all():
                continue
            after = _after(of)
            cross = inside != inside[after]
            count = inside.astype(np.int64) + cross
            at = np.cumsum(count) - count
            p, q = np.flatnonzero(cross), after[cross]
            share = (bound - (x, y)[axis][p]) / ((x, y)[axis][q] - (x, y)[axis][p])
            made = []
            for v in (x, y):
                new = np.empty(int(count.sum()))
                new[at[inside]] = v[inside]
                new[at[p] + inside[p]] = v[p] + (v[q] - v[p]) * share
                made.append(new)
            (x, y), of = made, np.repeat(of, count)
    return x, y, of


def _after(of: np.ndarray) -> np.ndarray:
    """Place of the next point on the ring of each point."""
    after, first = np.arange(1, len(of) + 1), _starts(of)
    after[np.append(first[1:], len(of))[: len(first)] - 1] = first
    return after


def _starts(of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(of, prepend=-1))


def _varint_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varints of values one after the other, and the length of each."""
    size = 1 + sum((values >> 7 * k > 0).astype(np.int64) for k in range(1, 10))
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = (values[some] >> 7 * k & 0x7F) | (size[some] > k + 1) * 0x80
    return out, size


def area_fields(areas: Sequence[Sequence[np.ndarray]], envelopes: np.ndarray, extent: int = EXTENT, buffer: int = BUFFER) -> list[bytes | None]:
    """geometry_fields of to_tile for many areas (their rings), each on its own tile; None where nothing is left."""
    rings = [p for of in areas for p in of]
    out: list[bytes | None] = [None] * len(areas)
    if not rings:
        return out
    shape = np.repeat(np.arange(len(areas)), [len(of) for of in areas])  # of each ring
    of = np.repeat(np.arange(len(rings)), [len(p) for p in rings])
    points, env = np.concatenate(rings), envelopes[shape[of]]
    x = (points[:, 0] - env[:, 0]) * (extent / (env[:, 2] - env[:, 0]))
    y = (points[:, 1] - env[:, 3]) * (-extent / (env[:, 3] - env[:, 1]))

    def opened(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rings without a last point that repeats the first."""
        first = _starts(of)
        last = np.append(first[1:], len(of))[: len(first)] - 1
        keep = np.ones(len(of), bool)
        keep[last[(last > first) & (x[first] == x[last]) & (y[first] == y[last])]] = False
        return x[keep], y[keep], of[keep]

    x, y, of = _clip(*opened(x, y, of), -buffer, extent + buffer)
    x, y = np.round(x), np.round(y)
    new = (np.diff(of, prepend=-1) != 0) | (np.diff(x, prepend=np.nan) != 0) | (np.diff(y, prepend=np.nan) != 0)
    x, y, of = opened(x[new], y[new], of[new])
    after, size = _after(of), np.bincount(of, minlength=len(rings))
    turn = np.bincount(of, x * y[after] - x[after] * y, len(rings))  # whole numbers
    good, outer = (size > 2) & (turn != 0), np.diff(shape, prepend=-1) != 0
    good &= good[np.flatnonzero(outer)][np.cumsum(outer) - 1]  # without its outer ring a shape has no holes
    some = good[of]
    x, y, of = x[some].astype(np.int64), y[some].astype(np.int64), of[some]
    if not len(of):
        return out
    first = _starts(of)
    kept, n = of[first], np.diff(np.append(first, len(of)))
    k = np.arange(len(of)) - np.repeat(first, n)
    back = np.repeat((turn[kept] > 0) != outer[kept], n)  # outer rings turn right on the screen
    order = np.where(back, np.repeat(first + n - 1, n) - k, np.arange(len(of)))
    x, y = x[order], y[order]
    start = np.diff(shape[of], prepend=-1) != 0
    begin = np.cumsum(2 * n + 3) - (2 * n + 3)
    values = np.empty(int((2 * n + 3).sum()), np.int64)
    values[begin], values[begin + 3], values[begin + 2 * n + 2] = command(MOVE, 1), (n - 1) << 3 | LINE, command(CLOSE, 1)
    at = np.repeat(begin, n) + 2 * k + 1 + (k > 0)
    for i, v in enumerate((x, y)):
        d = np.diff(v, prepend=0)
        d[start] = v[start]
        values[at + i] = d << 1 ^ d >> 63
    data, sizes = _varint_bytes(values)
    owner = shape[kept]
    length = np.bincount(owner, np.add.reduceat(sizes, begin), len(areas)).astype(np.int64)
    data, end, head = data.tobytes(), np.cumsum(length), _varint(3 << 3) + _varint(3)
    for i in np.unique(owner).tolist():
        out[i] = head + _field(4, data[end[i] - length[i] : end[i]])
    return out


class LayerBody:
    """A layer that grows feature by feature; only its bytes, keys and values are held."""

    def __init__(self) -> None:
        self.body, self.keys, self.values = bytearray(), {}, {}
        self.tags: dict[tuple, bytes] = {}

    def _tag(self, key: str, value: object) -> bytes:
        found = self.tags.get((key, type(value), value))
        if found is None:
            keys, values = self.keys, self.values
            found = _varint(keys.setdefault(key, len(keys))) + _varint(values.setdefault(_value(value), len(values)))
            if not isinstance(value, (float, np.floating)):  # 0.0 and -0.0 are equal and have bytes of their own
                self.tags[key, type(value), value] = found
        return found

    def add(self, fid: int | None, drawn: bytes, attributes: Iterable[tuple[str, object]]) -> None:
        """drawn: geometry_fields of the feature.  Null attributes are left out."""
        tags = b"".join([self._tag(k, v) for k, v in attributes if v is not None and v == v])
        self.body += _field(2, (_varint(1 << 3) + _varint(int(fid)) if fid is not None and fid >= 0 else b"") + (_field(2, tags) if tags else b"") + drawn)

    def layer(self, name: str, extent: int) -> bytes:
        """b"" if there are no features."""
        if not self.body:
            return b""
        tables = b"".join(_field(3, k.encode()) for k in self.keys) + b"".join(_field(4, v) for v in self.values)
        return _field(3, _field(1, name.encode()) + bytes(self.body) + tables + _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(2))


def encode_layer(name: str, features: Iterable[tuple[int | None, geometry.Shape, dict]], extent: int = EXTENT) -> bytes:
    """One layer of a tile; b"" if there are no features."""
    body = LayerBody()
    for fid, shape, attributes in features:
        body.add(fid, geometry_fields(shape), attributes.items())
    return body.layer(name, extent)


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = b[at]
            at += 1
            n |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return n

    while at < len(b):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 1:
            at += 8
            yield tag >> 3, np.frombuffer(b[at - 8 : at], "<f8")[0].item()
        else:
            n = varint()
            at += n
            yield tag >> 3, b[at - n : at]


def _varints(b: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in b:
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            out.append(n)
            n = shift = 0
    return out


def _decoded_value(b: bytes):
    (number, v), *_ = _fields(b)
    return v.decode() if number == 1 else bool(v) if number == 7 else (v >> 1) ^ -(v & 1) if number == 6 else v


def _layer(layer: bytes) -> dict:
    """What stands beside a layer's features: name, keys, values, extent, version."""
    found: dict = {"keys": [], "values": [], "extent": 4096, "version": 1}
    for number, v in _fields(layer):
        if number == 1:
            found["name"] = v.decode()
        elif number == 3:
            found["keys"].append(v.decode())
        elif number == 4:
            found["values"].append(_decoded_value(v))
        elif number in (5, 15):
            found["extent" if number == 5 else "version"] = v
    return found


def _features(layer: bytes, found: dict) -> Iterator[dict]:
    for number, v in _fields(layer):
        if number == 2:
            raw = dict(_fields(v))
            tags = _varints(raw.get(2, b""))
            yield {"id": raw.get(1), "type": raw[3], "commands": _varints(raw[4]), "attributes": {found["keys"][k]: found["values"][v] for k, v in zip(tags[::2], tags[1::2], strict=True)}}


def features_of(data: bytes) -> Iterator[tuple[str, dict]]:
    """Layer and feature (id, type, commands, attributes), one at a time: of a tile only its bytes, keys and values are held."""
    for _, layer in _fields(data):
        found = _layer(layer)
        for feature in _features(layer, found):
            yield found["name"], feature


def decode_tile(data: bytes) -> dict[str, dict]:
    """Layers of a tile: extent, version, features (id, type, commands, attributes)."""
    layers: dict[str, dict] = {}
    for _, layer in _fields(data):
        found = _layer(layer)
        layers[found["name"]] = {"extent": found["extent"], "version": found["version"], "features": list(_features(layer, found))}
    return layers


def points_of(commands: Sequence[int]) -> tuple[list[int], list[int]]:
    """Tile coordinates that a feature's commands visit, in their order."""
    xs, ys, at, x, y = [], [], 0, 0, 0
    while at < len(commands):
        kind, count = commands[at] & 7, commands[at] >> 3
        at += 1
        for _ in range(count if kind != CLOSE else 0):
            x, y = (old + ((v >> 1) ^ -(v & 1)) for old, v in zip((x, y), commands[at : at + 2], strict=True))
            xs.append(x)
            ys.append(y)
            at += 2
    return xs, ys


#: Features that decoded() holds at a time.
DECODED = 10_000


def decoded(tiles: DataFrame, data: str = "data") -> DataFrame:
    """z, x, y, layer, id, type, xs, ys, attributes of every feature of tiles (plain or gzip)."""

    names = ["z", "x", "y", "layer", "id", "type", "xs", "ys", "attributes"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for z, x, y, raw in rows[["z", "x", "y", data]].itertuples(index=False, name=None):
                raw = bytes(raw)
                for name, f in features_of(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    out.append((z, x, y, name, f["id"], f["type"], *points_of(f["commands"]), {k: str(v) for k, v in f["attributes"].items()}))
                    if len(out) == DECODED:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return tiles.select("z", "x", "y", data).mapInPandas(read, "z int, x int, y int, layer string, id long, type int, xs array<int>, ys array<int>, attributes map<string,string>")


#: A feature of more tiles than this at a zoom is dealt over all tasks, so no task unrolls a world-wide one alone.
SPREAD = 65_536
#: Bytes of finished tiles that a task holds at a time.
HELD_BYTES = 8 << 20


def tiles(features: DataFrame, zooms: Iterable[int], layer: str, attributes: Sequence[str] = (), wkb: str = "wkb", fid: str | None = "id", extent: int = EXTENT, buffer: int = BUFFER, simplify: bool = False) -> DataFrame:
    """z, x, y, layer, data of every non-empty tile of a layer; features need box columns and WKB shapes."""
    columns = [*([fid] if fid else []), wkb, *attributes]
    covered = tile_cover(features, zooms, buffer / extent, spread=SPREAD).select("z", "x", "y", *columns)

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            shapes, last, held = [], None, None
            for data in rows[wkb]:
                if data != last:  # a feature's tiles follow each other
                    last, held = data, geometry.read(bytes(data))
                shapes.append(held)
            z = rows["z"].to_numpy()
            if simplify:
                width = np.where(z > 11, 40075016.68557849 / (extent * 2.0**z), 40075016.68557849 / 2.0 ** (z + 8))
                shapes = geometry.simplify_shapes(shapes, width)
            env = np.stack(envelope(z, rows["x"].to_numpy(), rows["y"].to_numpy()), 1)
            out: list[bytes | None] = [None] * len(shapes)
            areas = [i for i, (kind, _) in enumerate(shapes) if kind == 3]
            for i, drawn in zip(areas, area_fields([shapes[i][1] for i in areas], env[areas], extent, buffer), strict=True):
                out[i] = drawn
            for i, (kind, parts) in enumerate(shapes):
                if kind != 3 and (shape := to_tile((kind, parts), env[i], extent, buffer)):
                    out[i] = geometry_fields(shape)
            yield rows.assign(**{wkb: out})[rows.columns][[o is not None for o in out]]

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, body, out, held = None, LayerBody(), [], 0
        for rows in batches:
            if not fid:
                rows = rows.assign(__fid=None)
            for r in rows[["z", "x", "y", fid or "__fid", wkb, *attributes]].itertuples(index=False, name=None):
                if r[:3] != last:
                    if last:
                        out.append((*last, layer, body.layer(layer, extent)))
                        held += len(out[-1][-1])
                        if held > HELD_BYTES:
                            yield pd.DataFrame(out, columns=_TILE_COLUMNS)
                            out, held = [], 0
                    last, body = r[:3], LayerBody()
                body.add(r[3], bytes(r[4]), zip(attributes, r[5:], strict=True))
            if out:
                yield pd.DataFrame(out, columns=_TILE_COLUMNS)
                out, held = [], 0
        if last:
            yield pd.DataFrame([(*last, layer, body.layer(layer, extent))], columns=_TILE_COLUMNS)

    placed = covered.mapInPandas(scaled, covered.schema).repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", fid or wkb)
    return placed.mapInPandas(encoded, "z int, x int, y int, layer string, data binary")


def concat_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """z, x, y, data: a tile's layers one after the other, in the order given."""
    parts = [df.withColumn("__n", F.lit(i)) for i, df in enumerate(layers)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    ordered = F.array_sort(F.collect_list(F.struct("__n", "data")))
    return rows.groupBy("z", "x", "y").agg(ordered.alias("__l")).select("z", "x", "y", F.aggregate("__l", F.lit(b""), lambda a, p: F.concat(a, p["data"])).alias("data"))


def compressed(df: DataFrame, column: str = "data") -> DataFrame:
    """gzip with a fixed time stamp; bytes that are gzip already stay."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda b: b if b is None or bytes(b[:2]) == b"\x1f\x8b" else gzip.compress(bytes(b), mtime=0))

    return df.withColumn(column, pack(column))
