"""Shapes as WKB: reading, boxes, points in areas, clipping and simplification for Arrow functions.

A shape is (kind, parts): kind 1 to 3 for points, lines and areas; parts is a list of coordinate arrays
(for areas all rings, the outer one first; several areas follow each other, told apart by their ring's turn).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Sequence

import numpy as np

NAMES = {1: "ST_Point", 2: "ST_LineString", 3: "ST_Polygon", 4: "ST_MultiPoint", 5: "ST_MultiLineString", 6: "ST_MultiPolygon", 7: "ST_GeometryCollection"}
Shape = tuple[int, list[np.ndarray]]


def type_name(wkb: bytes) -> str:
    return NAMES[struct.unpack_from("<I" if wkb[0] else ">I", wkb, 1)[0] & 0xFF]


def read(wkb: bytes) -> Shape:
    """Coordinates of a WKB value, flat; multi shapes share their single kind, a collection of several kinds has 7."""

    def one(at: int) -> tuple[int, list[np.ndarray], int]:
        end = "<" if wkb[at] else ">"
        kind = struct.unpack_from(f"{end}I", wkb, at + 1)[0] & 0xFF
        at += 5
        if kind == 1:
            return 1, [np.array([struct.unpack_from(f"{end}2d", wkb, at)])], at + 16
        n = struct.unpack_from(f"{end}I", wkb, at)[0]
        at += 4
        if kind == 2:
            return 2, [np.frombuffer(wkb, f"{end}f8", 2 * n, at).reshape(n, 2).astype(float)], at + 16 * n
        parts: list[np.ndarray] = []
        if kind == 3:
            for _ in range(n):
                k = struct.unpack_from(f"{end}I", wkb, at)[0]
                parts.append(np.frombuffer(wkb, f"{end}f8", 2 * k, at + 4).reshape(k, 2).astype(float))
                at += 4 + 16 * k
            return 3, parts, at
        kinds = set()
        for _ in range(n):
            inner, more, at = one(at)
            kinds.add(inner)
            parts += more
        return (kinds.pop() if len(kinds) == 1 else 7), parts, at

    kind, parts, _ = one(0)
    return kind, parts


def write(shape: Shape) -> bytes:
    kind, parts = shape
    if kind == 1 and len(parts) == 1 and len(parts[0]) == 1:
        return struct.pack("<BI2d", 1, 1, *parts[0][0])
    if kind == 2 and len(parts) == 1:
        return struct.pack("<BII", 1, 2, len(parts[0])) + parts[0].astype("<f8").tobytes()
    if kind == 3:
        return struct.pack("<BII", 1, 3, len(parts)) + b"".join(struct.pack("<I", len(p)) + p.astype("<f8").tobytes() for p in parts)
    return struct.pack("<BII", 1, kind + 3, len(parts)) + b"".join(write((kind, [p])) for p in parts)


def box(shape: Shape) -> tuple[float, float, float, float]:
    points = np.concatenate(shape[1])
    return (*points.min(0), *points.max(0))


def area(ring: np.ndarray) -> float:
    """Signed area: positive when the ring turns left."""
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2


def from_text(text: str) -> Shape:
    """A shape out of well-known text: points, lines or rings are the innermost brackets; a third coordinate is left out."""
    kind = re.match(r"\s*(?:SRID=\d+;)?\s*(MULTI)?(POINT|LINESTRING|POLYGON)", text, re.I)
    if not kind:
        raise ValueError(f"not a shape: {text[:40]!r}")
    parts = [np.array([[float(v) for v in p.split()[:2]] for p in group.split(",")]) for group in re.findall(r"\(([^()]+)\)", text)]
    return {"POINT": 1, "LINESTRING": 2, "POLYGON": 3}[kind[2].upper()], parts


def contains_points(rings: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings, a block of edges at a time."""
    inside = np.zeros(len(points), bool)
    edges = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings]) if rings else np.zeros((0, 4))
    edges = edges[edges[:, 1] != edges[:, 3]]
    px, py = points[:, 0], points[:, 1]
    step = max(1, 200_000 // max(1, len(points)))
    for i in range(0, len(edges), step):
        x0, y0, x1, y1 = (edges[i : i + step, k, None] for k in range(4))
        hit = ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
        inside ^= hit.sum(0) % 2 == 1
    return inside


def clip_ring(ring: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Part of a ring within an upright box."""
    for axis in (0, 1):
        for bound, keep in ((low[axis], lambda v, b: v >= b), (high[axis], lambda v, b: v <= b)):
            if not len(ring):
                return ring
            inside = keep(ring[:, axis], bound)
            if inside.all():
                continue
            after, stays = np.roll(ring, -1, axis=0), np.roll(inside, -1)
            out = []
            for p, q, i, j in zip(ring, after, inside, stays, strict=True):
                if i:
                    out.append(p)
                if i != j:
                    out.append(p + (q - p) * ((bound - p[axis]) / (q[axis] - p[axis])))
            ring = np.array(out) if out else np.zeros((0, 2))
    return ring


def clip_line(line: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Parts of a line within an upright box."""
    parts: list[list[np.ndarray]] = []
    for p, q in zip(line[:-1], line[1:], strict=True):
        d, t0, t1 = q - p, 0.0, 1.0
        for axis in (0, 1):
            if d[axis] == 0:
                if not low[axis] <= p[axis] <= high[axis]:
                    t0, t1 = 1.0, 0.0
            else:
                a, b = sorted(((low[axis] - p[axis]) / d[axis], (high[axis] - p[axis]) / d[axis]))
                t0, t1 = max(t0, a), min(t1, b)
        if t0 <= t1:
            a, b = p + t0 * d, p + t1 * d
            if parts and t0 == 0 and (parts[-1][-1] == a).all():
                parts[-1].append(b)
            else:
                parts.append([a, b])
    return [np.array(x) for x in parts]


def simplify(line: np.ndarray, tolerance: float, least: int = 2) -> np.ndarray:
    """Points farther than tolerance from the line that leaves them out; a ring keeps `least` points or stays."""
    if len(line) <= least or tolerance <= 0:
        return line
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, p = line[b] - line[a], line[a + 1 : b] - line[a]
        size = np.hypot(*d)
        far = np.hypot(p[:, 0], p[:, 1]) if size == 0 else np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / size
        at = int(far.argmax())
        if far[at] > tolerance:
            keep.add(a + 1 + at)
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return line[sorted(keep)] if len(keep) >= least else line


def _spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k], first[k] + 1, ... (size[k] numbers) for each k, one after the other, and the k of each."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size - first, size), of


def _most(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The largest value of each of n groups that stand one after the other; -inf where a group is empty."""
    out, edges = np.full(n, -np.inf), np.searchsorted(of, np.arange(n))
    held = np.bincount(of, minlength=n) > 0
    if held.any():
        out[held] = np.maximum.reduceat(values, edges[held])
    return out


def _first_most(values: np.ndarray, of: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Place of the first value of each group that is the group's largest (no group is empty)."""
    at = np.flatnonzero(values == most[of])
    return at[np.unique(of[at], return_index=True)[1]]


def _turn(o: np.ndarray, d: np.ndarray, v: np.ndarray) -> np.ndarray:
    return d[:, 0] * (v[:, 1] - o[:, 1]) - d[:, 1] * (v[:, 0] - o[:, 0])


class _Batch:
    """Lines and rings of many shapes, points one after the other.

    Segment i goes from point i to point i + 1 of a line, until a shortcut takes its place; a shortcut stands where the
    first segment that it replaces stood."""

    def __init__(self, shapes: list[Shape]) -> None:
        parts = [p for _, of in shapes for p in of]
        self.size = np.array([len(p) for p in parts])
        self.points = np.concatenate(parts)
        self.x, self.y = np.ascontiguousarray(self.points[:, 0]), np.ascontiguousarray(self.points[:, 1])
        self.line_end = np.cumsum(self.size)
        self.line_first = self.line_end - self.size
        parts_of = np.array([len(of) for _, of in shapes])
        self.shape = np.repeat(np.arange(len(shapes)), parts_of)  # of each line
        self.kind = np.repeat(np.array([kind for kind, _ in shapes]), parts_of)
        total = np.bincount(self.shape, self.size, len(shapes)).astype(np.int64)
        self.first, self.total = np.cumsum(total) - total, total
        self.alive = np.ones(len(self.points), bool)
        self.alive[self.line_end[self.size > 0] - 1] = False
        self.end = np.arange(len(self.points)) + 1
        self.end[-1:] = 0

    def meets(self, shape: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each shortcut a to b meets a standing segment anywhere but in an end they share; doubt counts as meeting."""
        i, of = _spans(self.first[shape], self.total[shape])
        x, y = self.x, self.y
        j = self.end[i]
        xa, ya, xb, yb = x[a], y[a], x[b], y[b]
        on = self.alive[i] & ((i < a[of]) | (i >= b[of]))
        on &= (np.maximum(x[i], x[j]) >= np.minimum(xa, xb)[of]) & (np.minimum(x[i], x[j]) <= np.maximum(xa, xb)[of])
        on &= (np.maximum(y[i], y[j]) >= np.minimum(ya, yb)[of]) & (np.minimum(y[i], y[j]) <= np.maximum(ya, yb)[of])
        i, j, of = i[on], j[on], of[on]
        found = np.zeros(len(a), bool)
        if not len(i):
            return found
        s, e, p, q = self.points[i], self.points[j], self.points[a][of], self.points[b][of]
        largest = np.maximum(np.abs(s).max(1), np.abs(e).max(1))
        eps = 1e-12 * np.maximum(1.0, _most(largest, of, len(a)))[of] ** 2
        d = q - p
        one, two, three, four = _turn(p, d, s), _turn(p, d, e), _turn(s, e - s, p), _turn(s, e - s, q)
        apart = (np.minimum(one, two) > eps) | (np.maximum(one, two) < -eps) | (np.minimum(three, four) > eps) | (np.maximum(three, four) < -eps)
        with_p, with_q = ((s == v).all(1) | (e == v).all(1) for v in (p, q))
        other = np.where(((s == p).all(1) | (s == q).all(1))[:, None], e, s)
        away = np.abs(_turn(p, d, other)) > eps  # they share an end and part there
        beyond = ((other - p) * d).sum(1)
        outside = (with_p & (beyond < 0)) | (with_q & (beyond > (d * d).sum(1)))
        found[of[~apart & ~((with_p ^ with_q) & (away | outside))]] = True
        return found

    def encloses(self, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a point of another line of the shape lies between each shortcut a to b and what it replaces."""
        found = np.zeros(len(a), bool)
        shape = self.shape[line]
        some = np.flatnonzero(self.total[shape] > self.size[line])
        if not len(some):
            return found
        i, of = _spans(a[some], b[some] - a[some] + 1)
        high = [_most(v[i], of, len(some)) for v in (self.x, self.y)]
        low = [-_most(-v[i], of, len(some)) for v in (self.x, self.y)]
        o, owner = _spans(self.first[shape[some]], self.total[shape[some]])
        x, y = self.x[o], self.y[o]
        near = ((o < self.line_first[line[some]][owner]) | (o >= self.line_end[line[some]][owner])) & (x >= low[0][owner]) & (x <= high[0][owner]) & (y >= low[1][owner]) & (y <= high[1][owner])
        for k in np.unique(owner[near]):
            at = some[k]
            found[at] = contains_points([self.points[a[at] : b[at] + 1]], self.points[o[near & (owner == k)]]).any()
        return found

    def replace(self, a: np.ndarray, b: np.ndarray) -> None:
        i, _ = _spans(a, b - a)
        self.alive[i] = False
        self.alive[a], self.end[a] = True, b

    def corners(self, rings: np.ndarray) -> np.ndarray:
        """Three points of each ring that always stay: its start, the farthest from it, and the farthest from their line."""
        i, of = _spans(self.line_first[rings], self.size[rings])
        start = self.points[self.line_first[rings]]
        off = self.points[i] - start[of]
        gone = np.hypot(off[:, 0], off[:, 1])
        far = i[_first_most(gone, of, _most(gone, of, len(rings)))]
        d = (self.points[far] - start)[of]
        side = np.abs(d[:, 0] * off[:, 1] - d[:, 1] * off[:, 0])
        wide = i[_first_most(side, of, _most(side, of, len(rings)))]
        return np.stack([self.line_first[rings], np.minimum(far, wide), np.maximum(far, wide), self.line_end[rings] - 1], 1)


#: Points of shapes that are simplified together.
_TOGETHER = 50_000


def simplify_shapes(shapes: Sequence[Shape], tolerance: float | Sequence[float]) -> list[Shape]:
    """Shapes without points nearer than tolerance (one, or one for each shape) to the shortcut that leaves them out,
    their topology kept.

    A shortcut is refused where it meets another segment of the shape, or where a point of another line or ring lies
    between it and what it replaces; the stretch is then cut at its farthest point.  A ring keeps three corners at
    least, so no ring collapses; points stay as they are.  Shapes go side by side: each round decides one stretch of every
    shape that has one left, in the shape's own order."""
    allowed = np.broadcast_to(np.asarray(tolerance, float), len(shapes))
    out, group, points = list(shapes), [], 0
    for k, (kind, parts) in enumerate(shapes):
        if kind in (2, 3) and allowed[k] > 0 and any(len(p) >= (3 if kind == 2 else 5) for p in parts):
            group.append(k)
            points += sum(map(len, parts))
        if group and (points > _TOGETHER or k + 1 == len(shapes)):
            for i, made in zip(group, _simplified([shapes[i] for i in group], allowed[group]), strict=True):
                out[i] = made
            group, points = [], 0
    return out


def _simplified(shapes: list[Shape], tolerance: np.ndarray) -> list[Shape]:
    batch = _Batch(shapes)
    points, cut = batch.points, np.flatnonzero(batch.size >= np.where(batch.kind == 2, 3, 5))
    ring = batch.kind[cut] == 3
    keep = np.ones(len(points), bool)
    keep[_spans(batch.line_first[cut], batch.size[cut])[0]] = False
    ends = np.stack([batch.line_first[cut], batch.line_end[cut] - 1], 1)
    keep[ends] = True
    corners = batch.corners(cut[ring])
    keep[corners] = True
    # each shape's stretches (line, first, last) are a stack, its first line on top and of a ring its last stretch
    line = np.concatenate([cut[~ring], np.repeat(cut[ring], 3)])
    a = np.concatenate([ends[~ring, 0], corners[:, :3].ravel()])
    b = np.concatenate([ends[~ring, 1], corners[:, 1:].ravel()])
    order = np.lexsort((a, -line))
    stacks: list[list[tuple[int, int, int]]] = [[] for _ in shapes]
    for k, item in zip(batch.shape[line[order]].tolist(), zip(line[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True), strict=True):
        if item[2] - item[1] > 1:
            stacks[k].append(item)
    open_ = [s for s in stacks if s]
    while open_:
        line, a, b = np.array([s.pop() for s in open_]).T
        i, of = _spans(a + 1, b - a - 1)
        d, p = points[b] - points[a], points[i] - points[a][of]
        size = (d * d).sum(1)
        along = np.clip((p * d[of]).sum(1) / np.where(size > 0, size, 1.0)[of], 0.0, 1.0)
        away = p - along[:, None] * d[of]
        far = np.hypot(away[:, 0], away[:, 1])
        most = _most(far, of, len(a))
        split, shape = i[_first_most(far, of, most)], batch.shape[line]
        short = np.flatnonzero((most <= tolerance[shape]) & (d != 0).any(1))
        short = short[~batch.meets(shape[short], a[short], b[short])]
        short = short[~batch.encloses(line[short], a[short], b[short])]
        batch.replace(a[short], b[short])
        refused = np.ones(len(a), bool)
        refused[short] = False
        keep[split[refused]] = True
        for s, no, n, lo, mid, hi in zip(open_, refused.tolist(), line.tolist(), a.tolist(), split.tolist(), b.tolist(), strict=True):
            if no:
                if mid - lo > 1:
                    s.append((n, lo, mid))
                if hi - mid > 1:
                    s.append((n, mid, hi))
        open_ = [s for s in open_ if s]
    left = np.concatenate([[0], np.cumsum(keep)])
    kept, first, last = points[keep], left[batch.line_first].tolist(), left[batch.line_end].tolist()
    lines = iter(zip(first, last, strict=True))
    return [(kind, [kept[lo:hi] for lo, hi in (next(lines) for _ in parts)]) for kind, parts in shapes]


def simplify_shape(shape: Shape, tolerance: float) -> Shape:
    """simplify_shapes of one shape."""
    return simplify_shapes([shape], tolerance)[0]
