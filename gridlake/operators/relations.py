"""Relations of shapes by their intersection matrix: how the interiors, borders and outsides of two shapes meet.

Points, lines, areas and multi shapes of one kind all take the same way.  The segments of both shapes cut each other
into pieces; every vertex, every cut and every piece lies in one part (interior, border, outside) of either shape,
and so do the faces beside a piece of an area's border.  The matrix holds the highest dimension found in each pair of
parts, -1 for none.  Cuts are exact: coordinates become whole numbers over a power of two, cuts are fractions.

A batch is first tested at once, in numpy: pairs of segments that certainly stay apart are told by their boxes and by
the sign of determinants larger than their rounding error.  Shapes without any doubtful pair are decided by where one
vertex of each part lies; only the others are cut.

The border of lines is the set of their ends that occur an odd number of times; points have none.  An empty shape
meets nothing.  Collections of several kinds have no matrix (null).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import Shape, box, contains_points, read

INNER, BORDER, OUTER = 0, 1, 2
Exact = tuple[Fraction, Fraction]


def segments(shape: Shape) -> np.ndarray:
    """x0, y0, x1, y1 of a shape's segments; rings are closed, segments without length left out."""
    kind, parts = shape
    out = []
    for p in parts:
        if kind == 3 and len(p) and (p[0] != p[-1]).any():
            p = np.concatenate([p, p[:1]])
        if kind > 1 and len(p) > 1:
            out.append(np.hstack([p[:-1], p[1:]]))
    s = np.concatenate(out) if out else np.zeros((0, 4))
    return s[(s[:, :2] != s[:, 2:]).any(axis=1)]


def _line_ends(shape: Shape) -> set[tuple[float, float]]:
    counts = Counter(tuple(map(float, e)) for p in shape[1] if len(p) for e in (p[0], p[-1])) if shape[0] == 2 else Counter()
    return {e for e, n in counts.items() if n % 2}


class _Figure:
    """A shape in whole numbers (times a common scale), with the cuts made into its segments."""

    def __init__(self, shape: Shape, scale: int) -> None:
        whole = lambda v: int(Fraction(float(v)) * scale)
        self.kind, self.scale = shape[0], scale
        self.floats = segments(shape)
        self.segments = [tuple(whole(v) for v in row) for row in self.floats.tolist()]
        self.vertices = {(whole(x), whole(y)) for p in shape[1] for x, y in p.tolist()}
        self.ends = {(whole(x), whole(y)) for x, y in _line_ends(shape)}
        self.cuts: list[set[Fraction]] = [{Fraction(0), Fraction(1)} for _ in self.segments]
        self.along: list[list[tuple[Fraction, Fraction]]] = [[] for _ in self.segments]

    def at(self, i: int, t: Fraction) -> Exact:
        x0, y0, x1, y1 = self.segments[i]
        return x0 + (x1 - x0) * t, y0 + (y1 - y0) * t

    def own(self, point: Exact) -> int:
        """The part that a vertex or cut on the shape itself lies in."""
        return BORDER if self.kind == 3 or point in self.ends else INNER

    def side(self, point: Exact, d: Exact, left: bool) -> int:
        """The part beside a point on the left or right of a direction, for areas: crossings of a ray to that side."""
        n = (-d[1], d[0]) if left else (d[1], -d[0])
        v = lambda x, y: x * d[0] + y * d[1]
        u = lambda x, y: x * n[0] + y * n[1]
        vm, um, odd = v(*point), u(*point), False
        for x0, y0, x1, y1 in self.segments:
            v0, v1 = v(x0, y0), v(x1, y1)
            if (v0 > vm) != (v1 > vm):
                u0, u1 = u(x0, y0), u(x1, y1)
                gap = (u0 - um) * (v1 - v0) + (u1 - u0) * (vm - v0)
                odd ^= gap > 0 if v1 > v0 else gap < 0
        return INNER if odd else OUTER

    def holds(self, point: Exact) -> int:
        """The part that a point off the shape's border lies in."""
        if self.kind != 3:
            return OUTER
        x, y = point
        fx, fy = float(Fraction(x) / self.scale), float(Fraction(y) / self.scale)
        s, size = self.floats, max(1.0, abs(fx), abs(fy), float(np.abs(self.floats).max(initial=0.0)))
        det = (s[:, 2] - s[:, 0]) * (fy - s[:, 1]) - (fx - s[:, 0]) * (s[:, 3] - s[:, 1])
        sure = (np.minimum(np.abs(s[:, 1] - fy), np.abs(s[:, 3] - fy)) > 1e-12 * size) & (np.abs(det) > 1e-12 * size * size)
        sure |= (np.maximum(s[:, 1], s[:, 3]) < fy - 1e-12 * size) | (np.minimum(s[:, 1], s[:, 3]) > fy + 1e-12 * size)
        hit = ((s[:, 1] > fy) != (s[:, 3] > fy)) & ((det > 0) == (s[:, 3] > s[:, 1]))
        odd = bool((hit & sure).sum() % 2)
        for i in np.flatnonzero(~sure):
            x0, y0, x1, y1 = self.segments[i]
            if (y0 > y) != (y1 > y):
                odd ^= ((x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) > 0) == (y1 > y0)
        return INNER if odd else OUTER


def _cut(a: _Figure, b: _Figure) -> set[Exact]:
    """Cuts the segments of two figures by each other; all places where borders, lines and points meet."""
    meets: set[Exact] = set()
    p, q = a.floats, b.floats
    for i in range(len(p)):
        near = (np.minimum(q[:, 0], q[:, 2]) <= max(p[i, 0], p[i, 2])) & (np.maximum(q[:, 0], q[:, 2]) >= min(p[i, 0], p[i, 2]))
        near &= (np.minimum(q[:, 1], q[:, 3]) <= max(p[i, 1], p[i, 3])) & (np.maximum(q[:, 1], q[:, 3]) >= min(p[i, 1], p[i, 3]))
        ax, ay, bx, by = a.segments[i]
        rx, ry = bx - ax, by - ay
        for j in np.flatnonzero(near):
            cx, cy, dx, dy = b.segments[j]
            sx, sy, wx, wy = dx - cx, dy - cy, cx - ax, cy - ay
            den, off = rx * sy - ry * sx, wx * ry - wy * rx
            if den:
                t, u = Fraction(wx * sy - wy * sx, den), Fraction(off, den)
                if 0 <= t <= 1 and 0 <= u <= 1:
                    a.cuts[i].add(t)
                    b.cuts[j].add(u)
                    meets.add(a.at(i, t))
            elif off == 0:
                size, other = rx * rx + ry * ry, sx * sx + sy * sy
                t0 = Fraction(wx * rx + wy * ry, size)
                t1 = t0 + Fraction(sx * rx + sy * ry, size)
                low, high = max(Fraction(0), min(t0, t1)), min(Fraction(1), max(t0, t1))
                if low <= high:
                    u0, u1 = (Fraction(int((x - cx) * sx + (y - cy) * sy) if x == int(x) and y == int(y) else (x - cx) * sx + (y - cy) * sy) / other for x, y in (a.at(i, low), a.at(i, high)))
                    a.cuts[i] |= {low, high}
                    b.cuts[j] |= {u0, u1}
                    meets |= {a.at(i, low), a.at(i, high)}
                    if low < high:
                        a.along[i].append((low, high))
                        b.along[j].append((min(u0, u1), max(u0, u1)))
    return meets


def _points_on(a: _Figure, b: _Figure) -> set[Exact]:
    """Points of a (points) that lie on b's points or segments; those segments are cut there."""
    out = {p for p in a.vertices if p in b.vertices}
    for x, y in a.vertices:
        for j, (cx, cy, dx, dy) in enumerate(b.segments):
            if min(cx, dx) <= x <= max(cx, dx) and min(cy, dy) <= y <= max(cy, dy) and (dx - cx) * (y - cy) == (dy - cy) * (x - cx):
                size = (dx - cx) ** 2 + (dy - cy) ** 2
                b.cuts[j].add(Fraction((x - cx) * (dx - cx) + (y - cy) * (dy - cy), size))
                out.add((x, y))
    return out


def _fill(m: np.ndarray, a: _Figure, b: _Figure, meets: set[Exact], turned: bool) -> None:
    """Enters a's vertices, cuts and pieces, and the faces beside them."""

    def enter(i: int, j: int, dimension: int) -> None:
        i, j = (j, i) if turned else (i, j)
        m[i, j] = max(m[i, j], dimension)

    lone = a.vertices if not a.segments else {v for v in a.vertices if v in a.ends or v in meets}
    for p in lone:
        enter(a.own(p), b.own(p) if p in meets else b.holds(p), 0)
    known: dict[Exact, int] = {}  # the part of b that a vertex off b lies in, so neighbours need not be asked again
    for i in range(len(a.segments)):
        places = sorted(a.cuts[i])
        for t, u in zip(places, places[1:], strict=False):
            p, q = a.at(i, t), a.at(i, u)
            if p in meets:
                enter(a.own(p), b.own(p), 0)
            if q in meets:
                enter(a.own(q), b.own(q), 0)
            middle = a.at(i, (t + u) / 2)
            on = any(low <= t and u <= high for low, high in a.along[i])
            if on:
                part = BORDER if b.kind == 3 else INNER
            else:
                part = known.get(p) if p in known else known.get(q)
                part = b.holds(middle) if part is None else part
                for end in (p, q):
                    if end not in meets:
                        known[end] = part
            enter(BORDER if a.kind == 3 else INNER, part, 1)
            if a.kind == 3:
                if b.kind == 3 and on:
                    d = (q[0] - p[0], q[1] - p[1])
                    for left in (True, False):
                        enter(a.side(middle, d, left), b.side(middle, d, left), 2)
                else:
                    beside = part if b.kind == 3 else OUTER
                    enter(INNER, beside, 2)
                    enter(OUTER, beside, 2)


def matrix(a: Shape, b: Shape) -> np.ndarray:
    """3 x 3 dimensions (-1 for none) in which interior, border and outside of a meet those of b."""
    m = np.full((3, 3), -1)
    m[OUTER, OUTER] = 2
    values = [v for s in (a, b) for p in s[1] for v in p.ravel().tolist()]
    scale = max((Fraction(v).denominator for v in values), default=1)
    one, two = _Figure(a, scale), _Figure(b, scale)
    if a[0] == 1:
        meets = _points_on(one, two)
    elif b[0] == 1:
        meets = _points_on(two, one)
    else:
        meets = _cut(one, two)
    _fill(m, one, two, meets, False)
    _fill(m, two, one, meets, True)
    return m


def _any(m: np.ndarray, *cells: tuple[int, int]) -> np.ndarray:
    return np.any([m[..., i, j] >= 0 for i, j in cells], axis=0)


def holds(name: str, m: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
    """Whether a relation holds, for matrices and the kinds (1 to 3) of both shapes."""
    i, e = INNER, OUTER
    inner = m[..., i, i]
    if name in ("intersects", "disjoint"):
        meet = _any(m, (i, i), (i, BORDER), (BORDER, i), (BORDER, BORDER))
        return meet if name == "intersects" else ~meet
    if name == "within":
        return (inner >= 0) & ~_any(m, (i, e), (BORDER, e))
    if name == "contains":
        return (inner >= 0) & ~_any(m, (e, i), (e, BORDER))
    if name == "equals":
        return (inner >= 0) & ~_any(m, (i, e), (BORDER, e), (e, i), (e, BORDER))
    if name == "touches":
        return (inner < 0) & _any(m, (i, BORDER), (BORDER, i), (BORDER, BORDER))
    if name == "overlaps":
        return (a == b) & (inner == np.where(a == 2, 1, a - 1)) & (m[..., i, e] >= 0) & (m[..., e, i] >= 0)
    if name == "crosses":
        mixed = np.where(a < b, m[..., i, e] >= 0, m[..., e, i] >= 0) & (inner >= 0)
        return np.where(a == b, (a == 2) & (inner == 0), mixed)
    raise ValueError(f"unknown relation {name!r}; known: {', '.join(NAMES)}")


NAMES = ("intersects", "disjoint", "within", "contains", "equals", "touches", "overlaps", "crosses")


def _doubtful(s: np.ndarray, owner: np.ndarray, n: int, t: np.ndarray) -> np.ndarray:
    """Shapes of a batch with a segment or point that may meet a segment or point of the given shape."""
    out = np.zeros(n, bool)
    if not len(s) or not len(t):
        return out
    low, high = np.minimum(t[:, :2], t[:, 2:]), np.maximum(t[:, :2], t[:, 2:])
    step = max(1, 400_000 // len(t))
    turn = lambda p, q: (p[..., 2] - p[..., 0]) * (q[1] - p[..., 1]) - (p[..., 3] - p[..., 1]) * (q[0] - p[..., 0])
    size = lambda p, q: np.abs((p[..., 2] - p[..., 0]) * (q[1] - p[..., 1])) + np.abs((p[..., 3] - p[..., 1]) * (q[0] - p[..., 0]))
    for k in range(0, len(s), step):
        c = s[k : k + step, None, :]
        meet = (np.minimum(c[..., 0], c[..., 2]) <= high[:, 0]) & (np.maximum(c[..., 0], c[..., 2]) >= low[:, 0])
        meet &= (np.minimum(c[..., 1], c[..., 3]) <= high[:, 1]) & (np.maximum(c[..., 1], c[..., 3]) >= low[:, 1])
        i, j = np.nonzero(meet)
        p, q = s[k + i], t[j]
        apart = np.zeros(len(i), bool)
        for one, two in ((p, q), (q, p)):  # both ends of one on the same, certain side of the other
            first, last = turn(one, two[:, :2].T), turn(one, two[:, 2:].T)
            error = 1e-14 * (size(one, two[:, :2].T) + size(one, two[:, 2:].T))
            apart |= (np.minimum(first, last) > error) | (np.maximum(first, last) < -error)
        out[owner[k + i[~apart]]] = True
    return out


def matrices(shapes: Sequence[Shape | None], other: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of many shapes with another one, and their kinds; kind 0 for shapes without a matrix."""
    n = len(shapes)
    kinds = np.array([0 if s is None or s[0] not in (1, 2, 3) else s[0] for s in shapes])
    m = np.full((n, 3, 3), -1)
    m[:, OUTER, OUTER] = 2
    pieces = [(i, _pointed(s)) for i, s in enumerate(shapes) if kinds[i]]
    owner = np.concatenate([np.full(len(p), i) for i, p in pieces]) if pieces else np.zeros(0, int)
    flat = np.concatenate([p for _, p in pieces]) if pieces else np.zeros((0, 4))
    doubt = _doubtful(flat, owner, n, _pointed(other)) if n else np.zeros(0, bool)
    heads = [(i, p[0]) for i, s in enumerate(shapes) if kinds[i] for p in (s[1] if s[0] > 1 else [q[k : k + 1] for q in s[1] for k in range(len(q))]) if len(p)]
    who, first = np.array([i for i, _ in heads], int), np.array([p for _, p in heads]).reshape(-1, 2)
    inside = contains_points(other[1], first) if other[0] == 3 and len(first) else np.zeros(len(first), bool)
    ends = np.array([bool(_line_ends(s)) if kinds[i] == 2 else kinds[i] == 3 for i, s in enumerate(shapes)], bool)
    for part, flag in ((INNER, inside), (OUTER, ~inside)):
        _enter(m, np.bincount(who, flag, n) > 0 if len(who) else np.zeros(n, bool), kinds, ends, part, False, other[0])
    own_ends = bool(_line_ends(other)) if other[0] == 2 else other[0] == 3
    areas = kinds[owner] == 3
    for p in [q for part in other[1] for q in (part[:1] if other[0] > 1 else part)]:
        s = flat[areas]
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((s[:, 1] > p[1]) != (s[:, 3] > p[1])) & (p[0] < (s[:, 2] - s[:, 0]) * (p[1] - s[:, 1]) / (s[:, 3] - s[:, 1]) + s[:, 0])
        within = np.bincount(owner[areas], hit, n) % 2 == 1
        for part, flag in ((INNER, within), (OUTER, ~within)):
            _enter(m, flag & (kinds > 0), np.full(n, other[0]), np.full(n, own_ends), part, True, 0, kinds)
    for i in np.flatnonzero(doubt):
        m[i] = matrix(shapes[i], other)
    return m, kinds


def _pointed(shape: Shape) -> np.ndarray:
    """Segments, and points as segments without length (lines and rings without any length too)."""
    s = segments(shape) if shape[0] > 1 else np.zeros((0, 4))
    if len(s):
        return s
    points = np.concatenate(shape[1]) if shape[1] else np.zeros((0, 2))
    return np.hstack([points, points])


def _enter(m: np.ndarray, there: np.ndarray, kinds: np.ndarray, ends: np.ndarray, part: int, turned: bool, other: int, others: np.ndarray | None = None) -> None:
    """Enters whole parts of shapes that meet nothing of the other shape's border and lie in one part of it."""
    view = m.transpose(0, 2, 1) if turned else m
    area, line = there & (kinds == 3), there & (kinds == 2)
    put = lambda rows, i, d: view.__setitem__((rows, i, part), np.maximum(view[rows, i, part], d))
    put(there & (kinds == 1), INNER, 0)
    put(line, INNER, 1)
    put(line & ends, BORDER, 0)
    put(area, BORDER, 1)
    put(area, INNER, 2)
    beside = area & (others == 3 if others is not None else np.full(len(m), other == 3))
    put(beside, OUTER, 2)


def relation(name: str, shape: Shape, wkb: Column, boxes: Sequence[Column]) -> Column:
    """A condition for filters: the boxes decide first, in the scan; the exact test sees only shapes whose boxes meet."""
    holds(name, np.full((1, 3, 3), -1), np.array([1]), 1)  # an unknown name is an error of the plan, not of a row
    if not any(len(p) for p in shape[1]):
        return wkb.isNotNull() if name == "disjoint" else F.lit(False)
    x0, y0, x1, y1 = (float(v) for v in box(shape))
    meet = (boxes[0] <= x1) & (boxes[2] >= x0) & (boxes[1] <= y1) & (boxes[3] >= y0)

    @F.pandas_udf("boolean")
    def exact(values: pd.Series) -> pd.Series:
        m, kinds = _distinct(values, shape)
        found = holds(name, m, kinds, shape[0]) if len(kinds) else np.zeros(0, bool)
        return pd.Series(found, dtype=object).where(kinds > 0, None)

    return ~meet | exact(F.when(meet, wkb)) if name == "disjoint" else meet & exact(F.when(meet, wkb))


def matrix_text(wkb: Column, shape: Shape) -> Column:
    """The matrix as nine characters, row by row: F for none, else the dimension."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        m, kinds = _distinct(values, shape)
        return pd.Series(["".join("F" if v < 0 else str(v) for v in row.ravel()) if k else None for row, k in zip(m, kinds, strict=True)], dtype=object)

    return text(wkb)


def related(df: DataFrame, name: str, shape: Shape, wkb: str = "wkb", boxes: tuple[str, ...] = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """Rows whose shape stands in a relation to a given one.

    Box columns decide first, in the scan; only shapes whose boxes meet go through Arrow, a batch at a time."""
    if name != "disjoint":
        x0, y0, x1, y1 = (float(v) for v in box(shape))
        a, b, c, d = (F.col(n) for n in boxes)
        df = df.where((a <= x1) & (c >= x0) & (b <= y1) & (d >= y0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, kinds = _distinct(batch.column(wkb).to_pandas(), shape)
            yield batch.filter(pa.array(holds(name, m, kinds, shape[0]) & (kinds > 0)))

    return df.mapInArrow(run, df.schema)


_KNOWN: dict[tuple[bytes, bytes | None], tuple[np.ndarray, int]] = {}  # of short values, in each Python worker
_KEPT, _SHORT = 65_536, 2_048


def _distinct(values: pd.Series, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Matrices and kinds of a batch's values; equal values are read and tested once, short ones once for all batches
    and relations that a worker sees."""
    at, found = pd.factorize(values.map(lambda v: None if v is None else bytes(v)), use_na_sentinel=False)
    own = b"".join([bytes([shape[0]]), *(len(p).to_bytes(8, "little") + p.astype("<f8").tobytes() for p in shape[1])])
    keys = [(own, v if isinstance(v, bytes) else None) for v in found]
    new = [i for i, k in enumerate(keys) if k not in _KNOWN]
    m, kinds = np.full((len(keys), 3, 3), -1), np.zeros(len(keys), int)
    m[new], kinds[new] = matrices(_read(found[new]), shape)
    for i in set(range(len(keys))) - set(new):
        m[i], kinds[i] = _KNOWN[keys[i]]
    if len(_KNOWN) + len(new) > _KEPT:
        _KNOWN.clear()
    _KNOWN.update((keys[i], (m[i], int(kinds[i]))) for i in new[:_KEPT] if len(keys[i][1] or b"") <= _SHORT)
    return m[at], kinds[at]


def _read(values) -> list[Shape | None]:
    """Shapes of WKB values, without parts that are not numbers (an empty point)."""
    shapes = [read(v) if isinstance(v, bytes) else None for v in values]
    return [s if s is None or all(np.isfinite(p).all() for p in s[1]) else (s[0], [p for p in s[1] if np.isfinite(p).all()]) for s in shapes]
