"""Queries of exact relations: shapes on a lattice of squares cut by diagonals, whose matrix SQL finds from sets.

A shape is a set of vertices, edges (upright, level or diagonal) and triangles of the lattice, each with the part
(interior 0, border 1) it lies in.  Two shapes' matrix is then a join of two sets, whatever their geometry is.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import geometry, relations
from ..plans.filters import Filters
from ..sources.derived import view
from .registry import query

KINDS = (
    "POLYGON((0 0, 3 0, 3 3, 0 0))",
    "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))",
    "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((2 2, 4 2, 4 4, 2 4, 2 2)))",
    "LINESTRING(0 0, 2 2, 4 2)",
    "MULTILINESTRING((0 0, 2 0), (0 2, 2 2, 2 4))",
    "MULTIPOINT(0 0, 2 1)",
    "POINT(1 1)",
    "LINESTRING(0 0, 2 0, 2 2, 0 0)",
    "POLYGON((0 0, 6 0, 6 6, 0 6, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))",
    "LINESTRING(0 0, 4 4, 6 4)",
)
TARGETS = {
    "area": "POLYGON((2 2, 8 2, 8 8, 2 8, 2 2), (4 4, 6 4, 6 6, 4 6, 4 4))",
    "areas": "MULTIPOLYGON(((2 2, 5 2, 5 5, 2 2)), ((6 6, 8 6, 8 8, 6 8, 6 6)))",
    "line": "LINESTRING(2 2, 6 6, 8 6)",
    "lines": "MULTILINESTRING((2 2, 4 2), (2 4, 4 4, 4 6))",
    "points": "MULTIPOINT(2 2, 4 3, 6 6)",
}
STEP = 1000.0
Element = tuple[str, int, int]


def elements(text: str) -> dict[Element, int]:
    """Part of each lattice element that a shape covers: v (vertex), h, u, d (level, upright, diagonal edge), r, l (triangle)."""
    kind, parts = geometry.from_text(text)
    points = [[tuple(map(int, p)) for p in part.tolist()] for part in parts]
    if kind == 1:
        return {("v", x, y): 0 for part in points for x, y in part}
    edges: list[Element] = []
    ends: list[tuple[int, int]] = []
    for part in points:
        ends += [part[0], part[-1]]
        for (x0, y0), (x1, y1) in zip(part, part[1:], strict=False):
            n = max(abs(x1 - x0), abs(y1 - y0))
            dx, dy = (x1 - x0) // n, (y1 - y0) // n
            edges += [("u" if not dx else "d" if dy else "h", min(x0 + k * dx, x0 + (k + 1) * dx), min(y0 + k * dy, y0 + (k + 1) * dy)) for k in range(n)]
    reach = {"h": (1, 0), "u": (0, 1), "d": (1, 1)}
    corners = {("v", x + i * reach[e][0], y + i * reach[e][1]) for e, x, y in edges for i in (0, 1)}
    if kind == 2:
        return {e: 0 for e in edges} | {v: int(ends.count(v[1:]) % 2) for v in corners}
    span = range(-1, 12)
    middle = {"r": (2 / 3, 1 / 3), "l": (1 / 3, 2 / 3)}
    cells = [(t, x, y) for t in "rl" for x in span for y in span]
    inside = geometry.contains_points(parts, np.array([(x + middle[t][0], y + middle[t][1]) for t, x, y in cells]))
    faces = {c for c, i in zip(cells, inside, strict=True) if i}
    beside = {"h": [("r", 0, 0), ("l", 0, -1)], "u": [("r", -1, 0), ("l", 0, 0)], "d": [("r", 0, 0), ("l", 0, 0)], "v": [("r", 0, 0), ("l", 0, 0), ("r", -1, 0), ("r", -1, -1), ("l", -1, -1), ("l", 0, -1)]}
    out = dict.fromkeys(faces, 0)
    for e, around in beside.items():
        for x in span:
            for y in span:
                held = sum((t, x + i, y + j) in faces for t, i, j in around)
                if held:
                    out[e, x, y] = 0 if held == len(around) else 1
    return out


def wkb(text: str, dx: float, dy: float, step: float = STEP) -> bytes:
    """A lattice shape moved and scaled; multi shapes as such."""
    kind, parts = geometry.from_text(text)
    parts = [(p + (dx, dy)) * step for p in parts]
    if not text.startswith("MULTI"):
        return geometry.write((kind, parts))
    single = [p[i : i + 1] for p in parts for i in range(len(p))] if kind == 1 else parts
    return struct.pack("<BII", 1, kind + 3, len(single)) + b"".join(geometry.write((kind, [p])) for p in single)


def scaled(text: str, step: float = STEP) -> geometry.Shape:
    kind, parts = geometry.from_text(text)
    return kind, [p * step for p in parts]


_PLACE = {"k": f"id % {len(KINDS)}", "ox": f"floor(id / {len(KINDS)}) % 9 - 1", "oy": f"floor(id / {len(KINDS) * 9}) % 9 - 1"}


def _shapes(spark, sf_dir):
    """id, wkb, box: ten kinds of shapes at 81 places."""
    sizes = F.array(*(F.array(*(F.lit(float(v)) for v in geometry.box(geometry.from_text(t)))) for t in KINDS))

    @F.pandas_udf("binary")
    def made(k: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        known = {key: wkb(KINDS[key[0]], *key[1:]) for key in set(zip(k, x, y, strict=True))}
        return pd.Series([known[key] for key in zip(k, x, y, strict=True)])

    p = view(spark, sf_dir, "fx_polygons").select("id", *(F.expr(e).cast("int").alias(n) for n, e in _PLACE.items()))
    corner = lambda i, o: ((F.get(F.get(sizes, F.col("k")), F.lit(i)) + F.col(o)) * STEP)
    boxes = {n: corner(i, o) for i, (n, o) in enumerate((("xmin", "ox"), ("ymin", "oy"), ("xmax", "ox"), ("ymax", "oy")))}
    return p.withColumns({**boxes, "wkb": made("k", "ox", "oy")})


_DIMENSION = "case when e = 'v' then 0 when e in ('r', 'l') then 2 else 1 end"


def _matrix_sql(target: str) -> str:
    """id, k and m: cells (part of the one, part of the other) with their highest dimension."""
    kinds = ", ".join(f"({k}, '{e}', {x}, {y}, {p})" for k, text in enumerate(KINDS) for (e, x, y), p in elements(text).items())
    other = ", ".join(f"('{e}', {x}, {y}, {p})" for (e, x, y), p in elements(TARGETS[target]).items())
    return f"""with kinds(k, e, x, y, p) as (values {kinds}), other(e, x, y, p) as (values {other}),
shapes as (select id, {', '.join(f'cast({e} as int) as {n}' for n, e in _PLACE.items())} from fx_polygons),
places as (select distinct k, ox, oy from shapes),
mine as (select k, ox, oy, e, x + ox as x, y + oy as y, p from places join kinds using (k)),
cells as (select k, ox, oy, mine.p as a, coalesce(other.p, 2) as b, e, x, y from mine left join other using (e, x, y)
  union all select k, ox, oy, 2, other.p, e, x, y from places, other where not exists (select 1 from mine m where m.k = places.k and m.ox = places.ox and m.oy = places.oy and m.e = other.e and m.x = other.x and m.y = other.y)),
held as (select k, ox, oy, a, b, max({_DIMENSION}) as d from cells group by all union all select k, ox, oy, 2, 2, 2 from places),
full_cells as (select p.*, a.a, b.b, coalesce(h.d, -1) as d from places p cross join (values (0), (1), (2)) a(a) cross join (values (0), (1), (2)) b(b) left join held h on h.k = p.k and h.ox = p.ox and h.oy = p.oy and h.a = a.a and h.b = b.b),
texts as (select k, ox, oy, string_agg(case when d < 0 then 'F' else cast(d as varchar) end, '' order by a, b) as m from full_cells group by all)"""


_RULES = """not (m[1] = 'F' and m[2] = 'F' and m[4] = 'F' and m[5] = 'F') as intersects, m[1] = 'F' and m[2] = 'F' and m[4] = 'F' and m[5] = 'F' as disjoint,
m[1] <> 'F' and m[3] = 'F' and m[6] = 'F' as within, m[1] <> 'F' and m[7] = 'F' and m[8] = 'F' as contains,
m[1] <> 'F' and m[3] = 'F' and m[6] = 'F' and m[7] = 'F' and m[8] = 'F' as equals, m[1] = 'F' and not (m[2] = 'F' and m[4] = 'F' and m[5] = 'F') as touches,
a = b and m[1] = (case when a = 2 then '1' else cast(a - 1 as varchar) end) and m[3] <> 'F' and m[7] <> 'F' as overlaps,
case when a = b then a = 2 and m[1] = '0' when a < b then m[1] <> 'F' and m[3] <> 'F' else m[1] <> 'F' and m[7] <> 'F' end as crosses"""
_KIND = "case {} end".format(" ".join(f"when k = {k} then {geometry.from_text(t)[0]}" for k, t in enumerate(KINDS)))


def _queries(name: str) -> None:
    text = TARGETS[name]
    shape = scaled(text)

    @query(f"{_matrix_sql(name)} select id, m as matrix from shapes join texts using (k, ox, oy)", name=f"matrix_of_{name}")
    def matrices(spark, sf_dir):
        return _shapes(spark, sf_dir).select("id", relations.matrix_text(F.col("wkb"), shape).alias("matrix"))

    @query(f"{_matrix_sql(name)} select id, {_RULES} from (select *, {_KIND} as a, {shape[0]} as b from shapes join texts using (k, ox, oy))", name=f"relations_to_{name}")
    def all_relations(spark, sf_dir):
        filters, given = Filters({"id": "id"}), wkb(text, 0, 0)
        return _shapes(spark, sf_dir).select("id", *(filters.compile([n, given]).alias(n) for n in relations.NAMES))


_SPIKE = {"h": "5 + 20 * (id % 2)", "hole": "id % 3", "teeth": "floor(id / 6) % 4"}
_TOLERANCE = 10.0


@query(f"""with s as (select id, {', '.join(f'cast({e} as int) as {n}' for n, e in _SPIKE.items())} from fx_polygons)
select id, case when hole = 0 then 2 else 1 end as rings, 5 + case when h > {_TOLERANCE} then 3 when hole = 0 then 1 else 0 end as outer_points, case when hole = 0 then 4 end as hole_points from s""")
def simplify_topology(spark, sf_dir):
    """Squares with teeth below the tolerance on one side and a spike on another; a hole inside the spike
    keeps its tip, however low it is; the feet of a high spike stay as well."""
    p = view(spark, sf_dir, "fx_polygons").select("id", *(F.expr(e).cast("int").alias(n) for n, e in _SPIKE.items()))

    @F.pandas_udf("struct<rings: int, outer_points: int, hole_points: int>")
    def counted(h: pd.Series, hole: pd.Series, teeth: pd.Series) -> pd.DataFrame:
        shapes = []
        for high, kind, n in zip(h, hole, teeth, strict=True):
            side = [(1000.0 * (k + 0.5 * j) / n, 0.0 if j == 0 else -4.0) for k in range(n) for j in (0, 1)] if n else [(0.0, 0.0)]
            ring = np.array([*side, (1000.0, 0.0), (1000.0, 1000.0), (501.0, 1000.0), (500.0, 1000.0 + high), (499.0, 1000.0), (0.0, 1000.0), (0.0, 0.0)])
            tip = np.array([(499.9, 1000.0 + 0.2 * high), (500.1, 1000.0 + 0.2 * high), (500.0, 1000.0 + 0.6 * high), (499.9, 1000.0 + 0.2 * high)])
            shapes.append(geometry.read(geometry.write((3, [ring, tip] if kind == 0 else [ring]))))
        out = [(len(parts), len(parts[0]), len(parts[1]) if len(parts) > 1 else None) for _, parts in geometry.simplify_shapes(shapes, _TOLERANCE)]
        return pd.DataFrame(out, columns=["rings", "outer_points", "hole_points"]).astype("Int32")

    return p.select("id", counted("h", "hole", "teeth").alias("c")).select("id", "c.*")


for _name in TARGETS:
    _queries(_name)
