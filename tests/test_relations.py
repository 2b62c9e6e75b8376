"""Relations of shapes: against sets of lattice elements, and the cases that plain tests of vertices get wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import geometry, relations
from gridlake.plans.filters import Filters
from gridlake.queries import lattice

read = geometry.from_text


def true(a, b):
    a, b = read(a), read(b)
    exact = relations.matrix(a, b)
    quick, kinds = relations.matrices([a], b)
    assert (exact == quick[0]).all()
    return {n for n in relations.NAMES if relations.holds(n, exact, np.array(a[0]), b[0])}


A = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"


@pytest.mark.parametrize(("a", "b", "names"), [
    ("MULTILINESTRING((10 10, 11 11), (1 1, 2 2))", A, {"intersects", "crosses"}),
    ("MULTIPOLYGON(((10 10, 11 10, 11 11, 10 10)), ((1 1, 2 1, 2 2, 1 1)))", A, {"intersects", "overlaps"}),
    (A, A, {"intersects", "within", "contains", "equals"}),
    ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", A, {"intersects", "within"}),
    ("POINT(0 2)", A, {"intersects", "touches"}),
    ("POINT(4 2)", A, {"intersects", "touches"}),
    ("POINT(4 4)", A, {"intersects", "touches"}),
    ("POINT(2 2)", "LINESTRING(0 0, 4 4)", {"intersects", "within"}),
    ("POINT(0 0)", "LINESTRING(0 0, 4 4)", {"intersects", "touches"}),
    ("LINESTRING(1 1, 2 2)", "LINESTRING(0 0, 4 4)", {"intersects", "within"}),
    ("POINT(2 2)", "POINT(2 2)", {"intersects", "within", "contains", "equals"}),
    ("LINESTRING(0 0, 4 4)", "LINESTRING(4 4, 2 2, 0 0)", {"intersects", "within", "contains", "equals"}),
    ("LINESTRING(0 0, 4 4)", "LINESTRING(0 4, 4 0)", {"intersects", "crosses"}),
    ("LINESTRING(0 0, 2 2)", "LINESTRING(1 1, 4 4)", {"intersects", "overlaps"}),
    ("LINESTRING(0 0, 2 2)", "LINESTRING(2 2, 4 0)", {"intersects", "touches"}),
    ("MULTIPOINT(0 0, 9 9)", "MULTIPOINT(0 0, 1 1)", {"intersects", "overlaps"}),
    ("MULTIPOINT(1 1, 9 9)", A, {"intersects", "crosses"}),
    ("LINESTRING(0 1, 0 3)", A, {"intersects", "touches"}),
    ("POLYGON((1 1, 2 1, 2 2, 1 1))", "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1))", {"intersects", "touches"}),
    ("POINT(9 9)", A, {"disjoint"}),
    ("LINESTRING(0 0, 3 1)", "LINESTRING(1 1, 2 0)", {"intersects", "crosses"}),
    ("LINESTRING(0 0, 0.3 0.1)", "POINT(0.15 0.05)", {"intersects", "contains"}),
])
def test_named_cases(a, b, names):
    assert true(a, b) == names
    turned = {"within": "contains", "contains": "within"}
    assert true(b, a) == {turned.get(n, n) for n in names}


def by_sets(a, b):
    one, two = lattice.elements(a), lattice.elements(b)
    m = np.full((3, 3), -1)
    m[2, 2] = 2
    for e in one.keys() | two.keys():
        i, j = one.get(e, 2), two.get(e, 2)
        m[i, j] = max(m[i, j], {"v": 0, "r": 2, "l": 2}.get(e[0], 1))
    return m


def moved(text, dx, dy):
    kind, parts = read(text)
    return kind, [p + (dx, dy) for p in parts]


def as_text(text, dx, dy):
    import re

    return re.sub(r"(-?\d+) (-?\d+)", lambda m: f"{int(m[1]) + dx} {int(m[2]) + dy}", text)


def test_matrices_agree_with_lattice_sets():
    rng = random.Random(0)
    for other in lattice.TARGETS.values():
        cases = [(t, rng.randint(-1, 7), rng.randint(-1, 7)) for t in lattice.KINDS for _ in range(25)]
        found, _ = relations.matrices([moved(*c) for c in cases], read(other))
        for case, m in zip(cases, found, strict=True):
            wanted = by_sets(as_text(*case), other)
            assert (m == wanted).all(), (case, other, m.tolist(), wanted.tolist())
            assert (relations.matrix(moved(*case), read(other)) == wanted).all(), case


def test_matrices_of_turned_and_scaled_shapes():
    """The same matrices when coordinates are no whole numbers: shapes in 45 degree turns scaled by 0.1."""
    turn = np.array([[0.1, 0.1], [-0.1, 0.1]])
    rng = random.Random(1)
    for other in lattice.TARGETS.values():
        kind, parts = read(other)
        target = kind, [p @ turn for p in parts]
        for t in lattice.KINDS:
            dx, dy = rng.randint(-1, 7), rng.randint(-1, 7)
            k, p = moved(t, dx, dy)
            m = relations.matrix((k, [v @ turn for v in p]), target)
            assert m[2, 2] == 2 and m.max() == 2  # rounding moves borders, but nothing raises


def test_empty_mixed_and_strange_values(spark):
    import struct

    empty_point = struct.pack("<BI2d", 1, 1, float("nan"), float("nan"))
    empty_area = struct.pack("<BII", 1, 3, 0)
    mixed = struct.pack("<BII", 1, 7, 2) + geometry.write(read("POINT(1 1)")) + geometry.write(read("LINESTRING(0 0, 1 1)"))
    flat = geometry.write((2, [np.array([(1.0, 1), (1, 1)])]))
    sliver = geometry.write(read("POLYGON((0 0, 4 4, 0 0))"))
    values = [None, empty_point, empty_area, mixed, flat, sliver, geometry.write(read("POINT(1 1)"))]
    df = spark.createDataFrame([(i, v, 0.0, 0.0, 9.0, 9.0) for i, v in enumerate(values)], "id int, wkb binary, xmin double, ymin double, xmax double, ymax double").repartition(2)
    for name in relations.NAMES:
        rows = {r.id: r.v for r in df.select("id", Filters({"id": "id"}).compile([name, A]).alias("v")).collect()}
        assert rows[0] is None and rows[3] is None
        assert rows[1] == rows[2] == (name == "disjoint")
        assert rows[6] == (name in ("intersects", "within"))
    texts = {r.id: r.t for r in df.select("id", relations.matrix_text(F.col("wkb"), read(A)).alias("t")).collect()}
    assert texts[0] is None and texts[1] == "FFFFFF212" and texts[6] == "0FFFFF212"


def crossings(parts):
    """Pairs of segments, not neighbours, that meet; pieces of a ring that lie on each other count."""
    segments = [(i, k, tuple(p[k]), tuple(p[k + 1]), len(p) - 1) for i, p in enumerate(parts) for k in range(len(p) - 1)]
    found = 0
    for n, (i, k, a, b, size) in enumerate(segments):
        for j, m, c, d, _ in segments[n + 1 :]:
            shape = (2, [np.array([a, b])]), (2, [np.array([c, d])])
            relation = relations.matrix(*shape)
            near = i == j and (m - k in (1, size - 1))
            found += relation[0, 0] > 0 or (not near and relations.holds("intersects", relation, np.array(2), 2))
    return found


def test_simplification_keeps_the_topology():
    rng, removed = np.random.default_rng(7), 0
    for case in range(25):
        n = int(rng.integers(12, 40))
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        if np.diff(angle).max() > 2.5 or angle[0] + 2 * np.pi - angle[-1] > 2.5:
            continue
        ring = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(3, 10, n)[:, None]
        ring = np.concatenate([ring, ring[:1]])
        parts = [ring, ring * 0.15 + rng.uniform(-0.1, 0.1, 2)] if case % 2 else [ring]
        assert not crossings(parts)
        for tolerance in (0.3, 1.0, 4.0):
            _, made = geometry.simplify_shape((3, parts), tolerance)
            assert not crossings(made) and len(made) == len(parts)
            assert all(len(p) >= 4 and (p[0] == p[-1]).all() and geometry.area(p) != 0 for p in made)
            assert len(made) == 1 or geometry.contains_points(made[:1], made[1]).all()
            removed += sum(map(len, parts)) - sum(map(len, made))
    assert removed > 200
    line = (2, [np.array([(0.0, 0), (5, 0.2), (10, 0)]), np.array([(4.0, 0.1), (6, 0.1)])])
    assert len(geometry.simplify_shape(line, 1.0)[1][0]) == 3  # the other line lies between
    assert len(geometry.simplify_shape((2, line[1][:1]), 1.0)[1][0]) == 2


def test_shapes_are_simplified_side_by_side(monkeypatch):
    """Each shape of a batch comes out as it does alone, and a batch takes a few rounds, not some for each shape."""
    rng, shapes, tolerances = np.random.default_rng(11), [], []
    for case in range(200):
        angle = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 40))))
        ring = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(3, 10, len(angle))[:, None]
        ring = np.concatenate([ring, ring[:1]])
        shapes.append([(3, [ring]), (3, [ring, ring * 0.15, ring * 0.05 + 1]), (2, [ring[:-1], ring[: case % 7] + 1]), (1, [ring])][case % 4])
        tolerances.append([0.0, 0.3, 1.0, 4.0][case // 4 % 4])
    alone = [geometry.simplify_shape(s, t) for s, t in zip(shapes, tolerances, strict=True)]
    rounds, meets = [], geometry._Batch.meets
    monkeypatch.setattr(geometry._Batch, "meets", lambda *a: rounds.append(1) or meets(*a))
    together = geometry.simplify_shapes(shapes, tolerances)
    assert len(rounds) < 200
    for (kind, parts), (other, wanted) in zip(together, alone, strict=True):
        assert kind == other and len(parts) == len(wanted) and all(np.array_equal(p, q) for p, q in zip(parts, wanted, strict=True))
    assert sum(len(p) for _, parts in together for p in parts) < sum(len(p) for _, parts in shapes for p in parts)
    corner = (2, [np.array([(-4.0, 2), (-4, 1), (-5, 1), (-8, 2)])])  # (-4, 2) has one coordinate of each end of the shortcut
    assert geometry.simplify_shapes([corner], 0.3)[0][1][0].tolist() == [[-4, 2], [-4, 1], [-8, 2]]
