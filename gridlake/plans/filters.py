"""JSON filter expressions of vector layers, as boolean Columns.

An expression is a list: an operator's name, then arguments.  Scalars are literals; ["get", name] is a
field; a bare name may stand first in a comparison.  SQL's three-valued logic holds, so a row whose field
is null fails every comparison with it.  Unknown operators and fields raise ValueError: an expression that
is passed on as text would hide mistakes.  compat=True keeps one habit of older layers: "like" reads "." as
any one character (that is always so) and typing wrappers do not cast.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping
from functools import reduce
from operator import add, and_, eq, ge, gt, le, lt, mod, mul, ne, or_, sub, truediv

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import geometry, relations

COMPARE = {"==": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}
ARITHMETIC = {"+": add, "-": sub, "*": mul, "/": truediv, "%": mod, "^": F.pow}
FUNCTIONS: dict[str, Callable[..., Column]] = {"floor": F.floor, "ceil": F.ceil, "abs": F.abs, "min": F.least, "max": F.greatest}
TYPING = {"array": None, "boolean": None, "number": None, "string": None, "literal": None, "to-boolean": "boolean", "to-number": "double", "to-string": "string"}
BOX = ("xmin", "ymin", "xmax", "ymax")


class Filters:
    """fields: names used in expressions -> columns of the table; shape: the column of WKB that exact relations test."""

    def __init__(self, fields: Mapping[str, str], geometry: str = "geom_type", cast_types: bool = False, functions: Mapping[str, Callable[..., Column]] | None = None, shape: str = "wkb") -> None:
        self.shape = shape
        self.fields, self.geometry, self.cast_types = dict(fields), geometry, cast_types
        self.functions = {**FUNCTIONS, **(functions or {})}

    def compile(self, expression) -> Column:
        return self._value(expression)

    def field(self, name: str) -> Column:
        if name not in self.fields:
            raise ValueError(f"field {name!r} is not present in the layer's fields")
        return F.col(self.fields[name])

    def _value(self, x) -> Column:
        if isinstance(x, Column):
            return x
        if isinstance(x, (list, tuple)):
            if not x or not isinstance(x[0], str):
                raise ValueError(f"not an expression: {x!r}")
            return self._call(x[0], list(x[1:]))
        return F.lit(x)

    def _left(self, x) -> Column:
        """First argument of a comparison: a bare string names a field."""
        return self.field(x) if isinstance(x, str) else self._value(x)

    @staticmethod
    def _need(op: str, args: list, least: int, most: int | None = None) -> None:
        if len(args) < least or (most is not None and len(args) > most):
            raise ValueError(f"{op}: wrong number of arguments ({len(args)})")

    def _call(self, op: str, args: list) -> Column:
        if op in ("all", "any", "none"):
            self._need(op, args, 1)
            parts = [self._value(a) for a in args]
            return reduce(and_, parts) if op == "all" else reduce(or_, parts) if op == "any" else ~reduce(or_, parts)
        if op == "!":
            self._need(op, args, 1, 1)
            return ~self._value(args[0])
        if op in COMPARE:
            self._need(op, args, 2, 2)
            if args[0] == "$type" or args[0] == ["geometry-type"]:
                return COMPARE[op](F.col(self.geometry), F.lit(f"ST_{args[1]}"))
            return COMPARE[op](self._left(args[0]), self._value(args[1]))
        if op in ("in", "!in"):
            self._need(op, args, 2)
            values = args[1:]
            if len(values) == 1 and isinstance(values[0], (list, tuple)):
                values = values[0][1] if values[0] and values[0][0] == "literal" else values[0]
            found = self._left(args[0]).isin(*values)
            return found if op == "in" else ~found
        if op in ("has", "!has"):
            self._need(op, args, 1, 1)
            return self.field(args[0]).isNotNull() if op == "has" else self.field(args[0]).isNull()
        if op == "get":
            self._need(op, args, 1, 1)
            return self.field(args[0])
        if op == "like":
            self._need(op, args, 2, 3)
            options = args[2] if len(args) == 3 else {}
            return F.like(self._left(args[0]), F.lit(like_pattern(args[1], options.get("wildCard", "%"))), F.lit("\\"))
        if op == "between":
            self._need(op, args, 3, 3)
            return self._left(args[0]).between(self._value(args[1]), self._value(args[2]))
        if op in TYPING:
            self._need(op, args, 1)
            value = self._value(args[0])
            return value.try_cast(TYPING[op]) if self.cast_types and TYPING[op] else value
        if op in ARITHMETIC:
            self._need(op, args, 2, 2)
            return ARITHMETIC[op](self._value(args[0]), self._value(args[1]))
        if op in self.functions:
            return self.functions[op](*(self._value(a) for a in args))
        if op in ("before", "after", "during"):
            self._need(op, args, 2, 3)
            at = self._left(args[0])
            if op == "before":
                return at < _instant(args[1])
            if op == "after":
                return at > _instant(args[1])
            start, end = args[1:] if len(args) == 3 else args[1]
            return reduce(and_, [c for c in (None if start is None else at > _instant(start), None if end is None else at < _instant(end)) if c is not None])
        if op == "bbox":
            self._need(op, args, 4, 4)
            return overlaps(tuple(F.col(c) for c in BOX), tuple(F.lit(float(a)) for a in args))
        if op in SPATIAL:
            self._need(op, args, 1, 1)
            if isinstance(args[0], (str, bytes)):  # well-known text or binary: the exact relation
                shape = geometry.from_text(args[0]) if isinstance(args[0], str) else geometry.read(args[0])
                return relations.relation(op, shape, F.col(self.shape), [F.col(c) for c in BOX])
            return SPATIAL[op](tuple(F.col(c) for c in BOX), tuple(F.lit(float(a)) for a in args[0]))
        if op in ("dwithin", "beyond"):
            self._need(op, args, 3, 3)
            return distance_within(tuple(F.col(c) for c in BOX), args[0], args[1], float(args[2]), beyond=op == "beyond")
        if op in ARRAYS:
            self._need(op, args, 2, 2)
            return ARRAYS[op](self._left(args[0]), F.array(*(F.lit(v) for v in args[1])))
        raise ValueError(f"unknown operator {op!r}")


def _instant(x) -> Column:
    if isinstance(x, (datetime.datetime, datetime.date)):
        return F.lit(x)
    return F.lit(str(x)).cast("timestamp_ntz")


def like_pattern(pattern: str, wildcard: str = "%") -> str:
    """A pattern for SQL LIKE: the wildcard is %, and a dot any one character."""
    return pattern.replace(wildcard, "%").replace(".", "_") if wildcard != "." else pattern.replace(".", "%")


Box = tuple[Column, Column, Column, Column]


def overlaps(a: Box, b: Box) -> Column:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def inside(a: Box, b: Box) -> Column:
    return (a[0] >= b[0]) & (a[2] <= b[2]) & (a[1] >= b[1]) & (a[3] <= b[3])


def _interiors_meet(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


#: Relations of upright rectangles, for boxes as arguments; shapes as arguments are tested exactly.
SPATIAL: dict[str, Callable[[Box, Box], Column]] = {
    "intersects": overlaps,
    "disjoint": lambda a, b: ~overlaps(a, b),
    "within": inside,
    "contains": lambda a, b: inside(b, a),
    "equals": lambda a, b: (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3]),
    "touches": lambda a, b: overlaps(a, b) & ~_interiors_meet(a, b),
    "overlaps": lambda a, b: _interiors_meet(a, b) & ~inside(a, b) & ~inside(b, a),
    "crosses": lambda a, b: F.lit(False),  # never true of two areas
}


def distance_within(box: Box, x: float, y: float, limit: float, beyond: bool = False) -> Column:
    """Whether a point lies within (or beyond) a distance of a rectangle; squares, so no root is rounded."""
    dx = F.greatest(box[0] - x, F.lit(0.0), F.lit(float(x)) - box[2])
    dy = F.greatest(box[1] - y, F.lit(0.0), F.lit(float(y)) - box[3])
    near = dx * dx + dy * dy <= limit * limit
    return ~near if beyond else near


ARRAYS: dict[str, Callable[[Column, Column], Column]] = {
    "array-equals": lambda a, b: F.array_sort(a) == F.array_sort(b),
    "array-contains": lambda a, b: F.size(F.array_except(b, a)) == 0,
    "array-contained-by": lambda a, b: F.size(F.array_except(a, b)) == 0,
    "array-overlaps": F.arrays_overlap,
}

#: Relations of two intervals (start, end), by the fifteen names of interval algebra used in filters.
INTERVALS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "after": lambda a, b, c, d: a > d,
    "before": lambda a, b, c, d: b < c,
    "begins": lambda a, b, c, d: (a == c) & (b < d),
    "begun-by": lambda a, b, c, d: (a == c) & (b > d),
    "contains": lambda a, b, c, d: (a < c) & (b > d),
    "during": lambda a, b, c, d: (a > c) & (b < d),
    "ended-by": lambda a, b, c, d: (a < c) & (b == d),
    "ends": lambda a, b, c, d: (a > c) & (b == d),
    "equals": lambda a, b, c, d: (a == c) & (b == d),
    "meets": lambda a, b, c, d: b == c,
    "met-by": lambda a, b, c, d: a == d,
    "overlaps": lambda a, b, c, d: (a < c) & (b > c) & (b < d),
    "overlapped-by": lambda a, b, c, d: (a > c) & (a < d) & (b > d),
    "before-or-during": lambda a, b, c, d: b < d,
    "during-or-after": lambda a, b, c, d: a > c,
    "disjoint": lambda a, b, c, d: (b < c) | (a > d),
}
