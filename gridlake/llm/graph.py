"""Connected components of an edge table: forests within tasks, large and small stars between them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ints, kept

#: Edges that one task joins in memory.
SOLO = 1 << 18


def _forest(most: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stars (a: member, b: smallest node) that join what the edges of a task join, up to `most` nodes at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (parent := up.setdefault(x, x)) != x:
                up[x] = up[parent]
                x = up[x]
            return x

        def stars() -> pa.RecordBatch:
            members = np.array([x for x in up if root(x) != x], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(members), pa.array(np.array([root(x) for x in members.tolist()], np.int64))], ["a", "b"])

        for batch in batches:
            for x, y in zip(ints(batch, "a").tolist(), ints(batch, "b").tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if most is not None and len(up) >= most:
                yield stars()
                up.clear()
        yield stars()

    return run


def _unfinished(stars: DataFrame) -> bool:
    """Whether a node hangs on two others, or on one that hangs itself."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("held"))
    ends = ends.union(stars.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("held").alias("held"))
    return not ends.where("up > 1 or up = 1 and held = 1").isEmpty()


def components(edges: DataFrame, solo: int = SOLO) -> DataFrame:
    """node, component (its smallest node) for every node of edges(a, b) that has another one beside it.

    Edges hold a > b.  A round gives each edge's larger end to the least node that hangs above the smaller one (large
    stars), then joins all that a node hangs on to the least of them (small stars): rounds grow with the logarithm of the
    nodes, also along a path.  What is left of them after it, forests of each task make smaller; `solo` edges or fewer are
    one task's.  A round's edges are kept as a table, as estimates of their size would grow from round to round."""
    forest = lambda df, most=solo: df.mapInArrow(_forest(most), "a long, b long")
    least = lambda df: df.groupBy(F.col("a").alias("__n")).agg(F.min("b").alias("low")).hint("merge")
    stars = kept(forest(edges.select("a", "b")).distinct())
    while stars.count() > solo:
        if not _unfinished(stars):
            break
        large = cut(stars.join(least(stars), F.col("b") == F.col("__n"), "left").select("a", F.coalesce("low", "b").alias("b")).distinct())
        small = large.join(least(large), F.col("a") == F.col("__n"))
        small = small.select(F.inline(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))).where("a > b")
        stars = kept(forest(small.distinct()).distinct())
    else:
        stars = cut(forest(stars.coalesce(1), None))
    return cut(stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct()))
