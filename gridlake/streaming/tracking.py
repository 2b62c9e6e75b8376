"""Structured Streaming over tracking points and tiles: last positions, tracks, and an idempotent tile sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def last_positions(points: DataFrame, device: str, at: str, value: Sequence[str]) -> DataFrame:
    """Running last row of each device (output mode update or complete); state is one row a device."""
    best = F.max(F.struct(F.col(at), *(F.col(v) for v in value))).alias("__last")
    return points.groupBy(device).agg(best).select(device, F.col(f"__last.{at}").alias(at), *(F.col(f"__last.{v}").alias(v) for v in value))


def tracks(points: DataFrame, device: str, at: str, x: str, y: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines of each device and time window; a window closes once the watermark has passed it."""
    item = F.struct(F.col(at).alias("at"), F.col(x).alias("x"), F.col(y).alias("y"))
    out = points.withWatermark(at, late).groupBy(F.window(at, window), F.col(device)).agg(F.array_sort(F.collect_list(item)).alias("line"))
    return out.select(device, F.col("window.start").alias("start"), F.transform("line", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("line"))


def tile_sink(tiles: DataFrame, path: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Insert-or-ignore of arriving tiles (z, x, y, ...) into a Parquet store; a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.append_tiles(batch, path, [F.col(order)])

    return tiles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
