"""Tile store, job queue, run log and request routing as table transitions.

Every function takes tables and returns the next ones; writers commit them as Parquet.  Insert-or-ignore
is an anti join on the tile's key, so a repeated run adds nothing.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

TILE = ("z", "x", "y")
QUEUED, RUNNING, FAILED, MAX_ATTEMPTS = 0, 1, 2, 3


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, deterministic in place of first come."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")


def new_tiles(tiles: DataFrame, stored: DataFrame, order: Sequence[Column], keys: Sequence[str] = TILE) -> DataFrame:
    """Tiles to append: the first of each key that the store does not hold."""
    return first_of(tiles.join(stored.select(*keys), list(keys), "left_anti"), keys, order)


def append_tiles(tiles: DataFrame, path: str, order: Sequence[Column]) -> None:
    """Insert or ignore into a Parquet store partitioned by zoom; a store has one writer at a time."""
    spark = tiles.sparkSession
    try:
        tiles = new_tiles(tiles, spark.read.parquet(path), order)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        tiles = first_of(tiles, TILE, order)
    tiles.write.mode("append").partitionBy("z").parquet(path)


def lookup(stored: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """One tile; z prunes partitions, x and y reach the scan."""
    return stored.where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)).limit(1)


def missing(requests: DataFrame, stored: DataFrame, keys: Sequence[str] = TILE) -> DataFrame:
    return requests.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def present(requests: DataFrame, stored: DataFrame, keys: Sequence[str] = TILE) -> DataFrame:
    return requests.join(stored.select(*keys).distinct(), list(keys), "left_semi")


def metadata(options: dict[str, object]) -> list[tuple[str, str]]:
    """Name and value rows of a mercator store; bounds are clamped to the world."""
    w, s, e, n = options["bounds"]
    clamp = lambda v, most: max(-most, min(most, v))
    bounds = f"{clamp(s, 85.05112878)} {clamp(w, 180.0)} {clamp(n, 85.05112878)} {clamp(e, 180.0)}"
    fixed = [("name", options["name"]), ("description", options.get("description", "")), ("version", "1.0.0"), ("attribution", options.get("attribution", "")), ("type", "overlay"), ("format", options.get("format", "png")), ("minzoom", options["minzoom"]), ("maxzoom", options["maxzoom"]), ("bounds", bounds), ("scale", options.get("scale", "1.000000")), ("profile", "mercator")]
    return [(k, str(v)) for k, v in fixed]


def metadata_rows(sources: DataFrame) -> DataFrame:
    """metadata() of every datasource (datasource_id, name, description, attribution, format, minzoom, maxzoom, west, south,
    east, north): datasource_id, name, value."""
    clamp = lambda c, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c))).cast("string")
    bounds = F.concat_ws(" ", clamp("south", 85.05112878), clamp("west", 180.0), clamp("north", 85.05112878), clamp("east", 180.0))
    text = lambda c, default="": F.coalesce(F.col(c).cast("string"), F.lit(default))
    values = {"name": text("name"), "description": text("description"), "version": F.lit("1.0.0"), "attribution": text("attribution"), "type": F.lit("overlay"), "format": text("format", "png"), "minzoom": text("minzoom"), "maxzoom": text("maxzoom"), "bounds": bounds, "scale": F.lit("1.000000"), "profile": F.lit("mercator")}
    return sources.select("datasource_id", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()))))


# job queue


def eligible(now: Column) -> Column:
    return (F.col("status") == QUEUED) & (F.col("scheduled_for") <= now) & (F.col("failed_attempts") < MAX_ATTEMPTS)


def pull(queue: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next n jobs: the earliest, ties by id."""
    return queue.where(eligible(now)).orderBy("scheduled_for", "job_id").limit(n)


def started(queue: DataFrame, pulled: DataFrame) -> DataFrame:
    """The queue with pulled jobs running."""
    mark = pulled.select("job_id", F.lit(True).alias("__on"))
    return queue.join(mark, "job_id", "left").withColumn("status", F.when(F.col("__on"), RUNNING).otherwise(F.col("status"))).drop("__on")


def outcome(status_code: Column) -> Column:
    """fail for answers that round to the 400s to 600s, else done."""
    return F.when(F.floor(status_code / 100.0 + 0.5).isin(4, 5, 6), "fail").otherwise("done")


def finished(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Done jobs leave the queue; failed ones are queued again with one attempt more."""
    joined = queue.join(results.select("job_id", "status_code"), "job_id", "left")
    kept = joined.where(F.col("status_code").isNull() | (outcome(F.col("status_code")) == "fail"))
    again = F.col("status_code").isNotNull()
    return kept.withColumns({"status": F.when(again, QUEUED).otherwise(F.col("status")), "failed_attempts": F.col("failed_attempts") + F.when(again, 1).otherwise(0)}).drop("status_code")


# run log


def latest_run(log: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_of(log, keys, order)


def may_start(sources: DataFrame, log: DataFrame, key: str = "datasource_id") -> DataFrame:
    """Sources without a running pyramid."""
    return sources.join(log.where("running = 1").select(key).distinct(), key, "left_anti")


def repaired(log: DataFrame) -> DataFrame:
    """After a restart: runs still marked as running are complete."""
    return log.withColumns({"complete": F.when(F.col("running") == 1, 1).otherwise(F.col("complete")), "running": F.lit(0)})


# requests


def parse_request(path: Column) -> dict[str, Column]:
    """datasource, z, x, y and extension of a tile path; null parts where it is none."""
    parts = F.split(path, "/")
    file = F.split(F.get(parts, F.lit(6)), "\\.")
    ext = F.lower(F.get(file, F.lit(1)))
    z, x, y = (c.try_cast("int") for c in (F.get(parts, F.lit(4)), F.get(parts, F.lit(5)), F.get(file, F.lit(0))))
    ok = (F.size(parts) >= 7) & ext.isin("png", "mvt", "pbf") & z.between(0, 255) & (x >= 0) & (y >= 0)
    return {"ok": F.coalesce(ok, F.lit(False)), **{n: F.when(ok, c) for n, c in (("datasource", F.get(parts, F.lit(3))), ("z", z), ("x", x), ("y", y), ("ext", ext))}}


def routed(requests: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Requests with the host and port of their datasource, or "local"."""
    at = sources.select(key, F.when(F.col("host").isNotNull(), F.concat_ws(":", "host", F.col("port").cast("string"))).otherwise("local").alias("target"))
    return requests.join(at, key, "left")


def _fixed(rows: DataFrame) -> DataFrame:
    """rows, written to the checkpoint folder, so that their partitions stay as they are."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridlake-ckpt-"))  # one process: any folder is shared
    return rows.checkpoint()


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with number: their place (from 0) in the order of their group.

    Rows are dealt by ranges of group and order, and numbered within a range; a range starts where the group's ranges
    before it end.  So a group that holds most rows is numbered by as many tasks as any others."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = rows.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id())
    spread = _fixed(spread)
    counts = spread.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # ranges, not rows
    starts = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    held = spread.withColumn("__at", within).alias("r")
    on = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*by, "__part")])
    return held.join(starts.alias("s"), on).select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("r.__at") + F.col("s.__start")).alias("number"))


def dealt(rows: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Round robin over n workers within each group: worker 0 gets the first row."""
    return numbered(rows, by, order).withColumn("worker", (F.col("number") % n).cast("int")).drop("number")


def batched(rows: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Numbered batches of n rows within each group; the last may be short."""
    return numbered(rows, by, order).withColumn("batch", F.floor(F.col("number") / n)).drop("number")


def usable_keys(keys: DataFrame, failed: DataFrame, now: Column, after_days: int = 1) -> DataFrame:
    """Keys that never failed, or failed at least after_days ago."""
    joined = keys.join(failed.select("key", "failed_at"), "key", "left")
    return joined.where(F.col("failed_at").isNull() | (F.datediff(now, F.col("failed_at")) >= after_days)).drop("failed_at")


#: Checks of a datasource row: name and the condition that it breaks.
CHECKS: dict[str, Column | str] = {
    "zoom order": "minzoom > maxzoom",
    "zoom range": "minzoom not between 0 and 20 or maxzoom not between 0 and 20",
    "data type": "data_type not in ('vector', 'raster')",
    "host without port": "host is not null and port is null",
    "identifier": "identifier is null or identifier = ''",
}


def write_good(sources: DataFrame, path: str, checks: dict[str, str] | None = None) -> dict[str, int]:
    """Writes the rows that break no check; returns the number of rows, of good ones and of those that break each check.

    The counters are observed while the rows are written: no second pass over them."""
    checks = checks or CHECKS
    broken = {n: F.coalesce(F.expr(c), F.lit(False)) for n, c in checks.items()}
    good = ~reduce(or_, broken.values())
    seen = Observation("loaded")
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("good"), *(F.count_if(c).alias(n) for n, c in broken.items())]
    sources.observe(seen, *counts).where(good).write.mode("overwrite").parquet(path)
    return seen.get


def load_counts(sources: DataFrame, by: Sequence[str] = (), checks: dict[str, str] | None = None) -> DataFrame:
    """by, rows, good and a count for each broken check, in one grouping.

    A check named like a column before it gets a number behind its name (data_type_1)."""
    checks = checks or CHECKS
    broken = {n: F.coalesce(F.expr(c), F.lit(False)) for n, c in checks.items()}
    good = ~reduce(or_, broken.values())
    names = [*by, "rows", "good"]
    for n in (n.replace(" ", "_") for n in broken):
        names.append(next(free for free in (n, *(f"{n}_{i}" for i in range(1, len(names) + 1))) if free not in names))
    counts = sources.groupBy(*by).agg(F.count(F.lit(1)), F.count_if(good), *(F.count_if(c) for c in broken.values()))
    return counts.toDF(*names)


def errors(sources: DataFrame, checks: dict[str, str] | None = None) -> DataFrame:
    """One row for each check that a datasource breaks."""
    broken = F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in (checks or CHECKS).items()))
    return sources.withColumn("error", F.explode(F.filter(broken, lambda e: e.isNotNull())))
