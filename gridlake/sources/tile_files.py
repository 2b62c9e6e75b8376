"""Tiles as files root/z/x/y.ext: a sink that publishes them on commit, and a scan that reads them back.

Both are a Python data source.  A task of the sink writes into a folder of its own below the root's hidden staging folder; only
the folders of tasks that the job commits are published, so a lost or repeated task leaves nothing.  Publishing links
a file into its place, which fails where one is already there: insert or ignore.  The root must be a folder that the
driver and all executors share.  Commit messages name folders, not tiles, so the driver's memory does not grow.

The scan has a partition for each folder z/x, pruned by zoom; files are listed and read by tasks.  Spark's own scan of
binary files is not used, as it passes over files without bytes, and those are an answer of their own.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..operators import store

SCHEMA = "z int, x int, y int, data binary"
READ = "z int, x int, y int, ext string, length long, data binary"


@dataclass
class Written(WriterCommitMessage):
    folder: str


def staged(root: str) -> str:
    """A new hidden folder below root, made by the driver; tasks write into it and never make it."""
    path = os.path.join(root, f".staging-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def removed(path: str) -> None:
    """Removes a folder into which tasks that are being stopped may still write."""
    for _ in range(100):
        shutil.rmtree(path, ignore_errors=True)
        if not os.path.exists(path):
            return
        time.sleep(0.1)


class TileFiles(DataSource):
    """format("tile_files"): options path (the root) and ext; mode append keeps files, overwrite removes all tiles first."""

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        zooms = self.options.get("zooms")
        return TileReader(self.options["path"], None if zooms is None else {int(z) for z in zooms.split(",") if z}, self.options.get("ext"), self.options.get("content", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"z", "x", "y", "data"} - set(schema.names)
        if missing:
            raise ValueError(f"tiles need columns {', '.join(sorted(missing))}")
        return TileWriter(self.options["path"], self.options.get("ext", "png"), overwrite)


@dataclass
class Folder(InputPartition):
    z: int
    x: int


class TileReader(DataSourceReader):
    def __init__(self, root: str, zooms: set[int] | None, ext: str | None, content: bool) -> None:
        self.root, self.zooms, self.ext, self.content = root, zooms, ext, content

    def partitions(self) -> Sequence[Folder]:
        numbers = lambda at: sorted(int(e) for e in os.listdir(at) if e.isdigit()) if os.path.isdir(at) else []
        return [Folder(z, x) for z in numbers(self.root) if self.zooms is None or z in self.zooms for x in numbers(os.path.join(self.root, str(z)))] or [Folder(-1, -1)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        at = os.path.join(self.root, str(partition.z), str(partition.x))
        for entry in sorted(os.scandir(at), key=lambda e: e.name) if partition.z >= 0 else ():
            name, _, ext = entry.name.rpartition(".")
            if name.isdigit() and (self.ext is None or ext == self.ext):
                data = None
                if self.content:
                    with open(entry.path, "rb") as f:
                        data = f.read()
                yield partition.z, partition.x, int(name), ext.lower(), entry.stat().st_size, data


class TileWriter(DataSourceWriter):
    def __init__(self, root: str, ext: str, overwrite: bool) -> None:
        self.root, self.ext, self.overwrite = root, ext, overwrite
        self.staging = staged(root)

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        folder = os.path.join(self.staging, f"{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex}")
        os.mkdir(folder)
        for row in iterator:
            place = folder
            for part in (str(int(row["z"])), str(int(row["x"]))):  # one by one: a task that outlives its job finds no folder to write to
                place = os.path.join(place, part)
                with contextlib.suppress(FileExistsError):
                    os.mkdir(place)
            with open(os.path.join(place, f"{int(row['y'])}.{self.ext}"), "wb") as f:
                f.write(bytes(row["data"] or b""))
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite and os.path.isdir(self.root):
            for entry in os.listdir(self.root):
                if entry.isdigit():
                    shutil.rmtree(os.path.join(self.root, entry))
        for message in messages:
            if message is not None:
                self._publish(message.folder)
        removed(self.staging)

    def _publish(self, folder: str) -> None:
        for at, _, files in os.walk(folder):
            goal = os.path.join(self.root, os.path.relpath(at, folder))
            if files:
                os.makedirs(goal, exist_ok=True)
            for file in files:
                with contextlib.suppress(FileExistsError):  # the first tile stays
                    os.link(os.path.join(at, file), os.path.join(goal, file))

    def abort(self, messages: list[Written | None]) -> None:
        removed(self.staging)


def write_files(tiles: DataFrame, root: str, order: Sequence[Column], ext: str = "png", overwrite: bool = False) -> None:
    """Tiles (z, x, y, data) as files; of equal keys the first in order is written, files that exist stay."""
    tiles.sparkSession.dataSource.register(TileFiles)
    first = store.first_of(tiles, store.TILE, order).select("z", "x", "y", "data")
    first.write.format("tile_files").mode("overwrite" if overwrite else "append").option("path", root).option("ext", ext).save()


def read_files(spark: SparkSession, root: str, zooms: Iterable[int] | None = None, ext: str | None = None, content: bool = True) -> DataFrame:
    """z, x, y, ext, length, data of tile files; zooms prune folders, ext names; without content data is null and no file
    is opened.  An absent root or zoom gives no rows."""
    spark.dataSource.register(TileFiles)
    reader = spark.read.format("tile_files").option("path", root).option("content", str(content).lower())
    reader = reader.option("zooms", ",".join(str(int(z)) for z in zooms)) if zooms is not None else reader
    return (reader.option("ext", ext) if ext else reader).load()


def answers(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (z, x, y) with status: 200 for a stored tile, 400 for one without bytes, 204 without a file."""
    held = files.select("z", "x", "y", "length")
    size = F.col("length")
    return requests.join(held, ["z", "x", "y"], "left").withColumn("status", F.when(size.isNull(), 204).when(size == 0, 400).otherwise(200)).drop("length")


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether a path holds a tile table."""
    try:
        return set(store.TILE) <= set(spark.read.parquet(path).columns)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def save(tiles: DataFrame, table: str, root: str, order: Sequence[Column], ext: str = "png") -> str:
    """Insert or ignore into the tile table, if there is one, else into files; tells which."""
    if is_table(tiles.sparkSession, table):
        store.append_tiles(tiles, table, order)
        return "table"
    write_files(tiles, root, order, ext)
    return "files"


def create_table(spark: SparkSession, path: str) -> None:
    """An empty tile table (also empties one that is there)."""
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)


def truncate(spark: SparkSession, table: str, root: str) -> None:
    """Removes all tiles of a table, which stays a table, and all tile files."""
    if is_table(spark, table):
        create_table(spark, table)
    if os.path.isdir(root):
        write_files(spark.createDataFrame([], SCHEMA), root, [F.lit(1)], overwrite=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir, in one process anywhere."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if shared:
        path = os.path.join(shared.removeprefix("file:"), f"tiles-{uuid.uuid4().hex}")
        os.makedirs(path)
        return path
    return tempfile.mkdtemp(prefix="gridlake-tiles-")
