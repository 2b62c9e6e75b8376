"""Helpers shared by the corpus operators: lineage cuts, Arrow columns, table reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridlake-ckpt-"))  # one process: any folder is shared
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder, so lost executors cost no recomputation."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Materialise df as Parquet in the checkpoint folder.

    A checkpoint keeps the plan's estimate of its size, and a join's is the product of its sides: in a loop of joins that
    number doubles its digits each round until it fills the driver.  A table's size is that of its files."""
    path = f"{_checkpoint_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not have yet (names of columns ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(doc_id: Column, raw: Column) -> tuple[Column, Column]:
    """Two keys without nulls that name a row by its doc_id, null or not, and the xxhash64 of its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(0)), F.xxhash64(raw, doc_id.isNull())


def _matched(documents: DataFrame, rows: DataFrame, how: str, once: bool) -> DataFrame:
    doc, raw, doc2, raw2 = fresh(documents, "__doc", "__raw", "__doc2", "__raw2")
    own, theirs = row_keys(F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))), row_keys(F.col("doc_id"), F.col("raw"))
    keyed = documents.withColumns({doc: own[0], raw: own[1]})
    named = rows.select(theirs[0].alias(doc2), theirs[1].alias(raw2))
    return (keyed.dropDuplicates([doc, raw]) if once else keyed).join(named, (F.col(doc) == F.col(doc2)) & (F.col(raw) == F.col(raw2)), how).drop(doc, raw)


def only_rows(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The input's rows and columns: one row for each (doc_id, raw) of wanted, raw being xxhash64 of the text.

    Repetitions merge before the exchange, so a row that a third of the table repeats costs one row for each partition."""
    return _matched(documents, wanted, "left_semi", once=True)


def without_rows(documents: DataFrame, unwanted: DataFrame) -> DataFrame:
    """The input's rows and columns without those whose (doc_id, raw) is in unwanted."""
    return _matched(documents, unwanted, "left_anti", once=False)


def first_rows(df: DataFrame, n: int, order: list[Column], part: str, parts: int, fan: int = 32) -> DataFrame:
    """The first n rows, out of parts that hold at most n rows each (column `part`, from 0): as a tree, so a task
    orders at most fan * n rows and the driver, which takes the last step, meets no more."""
    group, place = fresh(df, "__group", "__place")
    while parts > fan:
        parts = -(-parts // fan)
        within = Window.partitionBy(group).orderBy(*order)
        df = df.withColumn(group, F.expr(f"{part} div {fan}")).withColumn(place, F.row_number().over(within)).where(F.col(place) <= n)
        df = df.withColumn(part, F.col(group)).drop(group, place)
    return df.orderBy(*order).limit(n)


def hashed_sample(df: DataFrame, n: int, key: Column, *ties: Column) -> DataFrame:
    """The n rows with the smallest xxhash64 of key (all rows, if fewer).

    Rows are counted first, and only hashes below a threshold that lets about n pass are sorted, so the driver and
    the sorting task meet little more than n rows, however many partitions there are."""
    hashed = F.xxhash64(key)
    total, share = df.count(), 1.1 * n + 100
    while share < total:
        below = df.where(hashed <= F.lit(int(-(2**63) + 2**64 * (share / total))))
        if below.count() >= n:
            df = below
            break
        share *= 2
    return df.orderBy(hashed, key, *ties).limit(n)


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a fold count."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def shuffle_buckets(spark: SparkSession, per_partition: int = 1) -> int:
    """Buckets for packed exchanges: one for each shuffle partition of the session, or so many."""
    return max(16, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        width = np.dtype(np.int32)
    else:
        column = column.cast(pa.large_string())
        width = np.dtype(np.int64)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, width, n + 1, column.offset * width.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about limit bytes each; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
