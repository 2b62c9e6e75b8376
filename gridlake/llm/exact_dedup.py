"""Exact deduplication by deterministic block naming.

Normalised texts (A-Z lower-cased, nothing else) are cut into blocks of a fixed number of bytes.  Equal
blocks get equal integers: blocks are dealt into buckets by a hash, sorted in each bucket, and named
bucket * 2^40 + rank.  Then adjacent names of a document are paired and the distinct pairs are sorted
and named in the same way, round by round, until one name is left.  (rounds, name) is the document's
identity: equal if and only if the texts are equal, since names stand for contents and not for hashes.

A block is referred to by a place where it stands: doc_id, sha of the text, position.  doc_id alone would
not do, since rows may repeat it with other texts.  The raw text is exchanged once, and each batch sends a
block that it holds many times only once, so a block that a third of all documents share costs one row for
each batch.  All later exchanges move integers.  Rounds grow with the logarithm of the longest text.

Null text counts as empty.  Every row of the input is a row of the result, rows without doc_id and repeated
rows included; of a group's rows with the largest doc_id (none, if no row has one) exactly one is kept.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only_rows, shuffle_buckets, strings

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_REFS = "doc_id long, sha binary, pos int, n int, rep_doc long, rep_sha binary, rep_pos int"
_BLOCKS = "rep_doc long, rep_sha binary, rep_pos int, block binary"
_ROWS = "doc_id long, doc long, sha binary, raw long, tag long"
_NO_ID = -1  # stands for a null doc_id in references; the sha beside it tells texts apart


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def identities(documents: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """doc_id (-1 for none), sha (of the normalised text), rounds, name: one row for each distinct (doc_id, text)."""
    docs = _texts(documents)
    buckets = shuffle_buckets(documents.sparkSession, 16)
    blocks = docs.mapInArrow(_blocks(block_bytes, refs=False), _BLOCKS)
    named = _named(blocks, [F.col("block")], buckets).select("rep_doc", "rep_sha", "rep_pos", "name")
    refs = docs.mapInArrow(_blocks(block_bytes, refs=True), _REFS)
    level = cut(refs.join(named, ["rep_doc", "rep_sha", "rep_pos"]).groupBy("doc_id", "sha", "pos", "n").agg(F.min("name").alias("name")))
    done, rounds = [], 0
    longest = level.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(level.where("n = 1").select("doc_id", "sha", F.lit(rounds).alias("rounds"), "name"))
        if longest == 1:
            break
        pairs = (
            level.where("n > 1")
            .groupBy("doc_id", "sha", F.expr("pos div 2").cast("int").alias("pos"), F.expr("(n + 1) div 2").cast("int").alias("n"))
            .agg(F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(-1)).alias("b"))
        )
        names = _named(pairs.select("a", "b").distinct(), [F.col("a"), F.col("b")], buckets)
        level, rounds, longest = cut(pairs.join(names, ["a", "b"]).select("doc_id", "sha", "pos", "n", "name")), rounds + 1, (longest + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _placed(documents: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of the input with their identity; row orders them within a group, the kept one last."""
    ids = identities(documents, block_bytes)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("raw")).mapInArrow(_rows, _ROWS)
    known = ids.select(F.col("doc_id").alias("doc"), "sha", "rounds", "name")
    return rows.join(known, ["doc", "sha"]).withColumn("row", F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "raw", "tag"))


def exact_groups(documents: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """doc_id, keep_id (largest doc_id of the equal texts), group_size (rows), kept, text_sha256 of every row."""
    placed = cut(_placed(documents, block_bytes))  # so the tags of rows are given once
    groups = placed.groupBy("rounds", "name").agg(F.max("row").alias("best"), F.count("*").alias("group_size"))
    # abs() keeps the values and hides the partitioning, so both sides of the join are exchanged and a hot group can be split
    groups = groups.select("rounds", F.abs("name").alias("name"), "best", "group_size")
    joined = placed.join(groups, ["rounds", "name"])
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(documents: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """The input's rows and columns, one row for each group of equal texts: the one exact_groups keeps, or one that
    agrees with it in doc_id and text."""
    best = _placed(documents, block_bytes).groupBy("rounds", "name").agg(F.max("row").alias("best"))
    return only_rows(documents, best.select("best.doc_id", "best.raw"))


def _named(rows: DataFrame, keys: list[Column], buckets: int) -> DataFrame:
    """rows with name: an integer for each distinct key."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    return bucketed.withColumn("name", F.col("bucket") * F.lit(1 << 40) + rank).drop("bucket")


def _blocks(size: int, refs: bool):
    names = (["doc_id", "sha", "pos", "n"] if refs else []) + ["rep_doc", "rep_sha", "rep_pos"] + ([] if refs else ["block"])
    kinds = ([pa.int64(), pa.binary(), pa.int32(), pa.int32()] if refs else []) + [pa.int64(), pa.binary(), pa.int32()] + ([] if refs else [pa.binary()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            raw = data.tobytes().translate(_LOWER)
            first: dict[bytes, tuple[int, bytes, int]] = {}
            rows: list[tuple] = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                sha = hashlib.sha256(text).digest()
                n = max(1, -(-len(text) // size))
                for pos in range(n):
                    block = text[pos * size : (pos + 1) * size]
                    rep = first.setdefault(block, (doc, sha, pos))
                    if refs:
                        rows.append((doc, sha, pos, n, *rep))
                    elif rep == (doc, sha, pos):
                        rows.append((*rep, block))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row of the input: its id, the id with nulls replaced, sha, hash of the raw text, and a tag of its own."""
    tag = TaskContext.get().partitionId() << 40
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        raw = data.tobytes().translate(_LOWER)
        shas = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        doc = batch.column("doc_id")
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([doc, doc.fill_null(_NO_ID), pa.array(shas, pa.binary()), batch.column("raw"), pa.array(range(tag, tag + n), pa.int64())], ["doc_id", "doc", "sha", "raw", "tag"])
        tag += n
