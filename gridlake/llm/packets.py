"""Packed exchanges: entries (key, doc, place) travel as binary columns, one row for a bucket and batch.

A row for each entry would cost tens of bytes and a JVM object; a packet costs the raw arrays, stored in
byte planes (first all lowest bytes, and so on), which the shuffle's compression makes smaller.  The
sender merges equal keys of its batch first, so a key that a third of all rows hold arrives once from each
batch, not once from each row.  Answers return in packets by document and are put together there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKET = "bucket int, kind int, key binary, key2 binary, doc binary, pos binary"
REPLY = "doc_id long, places binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("key", "key2", "doc", "pos"))])
_REPLY = pa.schema([("doc_id", pa.int64()), ("places", pa.binary())])
_TYPES = (np.uint64, np.uint32, np.int64, np.int32)
ASK, KNOWN = 0, 1
EMPTY64 = np.zeros(0, np.int64)


def planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes(), kind)


def of_sorted(at: np.ndarray, kind: int, columns: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
    """Packets of entries that are sorted by their bucket."""
    cuts = np.flatnonzero(np.diff(at)) + 1
    begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])
    rows: list[list] = [[int(at[a]) for a in begins], [kind] * len(begins)]
    for values, of in zip(columns, _TYPES, strict=True):
        rows.append([b""] * len(begins) if values is None else [planes(np.ascontiguousarray(values[a:b], of)) for a, b in zip(begins, ends, strict=True)])
    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)


def split(buckets: int, key: np.ndarray, doc: np.ndarray, pos: np.ndarray, key2: np.ndarray | None = None, kind: int = ASK) -> Iterator[pa.RecordBatch]:
    """Packets of entries sorted by key; a bucket is a range of the key's upper bits."""
    if len(key):
        at = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        yield from of_sorted(at, kind, [key, key2, doc, pos])


def by_document(buckets: int, doc: np.ndarray, pos: np.ndarray, kind: int = KNOWN) -> Iterator[pa.RecordBatch]:
    """Packets of answers, dealt by document."""
    if len(doc):
        at = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(at, kind="stable")
        yield from of_sorted(at[order], kind, [None, None, doc[order], pos[order]])


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, [key, key2, doc, pos]) of each bucket of a partition."""
    held: dict[tuple[int, int], list[list[bytes]]] = {}
    for batch in batches:
        for bucket, kind, *parts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            held.setdefault((bucket, kind), []).append(parts)
    for bucket, kind in sorted(held):
        rows = held.pop((bucket, kind))
        yield kind, [np.concatenate([unplaned(r[i], of) for r in rows]) for i, of in enumerate(_TYPES)]


def answered(packets: DataFrame, answer, buckets: int) -> DataFrame:
    """doc_id, places: packets are dealt by bucket, answer(key, key2, doc, pos) picks (doc, pos), and each document gets its own.

    Packets of kind KNOWN pass the first exchange unanswered."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, places = [], []
        for kind, (key, key2, doc, pos) in gathered(batches):
            if kind == ASK:
                doc, pos = answer(key, key2, doc, pos)
            docs.append(doc)
            places.append(pos)
        if docs:
            yield from by_document(buckets, np.concatenate(docs), np.concatenate(places))

    return packets.repartitionById(buckets, "bucket").mapInArrow(ask, PACKET).repartitionById(buckets, "bucket").mapInArrow(_regroup, REPLY)


def _regroup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (_, _, doc, pos) in gathered(batches):
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(doc)]])
        yield pa.RecordBatch.from_arrays([pa.array(doc[begins], pa.int64()), pa.array([pos[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())], schema=_REPLY)


def places(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value, np.int32).astype(np.int64) if value else EMPTY64
