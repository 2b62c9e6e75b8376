"""Exact substring deduplication by difference-cover anchors.

A window is `length` consecutive words of one document.  Each word that lies in a window whose word
sequence also starts earlier (smaller doc_id, or same document and earlier start) is removed.

Anchors.  {0, 1, 3, 9} is a perfect difference set modulo 13: every residue is a difference of two of
its members.  So for any two places i, j there is a shift d < 13 with i+d and j+d both at cover places,
and two equal windows of 20 words share the 8 words that start there.  Only cover places are hashed
(4 of 13); a window can be repeated only if it holds an anchor that occurs twice.

Extension.  Only windows around repeated anchors are hashed in full (96 bits) and grouped; of each
group the earliest start stays and the others are removed.  No pairs are made: a group costs one entry
for each batch of documents that holds it, because a batch merges its own repetitions first.

The text is exchanged once by doc_id (both joins reuse that exchange), anchors and windows as packets.

Null or empty text: no words, the row stays with zeros.  Rows without doc_id
have no place in the order: they come back whole, and no window counts as earlier because of them.  Rows that
repeat a doc_id are one document to the order: neither is earlier than the other.  Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packets
from .common import doc_chunks, ints, shuffle_buckets, strings
from .words import Words, windows

COVER, PERIOD = (0, 1, 3, 9), 13
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(documents: DataFrame, length: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words as text, if asked for)."""
    anchor = length - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"length must be at least {PERIOD}")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows without an id are dealt by their text and meet no answer, as `named` tells them apart
    docs = docs.withColumns({"key": F.coalesce("doc_id", F.xxhash64("text")), "named": F.col("doc_id").isNotNull()})
    answers = lambda rows: rows.select(F.col("doc_id").alias("key"), F.col("doc_id").isNotNull().alias("named"), "places")
    buckets = shuffle_buckets(documents.sparkSession)
    repeated = packets.answered(docs.where("named").select("doc_id", "text").mapInArrow(_anchor_packets(anchor, buckets), packets.PACKET), _repeated, buckets)
    around = docs.join(answers(repeated), ["key", "named"]).select("doc_id", "text", "places").mapInArrow(_window_packets(length, buckets), packets.PACKET)
    later = packets.answered(around, _later, buckets)
    schema = RESULT + (", text string" if with_text else "")
    return docs.join(answers(later), ["key", "named"], "left").select("doc_id", "text", "places").mapInArrow(_kept(length, with_text), schema)


def _anchor_packets(k: int, buckets: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = ints(batch, "doc_id"), strings(batch.column("text"))
            keys, docs, places = [], [], []
            for i, j in doc_chunks(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashed, whole = windows(w.hash, w.first, k)
                counts = np.diff(w.first)
                pos = np.arange(len(hashed)) - np.repeat(w.first[:-1], counts)
                at = np.flatnonzero(whole & cover[pos % PERIOD])
                keys.append(hashed[at])
                docs.append(np.repeat(ids[i:j], counts)[at])
                places.append(pos[at].astype(np.int32))
            if keys:
                key, doc, pos = map(np.concatenate, (keys, docs, places))
                order = np.argsort(key, kind="stable")
                key, doc, pos = key[order], doc[order], pos[order]
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                again = ~first
                again[:-1] |= ~first[1:]
                yield from packets.by_document(buckets, doc[again], pos[again])
                yield from packets.split(buckets, key[first], doc[first], pos[first])

    return run


def _repeated(key: np.ndarray, _: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    return doc[order[same]], pos[order[same]]


def _not_first(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, doc, pos), where a key's run begins, and which entries start later than its first."""
    order = np.lexsort((pos, doc, key2, key))
    key, key2, doc, pos = key[order], key2[order], doc[order], pos[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, first, (doc != doc[head]) | (pos != pos[head])


def _window_packets(length: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets), asked = ints(batch, "doc_id"), strings(batch.column("text")), batch.column("places")
            found: list[list[np.ndarray]] = [[], [], [], []]
            for i, j in doc_chunks(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                begin = np.zeros(len(w.hash) + 1, np.int32)
                for d, value in enumerate(asked.slice(i, j - i).to_pylist()):
                    p = packets.places(value)
                    np.add.at(begin, w.first[d] + np.maximum(p - PERIOD + 1, 0), 1)
                    np.add.at(begin, w.first[d] + p + 1, -1)
                hashed, whole = windows(w.hash, w.first, length)
                at = np.flatnonzero(whole & (np.cumsum(begin[:-1]) > 0))
                counts = np.diff(w.first)
                pos = np.arange(len(hashed)) - np.repeat(w.first[:-1], counts)
                for held, values in zip(found, (hashed[at], windows(w.hash, w.first, length, 1)[0][at].astype(np.uint32), np.repeat(ids[i:j], counts)[at], pos[at].astype(np.int32)), strict=True):
                    held.append(values)
            if found[0]:
                key, key2, doc, pos = map(np.concatenate, found)
                order, first, later = _not_first(key, key2, doc, pos)
                gone, kept = order[later], order[first]
                yield from packets.by_document(buckets, doc[gone], pos[gone])
                yield from packets.split(buckets, key[kept], doc[kept], pos[kept], key2[kept])

    return run


def _later(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, _, later = _not_first(key, key2, doc, pos)
    return doc[order[later]], pos[order[later]]


def _kept(length: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            raw, rows = data.tobytes(), []
            for i, (doc, later) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n, gone = len(words), 0
                if later:
                    p = packets.places(later)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, p, 1)
                    np.add.at(change, p + length, -1)
                    covered = np.cumsum(change[:-1]) > 0
                    gone = int(covered.sum())
                    words = [words[x] for x in np.flatnonzero(~covered).tolist()]
                kept = b" ".join(words)
                rows.append((doc, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            names, kinds = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"], [pa.int64()] * 3 + [pa.string()] * 2
            keep = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds, strict=False)], names[:keep])

    return run
