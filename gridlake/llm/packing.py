"""Packing of tokenised documents into sequences of a fixed capacity by minimum bin slack.

A document of n ids fills n // capacity whole sequences by itself; its remainder is an item.  Items of a
group (one scan partition, or less: a group ends once it holds `group_tokens` ids) are packed window by
window: the longest item opens a window, and a bitset subset-sum over the remaining lengths and their
counts finds the multiset that comes closest to the capacity; backtracking over the bitsets gives the
count of each length, and the same choice is used as often as the counts allow.  If even the best choice
leaves slack, an item is cut to fill it.  What is left at the end of a group is cut into sequences whose
lengths are powers of two, which need no padding.

There is no shuffle: each partition packs its own documents, and memory is bounded by group_tokens.
sequence_id is the partition's number times 2^36 plus a counter, the same when a task is repeated.
Ids are those of the byte-level BPE file by the tokenizers library, special tokens in a text included (their
strings give their own ids).  Texts of plain characters without such strings take the same vocabulary and
merges through tiktoken, which gives the same ids four times as fast; a test compares both on all documents.

Null text: the end id alone.  Null doc_id stays.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Outside these characters the two libraries' tables of letters and white space might differ.
_UNUSUAL = re.compile(r"[^\t\n\r -~\u00a1-\u024f]")
_loaded: dict[tuple, tuple] = {}


def tokenizer_files(json_path: str | None = None, ranks_path: str | None = None) -> tuple[str, str]:
    if json_path and ranks_path:
        return json_path, ranks_path
    import public_tokenizers

    return json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> ids as a uint32 array, as the tokenizers library gives them."""
    key = (json_path, ranks_path)
    if key not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        full, ranks = tokenizer_files(json_path, ranks_path)
        slow = Tokenizer.from_file(str(full))
        added = [re.escape(t.content) for t in slow.get_added_tokens_decoder().values()]
        apart = re.compile("|".join([_UNUSUAL.pattern, *added]))
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        quick = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        _loaded[key] = slow, quick, apart
    slow, quick, apart = _loaded[key]

    def encode(text: str) -> np.ndarray:
        if not apart.search(text):
            try:
                return np.asarray(quick.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its pattern runs out of stack on very long runs of white space
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (each at most counts times) whose sum is largest within room."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + k
            target -= length * k
    return chosen


def pack_items(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length).  All but the last few are full; those have powers of two as lengths."""
    heap: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        if lengths[i]:
            heap.setdefault(lengths[i], []).append((i, 0))
    counts = {n: len(items) for n, items in heap.items()}
    out: list[list[tuple[int, int, int]]] = []

    def take(n: int) -> tuple[int, int, int]:
        item, start = heap[n].pop()
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return item, start, n

    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = best_fill(counts, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        slack = capacity - sum(n * k for n, k in chosen.items())
        for _ in range(min(counts[n] // k for n, k in chosen.items()) if not slack else 1):
            out.append([take(n) for n, k in sorted(chosen.items(), reverse=True) for _ in range(k)])
        if slack and counts:
            bigger = [n for n in counts if n > slack]
            item, start, n = take(min(bigger))  # an item of slack or less would have been chosen
            out[-1].append((item, start, slack))
            heap.setdefault(n - slack, []).append((item, start + slack))
            counts[n - slack] = counts.get(n - slack, 0) + 1
    if out and (total := sum(n for _, _, n in out[-1])) < capacity:
        rest, size = out.pop(), 1 << (total.bit_length() - 1)
        while rest:
            while size > total:
                size >>= 1
            sequence, room = [], size
            while room:
                item, start, n = rest.pop(0)
                sequence.append((item, start, min(n, room)))
                if n > room:
                    rest.insert(0, (item, start + room, n - room))
                room -= min(n, room)
            out.append(sequence)
            total -= size
    return out


def pack_documents(documents: DataFrame, capacity: int = 1024, end_id: int = 0, json_path: str | None = None, ranks_path: str | None = None, group_tokens: int = 8_000_000) -> DataFrame:
    """One row for each piece of a document: its place in the document and in its sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(json_path, ranks_path), TaskContext.get().partitionId() << 36
        waiting, held = [], 0

        def flush() -> Iterator[tuple]:
            nonlocal sequence
            for pieces in pack_items([len(x[3]) for x in waiting], capacity):
                offset = 0
                for item, start, length in pieces:
                    doc, begin, total, ids = waiting[item]
                    yield doc, begin + start, length, zlib.crc32(ids[start : start + length].tobytes()), total, sequence, offset
                    offset += length
                sequence += 1

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                total, whole = len(ids), len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[start : start + capacity].tobytes()), total, sequence, 0))
                    sequence += 1
                if whole < total:
                    waiting.append((doc, whole, total, ids[whole:].copy()))
                    held += total - whole
                if held >= group_tokens:
                    rows += flush()
                    waiting, held = [], 0
                if len(rows) >= 100_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
        yield _batch(list(flush()))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)
