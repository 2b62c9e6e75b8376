"""Secret scans: three base patterns, and strings of high Shannon entropy.

Base kinds (leftmost non-overlapping matches, greedy): assign, access, hex.  Beyond them, every candidate
string (20 or more characters of a token alphabet) gets the entropy of each window of `window` characters
from counts that change by two characters from one window to the next; windows at or above the limit of
the string's character class (hex digits, or the base-64 alphabets) merge into spans of kind entropy.
Strings that the allow-list matches, and spans that touch a base span, are not reported.

A vectorised pass over a batch's bytes finds the documents that can match at all; only those are scanned
with patterns, and always from end to end.  Null text is empty; null doc_id stays; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_CLASS = re.compile(r"[0-9a-fA-F]+")
#: Limits in bits of entropy within a window of 20 characters.
LIMITS = {"hex": 3.0, "base64": 3.8}
#: Natural words (one case, or a capital first), words joined by - _ / or =, bare numbers and dates, repeated rules.
#: Words and joints share no character and no quantifier gives characters back, so matching takes linear time.
ALLOW = (r"[A-Z]?[a-z]+|[A-Z]+", r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})?[-_/=+]++(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)[-_/=+]++)*+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})?", r"[0-9_/=+-]+", r"(.)\1+")
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def dense_windows(text: str, window: int, limit: float) -> list[tuple[int, int]]:
    """Merged ranges of the windows whose character entropy is at least limit."""
    w = min(window, len(text))
    if w < 2:
        return []
    weigh = [0.0] + [c * log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, c in enumerate(text):
        if i >= w:  # the character that leaves goes first, so no count exceeds the window
            old = text[i - w]
            k = counts[old]
            total += weigh[k - 1] - weigh[k]
            counts[old] = k - 1
        k = counts.get(c, 0)
        total += weigh[k + 1] - weigh[k]
        counts[c] = k + 1
        if i >= w - 1 and log2(w) - total / w >= limit - 1e-9:
            if found and found[-1][1] >= i - w + 1:
                found[-1][1] = i + 1
            else:
                found.append([i - w + 1, i + 1])
    return [(a, b) for a, b in found]


def find_spans(text: str, window: int = 20, limits: dict[str, float] = LIMITS, allow: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """(kind number, start, end as code points) of every secret in a text, base kinds and entropy."""
    allow = allow or _allow(ALLOW)
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base = sorted(spans)
    starts, reach, far = [s for s, _, _ in base], [], 0
    for _, e, _ in base:
        far = max(far, e)
        reach.append(far)
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if not allow.fullmatch(word):
            kind = "hex" if HEX_CLASS.fullmatch(word) else "base64"
            for a, b in dense_windows(word, window, limits[kind]):
                a, b = a + m.start(), b + m.start()
                before = bisect_left(starts, b)  # base spans that start before b
                if not before or reach[before - 1] <= a:
                    spans.append((a, b, 3))
    return sorted(spans, key=lambda x: (x[0], x[2]))


def _allow(patterns: Iterable[str]) -> re.Pattern:
    # each pattern stands in a group of its own, so that \1 of the last one is written against its own group
    body, groups = [], 0
    for p in patterns:
        groups += 1
        body.append("(" + re.sub(r"\\(\d)", lambda m, g=groups: f"\\{int(m[1]) + g}", p) + ")")
        groups += re.compile(p).groups
    return re.compile("|".join(body))


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents that hold a key word, AKIA, or a long enough run of hex digits or token characters."""
    hit = np.zeros(len(offsets) - 1, bool)

    raw = data.tobytes()
    lower = raw.lower()
    for text, keys in ((lower, _KEYS), (raw, (b"AKIA",))):
        for key in keys:
            at = text.find(key)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right")) - 1
                hit[doc] = True
                at = text.find(key, max(at + 1, int(offsets[doc + 1]) - len(key)))
    for table, least in ((_HEX, 24), (_TOKEN, 20)):
        edges = np.flatnonzero(np.diff(table[data], prepend=False, append=False))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= least
        begins, ends = begins[long], ends[long]
        doc = np.searchsorted(offsets, begins, "right") - 1
        hit[doc] = True
        for d, e in zip(doc[ends > offsets[doc + 1]], ends[ends > offsets[doc + 1]], strict=True):  # runs over a border
            hit[d : int(np.searchsorted(offsets, e, "left"))] = True
    return hit


def scan_secrets(documents: DataFrame, window: int = 20, limits: dict[str, float] | None = None, allow: Iterable[str] = ALLOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row."""
    limits, allow = dict(limits or LIMITS), tuple(allow)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _allow(allow)
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            n = batch.num_rows
            counts, shas, texts = np.zeros((n, 4), np.int64), [none] * n, [""] * n
            for i in np.flatnonzero(_suspects(data, offsets)).tolist() if n else []:
                spans = find_spans(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"), window, limits, known)
                for _, _, k in spans:
                    counts[i, k] += 1
                shas[i] = hashlib.sha256(_joined(s for s in spans if s[2] < 3).encode()).hexdigest()
                texts[i] = _joined(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k].copy()) for k in range(3)), pa.array(shas), pa.array(texts), pa.array(counts[:, 3].copy())], SCHEMA_NAMES)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(documents: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """The input's rows and columns; found spans of text are replaced by mask, and n_chars, if there, counts the new text."""
    window, limits, allow = options.get("window", 20), dict(options.get("limits") or LIMITS), tuple(options.get("allow") or ALLOW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _allow(allow)
        for batch in batches:
            column, at = batch.column("text"), batch.schema.get_field_index("text")
            data, offsets = strings(column)
            texts, lengths = column.to_pylist(), {}
            for i in np.flatnonzero(_suspects(data, offsets)).tolist() if batch.num_rows else []:
                parts, end = [], 0
                for a, b, _ in find_spans(texts[i], window, limits, known):
                    if a >= end:
                        parts += [texts[i][end:a], mask]
                    end = max(end, b)
                texts[i] = "".join(parts) + texts[i][end:]
                if parts:
                    lengths[i] = len(texts[i])
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, column.type)
            where = batch.schema.get_field_index("n_chars")
            if where >= 0 and lengths:
                values = arrays[where].to_pylist()
                for i, n in lengths.items():
                    values[i] = n
                arrays[where] = pa.array(values, arrays[where].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)
