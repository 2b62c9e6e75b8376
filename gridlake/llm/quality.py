"""Quality rules: an isolation forest on rule statistics.

Every document gets counts of its words, symbols, repeated lines, repeated word windows, letters in
upper case and so on.  Ratios of these are the features of an isolation forest (random axis-parallel
splits; a short mean path means an anomaly).  Splits are drawn from the whole range that labelled rows
span, so junk soon falls into regions where no row marked good is; a tree ends where, by the counts of
all good rows, a part of `size` of them would leave fewer than two.  The cut on the score is the one that
best separates good from bad labelled rows among those that keep `keep_share` of the good ones.

Range, counts and cut are aggregates over all labelled rows: nothing is sampled.  The driver meets one row
for each leaf and each step of the score.

Null or empty text: zero words, base_failed.  Null doc_id: scored like any other row.  No labelled good
row: no forest, score 0, and only the base rules reject.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_chunks, strings
from .words import SEPARATOR, Words, mix, per_doc, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct", "n_distinct", "n_lines", "n_single")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _bytes_of(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL, _UPPER = _bytes_of("#*$%&|<>"), _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PUNCT = _bytes_of("!\"'()+,-./:;=?@[\\]^_`{}~")
_WINDOW = 8


def rule_counts(documents: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count, _SCHEMA)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        parts = [_chunk_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in doc_chunks(offsets, 1 << 19)]
        table = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], ["doc_id", *COUNTS])


def _chunk_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    w = Words(data, offsets)
    n_words = np.diff(w.first)
    of = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)
    salt = mix(of + np.uint64(1))
    char = (data & 0xC0) != 0x80
    hashed, whole = windows(w.hash, w.first, _WINDOW)
    again = np.zeros(len(hashed) + _WINDOW, np.int32)
    at = np.flatnonzero(whole)
    order = np.argsort(hashed[at] ^ salt[at])
    sorted_ = (hashed[at] ^ salt[at])[order]
    same = np.zeros(len(at), bool)
    same[1:] = sorted_[1:] == sorted_[:-1]
    same[:-1] |= same[1:]
    begins = at[order[same]]
    again[begins] += 1
    again[begins + _WINDOW] -= 1
    repeat = np.cumsum(again[: len(hashed)]) > 0
    is_first = np.zeros(len(w.hash), bool)
    is_first[np.unique(w.hash ^ salt, return_index=True)[1]] = True
    dup, lines = _lines(data, offsets)
    return np.stack(
        [
            n_words, per_doc(char & ~SEPARATOR[data], offsets), per_doc(_SYMBOL[data], offsets), dup, per_doc(repeat, w.first), per_doc(_UPPER[data], offsets),
            per_doc(_PUNCT[data], offsets), per_doc(is_first, w.first), lines, per_doc(w.end - w.start == 1, w.first),
        ],
        axis=1,
    )


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, dup, lines = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        worded = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        lines.append(len(worded))
        dup.append(len(worded) - len(set(worded)))
    return np.array(dup, np.int64), np.array(lines, np.int64)


FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "punctuation", "variety", "single")


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios of rule counts (columns as COUNTS)."""
    n, chars, symbols, dup, repeat, upper, punct, distinct, lines, single = counts.T.astype(np.float64)
    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    variety = np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2))
    return np.stack([chars / words, symbols / words, dup / np.maximum(lines, 1), repeat / words, upper / letters, punct / words, variety, single / words], axis=1)


class IsolationForest:
    """Whole trees of random splits within a box of feature values, in heap order; path lengths come from counts of rows in leaves."""

    def __init__(self, box: tuple[np.ndarray, np.ndarray], rows: int, trees: int = 200, size: int = 256, seed: int = 7) -> None:
        self.size = min(size, rows)
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.leaves = 1 << self.depth
        rng = np.random.default_rng(seed)
        grown = [self._grow(box, rng) for _ in range(trees)]
        self.feature, self.split = (np.array([g[k] for g in grown]) for k in (0, 1))
        self.length = np.zeros((trees, self.leaves))

    @staticmethod
    def expected(n: float) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, box: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[list[int], list[float]]:
        feature, split, boxes = [], [], [box]
        for at in range(self.leaves - 1):
            low, high = boxes[at]
            usable = np.flatnonzero(high > low)
            f = int(rng.choice(usable)) if len(usable) else 0
            cut_at = float(rng.uniform(low[f], high[f])) if len(usable) else np.inf
            upto, since = high.copy(), low.copy()
            if len(usable):
                upto[f] = since[f] = cut_at
            feature.append(f)
            split.append(cut_at)
            boxes += [(low, upto), (since, high)]
        return feature, split

    def leaves_of(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of each row, tree by tree."""
        every = np.arange(len(rows))
        for feature, split in zip(self.feature, self.split, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[every, feature[at]] >= split[at])
            yield at - (self.leaves - 1)

    def count(self, rows: np.ndarray) -> np.ndarray:
        """Rows in each leaf of each tree."""
        return np.stack([np.bincount(leaf, minlength=self.leaves) for leaf in self.leaves_of(rows)])

    def measure(self, counts: np.ndarray) -> None:
        """Path lengths out of the counts of all rows in the leaves."""
        share = self.size / max(1, int(counts[0].sum()))
        for tree, own in enumerate(counts):
            levels = [own * share]
            while len(levels[-1]) > 1:
                levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
            ended = np.zeros(self.leaves, bool)
            for depth, held in enumerate(reversed(levels)):
                wide = np.repeat(held, self.leaves >> depth)
                ends = ~ended & ((wide < 2) | (depth == self.depth))
                self.length[tree][ends] = depth + np.array([self.expected(v) for v in wide[ends]])
                ended |= ends

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies, under 0.5 for the usual."""
        total = np.zeros(len(rows))
        for length, leaf in zip(self.length, self.leaves_of(rows), strict=True):
            total += length[leaf]
        return 2 ** (-total / len(self.length) / max(self.expected(self.size), 1e-9))


#: Scores are told apart in so many steps when the cut is sought; a power of two, so a step's border is exact.
STEPS = 1 << 16


def calibrate(step: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_share: float) -> float:
    """The cut that rejects most bad rows for the good ones it costs, with keep_share of the good kept; inf if no cut helps.

    good and bad: how many rows have a score above (step - 1) / STEPS and up to step / STEPS, for ascending steps."""
    if not good.sum() or not bad.sum():
        return float("inf")
    kept, caught = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    gain = np.where(kept >= keep_share, caught + kept - 1, 0.0)
    best = int(np.argmax(gain))
    return float(step[best]) / STEPS if gain[best] > 0 else float("inf")


def _ratios(batch: pa.RecordBatch) -> np.ndarray:
    return features(np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1))


def _range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest value of each feature in a batch."""
    for batch in batches:
        if batch.num_rows:
            rows = _ratios(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(FEATURES)), pa.int32()), pa.array(rows.min(0)), pa.array(rows.max(0))], ["feature", "low", "high"])


def _fit(labelled: DataFrame, trees: int, keep_share: float) -> tuple[IsolationForest | None, float]:
    """The forest and the cut, out of all rows of labelled (quality as good, base_failed, COUNTS)."""
    passed = labelled.where(~F.col("base_failed"))
    box = labelled.select(*COUNTS).mapInArrow(_range, "feature int, low double, high double").groupBy("feature").agg(F.min("low"), F.max("high")).orderBy("feature").collect()
    rows = passed.where("good").count()
    if not rows:
        return None, float("inf")
    forest = IsolationForest((np.array([r[1] for r in box]), np.array([r[2] for r in box])), rows, trees)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((forest.count(_ratios(batch)) for batch in batches), np.zeros((trees, forest.leaves), np.int64)).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["leaf", "n"])

    counts = np.zeros(trees * forest.leaves, np.int64)
    for leaf, n in passed.where("good").select(*COUNTS).mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect():
        counts[leaf] = n
    forest.measure(counts.reshape(trees, forest.leaves))

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place = np.unique(np.ceil(forest.score(_ratios(batch)) * STEPS).astype(np.int64), return_inverse=True)
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            parts = (np.bincount(place[own], minlength=len(at)) for own in (good, ~good))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(n.astype(np.int64)) for n in parts)], ["step", "good", "bad"])

    seen = passed.select("good", *COUNTS).mapInArrow(steps, "step long, good long, bad long").groupBy("step").agg(F.sum("good"), F.sum("bad")).orderBy("step").collect()
    return forest, calibrate(*np.array(seen, np.int64).reshape(-1, 3).T, keep_share)


def quality_verdicts(documents: DataFrame, labels: DataFrame, trees: int = 200, keep_share: float = 0.995) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and anomaly (the forest's score) of every row."""
    spark = documents.sparkSession
    counts = cut(rule_counts(documents))
    base = counts.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__quality")).where("__id is not null and __quality in (0, 1)")
    labelled = cut(base.join(marks, F.col("doc_id") == F.col("__id")).select((F.col("__quality") == 1).alias("good"), "base_failed", *COUNTS))
    forest, most = _fit(labelled, trees, keep_share)
    shared = spark.sparkContext.broadcast((forest, most))  # splits and lengths of `trees` trees of `size` leaves

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, limit = shared.value
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1)
            score = grown.score(features(table)) if grown else np.zeros(len(table))
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            arrays = [batch.column(c) for c in ("doc_id", *COUNTS[:5], "base_failed")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(~failed.astype(bool) & (score <= limit)), pa.array(score)], ["doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly"])

    return base.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, anomaly double")
