"""Language-model scoring of whole documents.

Base model: add-one unigrams over all training tokens.  Model: a gated recurrent network over the most
frequent training words (`vocabulary` entries with the end and unknown marks), trained by truncated
backpropagation; a word outside them is scored as the unknown mark times its add-one share among the
words outside.  The state runs through a document from its first word to its end.

On Spark.  Word counts of all training documents are gathered in packets by word hash; each batch sends a
word once.  Texts are then kept as word numbers, which training and scoring read.  Words outside the vocabulary are looked up the other way round: each document's distinct ones
go to their word's bucket, which counts them over all training documents and returns sums by document.
The network is trained on every training document once, in `train_share` rounds, each on another
1/`train_share` of them, dealt over trainers whose number grows with their bytes; each trains on its own documents from
the same start, and the mean of their weights starts the next round (weights are averaged on the executors, in
slices and as a tree, so no task holds more than `_FAN` trainers' slices).

Null or empty text: the end token alone.  Rows without doc_id are scored and learned from.  A document is
known by a hash of its id and text, so rows that repeat a doc_id with other texts are documents of their own (two
documents out of 10^10 may share a hash; they would share the part of words outside the vocabulary); equal rows
get equal scores.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packets
from .common import crc_fold, cut, doc_chunks, first_rows, ints, shuffle_buckets, strings
from .gru import END, UNKNOWN, Gru
from .words import Words

U = np.uint64
_SLICES, _FAN = 32, 64


def _batch_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch and the place of each document's first word."""
    data, offsets = strings(batch.column("text"))
    hashes, firsts, at = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    for i, j in doc_chunks(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold=True)
        hashes.append(w.hash)
        firsts.append(w.first[1:] + at)
        at += len(w.hash)
    return np.concatenate(hashes), np.concatenate(firsts)


def _held(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


def _count_packets(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _batch_words(batch)
            learn = ~np.repeat(_held(batch), np.diff(first))
            key, n = np.unique(words[learn], return_counts=True)
            yield from packets.split(buckets, key, n, np.zeros(len(key), np.int32))

    return run


def _totals(most: int):
    """Tokens and distinct words of each bucket (kind 0), and its most frequent words (kind 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, _, n, _) in packets.gathered(batches):
            words, inverse = np.unique(key, return_inverse=True)
            count = np.zeros(len(words), np.int64)
            np.add.at(count, inverse, n)
            top = np.lexsort((words, -count))[:most]
            kind = np.ones(len(top) + 1, np.int32)
            kind[0] = 0
            part = np.full(len(kind), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(part), pa.array(np.concatenate([[len(words)], words[top].view(np.int64)])), pa.array(np.concatenate([[count.sum()], count[top]]))], ["kind", "part", "word", "n"])

    return run


class _Vocabulary:
    """Numbers of the vocabulary's words: END, UNKNOWN, then words from the most frequent on."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.sorted, self.counts = words[order], counts
        self.number = np.append(order + 2, UNKNOWN).astype(np.int32)
        self.begin = np.searchsorted(self.sorted, np.arange(1 << 16, dtype=U) << U(48)).astype(np.int32)  # first word of each upper 16 bits
        self.most = int(np.bincount((words >> U(48)).astype(np.int64), minlength=1).max())  # words that share them

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(hashes), UNKNOWN, np.int32)
        at, last = self.begin[hashes >> U(48)], len(self.sorted) - 1
        found = np.full(len(hashes), last + 1)
        for step in range(self.most):
            here = np.minimum(at + step, last)
            np.copyto(found, here, where=self.sorted[here] == hashes)
        return self.number[found]


def _other_packets(vocabulary, buckets: int):
    """Each document's distinct words outside the vocabulary: (word, document, count), and whether they train."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _batch_words(batch)
            at = np.flatnonzero(vocabulary.value.numbers(words) == UNKNOWN)
            if len(at):
                of = np.repeat(np.arange(batch.num_rows), np.diff(first))[at]
                order = np.lexsort((of, words[at]))
                key, of = words[at][order], of[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                begin = np.flatnonzero(new)
                n = np.diff(np.concatenate([begin, [len(key)]]))
                yield from packets.split(buckets, key[begin], ints(batch, "rid")[of[begin]], n, (~_held(batch))[of[begin]].astype(np.uint32))

    return run


def _looked_up(buckets: int):
    """Sums by document of n * log10(c + 1), of n where c > 0, and of n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sums = [], []
        for _, (key, learn, doc, n) in packets.gathered(batches):
            _, inverse = np.unique(key, return_inverse=True)
            c = np.bincount(inverse, np.where(learn == 1, n, 0))[inverse]
            part, where = np.unique(doc, return_inverse=True)
            docs.append(part)
            sums.append(np.stack([np.bincount(where, v) for v in (n * np.log10(c + 1), np.where(c > 0, n, 0), n)]))
        if docs:
            part, where = np.unique(np.concatenate(docs), return_inverse=True)
            logs, known, n = (np.bincount(where, v) for v in np.concatenate(sums, axis=1))
            at = (part.astype(U) * U(0x9E3779B97F4A7C15) >> U(32)).astype(np.int64) % buckets
            order = np.argsort(at, kind="stable")
            yield from packets.of_sorted(at[order], packets.ASK, [logs[order].view(U), known[order].astype(np.uint32), part[order], n[order].astype(np.int32)])

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (logs, known, doc, n) in packets.gathered(batches):
        order = np.lexsort((logs, doc))  # a fixed order of addition
        part, where = np.unique(doc[order], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.bincount(where, v[order])) for v in (logs.view(np.float64), known, n))], ["__doc", "other_log", "other_known", "other_n"])


_WEIGHTS = "slice int, trainer int, tokens long, weights binary"


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over at most _FAN trainers of a slice of weights times tokens, and of tokens, in the trainers' order."""
    rows = rows.sort_values("trainer")
    total = sum(np.frombuffer(w) for w in rows["weights"])
    return pd.DataFrame({"slice": rows["slice"][:1], "trainer": [rows["trainer"].iloc[0] // _FAN], "tokens": [rows["tokens"].sum()], "weights": [total.tobytes()]})


def _kind(vocabulary: _Vocabulary) -> type:
    """The shortest type that holds the vocabulary's numbers."""
    return np.uint16 if len(vocabulary.counts) <= 1 << 16 else np.int32


def _numbers(batch: pa.RecordBatch, kind: type) -> list[np.ndarray]:
    """The numbers of each document of a numbered batch."""
    return [np.frombuffer(value.as_buffer(), kind).astype(np.int32) for value in batch.column("numbers")]


_NUMBERED = "doc_id long, rid long, held_out boolean, size long, numbers binary"


def _numbered(docs: DataFrame, vocabulary) -> DataFrame:
    """docs with the numbers of each text's words and its end instead of the text, and the text's bytes and 8 more; kept,
    so that the rounds of training and the scores read them without splitting texts again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(vocabulary.value)
        for whole in batches:
            _, offsets = strings(whole.column("text"))
            for i, j in doc_chunks(offsets, 1 << 26):  # a column of bytes has 2 GB at most
                batch = whole.slice(i, j - i)
                hashes, first = _batch_words(batch)
                numbers = np.insert(vocabulary.value.numbers(hashes), first[1:], END).astype(kind)
                ends = ((first + np.arange(len(first))) * numbers.itemsize).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(numbers)])
                columns = [batch.column("doc_id"), batch.column("rid"), batch.column("held_out"), pa.array(np.diff(offsets[i : j + 1]) + 8), held]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "held_out", "size", "numbers"])

    return cut(docs.mapInArrow(run, _NUMBERED))


def train_network(docs: DataFrame, vocabulary: _Vocabulary, hidden: int, train_share: int, trainer_bytes: int) -> Gru:
    """The mean of trainers' networks; docs: the training documents (rid, text)."""
    docs = docs.withColumns({"doc_id": F.col("rid"), "held_out": F.lit(False)})
    return _trained(_numbered(docs, docs.sparkSession.sparkContext.broadcast(vocabulary)), vocabulary, hidden, train_share, trainer_bytes)


def _trained(numbered: DataFrame, vocabulary: _Vocabulary, hidden: int, train_share: int, trainer_bytes: int) -> Gru:
    """The network of the numbered documents that are not held out."""
    spark = numbered.sparkSession
    docs = numbered.where("not held_out").withColumn("share", F.pmod(F.xxhash64("rid"), F.lit(train_share)).cast("int"))
    sizes = {r[0]: r[1] for r in docs.groupBy("share").agg(F.sum("size")).collect()}  # train_share rows at most
    network, kind, counts = Gru(vocabulary.counts, hidden), _kind(vocabulary), spark.sparkContext.broadcast(vocabulary.counts)
    for turn in range(train_share):
        trainers = max(1, -(-sizes.get(turn, 0) // trainer_bytes))
        trainer = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(trainers)).cast("int")
        dealt = docs.where(F.col("share") == turn).select("rid", "numbers").repartitionById(trainers, trainer).sortWithinPartitions("rid", "numbers")
        start = spark.sparkContext.broadcast(network.flat())

        def train(batches: Iterable[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            stream = [np.array([END], np.int32)]
            for batch in batches:
                stream += _numbers(batch, kind)
            tokens = np.concatenate(stream)
            if len(tokens) > 1:
                own = Gru(counts.value, hidden).load(start.value)
                own.train(tokens)
                parts = np.array_split(own.flat().astype(np.float64) * len(tokens), _SLICES)
                me = np.full(_SLICES, TaskContext.get().partitionId(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(me), pa.array([len(tokens)] * _SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "trainer", "tokens", "weights"])

        made = dealt.mapInArrow(train, _WEIGHTS)
        while True:  # log(trainers) levels
            made = made.groupBy("slice", F.expr(f"trainer div {_FAN}").cast("int").alias("trainer")).applyInPandas(_added, _WEIGHTS)
            trainers = -(-trainers // _FAN)
            if trainers == 1:
                break
        parts = sorted((r[0], (np.frombuffer(bytes(r[3])) / r[2]).astype(np.float32).tobytes()) for r in made.collect())
        if len(parts) == _SLICES:
            network = Gru(vocabulary.counts, hidden).load(np.frombuffer(b"".join(p for _, p in parts), np.float32))
    return network


def language_model_scores(documents: DataFrame, vocabulary: int = 4096, hidden: int = 24, folds: int = 7, held_fold: int = 2, train_share: int = 8, trainer_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"rid": F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))), "held_out": F.coalesce(crc_fold("doc_id", folds) == held_fold, F.lit(False))})
    buckets = shuffle_buckets(spark)
    totals = cut(docs.mapInArrow(_count_packets(buckets), packets.PACKET).repartitionById(buckets, "bucket").mapInArrow(_totals(vocabulary - 2), "kind int, part int, word long, n long"))
    distinct, tokens = (x or 0 for x in totals.where("kind = 0").agg(F.sum("word"), F.sum("n")).first())
    ends = docs.where("not held_out").count()
    top = first_rows(totals.where("kind = 1"), vocabulary - 2, [F.desc("n"), F.asc("word")], "part", buckets).select("word", "n").collect()
    kept = np.array([r[1] for r in top], np.int64)
    rest_tokens, rest_distinct = tokens - int(kept.sum()), distinct - len(top)
    n_all, v_all = tokens + ends, distinct + (ends > 0)
    words = _Vocabulary(np.array([r[0] for r in top], np.int64).view(U), np.concatenate([[ends, rest_tokens], kept]).astype(np.float64))
    shared = spark.sparkContext.broadcast(words)
    others = docs.mapInArrow(_other_packets(shared, buckets), packets.PACKET).repartitionById(buckets, "bucket").mapInArrow(_looked_up(buckets), packets.PACKET)
    others = others.repartitionById(buckets, "bucket").mapInArrow(_summed, "__doc long, other_log double, other_known double, other_n double")
    numbered = _numbered(docs, shared)
    network = spark.sparkContext.broadcast(_trained(numbered, words, hidden, train_share, trainer_bytes))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_logs, kind = np.log10(shared.value.counts + 1), _kind(shared.value)
        for batch in batches:
            docs_ = _numbers(batch, kind)
            numbers, counts = np.concatenate([*docs_, np.zeros(0, np.int32)]), np.array([len(d) - 1 for d in docs_], np.int64)
            inside = (numbers != UNKNOWN) & (numbers != END)
            of = np.repeat(np.arange(len(counts)), counts + 1)[inside]
            own = np.bincount(of, minlength=len(counts))
            base = np.bincount(of, known_logs[numbers[inside]], len(counts)) + known_logs[END]
            columns = [batch.column("doc_id"), batch.column("rid"), batch.column("held_out"), pa.array(counts + 1), pa.array(own + (ends > 0)), pa.array(counts - own), pa.array(base), pa.array(network.value.score(docs_))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "held_out", "n_tokens", "known", "n_other", "base", "model"])

    scored = numbered.mapInArrow(score, "doc_id long, rid long, held_out boolean, n_tokens long, known long, n_other long, base double, model double")
    joined = scored.join(others, F.col("rid") == F.col("__doc"), "left")
    share = F.coalesce(F.col("n_other") / F.when(F.col("other_n") > 0, F.col("other_n")), F.lit(0.0))
    joined = joined.withColumn("logs", F.coalesce(F.col("other_log") * share, F.lit(0.0))).withColumn("more", F.coalesce(F.round(F.col("other_known") * share).cast("long"), F.lit(0)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (F.col("model") + F.col("logs") - F.col("n_other") * F.lit(float(np.log10(rest_tokens + rest_distinct + 1)))).alias("score"),
    )
