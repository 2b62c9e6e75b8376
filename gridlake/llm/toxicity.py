"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit (on at most `sample_rows` labelled rows outside the held-out fold, chosen by a hash of their id): terms
that at least `least_share` of them hold and whose share differs between toxic and other examples beyond
chance (G-squared) become the vocabulary.
Terms are words and their beginnings.  One more term, which every document has as often as it has words,
keeps a stray vocabulary word in a long text apart from a text full of them.  IDF is counted over all
documents.  Score (every whole text): the `k` nearest examples by cosine vote with
their similarity as weight; a monotone map from votes to label rates, fitted on leave-one-out votes of the
examples, makes a calibrated score.  A text without vocabulary terms gets the label rate of such examples.

The index keeps a list of postings for each term, cut into blocks of examples with the largest weight of
each block.  Blocks are visited from the highest upper bound down; once a bound is below the k-th best
similarity no later block can hold a neighbour, so the neighbours are exact.  Equal similarities are
ordered by the example's id.  Index and vocabulary are bounded by the parameters and are broadcast.

A labelled document is not among its own neighbours, in the fit as in the scores.

Null or empty text: scored as a text without terms.  Null doc_id: scored, not held out.  No usable labels:
score 0.  Labels that repeat an id: the larger one counts.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut, doc_chunks, hashed_sample, strings, without_rows
from .words import PLAIN, Words, mix

SCHEMA = "doc_id long, raw long, held_out boolean, score double, predicted int, vote double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


#: Terms are words and their beginnings of so many bytes, which catch a stem under many endings.
PREFIXES = (4, 5, 6, 7, 8)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First document of a chunk, term hashes, the document each belongs to, and words of each document."""
    data, offsets = strings(batch.column("text"))
    for i, j in doc_chunks(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold=True, separator=PLAIN, prefixes=PREFIXES)
        doc = np.repeat(np.arange(j - i), np.diff(w.first))
        parts, of = [w.hash], [doc]
        for p in w.prefix:
            at = np.flatnonzero(p)
            parts.append(p[at])
            of.append(doc[at])
        yield i, np.concatenate(parts), np.concatenate(of), np.diff(w.first)


def _label_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for i, term, doc, _ in _chunks(batch):
            pair = np.unique(np.stack([term, doc.astype(np.uint64)]), axis=1) if len(term) else np.zeros((2, 0), np.uint64)
            names, inverse = np.unique(pair[0], return_inverse=True)
            marked = np.bincount(inverse, toxic[i + pair[1].astype(np.int64)] == 1, len(names))
            seen = np.bincount(inverse, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(marked.astype(np.int64)), pa.array((seen - marked).astype(np.int64))], ["term", "bad", "fine"])


def _counted(vocabulary: np.ndarray):
    """Term numbers and counts of each document that has vocabulary terms, its number of words last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = [b""] * batch.num_rows
            counts: list[bytes] = [b""] * batch.num_rows
            for i, term, doc, words in _chunks(batch):
                if len(vocabulary) and len(term):
                    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                    hit = vocabulary[at] == term
                    pair, n = np.unique(doc[hit] * len(vocabulary) + at[hit], return_counts=True)
                    docs = pair // len(vocabulary)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(docs)) + 1, [len(docs)]])
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        if a < b:
                            found[i + docs[a]] = np.append(pair[a:b] % len(vocabulary), len(vocabulary)).astype(np.int32).tobytes()
                            counts[i + docs[a]] = np.append(n[a:b], words[docs[a]]).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "raw", "held_out")), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "raw", "held_out", "terms", "counts"])

    return run


def _frequencies(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
            seen += np.bincount(terms, minlength=size + 1)
        seen[size] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "docs"])

    return run


_TIES = 20  # low bits of a key: the example's rank by id, so equal similarities have an order
_TOP = (1 << _TIES) - 1


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors behind per-term postings, cut into blocks with the largest weight of each."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list[int], labels: list[int], terms: int, block: int = 256) -> None:
        if len(ids) > _TOP:
            raise ValueError(f"more than {_TOP} examples")
        rank = np.argsort(np.argsort(np.array(ids, np.int64), kind="stable"), kind="stable")
        by_rank = np.argsort(rank)
        self.ids, self.labels = np.array(ids, np.int64)[by_rank], np.array(labels)[by_rank]
        # examples of the same main term stand together, which keeps the bounds of other blocks low
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), ids[i]))
        self.place = np.empty(len(ids), np.int64)
        self.place[order] = np.arange(len(ids))
        self.rank, self.block, self.terms = rank[order], block, terms
        self.blocks = -(-len(ids) // block)
        term = np.concatenate([vectors[i][0] for i in order])
        weight = np.concatenate([vectors[i][1] for i in order])
        at = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by_block = np.lexsort((at, term, at // block))
        self.term, self.weight, self.at = term[by_block], weight[by_block], at[by_block] % block
        self.edges = np.searchsorted(at[by_block] // block, np.arange(self.blocks + 1))
        self.most = np.zeros((terms, self.blocks))
        np.maximum.at(self.most, (term, at // block), weight)

    def _postings(self, b: int) -> np.ndarray:
        """Weights of a block's postings, by term and example."""
        span = slice(self.edges[b], self.edges[b + 1])
        out = np.zeros((self.terms, min(self.block, len(self.ids) - b * self.block)))
        out[self.term[span], self.at[span]] = self.weight[span]
        return out

    def nearest(self, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and ranks (indexes of ids and labels) of each query's k nearest, best first; similarity 0 where there are fewer.

        queries: unit vectors in rows; own: for each its number among the examples, to be left out, or -1."""
        bounds = queries @ self.most
        best = np.zeros((len(queries), k), np.int64)
        for b in np.argsort(-bounds.max(0), kind="stable").tolist():
            # rounding keeps a similarity within half a unit of the twelfth digit, so a lower bound cannot hide a neighbour
            live = np.flatnonzero(bounds[:, b] >= (best[:, -1] >> _TIES) / 1e12 - 1e-9)
            live = live[bounds[live, b] > 0]
            if not len(live):
                continue
            keys = np.rint(queries[live] @ self._postings(b) * 1e12).astype(np.int64)
            if own is not None:
                inside = np.flatnonzero((own[live] >= 0) & (self.place[own[live]] // self.block == b))
                keys[inside, self.place[own[live[inside]]] % self.block] = 0
            ranks = self.rank[b * self.block : b * self.block + keys.shape[1]]
            keys = np.where(keys > 0, (keys << _TIES) | (_TOP - ranks), 0)
            both = np.concatenate([best[live], keys], axis=1)
            best[live] = -np.sort(np.partition(-both, k - 1, axis=1)[:, :k], axis=1)
        return (best >> _TIES) / 1e12, np.where(best > 0, _TOP - (best & _TOP), 0)


def votes(similar: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Share of the label among neighbours, weighted by similarity; nan without neighbours."""
    total = similar.sum(1)
    return np.where(total > 0, (similar * labels).sum(1) / np.where(total > 0, total, 1), np.nan)


def monotone(votes: np.ndarray, labels: np.ndarray, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Votes and rising label rates to interpolate between: pooled adjacent violators over quantile bins."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(bins, max(1, len(order) // 25))):
        if len(part):
            pools.append([float(votes[part].mean()) * len(part), float(labels[part].sum()), float(len(part))])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    x, y, n = np.array(pools).T
    return x / n, (y + 0.5) / (n + 1)


class Model:
    def __init__(self, idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], k: int) -> None:
        self.idf, self.k = idf, k
        full = [x for x in examples if len(x[2])]
        empty = [y for _, y, t, _ in examples if not len(t)]
        self.bare = (sum(empty) + 0.5) / (len(empty) + 1) if empty else (sum(y for _, y, _, _ in examples) / len(examples) if examples else 0.0)
        self.index, self.curve = None, None
        if full:
            self.number = {i: n for n, (i, *_) in enumerate(full)}
            self.index = BlockMaxIndex([(t, self.weights(t, c)) for _, _, t, c in full], [i for i, *_ in full], [y for _, y, *_ in full], len(idf))
            loo, labels = [], np.array([y for _, y, *_ in full])
            for a in range(0, len(full), 256):
                part = full[a : a + 256]
                similar, rank = self.index.nearest(self.dense([x[2:] for x in part]), k, own=np.arange(a, a + len(part)))
                loo.append(votes(similar, self.index.labels[rank]))
            loo = np.concatenate(loo)
            if (~np.isnan(loo)).any():
                self.curve = monotone(loo[~np.isnan(loo)], labels[~np.isnan(loo)])

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[terms]
        return v / np.linalg.norm(v)

    def dense(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.idf)))
        for i, (t, c) in enumerate(rows):
            out[i, t] = self.weights(t, c)
        return out

    def judge(self, ids: list[int | None], rows: list[tuple[np.ndarray, np.ndarray]], evidence: int) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        """Score, vote (nan without neighbours) and the first neighbours of each row of terms and counts.

        An example is no neighbour of its own document, so its label has no vote in its score."""
        score, vote = np.full(len(rows), float(self.bare)), np.full(len(rows), np.nan)
        shown: list[list[dict]] = [[] for _ in rows]
        full = [i for i, (t, _) in enumerate(rows) if len(t)] if self.index else []
        for a in range(0, len(full), 256):
            at = np.array(full[a : a + 256])
            own = np.array([self.number.get(ids[i], -1) for i in at.tolist()])
            similar, rank = self.index.nearest(self.dense([rows[i] for i in at]), self.k, own)
            v = votes(similar, self.index.labels[rank])
            near = ~np.isnan(v)
            vote[at] = v
            score[at[near]] = np.interp(v[near], *self.curve) if self.curve else v[near]
            for i, s, r in zip(at.tolist(), similar[:, :evidence].tolist(), rank[:, :evidence].tolist(), strict=True):
                shown[i] = [{"doc_id": int(self.index.ids[j]), "similarity": x, "toxic": int(self.index.labels[j])} for x, j in zip(s, r, strict=True) if x > 0]
        return score, vote, shown


def toxicity_scores(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, vote, evidence (the first of the nearest examples) of every row."""
    return _scores(documents, labels, **options).drop("raw")


def drop_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The input's rows and columns without rows predicted toxic; a row is known by doc_id, null or not, and text."""
    return without_rows(documents, _scores(documents, labels, **options).where("predicted = 1").select("doc_id", "raw"))


def _scores(documents: DataFrame, labels: DataFrame, sample_rows: int = 12_000, max_terms: int = 2048, least_share: float = 0.005, least_g: float = 30.0, k: int = 25, folds: int = 5, evidence: int = 5) -> DataFrame:
    """toxicity_scores with raw, the hash of a row's text."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"raw": F.xxhash64("text"), "held_out": F.coalesce(crc_fold("doc_id", folds) == 0, F.lit(False))})
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("__id is not null and toxic in (0, 1)").where(crc_fold("__id", folds) != 0)
    sample = cut(hashed_sample(cut(marks.groupBy("__id").agg(F.max("toxic").alias("toxic"))), sample_rows, F.col("__id")))
    joined = docs.join(F.broadcast(sample), docs["doc_id"] == sample["__id"])  # sample_rows pairs of integers at most
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, fine = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    terms = joined.select("text", "toxic").mapInArrow(_label_counts, "term long, bad long, fine long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).where(f"bad + fine >= {max(5.0, least_share * (bad + fine))}")
    chosen = terms.withColumn("g", _g_squared(bad, fine)).where(f"g >= {least_g}").orderBy(F.desc("g"), "term").limit(max_terms).select("term").collect() if bad and fine else []
    vocabulary = np.sort(np.array([r[0] for r in chosen], np.int64).view(np.uint64))
    counted = cut(docs.mapInArrow(_counted(vocabulary), "doc_id long, raw long, held_out boolean, terms binary, counts binary"))
    seen = {r[0]: r[1] for r in counted.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term long, docs long").groupBy("term").agg(F.sum("docs")).collect()}
    total = seen.get(len(vocabulary), 0)
    idf = np.array([np.log((1 + total) / (1 + seen.get(t, 0))) + 1 for t in range(len(vocabulary))] + [1.0])  # the last: all words
    rows = counted.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "toxic", "terms", "counts").collect()
    read = lambda b: np.frombuffer(bytes(b), np.int32)
    examples = {r[0]: (r[0], r[1], read(r[2]), read(r[3])) for r in rows}
    shared = spark.sparkContext.broadcast(Model(idf, [examples[i] for i in sorted(examples)], k))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(read(t), read(c)) for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            s, v, near = shared.value.judge(batch.column("doc_id").to_pylist(), rows, evidence)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "raw", "held_out")), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(v, mask=np.isnan(v)), pa.array(near, _EVIDENCE)], ["doc_id", "raw", "held_out", "score", "predicted", "vote", "evidence"])

    return counted.mapInArrow(score, SCHEMA)


def _g_squared(bad: float, fine: float):
    """Log-likelihood ratio of a term's label shares against no difference."""
    a, b = F.col("bad"), F.col("fine")
    rate = (a + b) / F.lit(bad + fine)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return 2 * (part(a, rate * bad) + part(b, rate * fine) + part(bad - a, (1 - rate) * bad) + part(fine - b, (1 - rate) * fine))
