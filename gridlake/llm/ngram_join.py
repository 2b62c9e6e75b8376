"""N-gram Jaccard self-join and near-duplicate components by PartEnum signatures.

A document's set holds its distinct shingles of `width` words (A-Z lower-cased).  Documents with equal sets
are one representative.  Two sets of sizes s and b link when their Jaccard similarity is at least
percent/100; then they differ in at most k = (s + b)(100 - percent)/(100 + percent) shingles, and b lies
within s * percent/100 and s * 100/percent.

Signatures.  Sizes fall into bands [2^j, 2^(j+1)).  For each band the shingle domain is partitioned, by a
hash, into more than k + 1 parts, and each set enumerates single parts: two sets that differ in at most k
shingles agree on all but k parts.  A set also takes part in the next band if a partner can lie there.
Parts are ordered by (shingles in them, hash of these, number), the same order for every set, and a set
with at most k differences to any partner signs only its k + 1 highest parts: of the parts two linked sets
agree on, the highest is among the k + 1 highest of both, so they share that signature, and parts with
few or no shingles, on which unrelated sets would agree, are left out.  No link is lost.

Candidates.  Signatures travel in packets.  Groups of up to `small` sets give all pairs; larger ones give a
star around one of them and a random cycle, twice as many pairs as members, which joins what is densely
linked.  Pairs pass a sound filter first (parities of hashed shingles: two sets cannot differ in fewer
shingles than their parities do) and are then verified on the sets themselves.  Only documents of such
pairs (and a few more, by a bitmap of bounded size) send their sets.  In large groups whose members are then
not yet in one component every member is compared with every one of another component, by parities, in
blocks of bounded size within tasks; pairs that pass are verified there, on the sets that travel with the
members, unless links found before join their components already.  So no pair across components stays
unchecked, no link is lost, and a task makes fewer rows than it has components.

Sets are told apart by two 64-bit sums of their hashed shingles and verified on 48 bits of each shingle:
right but for collisions of these hashes, which no part of the text can steer.

Null or empty text: an empty set, linked with nothing.  Fewer words than `width`: the whole sequence is one
shingle.  Every row is a row of the result, repeated rows and rows without doc_id too; the latter take part
in links, and component_id is null where no document of the component has an id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packets
from .common import cut, doc_chunks, ints, only_rows, shuffle_buckets, strings
from .graph import components
from .words import Words, mix, windows

U = np.uint64
SMALL = 6
_BLOCK, _BLOCK_BYTES = 2048, 32 << 20
_SPARE = 1.2
_LOW48 = U((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted by document and hash, and the document of each."""
    w = Words(data, offsets, fold=True)
    counts = np.diff(w.first)
    hashed, whole = windows(w.hash, w.first, width)
    of = np.repeat(np.arange(len(counts)), counts)
    hashed, of = hashed[whole], of[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        once = []
        for d in short:
            acc = U(counts[d])
            for h in w.hash[w.first[d] : w.first[d + 1]]:
                acc = mix(np.array([acc ^ h], U))[0]
            once.append(acc)
        hashed, of = np.concatenate([hashed, np.array(once, U)]), np.concatenate([of, short])
    order = np.lexsort((hashed, of))
    hashed, of = hashed[order], of[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])
    return hashed[new], of[new]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum modulo 2^64 of each document's values."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _prints(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(mix(sets ^ U(0x5851F42D4C957F2D)), first), _sums(mix(sets ^ U(0x14057B7EF767814F)), first)


def _sketch(values: np.ndarray) -> bytes:
    """Parities of hashed shingles: two bits or more for each shingle, a power of two in all, 512 at least."""
    size = max(512, 2 << (len(values) - 1).bit_length()) if len(values) else 512
    return np.packbits(np.bincount((values & U(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _chunk_sets(batch: pa.RecordBatch, width: int):
    data, offsets = strings(batch.column("text"))
    for i, j in doc_chunks(offsets):
        sets, of = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        yield i, j, sets, np.searchsorted(of, np.arange(j - i + 1))


_DESCRIBED = "doc_id long, raw long, rid long, n long, one long, two long, sketch binary"


def _describe(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, first in _chunk_sets(batch, width):
                one, two = _prints(sets, first)
                sketches = [_sketch(sets[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                own = (batch.column(c).slice(i, j - i) for c in ("doc_id", "raw", "rid"))
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sketches, pa.binary())], ["doc_id", "raw", "rid", "n", "one", "two", "sketch"])

    return run


def signatures(sets: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the documents of a chunk, and the document of each."""
    sizes = np.diff(first)
    found, owners = [], []
    band = np.where(sizes > 0, np.frexp(np.maximum(sizes, 1).astype(np.float64))[1] - 1, -1)
    for step in (0, 1):
        instance = band + step
        top = (1 << np.maximum(instance + 1, 0).astype(np.int64)) - 1
        partner = np.minimum(sizes * 100 // percent, top)
        use = (band >= 0) & ((step == 0) | (partner > top // 2))
        k = (sizes + partner) * (100 - percent) // (100 + percent)
        docs = np.flatnonzero(use & (k > 0))  # no difference allowed: equal sets only, and those are one
        if not len(docs):
            continue
        parts = np.ceil(_SPARE * (2 * top[docs] * (100 - percent) // (100 + percent) + 1)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(parts)])
        at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        owner = np.repeat(np.arange(len(docs)), sizes[docs])
        element = mix(sets[at] + U(0x9E3779B97F4A7C15))
        part = base[owner] + (element >> U(33)).astype(np.int64) % parts[owner]
        order = np.argsort(part, kind="stable")
        filled, begin, count = np.unique(part[order], return_index=True, return_counts=True)
        content = np.zeros(base[-1], U)
        content[filled] = np.add.reduceat(mix(element ^ U(0xD1342543DE82EF95))[order], begin)
        number = np.zeros(base[-1], np.int64)
        number[filled] = count
        whose = np.repeat(np.arange(len(docs)), parts)
        index = np.arange(base[-1]) - base[whose]
        ranked = np.lexsort((index, content, number, whose))[::-1]  # documents from last to first, highest part first
        place = np.arange(base[-1]) - (base[-1] - base[1:])[whose[ranked]]
        signed = ranked[place <= k[docs][whose[ranked]]]
        where = mix((index[signed] + (instance[docs][whose[signed]].astype(np.int64) << 40)).astype(U) + U(1))
        found.append(mix(content[signed] ^ where))
        owners.append(docs[whose[signed]])
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _signature_packets(width: int, percent: int, buckets: int):
    """(signature, first sum of the set) of each distinct set of a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, keys, names = set(), [], []
            for _, _, sets, first in _chunk_sets(batch, width):
                one, two = _prints(sets, first)
                fresh = np.zeros(len(first) - 1, bool)
                for d, p in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    if p not in seen:
                        seen.add(p)
                        fresh[d] = True
                key, owner = signatures(sets, first, percent)
                keep = fresh[owner]
                keys.append(key[keep])
                names.append(one.view(np.int64)[owner[keep]])
            if keys:
                key, name = np.concatenate(keys), np.concatenate(names)
                order = np.argsort(key, kind="stable")
                yield from packets.split(buckets, key[order], name[order], np.zeros(len(key), np.int32))

    return run


def group_pairs(key: np.ndarray, doc: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs out of groups of equal keys, and which entries (sorted by key and doc) belong to large groups."""
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    size = np.diff(np.concatenate([begin, [len(key)]]))
    group = np.cumsum(first) - 1
    large = size[group] > small
    a, b = [doc[begin[group[large]]]], [doc[large]]
    many = np.flatnonzero(large)  # in each large group a cycle in an order that all groups share
    many = many[np.lexsort((mix(doc[many].view(U)), group[many]))]
    a.append(doc[many[:-1]][group[many[1:]] == group[many[:-1]]])
    b.append(doc[many[1:]][group[many[1:]] == group[many[:-1]]])
    few = np.flatnonzero(~large)
    for step in range(1, small):
        i = few[few + step < len(key)]
        i = i[group[i + step] == group[i]]
        a.append(doc[i])
        b.append(doc[i + step])
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b], large


def _candidate_packets(buckets: int, small: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, _, doc, _) in packets.gathered(batches):
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            a, b, large = group_pairs(key, doc, small)
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                at = (mix(mix(pair[0].astype(U)) ^ pair[1].astype(U)) >> U(33)).astype(np.int64) % buckets
                order = np.argsort(at, kind="stable")
                yield from packets.of_sorted(at[order], packets.ASK, [pair[1][order].astype(U), None, pair[0][order], np.zeros(len(order), np.int32)])
            if large.any():
                yield from packets.split(buckets, key[large], doc[large], np.zeros(int(large.sum()), np.int32), kind=packets.KNOWN)

    return run


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kind, (key, _, doc, _) in packets.gathered(batches):
        pair = np.stack([doc, key.view(np.int64)])
        if kind == packets.ASK:
            pair = np.unique(pair, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(pair.shape[1], kind, np.int32)), pa.array(pair[0].copy()), pa.array(pair[1].copy())], ["kind", "a", "b"])


_PAIR = "x long, y long, a long, ra long, b long, rb long, cx long, cy long"
_PAIR_NAMES = [c.split()[0] for c in _PAIR.split(", ")]


def _plausible(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                x, y, m = int.from_bytes(sa, "little"), int.from_bytes(sb, "little"), 8 * min(len(sa), len(sb))
                x, y = (x ^ x >> m) & ((1 << m) - 1), (y ^ y >> m) & ((1 << m) - 1)  # sizes within a factor of two: one fold at most
                keep.append((x ^ y).bit_count() * (100 + percent) <= (na + nb) * (100 - percent))
            yield batch.select(_PAIR_NAMES).filter(pa.array(keep, pa.bool_()))

    return run


def _marks(size: int):
    """Words of a bitmap of `size` bits with a bit for each row name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.concatenate([mix(ints(batch, c).astype(U)) for c in ("ra", "rb")]) & U(size - 1))
            if len(bit):
                begin = np.flatnonzero(np.diff(bit >> U(6), prepend=U(size)))
                words = np.bitwise_or.reduceat(U(1) << (bit & U(63)), begin)
                yield pa.RecordBatch.from_arrays([pa.array((bit[begin] >> U(6)).astype(np.int64)), pa.array(words.view(np.int64))], ["word", "bits"])

    return run


def name_bitmap(pairs: DataFrame, most_bits: int = 1 << 26) -> np.ndarray:
    """A bitmap of the hashed row names of pairs: 32 bits a pair, most_bits at most.

    It only spares work: what it lets through besides is dropped by the joins, at any size."""
    size = 1 << min(most_bits.bit_length() - 1, max(16, (32 * pairs.count()).bit_length()))
    found = pairs.mapInArrow(_marks(size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(size // 64, U)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U)
    return bitmap


def _sets(width: int, bitmap):
    """Shingle sets, as 6 bytes a shingle, of the rows whose names are in a broadcast bitmap; a task sends a row once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            bit = mix(ints(batch, "rid").astype(U)) & U(64 * len(bitmap.value) - 1)
            batch = batch.filter(pa.array((bitmap.value[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1))
            rids = ints(batch, "rid").tolist()
            for i, _, sets, first in _chunk_sets(batch, width):
                names, rows, packed = _prints(sets, first)[0].view(np.int64).tolist(), [], []
                for d, name in enumerate(names):
                    if (rids[i + d], name) not in seen and first[d] < first[d + 1]:
                        seen.add((rids[i + d], name))
                        rows.append(d)
                        low = np.unique(sets[first[d] : first[d + 1]] & _LOW48)
                        packed.append(low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([rids[i + d] for d in rows], pa.int64()), pa.array([names[d] for d in rows], pa.int64()), pa.array(packed, pa.binary())], ["rid", "one", "shingles"])

    return run


def _read(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _links(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = np.concatenate([one, two])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _verify(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, one = [], None, None
            for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                if a != last:
                    last, one = a, _read(a)
                keep.append(_links(one, _read(b), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _components(documents: DataFrame, width: int, percent: int, small: int) -> DataFrame:
    """doc_id, raw (hash of the text), n, component (a number, null for empty sets) and component_id of every row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("raw", F.xxhash64("text")).withColumn("rid", F.coalesce("doc_id", "raw"))
    buckets = shuffle_buckets(spark)
    described = cut(docs.mapInArrow(_describe(width), _DESCRIBED))
    groups = described.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("low"), F.min("rid").alias("rid"), F.max("sketch").alias("sketch"))
    groups = cut(groups.withColumn("node", F.monotonically_increasing_id()))
    found = docs.select("text").mapInArrow(_signature_packets(width, percent, buckets), packets.PACKET).repartitionById(buckets, "bucket")
    found = cut(found.mapInArrow(_candidate_packets(buckets, small), packets.PACKET).repartitionById(buckets, "bucket").mapInArrow(_unpack, "kind int, a long, b long"))

    def sets_of(named: DataFrame):
        """rid, one, shingles of the rows that named (ra, rb) asks for, and the bitmap, to be destroyed after use."""
        bitmap = spark.sparkContext.broadcast(name_bitmap(named))
        return docs.select("rid", "text").mapInArrow(_sets(width, bitmap), "rid long, one long, shingles binary"), bitmap

    def verified(likely: DataFrame) -> DataFrame:
        """(a, b) of the pairs that link: numbers of nodes or, for cx and cy, of their components."""
        sets, bitmap = sets_of(likely)
        both = likely.join(sets.toDF("rb", "b", "right"), ["rb", "b"]).join(sets.toDF("ra", "a", "left"), ["ra", "a"])
        linked = cut(both.select(F.col("cx").alias("a"), F.col("cy").alias("b"), "left", "right").mapInArrow(_verify(percent), "a long, b long"))
        bitmap.destroy()
        return linked

    side = lambda name, node, rid, n, sketch: groups.select(F.col("one").alias(name), F.col("node").alias(node), F.col("rid").alias(rid), F.col("n").alias(n), F.col("sketch").alias(sketch))
    pairs = found.where("kind = 0").select("a", "b").join(side("a", "x", "ra", "na", "sa"), "a").join(side("b", "y", "rb", "nb", "sb"), "b")
    pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").withColumns({"cx": F.col("x"), "cy": F.col("y")})
    labels = components(verified(cut(pairs.mapInArrow(_plausible(percent), _PAIR))))
    placed = groups.select("node", "n", "one", "two", "low").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    entries = found.where("kind = 1").select(F.col("a").alias("one"), F.col("b").alias("key"))
    if not entries.isEmpty():
        placed = cut(placed)
        mixed = _mixed(entries.join(placed.select("one", "node", "component"), "one"))
        if not mixed.isEmpty():
            mixed = _merged(mixed)
            members = cut(mixed.select("node").distinct().join(groups.select("node", "n", "one", "rid"), "node"))
            sets, bitmap = sets_of(members.select(F.col("rid").alias("ra"), F.col("rid").alias("rb")))
            # a row name and a set may come from several rows of the input; one is enough
            members = members.join(sets, ["rid", "one"]).dropDuplicates(["node"]).select("node", "n", "shingles")
            more = cut(_blocks(mixed.join(members, "node")).mapInArrow(_across(percent), "a long, b long").distinct())
            bitmap.destroy()
            if not more.isEmpty():
                joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("root"))
                placed = placed.join(joined, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")
    placed = cut(placed)
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    # abs() keeps n and hides the partitioning, so both sides of the join are exchanged and a hot group can be split
    named = placed.join(lowest, "component").select(F.abs("n").alias("n"), "one", "two", "component", "component_id")
    rows = described.select("doc_id", "raw", "n", "one", "two").join(named, ["n", "one", "two"], "left")
    return rows.select("doc_id", "raw", "n", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similarity_components(documents: DataFrame, width: int = 5, percent: int = 80, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    return _components(documents, width, percent, small).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _mixed(entries: DataFrame) -> DataFrame:
    """key, node, component, first (the group's least node), size (of the group), main (its first member's component), for groups of several components."""
    keys = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most"), F.min_by("component", "one").alias("main"), F.min("node").alias("first")).where("least < most")
    # inverted keys hide the partitioning, so both sides of the join are exchanged and a large group can be split
    return cut(entries.join(keys.select(F.bitwise_not("key").alias("__key"), "size", "main", "first"), F.bitwise_not("key") == F.col("__key")).drop("__key", "one"))


def _merged(mixed: DataFrame) -> DataFrame:
    """key, node, component, size, main: groups that share members as one, where that is no more to compare.

    Sets that are alike share most of their signatures, so the same members stand in very many groups.  A merged group
    holds each of them once, and every pair that one of its groups holds; it replaces them if the square of its size is
    not above the sum of theirs."""
    # one edge for each node, and one for each two groups' first nodes: not one for each member of each group
    held = mixed.select("node", "first", F.min("first").over(Window.partitionBy("node")).alias("least"))  # a set's signatures
    edges = held.select(F.col("node").alias("a"), F.col("least").alias("b")).union(held.select(F.col("first").alias("a"), F.col("least").alias("b"))).distinct()
    labels = cut(components(edges))
    keyed = mixed.select("key", "size", "first").distinct().join(labels.select(F.col("node").alias("first"), F.col("component").alias("union")), "first")
    keyed = cut(keyed.select("key", "union", F.col("size").cast("double").alias("size")))
    apart = keyed.groupBy("union").agg(F.sum(F.col("size") * F.col("size")).alias("apart"))
    chosen = labels.groupBy(F.col("component").alias("union")).agg(F.count("*").alias("size")).join(apart, "union")
    chosen = cut(chosen.where(F.col("size").cast("double") * F.col("size") <= F.col("apart")).select("union", "size"))
    nodes = labels.select("node", F.col("component").alias("union")).join(chosen, "union")
    nodes = nodes.join(mixed.select("node", "component").distinct(), "node")
    main = nodes.groupBy("union", "component").agg(F.count("*").alias("n")).groupBy("union").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    whole = nodes.join(main, "union").select(F.col("union").alias("key"), "node", "component", "size", "main")
    left = keyed.join(chosen, "union", "left_anti").select("key")
    return cut(whole.unionByName(mixed.join(left, "key").select("key", "node", "component", "size", "main")))


def _blocks(mixed: DataFrame) -> DataFrame:
    """Members dealt to pairs of blocks (one, two) of their group, sorted by group and pair.

    Blocks of the main component meet only the others; the others meet all.  A block holds _BLOCK members, fewer where
    their sets would take more than _BLOCK_BYTES, but not under 64."""
    rest = F.col("component") != F.col("main")
    sides = mixed.groupBy("key").agg(F.sum(F.when(rest, 1).otherwise(0)).alias("others"), F.max("n").alias("longest"))
    sides = sides.select(F.bitwise_not("key").alias("__key"), "others", F.greatest(F.lit(64), F.least(F.lit(_BLOCK), F.lit(_BLOCK_BYTES // 6) / F.col("longest"))).alias("held"))
    m = mixed.join(sides, F.bitwise_not("key") == F.col("__key")).drop("__key")
    n_rest = F.ceil(F.col("others") / F.col("held")).cast("int")
    n_main = F.ceil((F.col("size") - F.col("others")) / F.col("held")).cast("int")
    own = F.when(rest, F.pmod(F.xxhash64("node"), n_rest)).otherwise(n_rest + F.pmod(F.xxhash64("node"), n_main)).cast("int")
    meets = F.sequence(F.lit(0), F.when(rest, n_rest + n_main).otherwise(n_rest) - 1)
    dealt = m.withColumn("own", own).withColumn("other", F.explode(meets)).withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    return dealt.select("key", "one", "two", "own", "node", "component", "n", "shingles").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")


def _across(percent: int):
    """Links between components (a, b) that join all components which a link of a pair of blocks joins.

    Pairs whose components are joined by links found before, in this or an earlier group of the task, are passed over."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}
        apart_: set[tuple[int, int]] = set()  # only saves repetitions

        def root(c: int) -> int:
            while (up := joined.get(c, c)) != c:
                joined[c] = joined.get(up, up)
                c = up
            return c

        for rows in runs(batches, ("key", "one", "two")):
            node, n, own, component = (rows.column(c).to_numpy() for c in ("node", "n", "own", "component"))
            part = np.array([root(c) for c in component.tolist()], np.int64)
            sets = [_read(x) for x in rows.column("shingles").to_pylist()]
            size = min(max(512, 2 << (len(x) - 1).bit_length()) for x in sets)
            bits = np.stack([np.packbits(np.bincount((x & U(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").view(U) for x in sets])
            left, right = np.flatnonzero(own == rows.column("one")[0].as_py()), np.flatnonzero(own == rows.column("two")[0].as_py())
            found: list[tuple[int, int]] = []
            for i in range(0, len(left), 64):
                x = left[i : i + 64]
                apart = np.zeros((len(x), len(right)), np.int64)
                for j in range(size // 64):
                    apart += np.bitwise_count(bits[x, j][:, None] ^ bits[right, j][None, :])
                total = n[x][:, None] + n[right][None, :]
                close = (apart * (100 + percent) <= total * (100 - percent)) & (part[x][:, None] != part[right][None, :])
                close &= 100 * np.minimum(n[x][:, None], n[right][None, :]) >= percent * np.maximum(n[x][:, None], n[right][None, :])
                for a, b in zip(*(side.tolist() for side in np.nonzero(close)), strict=True):
                    a, b = x[a], right[b]
                    if part[a] == part[b]:
                        continue
                    pair = (int(min(node[a], node[b])), int(max(node[a], node[b])))
                    if pair in apart_:
                        continue
                    if _links(sets[a], sets[b], percent):
                        low, high = sorted((int(part[a]), int(part[b])))
                        found.append((low, high))
                        joined[high] = low
                        part[part == high] = low
                    elif len(apart_) < 1_000_000:
                        apart_.add(pair)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], ["a", "b"])

    return run


def runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys out of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in keys], axis=1)
        begins = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            key = tuple(columns[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows and columns; of each component one row stays, of those with the smallest doc_id.

    Rows without a word are linked with nothing, so all of them stay; of rows that repeat doc_id and text one does."""
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")
    first = _components(documents, width, percent, SMALL).where("n > 0").groupBy("component").agg(F.min(row).alias("row"))
    return only_rows(documents.where(worded), first.select("row.doc_id", "row.raw")).union(documents.where(~worded))
