"""Merkle manifest of a dataset: a radix-ranked trie of document digests, with proofs and their verification.

Ranks.  A leaf's place among its source's leaves is found without a sort of the source: doc_ids are counted by
digits of 8 bits, the lowest level by the whole id, each higher level from the one below.  From the top down, a
prefix starts where its parent starts plus what its smaller siblings hold, so each window sees 256 siblings at
most.  Rows that share a doc_id are ranked in the same way by the leaf's first 60 bits, then by a number of their
own, so an id that a third of all rows carry is dealt like any other.  Sources are ranked by six bytes at a time.

Trie.  The rank's digits to the base `fanout` are a node's key.  Three digits at a time are reduced: the rows that
share the rest of the key, fanout^3 at most, meet in one row, whose arrays give three levels of nodes.  What is left
is reduced in the same way, until each source has one node, its subroot, and then the subroots have one, the root.

Proofs.  From the root down each node hands its children the siblings on the way up, split into those before and
those after; only runs of `fanout` leaves carry them through an exchange.  A proof is folded with the own (perhaps
altered) leaf and compared with the root.

Null source: a source of its own, the first.  Null doc_id: before all others.  Null text, lang, n_chars: "-".  Rows
that share a doc_id stand in the order of their leaves; equal rows get places side by side, in any order.  Empty
table: empty result.  Very long texts are hashed as they are.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGIT = 8  # bits of a histogram's digit
CHUNK = 6  # bytes of a source's name that make one number


def digest(fields: Sequence[Column]) -> Column:
    """sha256 (hex) of fields, each "-" for null, else its length in bytes, ":" and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def _starts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, start (rows of the group with a smaller value), same (rows with this one), total (rows of the group)."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    levels = [rows.groupBy(*by, F.col(value).alias("p0")).agg(F.count("*").alias("n"))]
    while low is not None and (high >> DIGIT * (len(levels) - 1)) - (low >> DIGIT * (len(levels) - 1)) >= 1 << DIGIT:
        k = len(levels)
        levels.append(levels[-1].groupBy(*by, F.shiftright(f"p{k - 1}", DIGIT).alias(f"p{k}")).agg(F.sum("n").alias("n")))
    top, k = Window.partitionBy(*by), len(levels) - 1
    out = levels[k].withColumns({"start": _before(top.orderBy(f"p{k}")), "total": F.sum("n").over(top)})
    for k in reversed(range(k)):
        above = out.select(*(F.col(b).alias(f"__{b}") for b in by), F.col(f"p{k + 1}").alias("up"), F.col("start").alias("base"), "total")
        here = levels[k].withColumn(f"p{k + 1}", F.shiftright(f"p{k}", DIGIT))
        on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by] + [F.col(f"p{k + 1}").eqNullSafe(F.col("up"))]
        joined = here.join(above, reduce(lambda x, y: x & y, on))
        out = joined.withColumn("start", F.col("base") + _before(Window.partitionBy(*by, f"p{k + 1}").orderBy(f"p{k}"))).select(*by, f"p{k}", "n", "start", "total")
    return out.select(*by, F.col("p0").alias(value), "start", F.col("n").alias("same"), "total")


def _before(window) -> Column:
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def group_ranks(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """rows with rank (from 0) in their group by longs, nulls first, and total (rows of the group).

    Later values are counted only among rows that tie in all earlier ones; rows that tie in all share a rank."""
    keys, done, columns = list(by), [], rows.columns
    left = rows.withColumns({"rank": F.lit(0).cast("long"), "total": F.lit(None).cast("long")})
    for i, value in enumerate(values):
        starts = _starts(left, keys, value).withColumnsRenamed({k: f"__{k}" for k in [*keys, value]} | {"total": "__total"})
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, value]])
        found = left.join(starts, on).select(*columns, (F.col("rank") + F.col("start")).alias("rank"), F.coalesce("total", "__total").alias("total"), "same")
        found, keys = cut(found), [*keys, value]
        left = found.where("same > 1").drop("same")
        if i + 1 == len(values) or left.isEmpty():
            return reduce(DataFrame.unionByName, [*done, found.drop("same")])
        done.append(found.where("same = 1").drop("same"))
    raise ValueError("no values to rank by")


def _hashed(nodes: Column, fanout: int) -> Column:
    """Nodes of the next level: the digest of every fanout neighbours."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256))


def _bundles(nodes: DataFrame, fanout: int) -> DataFrame:
    """skey, big, size, kids (node, digest), and digests d0 ... d3 of four levels, for every fanout^3 nodes.

    nodes: skey, idx, size (nodes of the source), digest, node (what to hand down with it)."""
    big = F.expr(f"idx div {fanout**3}").alias("big")
    held = nodes.groupBy("skey", big).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", "digest", "node"))).alias("kids"))
    held = held.withColumn("d0", F.transform("kids", lambda k: k["digest"]))  # an array of its own, not read anew for each run
    for k in range(3):
        held = held.withColumn(f"d{k + 1}", F.when(F.col("size") > fanout**k, _hashed(F.col(f"d{k}"), fanout)).otherwise(F.col(f"d{k}")))
    return held


def _step(digests: Column, place: Column, fanout: int, reached: Column) -> Column:
    """Siblings of a place before and after it, in an array; empty where the level is not reached."""
    at = F.pmod(place, F.lit(fanout)).cast("int")
    before = F.array_join(F.slice(digests, place - at + 1, at), "")
    after = F.array_join(F.slice(digests, place + 2, F.lit(fanout - 1) - at), "")
    step = F.array(F.struct(before.alias("before"), after.alias("after")))
    return F.when(reached, step).otherwise(F.slice(step, F.lit(1), F.lit(0)))


def _handed(bundles: DataFrame, above: DataFrame, fanout: int, keep: Sequence[str]) -> DataFrame:
    """skey, idx, digest, node, path and keep: the nodes of bundles with all siblings on the way to the root.

    above: skey, big, path, keep.  Runs are taken apart before leaves, so no row carries more than fanout of them."""
    joined = bundles.join(above, ["skey", "big"])
    steps = lambda j: F.concat(_step(F.col("d1"), j, fanout, F.col("size") > fanout), _step(F.col("d2"), F.floor(j / fanout).cast("int"), fanout, F.col("size") > fanout**2), F.col("path"))
    places = F.sequence(F.lit(0), F.floor((F.size("kids") - 1) / fanout).cast("int"))
    runs = F.transform(places, lambda j: F.struct(F.slice("kids", j * fanout + 1, F.lit(fanout)).alias("kids"), steps(j).alias("path")))
    runs = joined.select("skey", "size", *keep, F.explode(runs).alias("run"))
    kids = runs.select("skey", "size", *keep, F.col("run.path").alias("path"), F.col("run.kids.digest").alias("digests"), F.posexplode("run.kids").alias("place", "kid"))
    own = _step(F.col("digests"), F.col("place"), fanout, F.col("size") > 1)
    return kids.select("skey", *keep, F.col("kid.idx").alias("idx"), F.col("kid.digest").alias("digest"), F.col("kid.node").alias("node"), F.concat(own, "path").alias("path"))


def _reduced(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each round of three levels from the bottom up, and one node (skey, idx 0, digest) for each skey."""
    rounds = []
    while not rounds or nodes.where("size > 1").limit(1).count():
        rounds.append(nodes)
        size = F.ceil(F.col("size") / float(fanout**3)).cast("long")
        tops = _bundles(nodes, fanout).select("skey", F.col("big").alias("idx"), size.alias("size"), F.element_at("d3", 1).alias("digest"), F.struct("big").alias("node"))
        nodes = cut(tops)
    return rounds, nodes


def _paths(rounds: list[DataFrame], above: DataFrame, fanout: int, keep: Sequence[str]) -> DataFrame:
    """Leaves of the first round with paths; above: skey, big (0), path, keep of each skey."""
    for nodes in reversed(rounds):
        handed = _handed(_bundles(nodes, fanout), above, fanout, keep)
        above = handed.select("skey", F.col("idx").alias("big"), "path", *keep)
    return handed


def _source_chunk(j: int) -> Column:
    """Six bytes of a source as a long; bytes count from 1, so a shorter name stands before its continuations."""
    text = F.substring(F.hex(F.encode("source", "UTF-8")), 2 * CHUNK * j + 1, 2 * CHUNK)
    byte = lambda i: F.substring(text, 2 * i + 1, 2)
    total = sum((F.when(byte(i) != "", F.conv(byte(i), 16, 10).cast("long") + 1).otherwise(F.lit(0)) * F.lit(512 ** (CHUNK - 1 - i)) for i in range(CHUNK)), F.lit(0).cast("long"))
    return F.when(F.col("source").isNull(), F.lit(-1).cast("long")).otherwise(total)


def _ranked_sources(subroots: DataFrame) -> DataFrame:
    """source, skey, digest and rank of sources: null first, then by their bytes."""
    sources = subroots.withColumn("source", F.when(F.col("skey") != "", F.expr("substring(skey, 2)"))).withColumn("all", F.lit(0))
    longest = sources.agg(F.max(F.octet_length("source"))).first()[0] or 1
    chunks = {f"c{j}": _source_chunk(j) for j in range(-(-longest // CHUNK))}
    return group_ranks(sources.withColumns(chunks), ["all"], list(chunks))


def manifest(documents: DataFrame, fanout: int = 16, altered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path (siblings before and after, level by level), own.

    own is the digest to verify: altered (a Column over documents' FIELDS) where it is not null, else the leaf."""
    none = F.lit(None).cast("string")
    rows = documents.select(*FIELDS).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("skey"), digest([F.col(f) for f in FIELDS]).alias("leaf"), (none if altered is None else altered).alias("own"))
    rows = cut(rows.withColumn("tag", F.monotonically_increasing_id()))
    ranked = group_ranks(rows.withColumn("leaf60", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")), ["skey"], ["doc_id", "leaf60", "tag"])
    nodes = ranked.select("skey", F.col("rank").alias("idx"), F.col("total").alias("size"), F.col("leaf").alias("digest"), F.struct("doc_id", "own").alias("node"))
    rounds, subroots = _reduced(nodes, fanout)
    ranks = _ranked_sources(subroots.select("skey", "digest"))
    tops = ranks.select(F.lit("all").alias("skey"), F.col("rank").alias("idx"), F.col("total").alias("size"), "digest", F.struct(F.col("skey").alias("of")).alias("node"))
    top_rounds, root = _reduced(tops, fanout)
    start = F.array().cast("array<struct<before:string,after:string>>")
    above = root.select("skey", F.lit(0).cast("long").alias("big"), start.alias("path"), F.col("digest").alias("root"))
    sources = _paths(top_rounds, above, fanout, ["root"])
    sources = cut(sources.select(F.col("node.of").alias("skey"), F.lit(0).cast("long").alias("big"), "path", "root", F.col("digest").alias("subroot")))
    out = _paths(rounds, sources, fanout, ["root", "subroot"])
    source = F.when(F.col("skey") != "", F.expr("substring(skey, 2)"))
    return out.select(F.col("node.doc_id").alias("doc_id"), source.alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "path", F.coalesce("node.own", "digest").alias("own"))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def verified_manifest(documents: DataFrame, fanout: int = 16) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, where the texts of those whose
    id's crc32 is divisible by 5 are lower-cased after the manifest was made."""
    later = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    found = manifest(documents, fanout, F.when(crc_fold("doc_id", 5) == 0, digest(later)))
    found = found.withColumn("folded_root", folded(F.col("path"), F.col("own")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
