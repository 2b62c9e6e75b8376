"""URL filters by redirect equivalence, with DataFrame functions only.

A url is judged by the longest rule (host and path) that fits it.  A url that no rule fits takes the decision of
its aliases: urls are nodes, redirects and canonical links are edges, and a distributed connected-components job
(smallest label around a node, then that label's label, until nothing changes) finds which urls name one page.
A block by rule of any member reaches every member without a rule of its own; a url that a rule allows stays
allowed, whatever its aliases are.  Targets that are no pages themselves are judged by the rules as well.

Edges come from a page's html (`<link rel="canonical">`, `<meta http-equiv="refresh">`, outside comments, scripts
and styles; relative references are resolved against the page's url) and, if given, from a table of redirects.
Two urls are one node if host (A-Z lower-cased), path and query agree; scheme and fragment do not count, an empty
path counts as "/", "." and ".." in a target's path are resolved.  A target without a host or with another kind of
scheme (mailto:, javascript:) gives no edge.

Nodes get long integers once, in a checkpoint, so rounds move pairs of longs and hashes never decide.  A hub with
very many aliases is one row beside its edges; labels merge before the exchange.  Pages that a rule decides, and
pages without a host, are dealt by a number of their own, so no hot key forms in the last join.

Null url, or one without "://" or a host: host (and, without "://", path) are empty, no rule fits, no alias is known,
the verdict is allow.  Null html has no links.  Null ids stay; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Verdict, host and path of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINKING = r"(?i)canonical|refresh"
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
LINK_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
ATTRIBUTE = r"""(?is)[\s"'/]{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)^[\s0-9.]*[;,]?\s*(?:url\s*=)?\s*["']?([^"']*)"""


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """df with host, path, query and node of a url column.

    host: from the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the
    end; both empty for null or without "://".  node: the name under which urls are one, null without a host.
    Parts are columns of their own, so no expression holds another one many times."""
    rest, at = F.col("__rest"), F.locate("://", F.col(url))
    df = df.withColumn("__rest", F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")))
    df = df.withColumns({"host": lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)}).drop("__rest")
    return df.withColumn("node", node_name())


def node_name() -> Column:
    return F.when(F.col("host") != "", F.concat("host", F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")), "query"))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.  Rules are a short list held in code."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def page_links(pages: DataFrame) -> DataFrame:
    """url, target: canonical links and redirects that pages state, as written (references &amp; decoded)."""
    read = pages.where(F.col("html").rlike(LINKING)).select("url", F.regexp_replace("html", UNREAD, "").alias("html"))
    tags = read.select("url", F.explode(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0))).alias("tag"))
    tags = tags.select("url", *(_attribute(name).alias(name) for name in ("rel", "href", "http-equiv", "content")))
    canonical = F.array_contains(F.split(F.lower(F.trim("rel")), r"\s+"), "canonical")
    refresh = F.lower(F.trim("http-equiv")) == "refresh"
    target = F.when(canonical, F.col("href")).when(refresh, F.regexp_extract("content", REFRESH, 1))
    return tags.select("url", F.replace(F.trim(target), F.lit("&amp;"), F.lit("&")).alias("target"))


def _attribute(name: str) -> Column:
    return F.concat(*(F.regexp_extract("tag", ATTRIBUTE.format(name), i) for i in (1, 2, 3)))


def edges(links: DataFrame) -> DataFrame:
    """a, b: the nodes of links (url, target); targets are resolved against their url."""
    links = with_parts(links, "url").withColumnsRenamed({"node": "a"}).withColumn("bare", F.regexp_extract("target", "^[^#]*", 0))
    bare, host, path = F.col("bare"), F.col("host"), F.col("path")
    folder = F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), "^.*/", 0)
    whole = (
        F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), bare)
        .when(bare.startswith("//"), F.concat(F.lit("http:"), bare))
        .when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(bare.startswith("/"), F.concat(F.lit("http://"), host, bare))
        .when(bare.startswith("?"), F.concat(F.lit("http://"), host, path, bare))
        .when(bare != "", F.concat(F.lit("http://"), host, folder, bare))
    )
    targets = with_parts(links.select("a", whole.alias("whole")), "whole").withColumn("path", _without_dots(F.col("path")))
    pair = F.array(F.struct("a", node_name().alias("b")))
    # a generator, not a filter: the optimizer would write a filter's expressions out down to the scan
    return targets.select(F.inline(F.filter(pair, lambda e: e["a"] != e["b"])))


def _without_dots(path: Column) -> Column:
    """Path without "." and ".." segments."""
    segments = F.split(path, "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))))
    ends = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.array_join(kept, "/"), ends)).otherwise(path)


def aliases(links: DataFrame) -> DataFrame:
    """node, component of every url that links(a, b; not equal) of node names joins with another one.

    A component's number is the smallest of its nodes'.  Every round halves paths at least, so rounds grow with the
    logarithm of the longest chain of redirects; each is cut by a checkpoint."""
    links = cut(links.distinct())
    nodes = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
    one, two = nodes.select(F.col("node").alias("a"), F.col("id").alias("x")), nodes.select(F.col("node").alias("b"), F.col("id").alias("y"))
    pairs = links.join(one, "a").join(two, "b").select(F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))))
    around = cut(pairs.unionByName(nodes.select(F.col("id").alias("x"), F.col("id").alias("y"))).distinct())
    labels = cut(around.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("component")))
    while not around.isEmpty():
        near = around.join(labels, around["y"] == labels["id"]).groupBy("x").agg(F.min("component").alias("low"), F.max(F.when(F.expr("x = y"), F.col("component"))).alias("before"))
        jumps = labels.select(F.col("id").alias("low"), F.col("component").alias("jump"))
        labels = cut(near.join(jumps, "low").select(F.col("x").alias("id"), F.col("jump").alias("component"), "before"))
        if labels.where("component < before").isEmpty():
            break
        labels = labels.drop("before")
    return nodes.join(labels, "id").select("node", "component")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; redirects: url, target (absolute or relative)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("url").cast("string").alias("url"), F.col("target").cast("string").alias("target")))
    members = aliases(edges(links)).withColumns({"host": F.regexp_extract("node", "^[^/]*", 0), "path": F.regexp_extract("node", "^[^/]*([^?]*)", 1)})
    members = cut(members.select("node", "component", fitting_rule(F.col("host"), F.col("path"), rules)[1].alias("verdict")))
    blocked = members.where("verdict = 'block'").select("component").distinct()
    taken = members.where("verdict is null").join(blocked, "component", "left_semi").select(F.concat(F.lit("n"), F.col("node")).alias("key"), F.lit(True).alias("blocked"))
    return _with_aliases(pages, taken, rules)


def _with_aliases(pages: DataFrame, taken: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = with_parts(pages.select("page_id", "url"), "url")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    alone = F.concat(F.lit(" "), F.monotonically_increasing_id())  # so that pages that need no alias are dealt evenly
    rows = rows.withColumn("key", F.coalesce(F.when(F.col("verdict").isNull(), F.concat(F.lit("n"), F.col("node"))), alone))
    alias = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(taken, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", alias).alias("verdict"))
