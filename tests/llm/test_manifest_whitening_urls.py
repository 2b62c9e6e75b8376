"""URL filters, whitening and manifests against plain versions on awkward small tables."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from gridlake.llm import merkle, url_filter, whitening
from gridlake.llm.oracles import MANIFEST, URL_FILTER
from tests.llm.helpers import FOLD, documents, texts

# op11


def link(href, rel="canonical"):
    return f"<html><head><LINK data-rel='x' rel='{rel}' href=\"{href}\"></head><body>x</body></html>"


PAGES = [
    (1, "https://a.example.org/x", link("https://b.example.com/en/7")),  # alias of a blocked url
    (2, "http://A.example.org/x#top", None),  # the same node as 1
    (3, "https://www.example.com/en/9", link("https://b.example.com/en/7")),  # allowed by rule, stays so
    (4, "https://c.example.org/a/b", link("../../x")),  # its own /x, clean
    (5, "https://a.example.org/deep/er/y", link("../../x")),  # resolves to 1
    (6, "https://d.example.org/", '<meta http-equiv="Refresh" content="0; URL=\'//e.example.net/fr/1?q=1&amp;r=2#f\'">'),
    (7, "https://e.example.net/fr/1?q=1&r=2", ""),
    (8, "https://f.example.org", link("https://d.example.org")),  # chain to 6
    (9, "https://g.example.org/1", "<!-- " + link("https://b.example.com/en/7") + " --><script>'" + link("https://b.example.com/en/7") + "'</script>"),
    (10, "https://h.example.org/1", link("mailto:x@b.example.com") + link("") + link("#x") + link("https://h.example.org/1")),
    (11, None, link("https://b.example.com/en/7")),
    (12, "no scheme", link("/x")),
    (13, "https:///only/path", ""),
    (14, "HTTPS://Sub.Example.COM/en/", ""),
    (15, "https://example.com/e", ""),
    (16, "https://x.net/es/?a://b", ""),
    (17, "https://notexample.org?u=/fr/", link("?p=2")),
    (18, "https://notexample.org/?p=2", link("http://x.net/es/1")),
    (None, "https://a.example.org/x", ""),
    (1, "https://a.example.org/x", link("https://b.example.com/en/7")),
    (19, "https://i.example.org/p", link("https://hub.example.org/h")),
    (20, "https://j.example.org/p", link("/en/2")),
] + [(100 + i, f"https://chain.example.org/{i}", link(f"/{i + 1}" if i < 20 else "https://z.net/fr/")) for i in range(21)]
BLOCKED = {1, 2, 5, 6, 7, 8, None, 14, 16, 17, 18} | set(range(100, 121)) - {14} | set()


def judged_plainly(pages):
    def parts(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(FOLD)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        query = re.match(r"[^?#]*(\?[^#]*)?", rest)[1] or ""
        return host, path, (host + (path or "/") + query) if host else None

    def rule(host, path):
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda f: len(f[0])) if fits else (None, None)

    return [(page, *parts(url)[:2], rule(*parts(url)[:2])[0], rule(*parts(url)[:2])[1]) for page, url, _ in pages]


def test_url_filter_cases(spark):
    pages = spark.createDataFrame([(*p, 1, "r") for p in PAGES], "page_id long, url string, html string, component int, rule string").repartition(3)
    found = url_filter.judged(pages).collect()
    assert len(found) == len(PAGES)
    plain = judged_plainly(PAGES)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in found) == sorted((str(p), h, a, str(r)) for p, h, a, r, _ in plain)
    own = {(str(p), h, a): v for p, h, a, _, v in plain}
    for r in found:
        wanted = own[str(r.page_id), r.host, r.path] or ("block" if r.page_id in BLOCKED else "allow")
        assert r.verdict == wanted, r
    blocked_by_alias = {r.page_id for r in found if r.verdict == "block" and r.rule is None}
    assert {1, 2, 5, 6, 8, None, 17, 18, 110} <= blocked_by_alias


def test_url_filter_sql(spark):
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [list(p) for p in PAGES])
    theirs = con.execute(URL_FILTER).fetchall()
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    mine = url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, mine))) == sorted(map(str, theirs))


def test_url_filter_redirect_table_and_empty(spark):
    pages = spark.createDataFrame([(1, "https://a.org/1", None), (2, "https://b.org/1", None)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("https://a.org/1", "/2"), ("https://a.org/2", "https://c.net/es/"), (None, "https://b.org/1")], "url string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judged(pages, redirects=redirects).collect()} == {1: "block", 2: "allow"}
    assert url_filter.judged(pages.limit(0)).collect() == []


# op12


def whitened_plainly(vectors, k=8):
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    centred = [[Fraction(a) - m for a, m in zip(row, mean, strict=True)] for row in x]
    d = len(mean)
    v = np.array([[float(sum(row[i] * row[j] for row in centred) / n) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x], np.array(centred, float) @ axes / np.sqrt(values), values / np.trace(v), v


def test_whitening_matches_exact_arithmetic(spark):
    rng = np.random.default_rng(0)
    good = (rng.normal(size=(70, 10)) @ rng.normal(size=(10, 10)) * 3 + 50).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), "w") for i, v in enumerate(good)] + [(900, None, "w"), (901, [1.0] * 9 + [float("nan")], "w"), (902, [None] + [1.0] * 9, "w"), (903, [float("inf")] * 10, "w")]
    rows += [(None, good[3].tolist(), "w"), (5, good[5].tolist(), "w")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(5)
    found = whitening.whiten(vectors).collect()
    used = [*good, good[3], good[5]]
    n, deviation, whitened, explained, _ = whitened_plainly(used)
    assert len(found) == 8 * n and {r.n for r in found} == {n}
    ids = [*range(70), None, 5]
    plain = sorted((str(i), k + 1, dev, round(abs(w[k]), 6)) for i, dev, w in zip(ids, deviation, whitened, strict=True) for k in range(8))
    assert sorted((str(r.vec_id), r.component, r.deviation, round(abs(r.whitened), 6)) for r in found) == plain
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-10 for r in found)


def test_whitening_of_nearly_flat_data_far_from_zero(spark):
    """Variances of one part in 10^10 of the largest are found, although entries are 100,000 and more."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 6)) * [3e6, 1e5, 40, 30, 20, 10]) / 1024
    found = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>").repartition(40)).collect()
    assert len(found) == 400 * 6 and found[0].identity_error < 1e-6
    *_, v = whitened_plainly(x.tolist(), 6)
    values = np.sort(np.linalg.eigvalsh(v / 1.0))[::-1]
    share = {r.component: r.explained for r in found}
    assert all(abs(share[k + 1] * np.trace(v) / values[k] - 1) < 1e-3 for k in range(6))


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, []), (4, [1e300, -1e300])], schema)).collect()
    assert len(ragged) == 8 and all(r.n == 4 for r in ragged)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], schema)).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True} and flat[0].identity_error < 1e-12


def test_products_are_exact():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(37, 3)) * [1e12, 1.0, 1e-9]
    high, low = whitening.product((a, a * 1e-17), (a, a * 1e-17))
    for i in range(3):
        for j in range(3):
            exact = sum((Fraction(x[i]) + Fraction(x[i] * 1e-17)) * (Fraction(x[j]) + Fraction(x[j] * 1e-17)) for x in a.tolist())
            size = sum(abs(Fraction(x[i]) * Fraction(x[j])) for x in a.tolist())
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) < size / 2**85


# op13


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_plainly(rows, fanout=16):
    def climb(level):
        """The top of a list of nodes, and for each of them the siblings (before, after) of every level."""
        paths = [[] for _ in level]
        members = [[i] for i in range(len(level))]
        while len(level) > 1:
            above, joined = [], []
            for k in range(0, len(level), fanout):
                run = level[k : k + fanout]
                for p in range(len(run)):
                    for leaf in members[k + p]:
                        paths[leaf].append(("".join(run[:p]), "".join(run[p + 1 :])))
                above.append(h(*run))
                joined.append([leaf for m in members[k : k + fanout] for leaf in m])
            level, members = above, joined
        return level[0], paths

    leaf = lambda r, text: h(*(field(v) for v in (r[0], r[1], r[2], r[3], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, below = [], {}
    for s in order:
        held = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        top, paths = climb([leaf(r, r[4]) for r in held])
        tops.append(top)
        below[s] = list(zip(held, paths, strict=True))
    root, top_paths = climb(tops)
    out = []
    for s, sub, upper in zip(order, tops, top_paths, strict=True):
        for r, path in below[s]:
            acc = leaf(r, r[4].translate(FOLD) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None else r[4])
            for b, a in path + upper:
                acc = h(b, acc, a)
            out.append((str(r[0]), leaf(r, r[4]), sub, root, h(*(b + a for b, a in path + upper)), acc, acc == root))
    return sorted(out)


def rows_of(n, sources):
    values = texts()
    return [(None if i % 41 == 40 else (i * 7919) % 100_003 - 500, sources[i % len(sources)], None if i % 13 == 0 else "en", i if i % 7 else None, values[i % len(values)]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 17, 400])
def test_manifest_matches_plain_version(spark, n):
    rows = rows_of(n, ["src1", None, "src10", "src1", "", "Ünï", "src1", "a much longer name of a source", "a much longer name of"])
    rows += rows[: n // 3]  # repeated rows
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, size int").repartition(3)
    found = merkle.verified_manifest(df).collect()
    mine = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found)
    assert mine == manifest_plainly(rows)


def test_manifest_of_deep_tries_and_its_sql(spark):
    """A fanout of 2 needs four rounds of three levels; the SQL agrees at 16."""
    rows = rows_of(700, ["s"]) + [(5, "s", None, None, f"t{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    found = merkle.verified_manifest(df, 2).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found) == manifest_plainly(rows, 2)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [list(r) for r in rows])
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    theirs = con.execute(MANIFEST).fetchdf()[names]
    assert len(theirs) == len(rows) and theirs["root"].nunique() == 1
    mine = merkle.verified_manifest(df).select(names).toPandas()
    as_text = lambda t: sorted((r.leaf, r.proof_sha256, r.folded_root, bool(r.verified)) for r in t.itertuples())
    assert as_text(mine) == as_text(theirs)


def test_manifest_of_nothing_and_of_documents(spark):
    assert merkle.verified_manifest(documents(spark, [])).collect() == []
    df = documents(spark)
    found = merkle.verified_manifest(df).collect()
    plain = manifest_plainly([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()])
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found) == plain


def test_ranks_over_the_whole_range_of_longs(spark):
    values = [-(2**63), 2**63 - 1, 0, None, 5, 5, -1, 2**40, 2**40 + 1, None]
    rows = spark.createDataFrame([("g", v, i) for i, v in enumerate(values)], "g string, v long, tag long")
    found = {r.tag: r.rank for r in merkle.group_ranks(rows, ["g"], ["v", "tag"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert found == {i: k for k, i in enumerate(order)}
