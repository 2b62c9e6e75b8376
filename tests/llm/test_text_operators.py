import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridlake.llm import exact_dedup, graph, ngram_join, quality, secrets, substring_dedup
from gridlake.llm import words as w
from gridlake.llm.common import strings

from .helpers import FOLD, as_dict, documents, texts, words

VALUES = texts()


def test_words_match_the_pattern(monkeypatch):
    monkeypatch.setattr(w, "_SEGMENT", 64)
    w._powers.clear()
    data, offsets = strings(pa.array(VALUES))
    found = w.Words(data, offsets)
    expected = [x for t in VALUES for x in words(t)]
    assert [bytes(data[a:b]).decode() for a, b in zip(found.start, found.end)] == expected
    assert np.diff(found.first).tolist() == [len(words(t)) for t in VALUES]
    assert len({(h, x) for h, x in zip(found.hash.tolist(), expected)}) == len(set(expected)) == len(set(found.hash.tolist()))
    w._powers.clear()


def test_difference_cover_reaches_every_pair():
    p = substring_dedup.PERIOD
    for i in range(p):
        for j in range(p):
            assert any((i + d) % p in substring_dedup.COVER and (j + d) % p in substring_dedup.COVER for d in range(p))


def test_substring_dedup_against_brute_force(spark):
    docs = as_dict(VALUES)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark), with_text=True).collect()}
    seen, removed = set(), 0
    assert set(got) == set(docs)
    for i in sorted(docs):
        own = words(docs[i])
        gone = [False] * len(own)
        for p in range(len(own) - 19):
            key = tuple(own[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(own, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert got[i].text == kept
        removed += sum(gone)
    assert removed > 500


def test_substring_dedup_of_repeated_rows_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(rows).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30)]
    assert substring_dedup.remove_repeats(rows.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_exact_dedup_against_grouping(spark, block):
    docs = {i: (t or "").translate(FOLD) for i, t in as_dict(VALUES).items()}
    groups = collections.defaultdict(list)
    for i, t in docs.items():
        groups[t].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(documents(spark), block_bytes=block).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        keep = max(groups[t])
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(groups[t]), keep == i, hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_of_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "A"), (None, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(rows).collect())
    assert got == {(1, 2, 4, False): 2, (1, 1, 1, True): 1, (2, 2, 4, True): 1, (None, 2, 4, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1}
    assert exact_dedup.exact_groups(rows.limit(0)).count() == 0
    kept = exact_dedup.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert kept.count() == len({(t or "").translate(FOLD) for t in VALUES})


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    same = spark.createDataFrame([(1, "Same text"), (1, "Same text"), (1, "same text")], "doc_id long, text string")
    assert exact_dedup.keep_one(same).count() == 1
    mixed = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (9, "b", 3), (None, "A", 4), (None, "c", 5), (None, "c", 6), (0, "c ", 7)], "doc_id long, text string, __raw int")
    kept = exact_dedup.keep_one(mixed)
    assert kept.columns == mixed.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "c"), (-1, "c "), (5, "a"), (9, "b")]
    groups = collections.Counter((r.keep_id, r.kept) for r in exact_dedup.exact_groups(mixed).collect())
    assert sum(n for (_, kept), n in groups.items() if kept) == 4


def shingles(text):
    own = words((text or "").translate(FOLD))
    return frozenset(tuple(own[p : p + 5]) for p in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def brute_components(docs, percent=80):
    sets, up = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in docs}


def family(seed, copies, edits, length=140):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 4000)}" for _ in range(length)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("small", [2, 6])
def test_ngram_join_against_brute_force(spark, small):
    values = VALUES + family(1, 40, 6) + family(2, 25, 3, 12) + family(3, 15, 12, 600) + family(4, 10, 2, 6)
    docs = as_dict(values)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(documents(spark, values), small=small).collect()}
    assert got == brute_components(docs)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for size in [4, 5, 6, 7, 9, 15, 16, 31, 32, 50, 64, 127, 128, 300, 1000]:
        for _ in range(20):
            one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            two = one.copy()
            drop = rng.integers(0, max(1, size // 5) + 1)
            two = np.delete(two, rng.choice(len(two), min(drop, len(two) - 1), replace=False))
            more = rng.integers(0, max(1, size // 8) + 1)
            two = np.unique(np.concatenate([two, rng.integers(0, 2**63, more).astype(np.uint64)]))
            shared = len(np.intersect1d(one, two))
            linked = 100 * shared >= 80 * (len(one) + len(two) - shared)
            keys, owners = ngram_join.signatures(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]), 80)
            if linked and shared < max(len(one), len(two)):
                assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


def test_ngram_join_of_repeated_rows_and_empty_table(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "wv")
    rows = spark.createDataFrame([(5, text), (5, text), (9, text + " x"), (None, text), (7, ""), (None, None), (5, other), (6, other), (None, "alone")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(rows).collect())
    assert got == {(5, 26, 5): 4 - 1, (6, 26, 5): 1, (7, 0, 7): 1, (9, 27, 5): 1, (None, 26, 5): 1, (None, 0, None): 1, (None, 1, None): 1}
    assert ngram_join.similarity_components(rows.limit(0)).count() == 0
    kept = ngram_join.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, ""), (0, "alone"), (5, "v0 v1"), (5, "w0 w1"), (7, "")]


def test_a_block_of_linked_components_gives_no_more_rows_than_components():
    rng = np.random.default_rng(2)
    pack = lambda s: np.unique(s).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    base = rng.integers(0, 1 << 48, (2, 100), dtype=np.uint64)
    sets = [pack(np.concatenate([base[i % 2][:97], rng.integers(0, 1 << 48, 3, dtype=np.uint64)])) for i in range(60)]
    column = lambda v: pa.array(v, pa.int64())
    zero = column([0] * 60)
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, zero, column(range(60)), column(range(60)), column([100] * 60), pa.array(sets, pa.binary())], ["key", "one", "two", "own", "node", "component", "n", "shingles"])
    pairs = [p for b in ngram_join._across(80)(iter([batch])) for p in zip(*b.to_pydict().values(), strict=True)]
    assert len(pairs) == 58  # two groups of thirty, each joined by a tree
    roots = {i: i for i in range(60)}
    for a, b in pairs:
        roots = {i: roots[a] if r == roots[b] else r for i, r in roots.items()}
    assert len({roots[i] for i in range(0, 60, 2)}) == len({roots[i] for i in range(1, 60, 2)}) == 1 and roots[0] != roots[1]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(29, 500), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in [*range(1, 30), 500]}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    made, cut = [], graph.cut

    def counted(df):
        made.append(cut(df))
        assert len(made) <= 12, "a round for each few nodes"
        return made[-1]

    monkeypatch.setattr(graph, "cut", counted)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    edges = [*zip(ids[:-1], ids[1:], strict=True), *((1000, i) for i in range(1001, 1040)), *((2000, i) for i in range(1960, 1990)), (5, 5)]
    try:
        spark.conf.set(batch, "10")
        wanted = {**{i: 0 for i in ids}, **{i: 1000 for i in range(1000, 1040)}, **{i: 1960 for i in [*range(1960, 1990), 2000]}}
        for options in ({}, {"solo": 16}):
            made.clear()
            found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(6), **options)
            assert {r.node: r.component for r in found.collect()} == wanted
            assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64  # it does not multiply from round to round
    finally:
        spark.conf.set(batch, before)


def brute_rules(text):
    own, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    counts = collections.Counter(tuple(own[p : p + 8]) for p in range(len(own) - 7))
    covered = set()
    for p in range(len(own) - 7):
        if counts[tuple(own[p : p + 8])] > 1:
            covered.update(range(p, p + 8))
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randint(0, 300)) for _ in range(rng.randint(40, 120)))
    good, bad = [plain() + "." for _ in range(150)], [re.sub(r" ", "### ", plain()) for _ in range(60)]
    values = VALUES + good + bad
    docs = as_dict(values)
    ids = list(docs)
    labels = [(ids[len(VALUES) + i], int(i < 150), 0) for i in range(0, 210, 2)] + [(None, 1, 0), (ids[0], None, 0)]
    got = {r.doc_id: r for r in quality.quality_verdicts(documents(spark, values), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for i, t in docs.items():
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == brute_rules(t)
        assert not (got[i].kept and got[i].base_failed)
    tested = [ids[len(VALUES) + i] for i in range(1, 210, 2)]
    assert np.mean([got[i].kept for i in tested[:75]]) > 0.95
    assert np.mean([got[i].kept for i in tested[75:]]) < 0.1


def test_quality_is_fitted_on_every_labelled_row(spark):
    rng = np.random.default_rng(5)
    counts = rng.integers(20, 400, (25_000, len(quality.COUNTS)))
    good = rng.random(25_000) < 0.7
    counts[~good, 2] += 300
    counts[:, 4] = 0
    failed = counts[:, 0] < 30
    rows = [(bool(g), bool(f), *map(int, r)) for g, f, r in zip(good, failed, counts, strict=True)]
    labelled = spark.createDataFrame(rows, "good boolean, base_failed boolean, " + ", ".join(f"{c} long" for c in quality.COUNTS)).repartition(3)
    forest, most = quality._fit(labelled, 8, 0.9)
    values = quality.features(counts)
    whole = quality.IsolationForest((values.min(0), values.max(0)), int((good & ~failed).sum()), 8)
    whole.measure(whole.count(values[good & ~failed]))
    assert (forest.split == whole.split).all() and (forest.length == whole.length).all()
    kept = lambda c: np.mean(whole.score(values[good & ~failed]) <= c)
    caught = lambda c: np.mean(whole.score(values[~good & ~failed]) > c)
    gains = [caught(c) + kept(c) - 1 for c in np.linspace(0.2, 0.9, 300) if kept(c) >= 0.9]
    assert kept(most) >= 0.9 and caught(most) + kept(most) - 1 >= max(gains) - 1e-3


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_verdicts(documents(spark), none).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert quality.quality_verdicts(documents(spark).limit(0), none).count() == 0


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_secrets_against_brute_force(spark):
    rng = random.Random(4)
    pieces = ["password", "Secret", "api_key", "APIKEY", "tokEN", "ſecret", "=", ": ", '"', "'", " ", "é", "\n", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "hunter2-x", "中"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)] + VALUES
    values += ["key " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(40)) + " end", "a_very_long_snake_case_identifier_name here", "Donaudampfschifffahrtsgesellschaft", "2024-01-02/2024-03-04-2025"]
    docs = as_dict(values)
    got = {r.doc_id: r for r in secrets.scan_secrets(documents(spark, values)).collect()}
    for i, t in docs.items():
        base = brute_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in secrets.KINDS[:3])
        assert set(text.split(",")) - {""} <= set(got[i].spans.split(","))
    ids = list(docs)
    assert got[ids[-4]].n_entropy == 1 and not any(got[i].n_entropy for i in ids[-3:])
    assert secrets.scan_secrets(documents(spark).limit(0)).count() == 0


def test_window_entropy_from_incremental_counts():
    rng = random.Random(6)
    for _ in range(50):
        text = "".join(rng.choice("abcdef0123456789XYZ") for _ in range(rng.randint(2, 60)))
        width = min(20, len(text))
        for limit in (2.5, 3.2):
            hot = set()
            for p in range(len(text) - width + 1):
                share = np.array(list(collections.Counter(text[p : p + width]).values())) / width
                if -(share * np.log2(share)).sum() >= limit - 1e-9:
                    hot.update(range(p, p + width))
            got = set()
            for a, b in secrets.dense_windows(text, 20, limit):
                got.update(range(a, b))
            assert got == hot


def test_secret_scans_of_runs_and_rules_take_linear_time():
    rng = random.Random(15)
    values = [c * n + tail for c in "=A0-_/" for n in (1, 19, 20, 21, 22, 40, 1000) for tail in ("", "aBc9dEf", "b1")]
    values += ["-" * n + "aBc9dEf" for n in (10, 18, 40, 10_000, 200_000)] + ["-a" * 100_000 + "B9x", "aB" * 100_000, "Ab-" * 100_000 + "9a9"]
    values += ["".join(rng.choice("aBcD019-_=+/ ") for _ in range(rng.randint(0, 200))) for _ in range(2000)]
    began = time.process_time()
    for text in values:
        for a, b, kind in secrets.find_spans(text):
            assert 0 <= a < b <= len(text) and 0 <= kind < 4
    assert time.process_time() - began < 20
    loose = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,4})(?:[-_/=+]+(?:[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,4}))+")
    quick = re.compile(secrets.ALLOW[1])
    for _ in range(20_000):
        text = "".join(rng.choice("aBcD12-_=") for _ in range(rng.randint(0, 10)))
        assert bool(loose.fullmatch(text)) == bool(quick.fullmatch(text))


def test_redaction_keeps_rows_and_columns(spark):
    values = ['x password = "hunter22" y', "clean text", None, "0123456789abcdef0123456789abcdef"]
    docs = documents(spark, values)
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns
    texts_, lengths = ({i: getattr(r, c) for i, r in got.items()} for c in ("text", "n_chars"))
    ids = list(as_dict(values))
    assert [texts_[i] for i in ids] == ['x [SECRET]" y', "clean text", None, "[SECRET]"]
    assert [lengths[i] for i in ids] == [13, 10, None, 8]
