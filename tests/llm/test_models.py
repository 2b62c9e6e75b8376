import collections
import math
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridlake.llm import gru, html_text, lm_score, packing, piece_fst, queries, toxicity

from .helpers import FOLD, as_dict, documents, texts, words

VALUES = texts()


# toxicity


def toxic_corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "rotten", "nasty", "grubbing", "grubber"]
    values, marks = [], []
    for i in range(n):
        own = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        mark = int(i % 4 == 0)
        if mark:
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(bad)
        values.append(" ".join(own))
        marks.append(mark)
    return values, marks


def test_toxicity_is_right_on_held_out_rows(spark):
    values, marks = toxic_corpus()
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(values)] + [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (None, values[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, terms string, toxic string, counts int").repartition(4)
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [i for i in range(len(values)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(len(values)))
    assert np.mean([got[i].predicted == marks[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[9000].score == got[9001].score < 0.5 and not got[None].held_out
    assert got[0].evidence and got[0].evidence[0].similarity >= got[0].evidence[-1].similarity
    assert all(e.doc_id != i for i, r in got.items() for e in r.evidence)
    learned = {e.doc_id for r in got.values() for e in r.evidence}
    assert not learned & set(held)
    other = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0")).collect()}
    assert all(abs(other[i] - got[i].score) < 1e-12 for i in other)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity_scores(documents(spark), none).collect()} == {(0.0, 0)}
    assert toxicity.toxicity_scores(documents(spark).limit(0), none).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        v = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, v / np.linalg.norm(v)))
    ids = rng.permutation(5000)[:500].tolist()
    index = toxicity.BlockMaxIndex(vectors, ids, [i % 2 for i in ids], 40, block=16)
    dense = np.zeros((500, 40))
    for i, (t, v) in enumerate(vectors):
        dense[i, t] = v
    queries = np.arange(0, 500, 7)
    similar, rank = index.nearest(dense[queries], 10, own=queries)
    for q, s, r in zip(queries, similar, rank):
        sims = np.round(dense @ dense[q], 12)
        order = [i for i in np.lexsort((ids, -sims)) if sims[i] > 0 and i != q][:10]
        assert index.ids[r[s > 0]].tolist() == [ids[i] for i in order]
        assert np.allclose(s[s > 0], sims[order]) and (index.labels[r[s > 0]] == index.ids[r[s > 0]] % 2).all()


# html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Logo</a><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav></header>
<div class="cookie-banner"><p>We use cookies to improve our site and to show you better adverts.</p></div>
<article><h1>A &amp; B</h1><p><b>First   <i>par</i>agraph.<br><p>Second &lt;one&gt; with <a href=x>a link</a>
and a new line.</p><!-- <p>hidden</p> --><div class="ad-slot">Buy this now, it is a wonderful thing to have.</div>
<ul><li>alpha<li>beta</ul><form><label>Mail</label><input name=m><button>Send</button></form>
<div id="comments"><p>I liked this article a lot, thank you for writing it all down.</p></div></article>
<aside><h2>Related</h2><p>Something else entirely that is long enough to look like text.</p></aside>
<footer><p>&copy; 2020 Someone</p></footer>"""


def test_html_text_of_awkward_pages(spark):
    pages = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>Just a plain text without any article element around it.", "x"), (5, "u", "a < b & c &#233;", "x"), (6, "u", "<article>" + "<p>word</p>" * 5000, "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    rows = html_text.extract_text(df).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == ["A & B\nFirst paragraph.\nSecond <one> with a link and a new line.\nalpha\nbeta"] * 2
    assert got[2] == got[3] == [""]
    assert got[None] == ["Just a plain text without any article element around it."]
    assert got[5] == ["a < b & c é"]
    assert got[6] == ["\n".join(["word"] * 5000)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_decision_tree_fits_its_table():
    rows, labels = html_text.labelled_rows(html_text.LABELLED)
    tree = html_text.DecisionTree(rows, labels)
    assert (tree.predict(rows) == (labels == 1)).mean() > 0.96


def bare(page):
    """A page without the names that tell what its parts are."""
    page = re.sub(r"<(/?)(article|nav|footer|aside|header|main)\b", r"<\1div", page)
    return re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_counts_and_densities_decide_where_nothing_is_named():
    rng = random.Random(14)
    draw = lambda n: " ".join(rng.choice(["alpha", "beta", "of", "gamma", "in"]) for _ in range(n)) + "."
    tree, right, shared, either = html_text.DecisionTree(*html_text.labelled_rows(html_text.LABELLED)), 0, 0, 0
    for _ in range(60):
        menu = "".join(f'<li><a href="/{i}">{draw(1)}</a></li>' for i in range(rng.randint(4, 9)))
        body = "".join(f"<p>{draw(rng.randint(12, 90))}</p>" for _ in range(rng.randint(3, 12)))
        page = f'<nav><ul>{menu}</ul></nav><div class="ad">{draw(rng.randint(6, 9))}</div><article><h1>{draw(7)}</h1>{body}</article><footer>&copy; {draw(rng.randint(5, 10))}</footer>'
        want = [f.text for f in html_text.blocks(page) if f.main]
        assert html_text.page_text(page, tree).split("\n") == want
        got = html_text.page_text(bare(page), tree).split("\n")
        right += got == want
        shared, either = shared + len(set(got) & set(want)), either + len(set(got) | set(want))
    assert right > 0.6 * 60 and shared > 0.93 * either


def test_blocks_of_every_length_and_link_density_stay_in_an_article():
    rng, tree = random.Random(3), html_text.DecisionTree(*html_text.labelled_rows(html_text.LABELLED))
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "of", "gamma"]) for _ in range(n))
    for _ in range(100):
        body = []
        for _ in range(rng.randint(1, 14)):
            n = rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90])
            linked = rng.choice([0, 0, 0, 1, n // 2, n])
            tag = rng.choice(["p", "p", "li", "h2", "td", "blockquote"])
            body.append(f"<{tag}>" + (f"<a href=x>{words(linked)}</a> " if linked else "") + f"{words(n - linked)}</{tag}>")
        side = "".join(f"<p>{words(rng.choice([3, 9, 30, 80]))}</p>" for _ in range(rng.randint(0, 4)))
        page = f"<nav><a href=/>{words(2)}</a></nav><article><h1>{words(5)}</h1>{''.join(body)}</article><aside>{side}</aside><footer>{side}<p>{words(6)}</p></footer>"
        assert html_text.page_text(page, tree).split("\n") == [b.text for b in html_text.blocks(page) if b.main]


def test_names_do_not_overrule_articles():
    tree, body = html_text.DecisionTree(*html_text.labelled_rows(html_text.LABELLED)), "word " * 60
    kept = "word " * 59 + "word"
    for page in (
        f'<article class="post has-sidebar share-enabled"><p>{body}</p></article>',
        f'<article class="story related-topics"><p>{body}</p></article>',
        f'<main><div class="legal notice-body"><p>{body}</p></div></main>',
        f"<script>var s='<!--';</script><article><p>{body}</p></article>",
        f"<style>a::after{{content:'<!--'}}</style><article><p>{body}</p></article>",
        f'<nav class="nav"><a href=x>home</a></nav><article id="content-with-ads"><h1>Some title of it</h1><p>{body}</p></article>',
    ):
        assert kept in html_text.page_text(page, tree) and "<" not in html_text.page_text(page, tree)
    notes = html_text.page_text(f'<article><p>{body}</p><div class="newsletter"><p>Sign up here</p></div><div class="comments"><p>{body}</p></div><p>{body}</p></article>', tree)
    assert notes == kept + "\n" + kept
    assert [b.text for b in html_text.blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds")] == ["so x=1 holds"]


@pytest.mark.parametrize("page", ["<b x " * 60_000, '<b x="' * 60_001 + ">", '<b x=">" ' * 40_000 + "'", "<b x " * 60_000 + "'>", "<div>w " * 60_000, "<div>" * 60_000 + "</x>" * 60_000, "<head>" * 60_000, "<script>" * 20_000, "<p>" * 60_000 + "</div>" * 60_000, "<!-- " * 60_000, "<" * 200_000 + ">"])
def test_html_is_read_in_linear_time(page):
    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 5


def test_html_with_unclosed_tags_and_quotes():
    read = lambda page: [b.text for b in html_text.blocks(page)]
    assert read('<p title="a > b">one</p><p>two <b class=x') == ["one", "two <b class=x"]
    assert read('<p>one</p><p title="two>three</p><p>four</p>') == ["one", "three", "four"]
    assert read("a < b <!-- x <p>y") == ["a < b"]
    assert read("<script>x<p>y</p>") == []


# pieces


def test_piece_encoding_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_fst.model_path(None))
    rng = random.Random(8)
    values = VALUES + ["".join(rng.choice("abcdeinorstuw  \n\t éñü中🙂Ж019.,-ThE\x00") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    docs = as_dict(values)
    encoded = piece_fst.encode_pieces(documents(spark, values))
    for r in encoded.collect():
        expected = model.encode(docs[r.doc_id] or "")
        assert r.ids == expected and r.n_ids == len(expected) and r.round_trip
        assert r.ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes())
    assert {r.doc_id: r.text for r in piece_fst.decode_pieces(encoded).collect()} == {i: t or "" for i, t in docs.items()}
    assert piece_fst.encode_pieces(documents(spark).limit(0)).count() == 0


def test_piece_query_returns_the_ids(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_fst.model_path(None))
    docs = as_dict(VALUES[:30])
    documents(spark, VALUES[:30]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_piece_encoding(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: model.encode(t or "") for i, t in docs.items()}


def test_unigram_shortest_path_is_the_best_split():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab"]
    scores = [0.0, -3.0, -2.0, -2.1, -2.2, -2.5, -3.9, -6.6, -3.1, -4.0]
    fst = piece_fst.PieceTransducer(pieces, scores, ["unknown"] + ["normal"] * 9, merges=False)

    def best(text):
        table = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            table[end] = min((table[s][0] - scores[i], [*table[s][1], i]) for s in range(end) if s in table and (i := fst.ids.get(text[s:end])) is not None)
        return table[len(text)][1]

    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert fst.encode(text) == best("▁" + text)
    assert fst.encode("az") == [fst.ids["▁a"], 0]


# packing


def test_packing_covers_every_id_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    values = VALUES + ["<|endoftext|> x", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "<|endof text|>", " " * 400_000 + "end", "a\x1cb c", "中文 " * 900]
    docs = as_dict(values)
    rows = packing.pack_documents(documents(spark, values)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in docs.items():
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack_documents(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_both_ways_to_ids_agree_on_all_documents(sf):
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    library, encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), packing.encoder()
    for text in pq.read_table(path, columns=["text"]).column("text").to_pylist():
        assert encode(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_best_fill_is_the_best_subset():
    rng = random.Random(10)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room, sums = rng.randint(1, 60), {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        chosen = packing.best_fill(counts, room)
        assert all(k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("capacity", [8, 64])
def test_pack_items_loses_nothing(capacity):
    rng = random.Random(11)
    for _ in range(100):
        lengths = [rng.randint(0, capacity - 1) for _ in range(rng.randint(0, 60))]
        held = collections.Counter()
        for sequence in packing.pack_items(lengths, capacity):
            total = sum(n for _, _, n in sequence)
            assert total == capacity or total & (total - 1) == 0
            for item, start, n in sequence:
                held.update((item, p) for p in range(start, start + n))
        assert held == collections.Counter((i, p) for i, n in enumerate(lengths) for p in range(n))


# language model


def test_gru_gradients_match_differences():
    rng = np.random.default_rng(3)
    model = gru.Gru(np.array([5.0, 3, 8, 2, 1, 4]), hidden=4, per_class=3)
    for n in ("inputs", "u", "bias", "class_w", "class_b", "word_w", "word_b"):
        setattr(model, n, getattr(model, n).astype(np.float64) * 3 + 0.05)
    tokens, targets = rng.integers(0, 6, (5, 3)), rng.integers(0, 6, (5, 3))
    h = rng.standard_normal((3, 4)) * 0.3
    _, g, _ = model.gradients(tokens, targets, h)
    for name in ("inputs", "u", "bias", "class_w", "class_b", "word_w", "word_b"):
        values = getattr(model, name)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in values.shape)
            old = values[at]
            values[at] = old + 1e-4
            up = model.gradients(tokens, targets, h)[0]
            values[at] = old - 1e-4
            down = model.gradients(tokens, targets, h)[0]
            values[at] = old
            assert abs((up - down) / 2e-4 - g[name][at]) < 1e-4


def test_gru_gradients_match_differences_in_classes_of_every_size():
    rng = np.random.default_rng(8)
    model = gru.Gru(1000.0 / np.arange(1, 101), hidden=4, per_class=8)
    assert model.sizes.tolist() == [1, 3, 4, *[8] * 7, *[16] * 3]  # the more frequent, the smaller
    for n in ("inputs", "u", "bias", "class_w", "class_b", "word_w", "word_b"):
        setattr(model, n, getattr(model, n).astype(np.float64) * 3 + 0.05)
    tokens, targets = rng.integers(0, 100, (9, 30)), rng.integers(0, 100, (9, 30))
    _, g, _ = model.gradients(tokens, targets, rng.standard_normal((30, 4)) * 0)
    for name, at in [*(("word_w", (c, 2, int(model.sizes[c]) - 1)) for c in range(len(model.sizes))), *(("word_b", (c, 0)) for c in range(len(model.sizes))), ("class_w", (1, 2)), ("class_b", (12,)), ("inputs", (int(tokens[3, 3]), 5)), ("u", (3, 7)), ("bias", (9,))]:
        values = getattr(model, name)
        old, found = values[at], []
        for step in (1e-4, -1e-4):
            values[at] = old + step
            found.append(model.gradients(tokens, targets, np.zeros((30, 4)))[0])
        values[at] = old
        assert abs((found[0] - found[1]) / 2e-4 - g[name][at]) < 1e-6, name


def test_gru_class_sizes_make_one_distribution():
    model = gru.Gru(1000.0 / np.arange(1, 101), hidden=4, per_class=8)
    model.class_b[:], model.word_b[:] = -70, 3  # far-off logits too
    states = np.random.default_rng(9).uniform(-1, 1, (3, 4)).astype(np.float32)
    every = np.arange(int(model.sizes.sum()))
    for state in states:
        assert abs(np.exp(model.log_probs(np.tile(state, (len(every), 1)), every, part=32).astype(np.float64)).sum() - 1) < 1e-5


def test_gru_windows_ask_for_little_memory(monkeypatch):
    grown, gradients = [], gru.Gru.gradients

    def traced(self, tokens, targets, h):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        found = gradients(self, tokens, targets, h)
        grown.append(tracemalloc.get_traced_memory()[1] - before)
        return found

    monkeypatch.setattr(gru.Gru, "gradients", traced)
    stream = np.random.default_rng(5).integers(0, 4096, 6 * 2048 + 1).astype(np.int32)
    tracemalloc.start()
    gru.Gru(1e6 / np.arange(1, 4097), hidden=24).train(stream, least_updates=6)
    tracemalloc.stop()
    assert len(grown) == 6 and max(grown[1:]) < 2.5e6  # all of a window's arrays: 8 MB


def test_gru_scores_do_not_depend_on_windows_or_groups():
    rng = np.random.default_rng(4)
    model = gru.Gru(np.arange(1, 30.0), hidden=8, per_class=6)
    docs = [np.append(rng.integers(2, 29, n), 0).astype(np.int32) for n in (0, 1, 3, 70, 200, 5)]
    full = model.score(docs)
    assert np.allclose(full, model.score(docs, group=2, steps=7), atol=1e-3)
    assert np.allclose(full, [model.score([d])[0] for d in docs], atol=1e-3)
    total = sum(10 ** model.score([np.array([t], np.int32)])[0] for t in range(29))
    assert 0.9 < total <= 1.0001


def test_gru_scores_one_long_document_beside_short_ones():
    rng = np.random.default_rng(6)
    model = gru.Gru(np.arange(1, 30.0), hidden=4, per_class=6)
    docs = [np.array([0], np.int32)] * 1023 + [np.append(rng.integers(2, 29, 200_000), 0).astype(np.int32)]
    tracemalloc.start()
    scores = model.score(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(scores).all() and most < 100e6
    assert np.allclose(scores[:1023], scores[0])


def test_averages_of_many_trainers(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "_FAN", 2)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5}") for i in range(60)], "rid long, text string")
    hashes, _ = lm_score._batch_words(pa.RecordBatch.from_pydict({"text": [f"w{i}" for i in range(7)]}))
    vocabulary = lm_score._Vocabulary(hashes, np.array([60.0, 0] + [10.0] * 7))
    network = lm_score.train_network(docs, vocabulary, hidden=4, train_share=1, trainer_bytes=100)
    assert np.isfinite(network.flat()).all() and network.flat().std() > 0


@pytest.mark.parametrize("length", [1, 2, 40, 2000, 2047, 9001])
def test_gru_training_reads_every_token_once(length, monkeypatch):
    seen, gradients = collections.Counter(), gru.Gru.gradients

    def counted(self, tokens, targets, h):
        seen.update(zip(tokens.ravel().tolist(), targets.ravel().tolist()))
        return gradients(self, tokens, targets, h)

    monkeypatch.setattr(gru.Gru, "gradients", counted)
    stream = np.random.default_rng(5).integers(0, 29, length).astype(np.int32)
    gru.Gru(np.arange(1, 30.0), hidden=4, per_class=6).train(stream)
    assert seen == collections.Counter(zip(stream[:-1].tolist(), stream[1:].tolist()))


def test_every_training_document_reaches_the_network(spark):
    values = [f"w{i} w{i}" for i in range(64)]
    hashes, _ = lm_score._batch_words(pa.RecordBatch.from_pydict({"text": values}))
    vocabulary = lm_score._Vocabulary(hashes[::2], np.array([64.0, 0] + [2.0] * 64))
    docs = spark.createDataFrame(list(enumerate(values)), "rid long, text string")
    inputs = lm_score.train_network(docs, vocabulary, hidden=4, train_share=8, trainer_bytes=70).inputs
    start = gru.Gru(vocabulary.counts, 4).inputs
    assert (inputs != start).any(axis=1)[vocabulary.numbers(hashes[::2])].all()


def test_vocabulary_numbers_of_hashes_with_equal_upper_bits():
    rng = np.random.default_rng(2)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 64, 300, np.uint64), (np.uint64(0xFFFF) << np.uint64(48)) + rng.integers(0, 1 << 40, 20, np.uint64), rng.integers(0, 9, 5, np.uint64)]))
    rng.shuffle(hashes)
    vocabulary = lm_score._Vocabulary(hashes[:200], np.ones(202))
    number = {h: i + 2 for i, h in enumerate(hashes[:200].tolist())}
    assert vocabulary.numbers(hashes).tolist() == [number.get(h, gru.UNKNOWN) for h in hashes.tolist()]
    assert lm_score._Vocabulary(hashes[:0], np.ones(2)).numbers(hashes[:2]).tolist() == [gru.UNKNOWN] * 2


def test_numbered_texts_are_words_and_ends(spark):
    values = ["a b  c", None, "", "c zz\na", "É a"]
    hashes, _ = lm_score._batch_words(pa.RecordBatch.from_pydict({"text": ["a", "b", "c"]}))
    shared = spark.sparkContext.broadcast(lm_score._Vocabulary(hashes, np.ones(5)))
    docs = spark.createDataFrame([(i, i, False, v) for i, v in enumerate(values)], "doc_id long, rid long, held_out boolean, text string")
    got = {r.doc_id: (r.size, np.frombuffer(r.numbers, np.uint16).tolist()) for r in lm_score._numbered(docs, shared).collect()}
    assert got == {0: (14, [2, 3, 4, 0]), 1: (8, [0]), 2: (8, [0]), 3: (14 - 2 + 0, [4, 1, 2, 0]), 4: (12, [1, 2, 0])} or got[3][0] == len("c zz\na") + 8
    assert [got[i][1] for i in range(5)] == [[2, 3, 4, 0], [0], [0], [4, 1, 2, 0], [1, 2, 0]]


def test_lm_scores_against_brute_force(spark):
    rng = random.Random(12)
    patterned = [" ".join("red green blue yellow".split()[(i + j) % 4] for j in range(rng.randint(5, 60))) for i in range(120)]
    values = VALUES + patterned
    docs = as_dict(values)
    got = {r.doc_id: r for r in lm_score.language_model_scores(documents(spark, values), vocabulary=64, hidden=8, train_share=2).collect()}
    tokens = {i: [*words((t or "").translate(FOLD)), None] for i, t in docs.items()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter(x for i in docs if i not in held for x in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    better = 0
    for i, own in tokens.items():
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in own)
        r = got[i]
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(own), sum(counts[x] > 0 for x in own), total)
        assert r.score < 0 and math.isfinite(r.score)
        better += i in held and r.score > r.base_score
    assert better > 0.7 * len(held)


def test_lm_scores_of_an_id_with_other_texts(spark):
    rows = [(i, f"common the word{i % 3} the common") for i in range(1, 9)] + [(40, "the rare words qx1 qx2 qx3"), (40, "zz9 zz9 zz9 common the the"), (None, "zz9 the"), (None, "qx1 the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 9)): r.n_known for r in lm_score.language_model_scores(df, vocabulary=4, hidden=4).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(x for i, t in rows if not held(i) for x in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    plain = {}
    for i, t in rows:
        own = [*t.split(), None]
        plain[i, len(own), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own), 9)] = sum(counts[x] > 0 for x in own)
    assert got == plain


def test_lm_scores_of_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a"), (None, "x"), (3, None)], "doc_id long, text string")
    got = lm_score.language_model_scores(rows).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3]
    assert {(r.held_out, r.n_tokens, r.n_known) for r in got if r.doc_id is None} == {(False, 2, 2)}
    assert len({(r.base_score, r.score, r.n_known) for r in got if r.doc_id == 1}) == 1
    assert lm_score.language_model_scores(rows.limit(0)).count() == 0
