import collections
import zlib

from gridlake.llm import secrets

from .helpers import FOLD, documents, texts
from .test_models import toxic_corpus
from .test_text_operators import brute_components

import corpus_pipeline


def test_stages_against_plain_versions(spark, tmp_path):
    toxic, marks = toxic_corpus(240)
    values = texts() + ['password = "hunter22222" ok then']
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(values + toxic)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(len(values) + i, 1, m) for i, m in enumerate(marks)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "secret_scan", "packing"]
    held, stage = {r.doc_id: r.text for r in docs.collect()}, docs
    for name, run in corpus_pipeline.STAGES[:-1]:
        before, stage = held, run(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        rows = stage.collect()
        held = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(held)
        if name == "toxicity":
            gone = set(before) - set(held)
            truth = {len(values) + i for i, m in enumerate(marks) if m}
            assert len(gone & truth) > 0.9 * len(truth) and len(gone - truth) < 8
            assert set(range(len(values))) <= set(held)
        elif name == "exact_dedup":
            largest = collections.defaultdict(int)
            for i, t in before.items():
                key = (t or "").translate(FOLD)
                largest[key] = max(largest[key], i)
            assert set(held) == set(largest.values())
        elif name == "ngram_join":
            assert set(held) == {i for i, (_, c) in brute_components(before).items() if i == c}
        else:
            assert set(held) == set(before)
            assert [i for i in held if held[i] != before[i]] == [i for i, t in before.items() if secrets.find_spans(t or "")]
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        stage = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, stage, str(tmp_path)).collect()
    totals = collections.Counter()
    for r in pieces:
        totals[r.doc_id] += r.length
    assert totals == {r.doc_id: r.doc_tokens for r in pieces} and set(totals) == set(held)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert key(whole) == key(pieces)


def test_toxicity_stage_drops_rows_not_ids(spark, tmp_path):
    values, marks = toxic_corpus(300)
    bad, fine = values[0], values[1]
    rows = [(i, t, 1) for i, t in enumerate(values)] + [(7001, bad, 1), (7001, fine, 2), (None, bad, 3), (None, fine, 4), (None, fine, 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc int")
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    odd = [(r.doc_id, r.text) for r in kept.collect() if r.doc_id is None or r.doc_id > 7000]
    assert sorted(odd, key=str) == sorted([(7001, fine), (None, fine), (None, fine), (None, None)], key=str)
