import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from terrafold.llm import language_model
from terrafold.llm.decontaminate import align, word_hashes
from terrafold.llm.language_model import language_model_scores


def brute(rows, order):
    texts = [(t or "").lower().split() for _, t in rows]
    c = Counter(tuple(w[i : i + n]) for w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))
    out = []
    for (d, _), w in zip(rows, texts):
        s = 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or c[g] >= 2:
                    s += math.log(c[g] / (total if n == 1 else c[g[:-1]]))
                    break
                s += math.log(0.4)
        out.append((d or -1, len(w), s))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(make, edge, order, monkeypatch):
    monkeypatch.setattr(language_model, "PARTITION", 5000)
    got = sorted((r.doc_id or -1, r.n_words, r.score) for r in language_model_scores(make(edge), order).collect())
    want = brute(edge, order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-6 * max(1, abs(b[2])) for a, b in zip(got, want))
    assert language_model_scores(make([]), order).count() == 0


def test_equal_blocks_and_many_of_them(spark, make):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(1, "a b c a b c d"), (2, "x y"), (None, "")] * 5 + [(k, f"a b c w{k % 3}") for k in range(20)]
    got = sorted((r.doc_id or -1, r.n_words, r.score) for r in language_model_scores(make(rows).coalesce(1), 3).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute(rows, 3)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want))


def test_only_ascii_white_space_ends_words(make):
    texts = ["a~b c a~b", "c~d c~d e", "~ e", "a c e"]
    for space in "\u00a0\u3000\u2028\x1c\x1f":
        got = sorted((r.doc_id, r.n_words, r.score) for r in language_model_scores(make([(k + 1, t.replace("~", space)) for k, t in enumerate(texts)])).collect())
        want = brute(list(enumerate(texts, 1)), 2)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want))


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, seen, sf_dir)
        assert out.columns == columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in seen.select("doc_id").collect()} and kept
        seen = spark.createDataFrame(out.collect(), docs.schema)
    assert not seen.filter("text rlike 'AKIA[A-Z0-9]{14}'").count()
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in seen.collect() for b in bench)
    assert seen.select("text").distinct().count() == seen.count()
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in seen.collect()}
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def test_stages_on_edges(spark, make, edge, sf_dir):
    docs = make(edge)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]), sf_dir).count() == 0, name
    kept = sorted(r.doc_id or -1 for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect())
    gone = {7, 8, 9}  # 6 has the smallest id of its copies
    assert kept == sorted(d or -1 for d, _ in edge if d not in gone)


def test_jaccard_stage_equals_brute_force_on_the_table(spark, sf_dir):
    from tests.llm.test_jaccard import brute as components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).select("doc_id").collect())
    want = [d for d, _, c in components([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if d == c]
    assert kept == want and len(want) < docs.count()


def test_decontamination_stage_equals_aligning_all_pairs_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, sf_dir).select("doc_id").collect()}
    items = [h for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(h := word_hashes(r.text or ""))]
    gone = set()
    for r in docs.select("doc_id", "text").collect():
        words = word_hashes(r.text or "")
        # No alignment scores more than the item's words that the document has.
        near = [h for h in items if np.isin(h, words).sum() >= 0.4 * len(h)]
        if any(align(h, words)[0] >= 0.4 for h in near):
            gone.add(r.doc_id)
    assert gone and kept == {r.doc_id for r in docs.select("doc_id").collect()} - gone
