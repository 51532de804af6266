import zlib

import numpy as np
from terrafold.llm.common import table
from terrafold.llm.quality import RANK, SIZE, features, fit, fit_quality, held_out, keep_good, quality_scores, raw_scores


def test_linear_time_sum_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = (0.3, rng.normal(size=SIZE).astype(np.float32), rng.normal(size=(SIZE, RANK)).astype(np.float32))
    i, x = features("a few words, and some more words!! | x")
    z, _ = raw_scores(model, i, x, np.array([0, len(i)]))
    b, w, v = model
    want = b + (w[i] * x).sum() + sum(float(v[i[p]] @ v[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
    assert abs(z[0] - want) < 1e-3


def test_query_equals_the_sum_over_all_pairs(spark, make, edge):
    rows = edge[:9] + [(100 + k, f"word{k % 5} and more text of number {k}" + "!! ##" * (k % 2)) for k in range(60)]
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    b, w, v = fit_quality(make(rows), labels)
    want = []
    for d, t in rows:
        i, x = (a.astype(np.float64) if a.dtype != np.int32 else a for a in features(t or ""))
        z = b + sum(float(w[p]) * y for p, y in zip(i, x))
        z += sum(float(v[i[p]].astype(np.float64) @ v[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
        want.append((d, 1 / (1 + np.exp(-z))))
    got = sorted((r.doc_id, r.score) for r in quality_scores(make(rows), labels).collect())
    assert all(a[0] == c[0] and abs(a[1] - c[1]) < 1e-4 for a, c in zip(got, sorted(want)))


def test_rows_of_one_id_give_one_model(spark, make):
    rows = [(k, f"text {k} of kind {k % 2}") for k in range(40)] + [(k, f"other text of {k} {'x' * k}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    a, c = (fit_quality(make(r), labels) for r in (rows, rows[::-1]))
    assert a[0] == c[0] and np.array_equal(a[1], c[1]) and np.array_equal(a[2], c[2])


def test_held_out_accuracy_and_threshold(spark):
    d, lab = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = quality_scores(d, lab).collect()
    assert len(rows) == d.count()
    truth = {r.doc_id: r.quality for r in lab.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for _, p, y in held]) > 0.93
    good, bad = ([s for s, _, y in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_held_out_labels_are_not_learned(spark, make):
    texts = [(k, f"word{k % 7} and more text of document {k}" + "!! ##" * (k % 2)) for k in range(200)]
    label = lambda flip: spark.createDataFrame([(k, (k + (flip and zlib.crc32(str(k).encode()) % 5 == 0)) % 2, 0) for k, _ in texts], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, quality_scores(make(texts), label(f)).collect())) for f in (0, 1))
    assert a == b


def test_edges(spark, make, edge):
    labels = spark.createDataFrame([(6, 1, 0), (10, 0, 0), (10, 0, 0), (None, 1, 0), (4, None, 0), (12, 1, 1), (24, 5, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(make(edge), labels).collect()
    assert len(rows) == len(edge) and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1  # null and empty
    assert quality_scores(make([]), labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {round(r.score, 6) for r in quality_scores(make(edge), none).collect()} == {0.5}
    kept = keep_good(make(edge), none)
    assert kept.columns == make([]).columns and kept.count() == len(edge)
    assert held_out is not None and fit([], np.empty(0, np.float32))[0] == 0
