import random

import numpy as np
import pytest
from terrafold.llm import jaccard
from terrafold.llm.jaccard import components, gram_set, jaccard_join, may_link, signatures, sketch


def brute(rows, words, limit):
    """Sets of words' tuples themselves, all pairs."""
    import re

    sets, low = {}, {chr(c): chr(c + 32) for c in range(65, 91)}
    for i, (d, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(low.get(c, c) for c in t or ""))
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: rows[i][0] for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j])]
    by = {}
    for i in sets:
        by.setdefault(rows[i][0], []).append(i)
    links += [(x[0], y) for x in by.values() for y in x[1:] if sets[x[0]] and sets[y]]  # rows with one id are one node
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return sorted((rows[i][0], len(sets[i]), label[i]) for i in sets)


def families(n=6, copies=12, seed=2):
    """Texts with random edits of many strengths, so that links chain and some pairs fall just short."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("xyzrst")
    out, k = [], 1000
    for f in range(n):
        base = [word() for _ in range(30 + 60 * f)]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            out.append((k, " ".join(w)))
            k += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("words", "limit"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(make, edge, words, limit, monkeypatch):
    rows = [x for x in edge if x[0] is not None] + families()
    want = brute(rows, words, limit)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(make(rows), words, limit).collect())
    assert got == want


def test_large_groups_give_the_same_components(make, monkeypatch):
    rows = families(n=2, copies=40, seed=9)
    want = brute(rows, 3, 90)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "SETS", 7)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(make(rows), 3, 90).collect()) == want
    assert len({c for _, _, c in want}) > 2


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for limit in (80, 90):
        for n in [*range(1, 40), 100, 333, 1000, 5000]:
            a = np.unique(rng.integers(0, 2**63, n, np.uint64))
            drop = int(len(a) * (100 - limit) / 100 / 2)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - drop]], rng.integers(0, 2**63, drop, np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= limit * (len(a) + len(b) - same):
                assert len(np.intersect1d(signatures(a, limit), signatures(b, limit)))


@pytest.mark.parametrize("limit", [80, 90])
def test_sketches_of_linked_sets_pass(limit):
    sets = [gram_set(t, 3) for _, t in families(n=3, copies=15, seed=3)]
    rows = [(i, *x) for i, s in enumerate(sets) for x in sketch(s, limit)]
    i, c, n, equal, sizes = zip(*rows)
    found = may_link(np.array(i), np.array(n), np.array(i), np.array(c), equal, sizes, limit)
    pairs = {tuple(sorted((i[x], i[y]))) for x, y in found}
    links = set()
    for a in range(len(sets)):
        for b in range(a):
            m = len(np.intersect1d(sets[a], sets[b]))
            if 100 * m >= limit * (len(sets[a]) + len(sets[b]) - m):
                links.add((b, a))
    assert links and links <= pairs and len(pairs) < 3 * len(links)


def test_chains_and_empty_tables(spark, make):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(1, 61)}
    assert jaccard_join(make([])).count() == 0
    assert [tuple(r) for r in jaccard_join(make([(None, "a b c d"), (4, None)])).orderBy("n_shingles").collect()] == [(4, 0, 4), (None, 1, None)]


def test_rows_without_an_id_connect_others(make):
    words = [f"w{i}" for i in range(100)]
    text = lambda first: " ".join([*first, *words[len(first) :]])
    a, m, c = text([]), text(["x1", "x2", "x3"]), text(["x1", "x2", "x3", "x4", "x5", "x6"])
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(1, a), (None, m), (2, c), (None, m), (7, other), (None, other), (None, "alone without any id"), (8, a.upper()), (9, "of two texts once"), (9, "another of those two texts"), (10, "another of those two texts")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(make(rows), 3, 90).collect()), key=str)
    assert got == sorted([(1, 98, 1), (None, 98, 1), (2, 98, 1), (None, 98, 1), (7, 48, 7), (None, 48, 7), (None, 2, None), (8, 98, 1), (9, 2, 9), (9, 3, 9), (10, 3, 9)], key=str)
