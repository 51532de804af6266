import random

import numpy as np
from terrafold.llm import decontaminate
from terrafold.llm.decontaminate import align, find_leaks, word_hashes


def brute_align(item, words):
    h = [[0.0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if item[i - 1] == words[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
    return max(map(max, h)) / len(item)


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
        score, x, y = align(a, b)
        assert abs(score - brute_align(a.tolist(), b.tolist())) < 1e-9
        if score:
            assert abs(brute_align(a.tolist(), b[x:y].tolist()) - score) < 1e-9


def test_copies_and_edited_copies_are_found_and_clean_texts_left_alone(spark, make, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(12, 50)))) for k in range(20)]
    rows, want = [], set()
    for d in range(200):
        t = say(rng.randint(5, 300))
        if d % 4 == 0:
            k, item = items[d % 20 if d % 8 else 3]  # item 3 is frequent
            copy = item.split()
            if d % 3 == 0:
                for at in range(4, len(copy), 7):
                    copy[at] = "edited"
                del copy[2]
            t[len(t) // 2 : len(t) // 2] = copy
            want.add((d, k))
        rows.append((d, " ".join(t).capitalize() + "."))
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(make(rows), bench).collect()}
    assert got == want
    exact = {(r.doc_id, r.item_id) for r in find_leaks(make(rows), bench).filter("similarity = 1").collect()}
    assert exact == {(d, k) for d, k in want if d % 3}
    monkeypatch.setattr(decontaminate, "PART", 800)  # more items than one part holds
    assert {(r.doc_id, r.item_id) for r in find_leaks(make(rows), bench).collect()} == want


def test_query_equals_aligning_all_pairs(spark, make):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randint(8, 25))] for _ in range(8)]
    rows = []
    for d in range(70):
        t = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(d % 3):
            copy = list(rng.choice(items))
            copy = copy[rng.randint(0, len(copy) // 2) :]
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            at = rng.randint(0, len(t))
            t[at:at] = copy
        rows.append((d, " ".join(t)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(make(rows), bench).collect()}
    thirds = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want, unseen = {}, 0
    for d, t in rows:
        for k, w in enumerate(items):
            s = brute_align(w, t.split())
            if s >= 0.4:
                want[d, k] = round(s, 9)
                unseen += not thirds(w) & thirds(t.split())
    assert unseen == 0 and len(want) > 40
    assert got == want


def test_documents_that_begin_inside_an_item(spark, make):
    rng = random.Random(11)
    items = [["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)] for n in (12, 20, 41)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    cases = [(k, cut, tail) for k, w in enumerate(items) for cut in (1, 2, 5, len(w) // 2) for tail in ([], [f"other{i}" for i in range(60)])]
    rows = [(d, " ".join(items[k][cut:] + tail)) for d, (k, cut, tail) in enumerate(cases)]
    got = {(r.doc_id, r.item_id, r.similarity, r.first_word, r.end_word) for r in find_leaks(make(rows), bench).collect()}
    left = lambda k, cut: len(items[k]) - cut
    assert got == {(d, k, round(left(k, cut) / len(items[k]), 9), 0, left(k, cut)) for d, (k, cut, _) in enumerate(cases)}


def test_edges(spark, make, edge):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, "!!")], "item_id long, text string")
    assert {(r.doc_id, r.similarity) for r in find_leaks(make(edge), bench).collect()} == {(5, 1.0)}
    assert find_leaks(make([]), bench).count() == 0
    assert find_leaks(make(edge), bench.limit(0)).count() == 0
    assert len(word_hashes("")) == 0
