import random
from collections import Counter, defaultdict

import numpy as np
from terrafold.llm.divergence import SCALE, scaled, source_divergence, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, term string, total long, block string, value string, rank string, n string, d string, held string"


def brute(rows, least=3, top=200):
    """Results by Python's integers, from rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [Counter(t.decode() for t in terms_of(text)) for text, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        of = [(r[2], c) for r, c in zip(rows, found) if r[1] == lang]
        df = Counter(t for _, c in of for t in c)
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        count = defaultdict(Counter)
        for s, c in of:
            count[s].update({t: n for t, n in c.items() if df[t] >= least})
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + SCALE * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in p:
            parts = {"pair": [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in p if x != s]}
            parts["term"] = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k % 7, *r, "t", 1, "b", "v", "r", "n", "d", "h") for k, r in enumerate(rows)], SCHEMA)


def results(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_terms_are_letters_and_whatever_is_no_ascii():
    assert terms_of("It's A-Z_09 \x7fÄRGER\u00a0東京 x²\n") == [x.encode() for x in ("it", "s", "a", "z", "Ärger\u00a0東京", "x²")]


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.choice([5, 10**6, 10**12, 9 * 10**15])
        c = rng.randrange(total)
        assert scaled(np.array([c]), total).tolist() == [1 + SCALE * (c + 1) // total]


def test_equals_brute_force_in_any_blocks(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "x"]), rng.choice(["a", "b", None, "é", "z" * 30])) for _ in range(150)]
    rows += [(None, "en", "no text"), ("", "empty", "a"), ("", "empty", "b"), ("once only", "lone", "a"), ("w " * 50_000, "en", "a"), ("q" * 100_000, "de", "b")]
    rows += rows[:20] + [("hot hot", "en", "hot")] * 300
    want = brute(rows)
    assert results(source_divergence(table(spark, rows))) == want
    assert results(source_divergence(table(spark, rows), terms=7, sources=2)) == want
    assert results(source_divergence(table(spark, rows), top=3, terms=20)) == brute(rows, top=3)


def test_empty_table_and_a_language_without_kept_terms(spark):
    assert results(source_divergence(table(spark, []))) == []
    assert results(source_divergence(table(spark, [("a", "l", "s"), ("b", "l", "t")]))) == [("l", "s", "pair", "t", 0, 1), ("l", "t", "pair", "s", 0, 1)]
