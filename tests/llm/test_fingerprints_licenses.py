import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F
from terrafold.llm import fingerprints as llm_fingerprints
from terrafold.llm.fingerprints import delete, fingerprints, insert, vectors
from terrafold.llm.licenses import TEMPLATES, bands, hitting_set, license_matches, license_scan, template_words


def xx(text, seed=42):
    return xxhash.xxh64_intdigest(text.encode() if isinstance(text, str) else text, seed)


def brute_vector(text):
    """Exact lanes and wide lanes of a text."""
    exact, wide = [0] * 8, [0] * 64
    for p in text.split("\n") if text else ():
        for j in range(4):
            h = xx(p, xx(j.to_bytes(4, "little")))
            exact[2 * j] += h & 0xFFFFFFFF
            exact[2 * j + 1] += h >> 32
        w = p.split(" ")
        for h in [xx(b, xx(a)) for a, b in zip(w, w[1:])] or ([xx(p)] if p else []):
            wide[(h & 31) + 32 * (h >> 21 & 1)] += 1 - 2 * (h >> 20 & 1)
    return [x % 2**32 for x in exact], wide


def brute_fingerprints(spark, rows):
    """Rows (doc_id, n_chars, sha, fingerprint, edited fingerprint, likenesses), in the order of a sort of all rows."""
    hashes = [r.h for r in spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "i int, t string").select("i", F.xxhash64("t").alias("h")).orderBy("i").collect()]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0), hashes[i]))
    written = lambda v: "".join(f"{x:08x}" for x in v[0]) + ":" + "".join(f"{x % 2**16:04x}" for x in v[1])

    def like(a, b):
        squares = sum(x * x for x in a[1]) + sum(x * x for x in b[1])
        return round(max(0.0, min(1.0, 2 * sum(x * y for x, y in zip(a[1], b[1])) / squares)) if squares else 1.0, 9)

    out, known = [], {}
    vector = lambda t: known[t] if t in known else known.setdefault(t, brute_vector(t))
    for i, j in zip(order, [*order[1:], *order[:1]]):
        t, n = rows[i][1] or "", rows[j][1] or ""
        c = len(t) // 2
        e = t[: len(t) - c] + n[:c]
        v, w = vector(t), vector(e)
        out.append((str(rows[i][0]), len(t), hashlib.sha256(e.encode()).hexdigest(), written(v), written(w), like(v, w), like(v, vector(n))))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_fingerprints_equal_brute_force(spark, make, edge, monkeypatch):
    rows = [*edge, (400, "a b\n\n\nc"), (401, "a b\nc"), (402, "\n\n"), (403, "\n")]
    want = brute_fingerprints(spark, rows)
    assert found(fingerprints(make(rows))) == want
    monkeypatch.setattr(llm_fingerprints, "RANGE", 4)
    assert found(fingerprints(make(rows))) == want
    got = {r.doc_id: r.fingerprint for r in fingerprints(make(rows)).collect()}
    assert got[6] == got[7] and got[1] == got[2] and len({got[k] for k in (1, 6, 8, 9, 400, 401, 402, 403)}) == 8
    assert fingerprints(make([])).count() == 0
    one = fingerprints(make([(None, "a b")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("ids", [[1, 3, 2**62], [-(2**63) + 5, 3, 2**63 - 5], [-(2**63), 2**63 - 1, None], [7] * 1000, [None] * 1000, [*range(500), *range(2**60, 2**60 + 500)]])
def test_any_ids(spark, make, ids, monkeypatch):
    monkeypatch.setattr(llm_fingerprints, "RANGE", 20)
    rows = [(d, f"text {k % 300}\nof document {d}") for k, d in enumerate(ids)]
    assert found(fingerprints(make(rows))) == brute_fingerprints(spark, rows)


def test_equal_rows_are_dealt_to_many_ranges(spark, make, monkeypatch):
    rows = [(5, "one text")] * 3000 + [(4, "another"), (6, "first"), (None, "last")]
    monkeypatch.setattr(llm_fingerprints, "RANGE", 50)
    placed = llm_fingerprints.next_texts(make(rows))
    assert placed.groupBy("r").count().agg(F.max("count")).first()[0] < 600
    assert found(fingerprints(make(rows))) == brute_fingerprints(spark, rows)


def test_order_of_paragraphs_insertion_and_deletion(spark):
    df = spark.createDataFrame([(1, "a b c\nd e\nf"), (2, "f\na b c\nd e"), (3, "a b c\nf"), (4, "d e"), (5, "a b c\nd e\nf\nf")], "k long, t string")
    v = {r.k: r for r in vectors(df, ["k"], "t").collect()}
    assert v[1].exact == v[2].exact and v[1].packed == v[2].packed and v[1].exact != v[5].exact
    x = spark.createDataFrame([(v[1].exact, v[3].exact, v[4].exact)], "a array<long>, b array<long>, c array<long>").select(insert(F.col("b"), F.col("c")).alias("i"), delete(F.col("a"), F.col("c")).alias("d")).first()
    assert x.i == v[1].exact and x.d == v[3].exact


def brute_licenses(text):
    w = template_words(text or "")
    have = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    out = []
    for name, t in TEMPLATES.items():
        g = template_words(t)
        grams = {tuple(g[i : i + 5]) for i in range(max(1, len(g) - 4))}
        if len(grams & have) >= 0.8 * len(grams):
            out.append(name)
    return ",".join(sorted(out))


def test_licenses_equal_brute_force(make, edge):
    filler = "some other words that stand here " * 8
    rows = list(edge)
    for k, t in enumerate(TEMPLATES.values()):
        rows += [(300 + 3 * k, t), (301 + 3 * k, filler + t.upper() + " " + filler), (302 + 3 * k, filler + " ".join(t.split()[:3]) + " license " + filler)]
    notice = TEMPLATES["mit-notice"]
    rows += [(None, filler + notice), (None, filler), (7777, filler + notice), (7777, filler), (7778, TEMPLATES["mit-text"] + " " + TEMPLATES["bsd-text"])]
    got = sorted((r.doc_id or -1, r.licenses, r.n_licenses) for r in license_scan(make(rows)).collect())
    assert got == sorted((d or -1, (x := brute_licenses(t)), len(x.split(",")) if x else 0) for d, t in rows)
    assert {(7777, "mit-notice", 1), (7777, "", 0), (-1, "mit-notice", 1)} <= set(got)
    best = {r.license: (r.containment, r.first_shingle) for r in license_matches(make(rows)).filter("doc_id = 7777").collect()}
    assert best["mit-notice"][0] == 1.0
    assert license_scan(make([])).count() == 0
    assert all(set(template_words(t)) & set(hitting_set(TEMPLATES)) for t in TEMPLATES.values()) and bands(32) <= 40
