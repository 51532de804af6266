import hashlib
import random
import zlib

from terrafold.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, rep string, node string, key string"


def brute(rows):
    """Nodes of a plain trie of rebuilt conversations."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(x, key=lambda t: t[:2])] for c, x in own.items()}
    found = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = {}
    for c, seq in found.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    folded = {}
    for p in sorted(nodes, key=len, reverse=True):
        below = [folded[k] for k in kids.get(p, [])]
        own_saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        folded[p] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(found[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(kids.get(p, [])), *folded[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def results(spark, rows):
    df = spark.createDataFrame([(*r, "d", "r", "n", "k") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie(df).collect()), key=str)


def talk(rng, n, said):
    return [(None if k == 0 and rng.random() < 0.3 else k, rng.choice(["user", None, "bot"]), rng.choice(said)) for k in range(n)]


def test_equals_a_plain_trie(spark):
    rng = random.Random(4)
    said = ["", None, "hello", "é東", "yes", "no " * 30]
    rows = [(c, *t) for c in rng.sample(range(-20, 200), 120) for t in talk(rng, rng.randint(1, 12), said)]
    rows += [(300, *t) for t in talk(rng, 400, said)] + [(c, k, "user", f"turn {k}") for c in range(400, 440) for k in range(5)]
    rows += [(None, 1, "user", "of no conversation"), (500, 0, "u", "x" * 100_000)]
    rng.shuffle(rows)
    assert results(spark, rows) == brute(rows)


def test_long_shared_prefixes_and_ids_in_many_blocks(spark):
    rows = [(5 * c, k, "u", str(k) if k < 14 else f"{k} of {c % 2}") for c in (2, 3, 7, 5000, 60_000) for k in range(16)]
    assert results(spark, rows) == brute(rows)


def test_a_conversation_in_several_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(7, k, "u", f"{k}") for k in range(3000)] + [(c, 0, "u", "short") for c in (1, 6, 8, 9)]
        assert results(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_few_rows(spark):
    assert results(spark, []) == []
    for rows in ([(3, 0, "u", "a")], [(3, k, None, None) for k in range(12)], [(2, 0, "u", "a"), (4, 0, "u", "a"), (4, 0, "u", "a")]):
        assert results(spark, rows) == brute(rows)
