import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from terrafold.llm.secrets import RULES, _found, _machine, automaton, redact, scan, secret_scan

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Kinds, expressions and least lengths of their own.
OTHERS = (
    ("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 1), ("forge", "gh[opsu]_[A-Za-z0-9]+", 24), ("chat", "xox[abpr]-[0-9A-Za-z-]+", 15),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}(\.[A-Za-z0-9_-]*)?", 1),
)


def spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 3 + i, m.end(), k) for i, (k, p, n) in enumerate(OTHERS) for m in re.finditer(p, text) if len(m[0]) >= n]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def random_texts(n=400):
    rng = random.Random(3)
    bits = ["password", "PassWD", "api_key", "apikey", "token", "secret", '"', "'", " ", "  ", ":", "=", "\n", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "xyz", "é", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "ſecret"]
    bits += ["gho_", "xoxb-", "1234567890", "eyJ", "eyJhbGciOiJ", ".", ".eyJzdWIiOiI", "-----BEGIN ", "PRIVATE KEY-----", "EC ", "東", "A" * 19 + " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def said(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def test_spans_equal_brute_force(make, edge):
    rows = edge + [(100 + k, t) for k, t in enumerate(random_texts())]
    rows += [(900, "é token = " + "x" * 70_000 + " " + "0a" * 3000), (901, "password" + " " * 50_000 + "=" + " " * 9 + "abcdefghijklmnop"), (902, "secret=password:abcdefghijklmnop token=aa:secret=bbbbbbbbbbbbb")]
    rows += [(903, "eyJ" * 4000 + ".eyJ" + "b" * 9 + "." + "eyJ" + "c" * 9 + ".eyJdddddddddd.eyJeeeeeeeee")]
    got = sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan(make(rows)).collect())
    want = []
    for d, t in rows:
        s = spans(t or "")
        b = [x for x in s if x[0] in ("assign", "access", "hex")]
        want.append((d or -1, *(sum(k == n for k, _, _ in b) for n in ("assign", "access", "hex")), hashlib.sha256(said(b).encode()).hexdigest(), said(s)))
    assert got == sorted(want)
    for kind in RULES:
        assert any(kind + ":" in r[-1] for r in got), kind
    assert secret_scan(make([])).count() == 0


def test_automaton_returns_to_its_start_at_line_feeds_and_is_minimal():
    classes, nxt, bits = _machine()
    assert set(nxt[:, classes[10]].tolist()) == {0}
    assert len(np.unique(np.column_stack([bits, nxt]), axis=0)) == len(nxt)


@pytest.mark.parametrize("text", ["x", "\n", "token" * 5000, "password" + " " * 30_000 + ":" + "b" * 30_000, " ".join(random_texts(200))])
def test_stretches_give_the_states_of_one_pass(text):
    classes, nxt, _ = machine = automaton((RULES["assign"][0], RULES["hex"][0], RULES["access"][0]))
    data, s, want = np.frombuffer(text.encode(), np.uint8), 0, []
    for c in classes[data].tolist():
        s = int(nxt[s, c])
        want.append(s)
    assert scan(data, machine).tolist() == want


def test_a_long_line_takes_little_time():
    text = ("the quick brown token fox jumps over a lazy dog and so on with more words " * 14_000)[:1_000_000]
    b, machine = pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), _machine()
    began = time.thread_time()
    assert _found(b, machine) == {}
    assert time.thread_time() - began < 1


def test_redaction_removes_every_span_and_keeps_the_rest(make, edge):
    rows = [(100 + k, t) for k, t in enumerate(random_texts(80))] + edge
    out = redact(make(rows))
    assert out.columns == make([]).columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    for d, t in rows:
        if t is None or not spans(t):
            assert (d, t) in got
    assert all(t is None or not spans(t) for _, t in got)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
