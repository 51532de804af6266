"""Secret scans with one combined deterministic automaton.

The rules' expressions become one non-deterministic automaton, then by subset construction and minimisation a
deterministic one: an array of next states by (state, class of bytes) and one bit for each rule in each state.
Texts are scanned as bytes, once for all rules: the bytes of a slice are cut into stretches of one length, which all
take a step at a time from the first state; where a stretch begins inside a possible match, the states are mended
from its true first state until they agree. No rule's match holds a line feed, and the automaton is back in its first
state after each, so texts are scanned one behind the other.

A stretch of bytes outside the first state that holds a match gives its spans by two automata of the rule alone: the
reversed one, read from the right, marks every place where a match begins; the forward one gives the last place where
it ends. Matches are leftmost and without overlaps; those whose last group is too short are dropped after that.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import cache
from math import isqrt
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import slices, texts

_KEY = r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: kind: (expression, the same for matches that are long enough; None: all are). The first three are the base.
RULES = {
    "assign": (_KEY + r"[A-Za-z0-9+/_.=-]+", _KEY + r"[A-Za-z0-9+/_.=-]{12,}"),
    "access": (r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14,}"),
    "hex": (r"[0-9a-f]+", r"[0-9a-f]{16,}"),
    "private": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", None),
    "forge": (r"gh[opsu]_[A-Za-z0-9]+", r"gh[opsu]_[A-Za-z0-9]{20,}"),
    "chat": (r"xox[abpr]-[0-9A-Za-z-]+", r"xox[abpr]-[0-9A-Za-z-]{10,}"),
    "webtoken": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?", None),
}
BASE = ("assign", "access", "hex")
#: In the combined automaton rules stand whole, but repeats aren't counted: it would have to tell all counts of all rules
#: apart. How long a match is shows in how many bytes on end its bit stands.
COMBINED = {k: whole.replace("{0,20}", "*").replace("{8,}", "+") for k, (whole, _) in RULES.items()}
LEAST = {k: int(enough.rpartition("{")[2].rstrip(",}")) if enough else 1 for k, (_, enough) in RULES.items()}


def _fragment(tree, fold: bool, edges: list, states: list) -> tuple[int, int]:
    """Thompson's construction: adds the states of a parsed expression, gives its first and last."""

    def state() -> int:
        edges.append([])
        states.append([])
        return len(edges) - 1

    def chars(op, value) -> frozenset[int]:
        if op is C.LITERAL:
            both = {chr(value).lower(), chr(value).upper()} if fold else {chr(value)}
            return frozenset(ord(x) for x in both)
        if op is C.IN:
            found = frozenset().union(*(frozenset(range(v[0], v[1] + 1)) if o is C.RANGE else chars(o, v) for o, v in value if o is not C.NEGATE))
            return frozenset(range(256)) - found if value[0][0] is C.NEGATE else found
        raise ValueError(f"not in a rule: {op}")

    first = last = state()
    for op, value in tree:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            for _ in range(least):
                a, b = _fragment(inner, fold, edges, states)
                edges[last].append(a)
                last = b
            if most is C.MAXREPEAT:
                a, b = _fragment(inner, fold, edges, states)
                end = state()
                edges[last] += [a, end]
                edges[b] += [a, end]
                last = end
            else:
                end = state()
                for _ in range(most - least):
                    a, b = _fragment(inner, fold, edges, states)
                    edges[last] += [a, end]
                    last = b
                edges[last].append(end)
                last = end
        elif op is C.SUBPATTERN:
            a, b = _fragment(value[3], (fold or bool(value[1] & re.I)), edges, states)
            edges[last].append(a)
            last = b
        elif op is C.BRANCH:
            end = state()
            for branch in value[1]:
                a, b = _fragment(branch, fold, edges, states)
                edges[last].append(a)
                edges[b].append(end)
            last = end
        else:
            end = state()
            states[last].append((chars(op, value), end))
            last = end
    return first, last


def _deterministic(edges: list, steps: list, first: list[int], accept: dict[int, int], searching: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, next state by state and class, bits of what ends in each state). State 0 is the first.

    A searching automaton may begin a match at every byte.
    """
    sets = sorted({s for x in steps for s, _ in x}, key=sorted)
    signs: dict[tuple, int] = {}
    classes = np.array([signs.setdefault(tuple(byte in s for s in sets), len(signs)) for byte in range(256)], np.uint8)
    member = [int(np.flatnonzero(classes == k)[0]) for k in range(len(signs))]

    def closure(found) -> frozenset[int]:
        todo, seen = list(found), set(found)
        while todo:
            for t in edges[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if steps[s] or s in accept)

    start = closure(first)
    number, order, table = {start: 0}, [start], []
    moves: dict[tuple[int, int], frozenset[int]] = {}  # what a state alone leads to

    def move(s: int, k: int) -> frozenset[int]:
        if (s, k) not in moves:
            moves[s, k] = closure([t for chars, t in steps[s] if member[k] in chars])
        return moves[s, k]

    for at in order:  # grows meanwhile
        row = []
        for k in range(len(member)):
            to = frozenset().union(start if searching else (), *(move(s, k) for s in at))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    nxt = np.array(table, np.int32)
    bits = np.array([sum({accept.get(s, 0) for s in x}) for x in order], np.uint32)
    # Minimisation: split the blocks by what they lead to until nothing splits.
    block = np.unique(bits, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[nxt]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    swap = np.arange(block.max() + 1)
    swap[[0, block[0]]] = swap[[block[0], 0]]
    block = swap[block]
    one = np.unique(block, return_index=True)[1]
    return classes, block[nxt[one]].astype(np.int32), bits[one]


@cache
def automaton(rules: tuple[str, ...], searching: bool = True, reverse: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The automaton of all rules together, bit k for rule k; reversed: it reads from the right."""
    edges: list[list[int]] = []
    steps: list[list[tuple[frozenset[int], int]]] = []
    ends = [_fragment(_parser.parse(pattern), False, edges, steps) for pattern in rules]
    if reverse:
        back: list[list[int]] = [[] for _ in edges]
        back_steps: list[list] = [[] for _ in edges]
        for a in range(len(edges)):
            for b in edges[a]:
                back[b].append(a)
            for chars, b in steps[a]:
                back_steps[b].append((chars, a))
        edges, steps, ends = back, back_steps, [(b, a) for a, b in ends]
    return _deterministic(edges, steps, [a for a, _ in ends], {b: 1 << k for k, (_, b) in enumerate(ends)}, searching)


def scan(data: np.ndarray, machine: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The state after each byte."""
    classes, nxt, _ = machine
    width, flat = nxt.shape[1], np.ascontiguousarray(nxt).ravel() * nxt.shape[1]
    length = max(64, min(2048, isqrt(len(data))))
    count = -(-len(data) // length)
    padded = np.full(count * length, 10, np.uint8)
    padded[: len(data)] = data
    read = np.ascontiguousarray(classes[padded].reshape(count, length).T)
    out = np.empty((length, count), np.int32)
    state = np.zeros(count, np.int32)
    for t in range(length):
        state = flat[state + read[t]]
        out[t] = state
    for k in np.flatnonzero(out[-1, :-1]).tolist() if count > 1 else ():  # ends inside a possible match
        while k + 1 < count and (s := int(out[-1, k])):
            k += 1
            for t in range(length):
                s = int(flat[s + int(read[t, k])])
                if out[t, k] == s:
                    break
                out[t, k] = s
            else:
                continue  # not yet as from the first state: the next stretch changes as well
            break
    return np.ascontiguousarray(out.T).ravel()[: len(data)] // width


@cache
def _alone(kind: str) -> tuple:
    """Lists for single steps: the reversed searching automaton of a rule, and its forward one, bit 2 for long enough."""
    whole, enough = RULES[kind]
    back = automaton((whole,), reverse=True)
    classes, nxt, bits = automaton((whole, enough or whole), searching=False)
    dead = (nxt == np.arange(len(nxt))[:, None]).all(1) & (bits == 0)
    return (*(x.tolist() for x in back), classes.tolist(), nxt.tolist(), bits.tolist(), dead.tolist())


def matches(data: bytes, kind: str) -> list[tuple[int, int]]:
    """Leftmost matches of a rule without overlaps, those that are long enough."""
    back_classes, back, begins, classes, nxt, bits, dead = _alone(kind)
    starts, s = [], 0
    for i in range(len(data) - 1, -1, -1):
        s = back[s][back_classes[data[i]]]
        if begins[s]:
            starts.append(i)
    starts.reverse()
    out, k = [], 0
    while k < len(starts):
        s, end, kept = 0, 0, False
        for i in range(starts[k], len(data)):
            s = nxt[s][classes[data[i]]]
            if bits[s]:
                end, kept = i + 1, bits[s] & 2
            elif dead[s]:
                break
        if kept:
            out.append((starts[k], end))
        k = bisect_left(starts, end, k)
    return out


def _found(batch: pa.RecordBatch, machine) -> dict[int, list[tuple[int, int, str]]]:
    """Spans by row, for rows that have any: by start, then in the order of the rules."""
    column = batch.column("text")
    ends = np.cumsum(pc.binary_length(column).to_numpy() + 1)  # each text gets a line feed
    raw = ("\n".join(column.to_pylist()) + "\n").encode()
    data = np.frombuffer(raw, np.uint8)
    states, bits = scan(data, machine), machine[2].astype(np.uint8)
    found = bits[states]
    hits, rules = [], []
    for rank, least in enumerate(LEAST.values()):
        on = np.flatnonzero(found & (1 << rank))
        change = np.flatnonzero(np.append(True, on[1:] != on[:-1] + 1)) if len(on) else on
        long = np.diff(np.append(change, len(on))) >= least
        hits.append(on[change[long]])
        rules.append(np.full(len(hits[-1]), 1 << rank, np.uint8))
    hits, rules = np.concatenate(hits), np.concatenate(rules)
    if not len(hits):
        return {}
    order = np.argsort(hits, kind="stable")
    hits, rules = hits[order], rules[order]
    idle = np.append(-1, np.flatnonzero(states == 0))  # the last byte is a line feed
    right = np.searchsorted(idle, hits)
    change = np.flatnonzero(np.append(True, right[1:] != right[:-1]))
    rules = np.bitwise_or.reduceat(rules, change)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for k, b in zip(right[change].tolist(), rules.tolist()):
        x, y = int(idle[k - 1]) + 1, int(idle[k])
        found = [(x + a, rank, x + e) for rank, kind in enumerate(RULES) if b >> rank & 1 for a, e in matches(raw[x:y], kind)]
        if found:
            rows.setdefault(int(np.searchsorted(ends, x, side="right")), []).extend(found)
    out, names = {}, list(RULES)
    for row, found in rows.items():
        low = int(ends[row - 1]) if row else 0
        places = np.append(0, np.cumsum((data[low : int(ends[row])] & 0xC0) != 0x80))  # code points before each byte
        out[row] = [(int(places[a - low]), int(places[e - low]), names[rank]) for a, rank, e in sorted(found)]
    return out


def _machine():
    return automaton(tuple(COMBINED.values()))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs.

    Null and empty texts have no spans (and the hash of an empty string). Repeated rows give repeated rows, an empty
    table an empty one; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_machine())
    said = lambda x: ",".join(f"{k}:{a}:{b}" for a, b, k in x)

    def run(batches):
        for b in slices(batches):
            found = _found(b, sent.value)
            rows = [found.get(i, ()) for i in range(b.num_rows)]
            counts = [pa.array([sum(x[2] == k for x in r) for r in rows], pa.int64()) for k in BASE]
            base = [hashlib.sha256(said([x for x in r if x[2] in BASE]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array(list(map(said, rows)), pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[removed]") -> DataFrame:
    """docs with each secret span of text replaced by mark (spans that overlap: by one), and n_chars, if there, counted anew.

    Null texts stay null; rows without a secret stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_machine())

    def run(batches):
        for b in slices(batches):
            filled = b.set_column(b.schema.get_field_index("text"), "text", pc.fill_null(b.column("text"), ""))
            found = _found(filled, sent.value)
            if not found:
                yield b
                continue
            values = b.column("text").to_pylist()
            for i, s in found.items():
                t, out, at = values[i], [], 0
                for x, y, _ in s:
                    if x >= at:
                        out += [t[at:x], mark]
                    at = max(at, y)
                values[i] = "".join([*out, t[at:]])
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(values, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
