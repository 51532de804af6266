import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from terrafold.llm.packing import best_fit_packing, sum_of_squares, token_ids
from terrafold.llm.tokens import CUT, library, pieces, token_counts

NAME = "byte_bpe_50k.json"


def library_ids(text):
    return library(NAME).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\t'sAZ09.,!é東\x1c\x85²<|>")), max_size=40))
def test_pieces_and_quick_ids_equal_the_library(text):
    parts = pieces(text)
    assert parts[0] + "".join(" " + p for p in parts[1:]) == text
    assert [i for k, p in enumerate(parts) for i in library_ids(p if k == 0 else " " + p)] == library_ids(text)
    assert token_ids(NAME, [text])[0].tolist() == library_ids(text)


def test_cut_only_before_words():
    assert CUT.split("a  b c") == ["a ", "b", "c"]


def test_counts_equal_the_library(make, edge):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(make(edge)).collect())
    want = []
    for d, t in edge:
        n = len(library_ids(t or ""))
        want.append((d or -1, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts(make([])).count() == 0


def test_packing_is_a_partition_of_all_ids(make, edge):
    got = best_fit_packing(make(edge), group=10).collect()
    want = []
    for d, t in edge:
        ids = [*library_ids(t or ""), 0]
        head = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        at = [0, *range(head, len(ids), 2048), len(ids)]
        want += [(d or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    assert best_fit_packing(make([])).count() == 0


def test_sum_of_squares_places_where_the_sum_is_smallest():
    rng = random.Random(1)
    capacity = 12
    lengths = [rng.randint(1, capacity) for _ in range(300)]
    seq, off = sum_of_squares(lengths, capacity)
    level = {}
    for s, i, o in zip(lengths, seq.tolist(), off.tolist()):
        assert level.get(i, 0) == o

        def total(change):
            gaps = {}
            for k, v in {**level, **change}.items():
                if v < capacity:
                    gaps[capacity - v] = gaps.get(capacity - v, 0) + 1
            return sum(n * n for n in gaps.values())

        options = [total({k: v + s}) for k, v in level.items() if v + s <= capacity] + [total({-1: s})]
        assert total({i: level.get(i, 0) + s}) == min(options)
        level[i] = level.get(i, 0) + s
    assert len(level) <= 1.1 * sum(lengths) / capacity + 2
