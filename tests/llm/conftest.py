import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, n string"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def documents(rows):
        return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "k", "h", None) for d, t in rows], SCHEMA)

    return documents


@pytest.fixture(scope="session")
def edge():
    """Null, empty and wordless texts, one very long text, copies, ties, repeated rows, other scripts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(150)
    near = base.split()
    near[70] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, base), (7, base), (8, " ".join(near)), (9, base.upper()), (10, say(40_000)), (11, "Übung Ärger <|endoftext|> 東京 x²\n\n  end  "), (12, say(60) + "\n" + say(50) + "\n\n" + say(9)), (12, "other text with the same id"), (13, say(5)), (13, say(5))]
    rows += [(20 + k, say(rng.randint(3, 200))) for k in range(30)]
    return rows + [rows[5], rows[-1], (None, say(12))]
