import re

import pytest
from terrafold.llm import registry

from tests.oracle import connect, difference

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) is None


def test_one_query_an_operator():
    found = [re.match(r"op(\d+)_", n) for n in registry.queries() if n != "pipeline"]
    assert sorted(int(m[1]) for m in found) == list(range(1, len(found) + 1))
