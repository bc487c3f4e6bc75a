"""Queries of the subpackage against their SQL."""

import pytest

from tests.compare import difference
from tests.conftest import SF_DIR
from threadtide.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), duck, queries.ORACLES[name]) is None


def test_all_operators_have_a_query():
    named = {q.split("_")[0] for q in queries.QUERIES}
    assert named == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
