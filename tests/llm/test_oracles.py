"""Registered queries against their oracles, on whole tables."""

import pytest

from tests.harness import SF, same
from textloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name])


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
