"""Registered queries against their SQL or what the tables promise, on the small tables."""

import pytest
from oracle import compare, connect

import corpus_pipeline
from boardlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    error, rows, *_ = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLE[name])
    assert error is None, error
    assert rows


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(corpus_pipeline.QUERIES) == {"pipeline"}
