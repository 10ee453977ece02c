"""Every registered query against its SQL on DuckDB, and partition invariance."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from boardlake.plans import ORACLE, QUERIES

MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    error, rows, *_ = compare(spark, con, sf, name, QUERIES[name], ORACLE.get(name))
    assert error is None, error
    assert rows > 0 or name in MAY_BE_EMPTY


def test_sql_only_for_known_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", ["w6_sample_epoch", "w7_shuffle_batches", "a2_class_metrics", "w11_mark_plan",
                                  "w12_arrow_plan", "j10_nearest_position"])
def test_results_do_not_depend_on_partitions(spark, sf, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(repr, QUERIES[name](spark, sf).collect())))
        assert seen[0] == seen[1] == seen[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 13
