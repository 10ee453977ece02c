"""Exact top-k against brute force: ties, short tables, odd vectors, many rounds."""

import math
import random

import numpy as np
import pytest

from boardlake.llm import topk


def plain(rows, k, every):
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in whole:
        if i % every == 0:
            first[i] = min(first.get(i, v), v)
    out = []
    for q, a in first.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in whole if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def vectors(n=230, width=6, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(60)]
    rows += [(2000, None), (2050, [None] * width), (2100, [math.nan] * width), (2150, [math.inf] + [0.0] * (width - 1)), (None, same),
             (2200, []), (2250, [0.0] * width), (2300, [0.5, 0.5]), (50, rows[3][1]), (51, rows[4][1])]
    return rows


@pytest.mark.parametrize("bins, block, query_block", [(512, 1024, 512), (4, 50, 2), (2, 37, 3)])
def test_equals_brute_force(spark, bins, block, query_block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, bins=bins, block=block, query_block=query_block).collect()))
    assert got == plain(rows, 5, 50)


def test_few_rows_and_large_numbers(spark):
    df = spark.createDataFrame([(0, [3e6, -4e6]), (1, [5e6, 1e6]), (50, [-2e6, 7e6])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == plain([tuple(r) for r in df.collect()], 5, 50)
    one = df.where("vec_id = 0")
    assert topk.top_k(one).count() == 0 and topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 1")).count() == 0


def test_components_without_a_place_in_a_long_are_an_error(spark):
    df = spark.createDataFrame([(50, [1.0, 2.0]), (51, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="embedding of vec_id 51"):
        topk.top_k(df).collect()


def test_no_side_is_multiplied_before_it_is_sent(spark, monkeypatch):
    """Copies of a side for every block of the other one would be broadcast (or shuffled) as a whole."""
    plans, keep = [], topk.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(topk, "stored", stored)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    rows = topk.top_k(df, block=2, query_block=1)
    assert sorted(map(tuple, rows.collect())) == plain(vectors(), 5, 50)
    assert not any("Generate" in p or "BroadcastNestedLoopJoin" in p for p in plans)
    meeting = [p for p in plans if "MapInPandas" in p]
    assert len(meeting) > 2 and all("CartesianProduct" in p for p in meeting)


def test_packed_blocks_come_back():
    rows = [[1, -2], [], [127, -129, 5], [2 ** 62 - 1], [-128, 127, 0, 1]]
    offsets, values = np.cumsum([0, *map(len, rows)]), np.array([x for r in rows for x in r])
    got, kinds = [], []
    for block, _, n, width, kind, ids, data in topk._packed(3, np.arange(10, 15), offsets, values, 2):
        assert block == 3 and n <= 2
        kinds.append(np.dtype(kind).itemsize)
        got += zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(data, kind).reshape(n, width).tolist())
    assert [i for i, _ in got] == [10, 11, 12, 13, 14] and kinds == [1, 8, 1]
    assert [v[:len(r)] for (_, v), r in zip(got, rows)] == rows and not any(any(v[len(r):]) for (_, v), r in zip(got, rows))
