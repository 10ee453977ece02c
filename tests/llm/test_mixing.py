"""Mixing: weights, budgets and permutations; equality with SQL is checked by test_queries."""

import math
from collections import Counter, defaultdict

import pytest

from boardlake.llm import mixing


def corpus(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 4}", 1) for i in range(400)]
    rows += [(900, None, "big", 1), (901, " \n ", "s1", 1), (None, "a b", "s2", 1), (902, "a b c", None, 1),
             (902, "a b c", None, 1), (903, "", "silent", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, block int")


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
@pytest.mark.parametrize("entropy, repeats", [(0.9, 4.0), (1.0, 1.5), (0.2, 9.0), (1.0, 1e9)])
def test_weights_blocks_and_budget(spark, entropy, repeats, bucket_rows):
    rows, df = corpus(spark)
    out = mixing.mix(df, entropy=entropy, repeats=repeats, bucket_rows=bucket_rows).collect()
    tokens = Counter()
    for i, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n}

    def state(a):
        z = sum(p ** a for p in shares.values())
        w = {s: p ** a / z for s, p in shares.items()}
        return w, -sum(x * math.log(x) for x in w.values()), max(w[s] * total / tokens[s] for s in w)

    want = next((k / 1e6 for k in range(0, 1_000_001, 100) if state(k / 1e6)[1] <= entropy * math.log(len(shares)) + 1e-9
                 and state(k / 1e6)[2] <= repeats + 1e-9), 1.0)
    weights = state(want)[0]
    spent, seen = Counter(), defaultdict(list)
    for r in out:
        spent[r.source] += r.n_tokens
        seen[r.source, r.block].append((r.position, r.doc_id))
    for s, w in weights.items():
        assert w * total - 2 <= spent[s] <= w * total + 8 + 2
    assert "silent" not in spent
    for (s, block), got in seen.items():
        assert sorted(p for p, _ in got) == list(range(1, len(got) + 1))
        have = Counter(i for i, _, x, _ in rows if x == s)
        assert not Counter(i for _, i in got) - have
        last = max(b for x, b in seen if x == s)
        if block < last:
            assert Counter(i for _, i in got) == have
    orders = {b: [i for _, i in sorted(g, key=lambda x: x[0])] for (s, b), g in seen.items() if s == "s1"}
    assert len(orders) < 2 or orders[0] != orders[1]


def test_buckets_do_not_change_the_mix(spark):
    _, df = corpus(spark)
    a, b = (sorted(map(tuple, mixing.mix(df, bucket_rows=n).collect()), key=repr) for n in (5, 20_000))
    assert a == b


def test_empty(spark):
    _, df = corpus(spark)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("source = 'silent'")).count() == 0
