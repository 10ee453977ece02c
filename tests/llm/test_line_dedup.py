"""Line dedup: alignment against a plain version, pairs and planted cases."""

import random
from collections import Counter

from boardlake.llm import line_dedup


def plain_align(a, b, off=(0, 0)):
    """The same definition by recursion, with a quadratic longest increasing subsequence."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [off] + plain_align(a[1:], b[1:], (off[0] + 1, off[1] + 1))
    if a[-1] == b[-1]:
        return plain_align(a[:-1], b[:-1], off) + [(off[0] + len(a) - 1, off[1] + len(b) - 1)]
    once = [x for x in a if Counter(a)[x] == 1 and Counter(b)[x] == 1]
    pairs = [(a.index(x), b.index(x)) for x in once]
    best = [[p] for p in pairs]
    for i, p in enumerate(pairs):
        for j in range(i):
            if pairs[j][1] < p[1] and len(best[j]) + 1 > len(best[i]):
                best[i] = best[j] + [p]
    if not pairs:
        return []
    line, out, last = max(best, key=len), [], (-1, -1)
    for x, y in [*line, (len(a), len(b))]:
        out += plain_align(a[last[0] + 1:x], b[last[1] + 1:y], (off[0] + last[0] + 1, off[1] + last[1] + 1))
        if x < len(a) and y < len(b):
            out.append((off[0] + x, off[1] + y))
        last = (x, y)
    return out


def test_alignment_is_valid_and_as_long_as_plain_patience():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(14))]
        b = [x for x in a if rng.random() < 0.7] + [rng.randrange(12) for _ in range(rng.randrange(5))]
        got = line_dedup.align(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert line_dedup.align(a, a) == [(i, i) for i in range(len(a))]
    for _ in range(100):
        a = rng.sample(range(30), 15)
        b = [x for x in a if rng.random() < 0.8] + [50]
        assert len(line_dedup.align(a, b)) == len(plain_align(a, b))


def test_blocks_need_neighbours_and_words():
    a, b = [1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 4, 8, 5]
    assert line_dedup.common_blocks(a, b, [9] * 7, 20) == [1, 2, 3]
    assert line_dedup.common_blocks(a, b, [1] * 7, 4) == []
    assert line_dedup.common_blocks(a, b, [30] * 7, 20) == [1, 2, 3, 4, 6]


P = "\n".join(f"passage line {i} has some words in it" for i in range(8))


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    out = line_dedup.dedup_lines(df, **more).collect()
    return sorted(((r.doc_id, r.text, r.n_deleted) for r in out), key=repr)


def test_planted_blocks(spark):
    rows = [(1, "own first line of one\n" + P), (2, P + "\ntail of two"), (3, "a\nb\nc"), (4, "a\nb\nd"), (5, P),
            (6, "x " + P), (7, ""), (8, None), (None, P), (9, "different words\n\n" + P.replace("3", "7") + "\nend")]
    got = {i: (t, n) for i, t, n in run(spark, rows)}
    assert got[1] == (rows[0][1], 0) and got[2] == ("tail of two", 8) and got[3] == ("a\nb\nc", 0)
    assert got[4] == ("a\nb\nd", 0) and got[5] == ("", 8) and got[7] == ("", 0) and got[8] == (None, 0)
    assert got[6][0] == "x passage line 0 has some words in it" and got[None] == (P, 0)
    assert got[9] == ("different words\n\npassage line 7 has some words in it\nend", 7)


def test_frequent_short_lines_do_not_hide_long_ones(spark):
    rows = [(i, f"unique {i} words here\nyes\n{P}\nno") for i in range(60)]
    got = {i: t for i, t, _ in run(spark, rows)}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"unique {i} words here" for i in range(1, 60))


def test_repeated_rows_and_ids(spark):
    rows = [(1, P), (1, P), (2, P), (2, P + "\nmore"), (2, P)]
    got = run(spark, rows)
    assert [t for i, t, _ in got if i == 1] == [P, P]
    assert sorted(t for i, t, _ in got if i == 2) == ["", "", "more"]


def test_empty(spark):
    assert run(spark, []) == []


def test_short_lines_pair_at_any_frequency(spark):
    for holders in (20, 21, 40):
        verse = "\n".join(f"two{i} words{i}" for i in range(30))
        rows = [(i, f"own opening {i} here\n{verse}") for i in range(holders)]
        got = {i: (t, n) for i, t, n in run(spark, rows)}
        assert got[0] == (rows[0][1], 0)
        assert all(got[i] == (f"own opening {i} here", 30) for i in range(1, holders))


def test_shortest_runs_cover_every_repeated_run():
    rng = random.Random(8)
    for _ in range(200):
        size = {x: rng.choice([0, 0, 1, 2, 5, 13]) for x in range(9)}
        a = [rng.randrange(9) for _ in range(rng.randrange(20))]
        words = [size[x] for x in a]
        inside = [a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1) if sum(words[i:j]) >= 12]
        keys = set(line_dedup.run_keys(a, words, 12))
        assert bool(inside) == bool(keys)
        for r in inside:
            assert keys >= set(line_dedup.run_keys(r, [size[x] for x in r], 12))


def test_pairs_with_the_first_holder_of_the_block(spark):
    b, c, d = (f"line {x} of seven words in all" for x in "bcd")
    block = f"{b}\n{c}\n{d}"
    rows = [(1, f"start of one\n{b}\nend"), (2, f"start of two\n{c}\nend"), (3, f"start of three\n{d}\nend"),
            (4, f"four begins\n{block}\nfour ends"), (5, f"five begins\n{block}\nfive ends"), (6, block)]
    got = {i: (t, n) for i, t, n in run(spark, rows)}
    assert all(got[i] == (rows[i - 1][1], 0) for i in (1, 2, 3, 4))
    assert got[5] == ("five begins\nfive ends", 3) and got[6] == ("", 3)


def test_all_runs_of_a_pair_go():
    rng = random.Random(6)
    for _ in range(400):
        size = {x: rng.choice([0, 1, 2, 5, 13]) for x in range(7)}
        a, b = ([rng.randrange(7) for _ in range(rng.randrange(16))] for _ in range(2))
        words, want = [size[x] for x in b], set()
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                if sum(words[i:j]) >= 12 and any(a[p:p + j - i] == b[i:j] for p in range(len(a))):
                    want |= set(range(i, j))
        assert line_dedup.common_blocks(a, b, words, 12) == sorted(want)


def test_repeated_and_moved_blocks(spark):
    q = P.replace("passage", "second")
    rows = [(1, f"u\n{P}\nv"), (2, f"y\n{P}\nx\n{P}\nz"), (3, f"u\n{P}\n{q}\nv"), (4, f"a\n{q}\n{P}\nb")]
    got = {i: (t, n) for i, t, n in run(spark, rows)}
    assert got[1] == (rows[0][1], 0) and got[2] == ("y\nx\nz", 16)
    assert got[3] == (f"{q}\nv", 9) and got[4] == ("a\nb", 16)


def test_columns_of_any_name_stay(spark):
    block = "one two three four five six seven\neight nine ten eleven twelve thirteen"
    rows = [(1, block, 1, 2, 3, "a", 5), (2, "own words\n" + block + "\nend", 6, 7, 8, "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, cut_id int, cut_sig int, _gone string, n_lines int")
    out = line_dedup.dedup_lines(df, counts=("lines", "deleted"))
    assert out.columns == df.columns + ["lines", "deleted"]
    assert sorted(map(tuple, out.collect())) == [(*rows[0], 2, 0), (2, "own words\nend", *rows[1][2:], 4, 2)]


def test_a_document_of_very_many_lines(spark):
    block = "\n".join(f"line {i} of a long shared list of words" for i in range(20_000))
    rows = [(1, block), (2, "head\n" + block + "\ntail")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == block and out[2].text == "head\ntail" and out[2].n_deleted == 20_000
