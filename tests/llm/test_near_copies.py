"""Near copies against all pairs by the definition, and which rows of a group stay."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from boardlake.llm import near_copies
from boardlake.llm.common import table


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {b" ".join(words)} - {b""}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_groups(texts):
    """Distinct texts -> smallest text index of their group, over all pairs that share a shingle or have none."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    holders = {}
    for i, s in enumerate(sets):
        for x in s or {b""}:
            holders.setdefault(x, []).append(i)
    pairs = {p for h in holders.values() for p in combinations(h, 2)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [(i, j) for i, j in sorted(pairs) if alike(sets[i], sets[j])]
    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(texts))], links


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def family(rng, n=120, copies=40, most=2):
    base = [f"w{rng.randrange(3000)}" for _ in range(n)]
    return [edited(rng, base, k % (most + 1)) for k in range(copies)]


def kept(df, **options):
    return sorted((r.doc_id for r in near_copies.keep_one(df, **options).collect()), key=repr)


def test_sketch_does_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"Wörd{i * i % 97}" for i in range(900))
    n, fp, parts = near_copies.sketch(text)
    assert n == len(shingle_set(text)) and len(parts) == 8
    monkeypatch.setattr("boardlake.llm.simhash.PIECE", 50)
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    again = near_copies.sketch(text)
    assert again[:2] == (n, fp) and again[2].tolist() == parts.tolist()
    hashes = [xxhash.xxh64_intdigest(s.lower(), 42) for s in shingle_set(text)]
    assert sorted(hashes) == np.unique(near_copies.shingle_hashes(text)).tolist()
    assert near_copies.sketch("")[:2] == near_copies.sketch(" \t\n")[:2] == (0, 0)
    assert near_copies.sketch("a b")[0] == 1 and len(near_copies.sketch("a " * 5000)[2]) == 1


def test_an_edit_leaves_most_parts():
    rng = random.Random(3)
    words = [f"w{rng.randrange(3000)}" for _ in range(400)]
    whole = set(near_copies.sketch(" ".join(words), 1000)[2].tolist())
    one = set(near_copies.sketch(edited(rng, words, 1), 1000)[2].tolist())
    assert len(whole) > 30 and len(whole - one) <= 4


@pytest.mark.parametrize("options", [{}, {"crowd": 4, "leaders": 4}])
def test_groups_equal_all_pairs(spark, options):
    rng = random.Random(11)
    texts = [t for k in range(6) for t in family(rng, 60 + 40 * k)] + ["", "one", "ONE", "a b c", "x " * 3000]
    texts += [edited(rng, [f"v{rng.randrange(900)}" for _ in range(80)], 0) for _ in range(60)]
    rng.shuffle(texts)
    texts = list(dict.fromkeys(texts))
    groups, _ = plain_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert kept(df, **options) == sorted(set(groups), key=repr)


def test_a_common_passage_links_nothing(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(150)]
    texts += [t + " more words" for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert kept(df) == sorted(range(150), key=repr)


def test_pairs_under_crowded_parts_are_found(spark):
    rng = random.Random(23)
    passage, texts = " ".join(f"p{i}" for i in range(100)), []
    for k in range(120):
        own = [f"u{rng.randrange(10**6)}" for _ in range(30)]
        texts += [f"{passage} {' '.join(own)}", f"{passage} {edited(rng, own, 2)}"]
    rng.shuffle(texts)
    groups, links = plain_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(links) >= 120 and kept(df) == sorted(set(groups), key=repr)


def test_caps_lose_no_link(spark):
    rng = random.Random(29)
    texts = [t for k in range(8) for t in family(rng, 40 + 30 * k, 25, 4)] + ["", "one two", "One two", "a b c d e"]
    rng.shuffle(texts)
    texts = list(dict.fromkeys(texts))
    groups, _ = plain_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert kept(df, parts=1, leaders=1, crowd=2) == sorted(set(groups), key=repr)


def test_rows_are_judged_one_by_one(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until the night falls"
    rows = [(None, text, 1, {"a": 1}), (4, text, 2, None), (4, text, 3, None), (4, "a clean text of another row", 4, None),
            (9, text + " now", 5, None), (None, "another clean text without an id", 6, None), (5, None, 7, None),
            (6, "", 8, None), (7, " \n", 9, None)]
    schema = "doc_id long, text string, near_sig int, sig map<string,int>"
    df = spark.createDataFrame(rows, schema)
    out = near_copies.keep_one(df)
    assert out.columns == df.columns
    got = [tuple(r)[:3] for r in out.collect()]
    assert sorted(x for i, t, x in got if x not in (2, 3)) == [4, 6, 7] and sum(x in (2, 3) for _, _, x in got) == 1
    assert near_copies.keep_one(spark.createDataFrame([], schema)).count() == 0
    assert near_copies.near_copies(df).count() == 4


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    texts = list(dict.fromkeys(t for _, t in rows))
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    groups, links = plain_groups(texts)
    want = {first[texts[g]] for g in groups}
    got = set(kept(docs))
    assert want <= got and len(got - want) <= len(links) // 10
