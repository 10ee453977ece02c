"""Phrase search by postings against a plain scan; equality with SQL on the tables is checked by test_queries."""

import hashlib
import random
import re

from boardlake.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    out = []
    for i, t in docs:
        w, hit, named = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(13, len(v))
            if item is None or not n:
                continue
            for s in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n]:
                        hit |= set(range(p, p + n))
                        named.add(str(item))
        text = ",".join(sorted(named))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(text.encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "The", "é9", "É9", "x_y", "don't", "zz", "Rare1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([40, 25, 13, 12, 5, 1, 14])] + [(7, ""), (8, None), (None, text(9)), (9, "--- !"),
                                                                             (2, text(15)), (10, "missing words here"), (11, "a a a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        t = text(rng.randrange(0, 60))
        item = items[rng.randrange(7)][1]
        if i % 2:
            t = t + ". " + item[rng.randrange(0, 5) * 0:] + "! " + text(rng.randrange(0, 400))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, " \n "), (None, items[0][1]), (3, docs[3][1]), (3, items[1][1]), (103, "a " * 40),
             (104, items[0][1] + " " + text(2000) + " " + items[0][1].upper())]
    return docs, items


def test_equals_plain_scan(spark):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, term int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=repr)
    assert got == plain(docs, items)


def test_shuffled_paths_give_the_same(spark, monkeypatch):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "bounded", lambda df, rows=0: df)
    got = sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=repr)
    assert got == plain(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert not decontaminate.contamination(d, b.limit(0)).where("n_hit > 0 OR contaminated").count()


def test_proximity(spark):
    d = spark.createDataFrame([(1, "q one two three alpha four five beta six"), (2, "alpha " + "x " * 30 + "beta"), (3, "beta alpha"), (4, "beta")],
                              "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    index = decontaminate.build_index(d, b)
    found = lambda n: sorted(r.doc_id for r in decontaminate.proximity_matches(index, n).collect())
    assert found(1) == [3] and found(3) == [1, 3] and found(31) == [1, 2, 3]


def test_drop_contaminated(spark):
    item = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, item, "s"), (2, item + " x" * 500, "s"), (3, "clean", None), (None, item, "s")],
                              "doc_id long, text string, source string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()), key=repr) == [2, 3, None]


def test_rows_go_by_their_own_text(spark):
    item = " ".join(f"b{i}" for i in range(13))
    rows = [(1, "clean words here", "k"), (1, "see " + item, "k"), (None, item, "k"), (None, None, "k"), (2, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    out = decontaminate.drop_contaminated_rows(docs, items)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
