"""Filter audit against a row-by-row application of every order, and the trie against plain dictionaries."""

import itertools
import random
import re

import pytest
from oracle import connect

from boardlake.llm import filter_audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(rows, words=200):
    """rows: (id, text, source) -> for each row the set of failed filters."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A"} if len(w) < words else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if t in least and (i is None or least[t] < i) else set()
        out.append(fails)
    return out


def plain_audit(rows, labels, words=200):
    fails, out = plain_fails(rows, words), {}
    parts = {}
    for (i, _, s), f in zip(rows, fails):
        parts.setdefault(s or "", []).append((i, f))
    shapley = {}
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs),
                    sum(labels.get(d[0], (0, 0))[0] for d in gone), sum(labels.get(d[0], (0, 0))[1] for d in gone)]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["aa", "b", "The", "x#", "é", "long" * 5, "Q", "zz", "日"])
    base = ["\t ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(40)]
    lead = "common start " * 30
    rows = [(rng.randrange(500), rng.choice(base) if rng.random() < .6 else lead + rng.choice(base) + rng.choice("ab"),
             rng.choice(["s", "t", "", None])) for _ in range(400)]
    rows += [(None, base[0], "s"), (None, base[0], "s"), (None, "only null", None), (7, None, "s"), (8, "", "s"),
             (9, "hot", "t"), (9, "hot", "t"), (9, "hot", "s"), *[(1000 + k, "hot", "t") for k in range(200)],
             (3, "word " * 30_000, "t"), (4, "word " * 30_000, "t"), (5, "word " * 29_999 + "other ", "t")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 500, 3)]
    return rows, labels


@pytest.mark.parametrize("range_,chunk", [(2_000_000, 8_000_000), (3_000, 2_000)])
def test_audit_equals_brute_force(spark, monkeypatch, range_, chunk):
    monkeypatch.setattr(filter_audit, "RANGE", range_)
    monkeypatch.setattr(filter_audit, "CHUNK", chunk)
    rows, labels = corpus()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, n int").repartition(5)
    lab = spark.createDataFrame([*labels, *labels[:5], (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, lab, words=12).collect()
    marks = {i: (q, t) for i, q, t in labels}
    assert sorted(map(tuple, got)) == plain_audit(rows, marks, 12)
    if chunk < 8_000_000:
        starts, parts, _ = filter_audit.text_ranges(df, "text")
        assert len(starts) > 5 and max(parts) > 1 and starts == sorted(set(starts)) and starts[0] == b""


def test_masks_name_rows(spark):
    rows, _ = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in filter_audit.masks(df, words=12).collect():
        key = (r.doc, r.part, r["mask"])
        got[key] = got.get(key, 0) + r.n
    want = {}
    for (i, _, s), f in zip(rows, plain_fails(rows, 12)):
        key = (i, s or "", sum(1 << "ABCDE".index(x) for x in f))
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_trie_holds_every_text_once():
    rng = random.Random(1)
    texts = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 30))) for _ in range(3000)} | {b"", b"a" * 5000}
    meeting = filter_audit.Meeting()
    order = sorted(texts) * 2
    rng.shuffle(order)
    for k, t in enumerate(order):
        meeting.meet(k, "p", 1, t, len)
    first = {}
    for k, t in enumerate(order):
        first.setdefault(t, k)
    assert sorted((t, d) for d, _, _, _, t in meeting.winners()) == sorted(first.items())
    assert len(meeting.losers) == len(texts)


def test_ids_of_other_types_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "x", "s"), ("a", "x", "s"), (None, "x", "s")], "doc_id string, text string, source string")
    lab = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    row = filter_audit.audit(df, lab).where("filter_order = 'EABCD' and step = 1").collect()[0]
    assert (row.kept, row.removed, row.good_lost) == (1, 2, 1)
    assert filter_audit.audit(df.limit(0), lab).count() == 0
    assert filter_audit.audit(df, lab.limit(0)).count() == 600


def test_sql_of_the_query_equals_brute_force(sf):
    con = connect(sf)
    rows = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
    labels = {i: (q, t) for i, q, t in con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    cols = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    got = con.execute(f"SELECT {cols} FROM ({queries.ORACLE['op13_filter_audit']})").fetchall()
    assert sorted(got) == plain_audit(rows, labels)
