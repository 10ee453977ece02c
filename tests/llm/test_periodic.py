"""Runs of repeating words against a plain search of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from boardlake.llm import periodic, queries


def plain_runs(w):
    """(start, length, period) by definition: maximal stretches of each period, the smallest period of a stretch."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        a = 0
        while a + q < len(w):
            b = a
            while b + q < len(w) and w[b] == w[b + q]:
                b += 1
            if b > a:
                if b - a + q >= max(6, 4 * q):
                    found.setdefault((a, b + q - a), q)
                a = b
            a += 1
    return sorted((a, n, q) for (a, n), q in found.items())


def row_of(words):
    runs = plain_runs(words)
    dropped = {k for a, n, q in runs for k in range(a + q, a + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(kept.encode()).hexdigest())


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def samples(seed=3):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 100, list("ab") * 3, list("ab") * 4, list("abb") * 9 + ["z"] + list("abb") * 4]
    for _ in range(250):
        alphabet = [f"w{k}" for k in range(rng.choice([1, 2, 3, 30]))]
        w = [rng.choice(alphabet) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            q = rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 32, 33, 40, 64, 65])
            unit = [rng.choice(alphabet + ["x", "y", f"u{rng.randrange(9)}"]) for _ in range(q)]
            w += (unit * 7)[:rng.randrange(3 * q, 6 * q)] + [rng.choice(alphabet) for _ in range(rng.randrange(0, 9))]
        out.append(w)
    return out


def test_runs_equal_brute_force():
    texts = samples()
    assert periodic.text_runs([[x.encode() for x in t] for t in texts]) == [plain_runs(t) for t in texts]


def test_nested_and_binary_words():
    rng = random.Random(5)
    inner = list("aaaaaaab") * 5 + ["c"]
    texts = [inner * 5, (inner * 4 + ["d"]) * 4] + [[rng.choice("ab") for _ in range(400)] for _ in range(40)]
    for n in (3, 4, 5, 6, 7):
        a, b = "a", "ab"
        for _ in range(n + 6):
            a, b = b, b + a
        texts.append(list(b))
    assert periodic.text_runs([[x.encode() for x in t] for t in texts]) == [plain_runs(t) for t in texts]


def test_long_periods_need_the_minimizers(monkeypatch):
    rng = random.Random(6)
    unit = [str(rng.randrange(50)) for _ in range(700)]
    text = [b"x"] * 3 + [w.encode() for w in (unit * 5)[:2900]] + [b"y"]
    assert periodic.text_runs([text, text[:100]]) == [[(3, 2900, 700)], []]
    monkeypatch.setattr(periodic, "minimizers", lambda grams, width: np.zeros(0, np.int64))
    assert periodic.text_runs([text]) == [[]]


def test_small_buffers(monkeypatch):
    texts = samples(8)
    monkeypatch.setattr(periodic, "BUFFER", 50)
    assert periodic.text_runs([[x.encode() for x in t] for t in texts]) == [plain_runs(t) for t in texts]


def test_rows(spark):
    texts = [" ".join(t) for t in samples(9)] + ["", " \t ", "a\x0ba\x0ca\ra a\na", "é é é é é é é", "x x x x", "a " * 20_000]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, None, "c"), (None, "b " * 9, "c"), (5, texts[9], "c"), (5, texts[9], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted(map(tuple, periodic.digest(periodic.find_runs(df)).collect()), key=repr)
    short = [(i, t) for i, t, _ in rows if len(t or "") < 30_000]
    want = [(i, *row_of(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in short]
    digest = hashlib.sha256(b"0,20000,1\n").hexdigest()
    want.append((len(texts) - 1, 1, 0, 20_000, 1, 20_000_000, digest, hashlib.sha256(b"a").hexdigest()))
    assert got == sorted(want, key=repr)
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_strongest_is_exact():
    big = 10 ** 9
    less, more = (0, 4 * big + 5, big + 1), (1, 4 * big + 1, big)  # equal as doubles
    assert periodic.strongest([less, more, (2, 4 * big + 1, big)]) == more
    assert periodic.strongest([]) is None


def test_planting_equals_its_rule(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-5, "a b c d e"), (None, "n n"), (-77, None)], docs.schema))
    source = {r.doc_id: r.text for r in docs.collect()}
    changed = 0
    for r in periodic.planted(docs).collect():
        old = source[r.doc_id]
        if r.doc_id is None or old is None:
            assert r.text == old
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", old)
        assert re.findall(r"[^\x20\x09-\x0D]+", r.text) == plant(r.doc_id, words)
        changed += r.text != old
    assert changed


def test_query_over_the_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = sorted((i, *row_of(plant(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for i, t in docs.items())
    got = sorted(map(tuple, queries.QUERIES["op11_periodic_runs"](spark, sf).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()))
    assert got == want and any(r[1] for r in got)
