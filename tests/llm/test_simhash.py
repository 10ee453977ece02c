"""SimHash fingerprints, covering anchors and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from boardlake.llm import simhash
from boardlake.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); components over links of at most three bits."""
    least = {}
    fps = sorted({f for _, f in rows})
    left = set(fps)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            f = todo.pop()
            group.add(f)
            near = {g for g in left if (f ^ g).bit_count() <= 3}
            left -= near
            todo += near
        ids = [i for i, f in rows if f in group and i is not None]
        for f in group:
            least[f] = min(ids) if ids else None
    return least


def texts():
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    rows = [base, base.upper(), base + " end", "", None, "one", "One", "two words", "  \t\n", "é É", "a b c"]
    for k in range(60):
        words = base.split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "x"
        rows.append(" ".join(words))
    rows += [" ".join(f"v{rng.randrange(900)}" for _ in range(80)) for _ in range(60)]
    return rows


def test_fingerprint_of_long_texts_is_cut_without_loss(monkeypatch):
    text = " ".join(f"Wörd{i % 97}" for i in range(500))
    whole = simhash.fingerprint(text)
    assert whole == plain_fingerprint(text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) == whole
        assert simhash.fingerprint("a  b") == plain_fingerprint("a b")


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    fx, kx, hx = simhash.anchors_of(x)
    fy, ky, _ = simhash.anchors_of(y)
    homes, copies = {}, {}
    for f, k, h in zip(fx.tolist(), kx.tolist(), hx.tolist()):
        if h:
            homes.setdefault(f, set()).add(k)
    for f, k in zip(fy.tolist(), ky.tolist()):
        copies.setdefault(f, set()).add(k)
    assert all(homes[a] & copies[b] for a, b in zip(x.tolist(), y.tolist()))
    assert max(map(len, copies.values())) <= 34


@pytest.mark.parametrize("hot", [4096, 3])
def test_components_equal_brute_force(spark, hot, monkeypatch):
    rows = list(enumerate(texts(), start=100)) + [(100, texts()[3]), (None, texts()[0]), (7, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    if hot != 4096:
        link = simhash.link_fingerprints
        monkeypatch.setattr(simhash, "link_fingerprints", lambda d: link(d, hot=hot))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    least = plain_components(fps)
    assert got == sorted(((i, f"{f:016x}", least[f]) for i, f in fps), key=repr)


def test_large_anchor_groups_in_blocks(monkeypatch):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 90:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(10)}
    fps = np.array(sorted(fps), dtype=np.uint64)
    monkeypatch.setattr(simhash, "PAIRS", 150)
    a, b = simhash._group_links(fps, np.ones(len(fps), dtype=bool))
    assert len(a) == 89 and centre in set(a.tolist()) | set(b.tolist())


def test_empty_table_and_component_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (200, 201), (None, 5)],
                                  "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d", "s"), (2, "a b c d", "t"), (3, "q r s t u", "s")],
                               "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3]
