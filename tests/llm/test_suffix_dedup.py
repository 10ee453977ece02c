"""Repeat removal against a plain table of all windows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from boardlake.llm import suffix_dedup


def plain(rows):
    """rows: (id, text) -> sorted (id, n_bytes, n_removed, n_spans, sha256)."""
    def signed(t):
        h = xxhash.xxh64(t.encode(), seed=42).intdigest()
        return h - (1 << 64) if h >> 63 else h
    docs = sorted({(i is None, i or 0, signed(t or ""), t or "") for i, t in rows})
    seen, done = set(), {}
    for d in docs:
        data = d[3].encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        done[(d[0], d[1], d[3])] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *done[(i is None, i or 0, t or "")]) for i, t in rows), key=repr)


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(60) for _ in range(4)]
    rows = []
    for i in range(n):
        t = text(rng.randrange(0, 120))
        if rng.random() < 0.5:
            s = rng.choice(shared)
            a = rng.randrange(0, 80)
            t = t + s[a:a + rng.randrange(90, 300)] + text(5)
        if rng.random() < 0.1:
            t = t + t
        rows.append((rng.randrange(10_000), t))
    rows += [(5, "x" * 450), (6, "ab" * 300), (7, "x" * 100), (8, "y" * 99), (9, ""), (10, None), (None, shared[0]),
             (None, shared[1]), rows[0], (rows[3][0], "other " + rows[4][1]), (11, "x" * 101 + "z")]
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, g int").repartition(5)
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, **more).collect()), key=repr)


@pytest.mark.parametrize("batches, hot, size", [(1, 2000, 16_000), (4, 2000, 50), (4, 5, 50)])
def test_equals_brute_force(spark, batches, hot, size, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE", size)
    rows = corpus()
    assert run(spark, rows, batches=batches, hot=hot) == plain(rows)


def test_texts_cut_into_pieces(spark, monkeypatch):
    rows = corpus(40, 9)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = df.toArrow().to_batches()[0].select([1])
    # The same windows, piece by piece, as from whole texts.
    def windows():
        out = []
        for x, ends, row, offset in suffix_dedup._pieces(table, 0):
            start, size, *_ = suffix_dedup.entries_of(x, ends)
            own = np.searchsorted(ends, start, side="right")
            base = offset[own] - np.concatenate(([0], ends))[own]
            for s, n, r, b in zip(start, size, row[own], base):
                out += [(r, s + b + k) for k in range(n)]
        return sorted(out)
    pieces = windows()
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 19)
    assert pieces == windows() and len(set(pieces)) == len(pieces)


def test_family_of_levels(spark):
    rows = [(i, t) for i, t in corpus(60, 4) if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    family = suffix_dedup.SuffixFamily(spark, suffix_dedup.screen_heads(df))
    sizes = []
    for low in range(0, 10_000, 1250):
        part = df.where(f"doc_id >= {low} and doc_id < {low + 1250}")
        family.add(part.selectExpr("doc_id", "xxhash64(coalesce(text, '')) sig", "coalesce(text, '') text"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1], [4, 2, 1, 1]]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_kept_text(spark):
    rows = [(1, "q" * 60 + "abc" * 40), (2, "abc" * 40 + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, keep_text=True).collect()}
    assert got[2] == b"tail" and got[1] == b"q" * 60 + (b"abc" * 40)[:0] + got[1][60:]


def test_packed_columns_come_back():
    columns = [np.array([1, 2 ** 63 + 5, 7], "<u8"), np.array([-1, 2 ** 40, 0], "<i8"), np.array([9, 8, 7], "u1")]
    got, tail = suffix_dedup.unpack(suffix_dedup.pack(columns, b"tail"), "<u8 <i8 u1")
    assert tail == b"tail" and all((a == b).all() for a, b in zip(got, columns))


def test_wide_ranges_are_scanned_in_slices(spark, monkeypatch):
    for name, value in (("RANGE", 20), ("FEW", 4), ("WIDE", 100_000), ("HELD", 300), ("TEXT", 5_000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus()
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert suffix_dedup.screen_heads(df).ranges == 2
    assert run(spark, rows, batches=3, hot=30) == plain(rows)


def test_slices_cover_all_and_keep_equal_heads_together(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE", 10)
    for head in ([], [3] * 40, list(range(35)), sorted([1, 2, 3, 9] * 12)):
        head = np.array(head, "<u8")
        cut = list(suffix_dedup.slices(head))
        assert np.concatenate([head[a:b] for a, b in cut]).tolist() == head.tolist()
        assert all(head[b - 1] != head[b] for _, b in cut[:-1]) and all(a < b for a, b in cut if len(head))


def test_blocks_of_a_task_do_not_multiply_with_its_text():
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, 3 << 22, dtype=np.uint8).tobytes().decode()
    batch = suffix_dedup.pa.record_batch([[letters[a:a + 100_000] for a in range(0, len(letters), 100_000)]], names=["text"])
    found = [b for out in suffix_dedup.head_rows([batch], 4) for b in out.column(1).to_pylist()]
    assert sorted(found) == list(range(16))


def test_spans_of_many_ranges_are_dealt_once(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(t or "" for _, t in rows)], "doc_id long, text string, sig long")
    screen = suffix_dedup.screen_heads(df)
    screen.ranges = 3
    batch = suffix_dedup.pa.record_batch([[i for i, _ in enumerate(rows)], [0] * len(rows), [t or "" for _, t in rows]],
                                         names=["doc_id", "sig", "text"])
    blocks = [r for out in suffix_dedup.entry_rows([batch], screen) for r in out.to_pylist() if r["level"] == suffix_dedup.NEW]
    blocks.sort(key=lambda r: r["bucket"])
    assert len(blocks) == 8
    given = suffix_dedup.pa.RecordBatch.from_pylist(blocks, schema=suffix_dedup.pa.schema(
        [("level", "int32"), ("bucket", "int64"), ("blob", "binary")]))
    spans = [r["bucket"] for out in suffix_dedup.merge_scan([given], 3) for r in out.to_pylist() if r["level"] == suffix_dedup.SPAN]
    assert spans and len(spans) == len(set(spans))
