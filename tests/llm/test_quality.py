"""The byte network: coverage of whole texts, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from boardlake.llm import quality


@pytest.fixture(scope="module")
def model():
    texts = [b"plain words run on here and there " * 8, b"odd### words%%% run*** on$$$ " * 8] * 40
    return quality.fit(texts, np.array([1.0, 0.0] * 40), epochs=4)


def test_symbols_mark_repeated_words():
    x = quality.symbols("the the then then. é é".encode())
    marked = [i for i, s in enumerate(x.tolist()) if s >= 256]
    assert marked == [4, 5, 6, 22, 23]


def test_chunks_cover_every_window(model):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, 1700).astype(np.int32)
    top, at = quality.chunk_maxima(x, model["table"], where=True)
    plain = np.array([sum(model["table"][k][x[i + k]] for k in range(quality.WIDTH))
                      for i in range(len(x) - quality.WIDTH + 1)])
    for c in range(len(top)):
        part = plain[c * quality.CHUNK:(c + 1) * quality.CHUNK]
        assert np.allclose(part.max(axis=0), top[c], atol=1e-5)
    assert np.allclose(quality.chunk_maxima(x, model["table"]), top)


def test_long_texts_score_the_same_in_pieces(model, monkeypatch):
    data = ("Some text of words words and more %% ".encode() * 90)[:3001]
    whole = quality.probability(data, model)
    for piece in (256, 512, 2816):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert quality.probability(data, model) == pytest.approx(whole, abs=1e-9)


@pytest.mark.parametrize("size", [1, 300, 910, 5_000])
def test_repeated_words_at_borders_of_pieces(model, monkeypatch, size):
    """Long words, long gaps and repeats of repeats keep their mark wherever a piece ends."""
    word = ("0123456789abcdef" * 400)[:size]
    data = f"a {word} {word} b {word}{' ' * 700}{word}\t{word}x {word} {word}".encode() + b" end" * 40
    first, last = quality.repeated_words(data)
    want = quality.symbols(data)
    for a in range(0, len(data) - 60, 37):
        b = min(len(data), a + 300)
        assert (quality.piece_symbols(data, a, b, first, last) == want[a:b]).all()
    whole = quality.probability(data, model)
    for piece in (256, 512, 1024):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert quality.probability(data, model) == pytest.approx(whole, abs=1e-9)


def test_held_out_accuracy_on_the_tables(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) > 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark, model):
    rows = [(1, ""), (2, None), (None, "a"), (3, "x"), (3, "x"), (4, "\n\n  "), (5, "é" * 700)]
    df = spark.createDataFrame([(i, t, "score") for i, t in rows], "doc_id long, text string, score string")
    got = quality.score_quality(df, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out) for r in got) == sorted(
        (i is None, i or 0, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_training_sees_no_held_out_row_and_copes_without_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, None, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    seen = {int(r.text.split()[1]) for r in quality.training_rows(docs, labels, 1000, 100).collect()}
    assert seen == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    flat = quality.train(docs, labels.limit(0))
    assert quality.probability(b"anything", flat) == pytest.approx(0.5)
