"""Packing against plain concatenation and cutting with the vocabulary's library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boardlake.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(12)
    odd = ["", " ", "\n\n x\t\ty ", "it's we'll", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "éà ß ñ", "日本語",
           "a" * 700, "   x", "x\x85y", "\x1c\x1d b", "12 345", "w " * 3000,
           "½ cup, 3² = 9, Ⅷ x①", "é_a__ é b_", "٣٤ é 12५ x", "é\u0301\u0915\u094d é's é'x", "é \u3000\u2028 x\xa0 y"]
    return odd + ["".join(rng.choice("abcdeéE 1'.,!\n\t’日") for _ in range(rng.randrange(1, 900))) for _ in range(120)]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, documents, length):
    """Every id of every document lies in one piece, sequences are gapless and full or a power of two."""
    held, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert ids
        held.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
        sequences.setdefault(p.sequence_id, []).append((p.offset, len(ids)))
    got = sorted((d, n, sum((i for _, i in sorted(parts)), [])) for (d, n), parts in held.items())
    assert got == sorted((d, len(ids), ids) for d, ids in documents)
    for parts in held.values():
        at = 0
        for start, ids in sorted(parts):
            assert start == at
            at += len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
    assert sum(n for parts in sequences.values() for _, n in parts) == sum(len(i) for _, i in documents)
    assert sum(sum(n for _, n in parts) < length for parts in sequences.values()) <= length.bit_length()


@pytest.mark.parametrize("length,parts", [(2048, 5), (64, 1), (100, 7), (1, 3)])
def test_pieces(spark, library, length, parts):
    rows = list(enumerate(texts()))[:None if length > 1 else 12]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    pieces = packing.pack(df, PATH, length).collect()
    if length > 1:
        check(pieces, [(i, ids_of(library, t)) for i, t in rows], length)
    else:
        assert len(pieces) == sum(len(ids_of(library, t)) for _, t in rows)


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, 1, "x"), (None, "null id", 2, "y"), (None, "other", 2, "y"), (5, "again", 3, "z"), (5, "again", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, ids string")
    pieces = packing.pack(df, PATH, 4).collect()
    got = sorted(((p.doc_id, p.start, len(p.ids) // 4) for p in pieces), key=repr)
    assert sum(n for *_, n in got) == sum(len(ids_of(library, t)) for _, t, *_ in rows)
    assert (1, 0, 1) in got
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    text = " ".join(texts()) + " 12 words 'll, " * 50
    monkeypatch.setattr(packing, "PIECE", 300)
    assert list(map(len, packing.stretches(text, 300)))[0] < len(text)
    assert "".join(packing.stretches(text, 300)) == text
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read(), memory=20)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert list(packing.stretches("x" * 1000, 300)) == ["x" * 1000]


def test_both_patterns_agree():
    """On all the characters for which both are used."""
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    letters = [chr(c) for c in range(0x3000) if packing.COMMON.fullmatch(chr(c))]
    rng = random.Random(1)
    for a in range(0, len(letters), 50):
        text = "é" + "".join(rng.choice(letters[a:a + 50] + list(" a1'!")) for _ in range(400))
        assert encoder.common.findall(text) == encoder.pieces.findall(text)


def test_other_tokenizer_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoder = packing.Encoder(open(path, encoding="utf-8").read())
    assert not encoder.plain
    for t in texts()[:20]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_partition_offsets_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    totals = [(p, 10 + p) for p in range(20) if p % 4]
    got = {r.part: r.offset for r in packing.partition_offsets(spark.createDataFrame(totals, "part int, tokens long")).collect()}
    at = 0
    for p, n in totals:
        assert got[p] == at
        at += n


def test_sequences(spark, library):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.sequences(packing.pack(df, PATH, 64)).orderBy("sequence_id").collect()
    assert [r.sequence_id for r in out] == list(range(len(out)))
    assert all(len(r.ids) == 4 * r.n_tokens for r in out) and all(r.n_tokens == 64 for r in out[:-6])
    total = [i for r in out for i in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    assert sorted(total) == sorted(i for _, t in rows for i in ids_of(library, t))


def test_query_over_the_whole_table(spark, sf, library):
    docs = {r.doc_id: ids_of(library, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = 0
    for p in queries.QUERIES["op12_packing"](spark, sf).collect():
        part = docs[p.doc_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(docs[p.doc_id])
        assert 0 <= p.offset and p.offset + p.length <= 2048
        seen += p.length
    assert seen == sum(map(len, docs.values()))
