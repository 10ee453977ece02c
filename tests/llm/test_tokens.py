"""Token counts against the library of the vocabulary file."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boardlake.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merger():
    return tokens.ByteMerger(open(PATH, encoding="utf-8").read(), memory=50)


def texts():
    rng = random.Random(8)
    odd = ["", " ", "  a", "a  ", "\n\n x\t\ty ", "it's we'll I'M 'd", "123 4567,89", "<|endoftext|>", "a<|endoftext|><|endoftext|> b",
           "<|endoftext", "éà ß ñ", "日本語のテキスト", "\U0001f600\U0001f680 ok", "a" * 700, "ab" * 600, "\u00a0 \u2003x", "x\r\ny", "\x00\x01", "a\x1c\x1d b\x1e \x1f", "a\x85b \x0b\x0c c", "\u180e \u200b\u2028x\u3000", "x\t\t", "\t y",
           "Zz" * 300 + "9" * 400 + "!" * 500 + " " * 300, "don’t"]
    alphabet = "abcdeéE 1'.,!\n\t’日"
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(150)]


def test_counts_equal_the_library(library, merger):
    for t in texts():
        assert merger.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t[:60])


def test_whole_tokens_are_proved(library, merger):
    sample = sorted(merger.whole)[::97]
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sample)
    assert "<|endoftext|>" not in merger.whole and len(merger.whole) > 40_000


def test_heap_and_plain_merges_agree(merger):
    for t in texts():
        piece = t[:300]
        if piece:
            assert merger._long(piece) == merger.merge_count(merger.spell(piece))


def test_query_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (3, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.count_tokens(df, PATH, limit=100).collect()), key=repr)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want, key=repr)
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0
