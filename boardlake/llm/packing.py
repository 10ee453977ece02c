"""Packing by concatenate and cut.

The token ids of all documents stand behind each other in one long row, which is cut into windows of fixed
length. The first pass encodes every document where it is read, stores its ids with the tokens before it in its
partition, and sums the tokens of each partition. Prefix sums over these totals, first inside blocks of partitions
and then over the blocks, give every partition its place in the long row. The second pass cuts each
document at the window borders: a boundary record for each piece says in which window it lies and where. What is
left behind the last full window is cut into windows of powers of two, so nothing is padded.

Ids never move between tasks; the second pass reads what the first has stored and needs only the totals.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boardlake.llm.common import bounded, short_batches
from boardlake.llm.tokens import PRE_TOKEN, PRE_TOKEN_ASCII, SPACE, byte_letters
from boardlake.session import shared_folder

LENGTH = 2048
BLOCK = 1024  # partitions whose totals one task adds up
PIECE = 1 << 20  # characters that are cut into pre-tokens at a time
WIDTH = 4  # bytes of an id
#: The same pre-token pattern for the faster of two pattern libraries; it holds for texts of the letters and signs below.
PRE_TOKEN_COMMON = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])"
                    rf"|[{SPACE}]+")
#: Latin letters and general punctuation, without the digits above the line and the fractions, which it takes for letters.
COMMON = re.compile(r"[\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]*")


class _Remembered(dict):
    """Pre-token -> its ids as bytes; a missing one is merged by the library."""

    def __init__(self, library: Tokenizer, memory: int):
        super().__init__()
        self.tokenize, self.memory, self.letters = library.model.tokenize, memory, dict(enumerate(byte_letters()))
        self.spelled = [k.to_bytes(WIDTH, "little") for k in range(library.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([self.spelled[t.id] for t in self.tokenize(spelled)])
        if len(piece) <= 64:
            if len(self) >= self.memory:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, as the library gives them for one tokenizer file.

    For plain byte-level files each pre-token is merged by the library once and remembered; texts go through other
    files of the library as they are.
    """

    def __init__(self, source: str, memory: int = 1_000_000):
        spec, self.library = json.loads(source), Tokenizer.from_str(source)
        pre = spec["pre_tokenizer"] or {}
        self.plain = (spec["model"]["type"], pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"),
                      spec["normalizer"]) == ("BPE", "ByteLevel", False, True, None)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        # Longer strings first: the leftmost longest special string is cut out of a text.
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")"
                                  ) if special else None
        self.pieces, self.common, self.ascii_pieces = (
            regex.compile(PRE_TOKEN), re.compile(PRE_TOKEN_COMMON), re.compile(PRE_TOKEN_ASCII))
        self.ids = _Remembered(self.library, memory)

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian numbers."""
        if not self.plain:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.special.split(text) if self.special is not None else [text]
        return b"".join(self.special_ids[p] if k % 2 else self._ordinary(p) for k, p in enumerate(parts))

    def _ordinary(self, text: str) -> bytes:
        find = (self.ascii_pieces if text.isascii() else self.common if COMMON.fullmatch(text) else self.pieces).findall
        if len(text) <= PIECE:
            return b"".join(map(self.ids.__getitem__, find(text)))
        return b"".join(b"".join(map(self.ids.__getitem__, find(part))) for part in stretches(text, PIECE))


def stretches(text: str, size: int):
    """Parts of a long text, cut in front of a space between two words, where a pre-token always begins."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and not (text[cut - 1].isalnum() and text[cut + 1:cut + 2].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(maxsize=1)
def encoder(source: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(source)


def encoded(docs: DataFrame, vocabulary: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """First pass, stored: (doc, part, before, n, ids); ``before`` are the tokens ahead in the same partition."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encode, part, before = encoder(shared.value).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encode(t.as_py()) + tail for t in batch.column(1)]
            n = np.array([len(x) // WIDTH for x in ids], np.int64)
            ends = before + np.cumsum(n)
            yield pa.record_batch([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(ends - n),
                                   pa.array(n), pa.array(ids, pa.binary())], names=["doc", "part", "before", "n", "ids"])
            before += int(n.sum())

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, part int, before long, n long, ids binary"
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    path = shared_folder(docs.sparkSession, "pack-ids")
    with short_batches(docs.sparkSession):
        rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def partition_offsets(totals: DataFrame) -> DataFrame:
    """(part, tokens) -> (part, offset): sums of earlier partitions, by blocks, then over the blocks."""
    blocks = totals.withColumn("block", F.floor(F.col("part") / F.lit(BLOCK)))
    rows = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(*rows)
    over = Window.orderBy("block").rowsBetween(*rows)
    ahead = blocks.groupBy("block").agg(F.sum("tokens").alias("sum")).select(
        "block", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("ahead"))
    return blocks.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(ahead, "block").select(
        "part", (F.col("ahead") + F.col("within")).alias("offset"))


def tail_windows(total: int, length: int) -> list[tuple[int, int, int]]:
    """(start, end, sequence) of the windows of powers of two behind the last full window."""
    full, out = total // length, []
    at, left, sequence = full * length, total - full * length, full
    while left:
        size = 1 << (left.bit_length() - 1)
        out.append((at, at + size, sequence))
        at, left, sequence = at + size, left - size, sequence + 1
    return out


def windows_of(at: Column, n: Column, total: int, length: int) -> Column:
    """The windows that the ids at, ..., at + n - 1 of the long row meet, as (start, end, sequence)."""
    full = total // length
    kind = "array<struct<start:bigint,end:bigint,sequence:bigint>>"
    first, last = F.floor(at / F.lit(length)), F.floor((at + n - 1) / F.lit(length))
    last_full = F.least(last, F.lit(full - 1))
    whole = F.when(first <= last_full, F.transform(F.sequence(first, F.greatest(first, last_full)), lambda w: F.struct(
        (w * length).alias("start"), ((w + 1) * length).alias("end"), w.alias("sequence")))).otherwise(
        F.array().cast(kind))
    tail = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(("start", "end", "sequence"), w)])
                     for w in tail_windows(total, length)]).cast(kind)
    met = F.filter(tail, lambda w: (w["start"] < at + n) & (w["end"] > at))
    return F.when(last < full, whole).otherwise(F.concat(whole, met))


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Return doc_id, start, ids, doc_tokens, sequence_id, offset for every piece of every document.

    A document is the ids of its text by the library of ``vocabulary``, without added special tokens, then ``end``.
    ``ids`` are the ids of the piece, four bytes each, little-endian; ``start`` counts the document's ids before it, ``offset`` the ids
    before it in its sequence. Sequences have ``length`` ids; what is left at the end makes sequences of powers of
    two. Documents keep the order in which they are read, so the same files give the same sequences.

    Null and empty texts are the id ``end`` alone. A very long text is encoded a megabyte of characters at a time and cut
    into as many pieces as it meets windows. Repeated rows and rows with a null id are documents
    like any other. An empty table gives no pieces. Other columns are not read.
    """
    rows = encoded(docs, vocabulary, end, id_col, text_col)
    totals = rows.groupBy("part").agg(F.sum("n").alias("tokens"))
    path = shared_folder(docs.sparkSession, "pack-totals")
    totals.write.parquet(path)
    totals = docs.sparkSession.read.schema(totals.schema).parquet(path)
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    placed = rows.join(bounded(partition_offsets(totals)), "part").select(
        "doc", "n", "ids", (F.col("offset") + F.col("before")).alias("at"))
    at, n = F.col("at"), F.col("n")

    def piece(w: Column) -> Column:
        start = F.greatest(w["start"], at)
        size = F.least(w["end"], at + n) - start
        return F.struct((start - at).alias("start"), F.substring("ids", ((start - at) * WIDTH + 1).cast("int"), (
            size * WIDTH).cast("int")).alias("ids"), w["sequence"].alias("sequence_id"), (start - w["start"]).alias("offset"))

    cut = placed.select("doc", "n", F.inline(F.transform(windows_of(at, n, total, length), piece)))
    return cut.select(F.col("doc").alias(id_col), "start", "ids", F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, n_tokens, ids, documents) of packed pieces; a group is one sequence, so it has a fixed bound."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("doc"))))
    rows = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("p.doc").alias("documents")).withColumn(
        "n_tokens", (F.octet_length("ids") / WIDTH).cast("long"))
