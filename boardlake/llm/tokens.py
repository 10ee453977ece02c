"""Token counts by the whole-token shortcut.

A byte-pair tokenizer cuts a text into pre-tokens and merges the bytes of each one. Which
strings of the vocabulary end as one token when they stand alone is proved once, by merging each
of them. A pre-token among them counts 1 by a lookup; only the others are merged.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level tokenizers, with white space as Unicode lists it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
#: The same pattern for texts of ASCII characters only.
PRE_TOKEN_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


NEVER = 1 << 60  # rank of a pair that is not merged


class ByteMerger:
    """Vocabulary of one byte-level tokenizer file, its merges and its special strings."""

    def __init__(self, source: str, memory: int = 500_000):
        spec = json.loads(source)
        pre = spec["pre_tokenizer"]
        if (spec["model"]["type"], pre["type"], pre["add_prefix_space"], pre["use_regex"], spec["normalizer"]) != (
                "BPE", "ByteLevel", False, True, None):
            raise ValueError("not a plain byte-level tokenizer file")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        special = [t["content"] for t in spec["added_tokens"]]
        # Longer strings first: the leftmost longest special string is cut out of a text.
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
                                     ) if special else None
        self.pieces, self.ascii_pieces = regex.compile(PRE_TOKEN), re.compile(PRE_TOKEN_ASCII)
        self.memory = memory
        self.known: dict[str, int] = {}
        self.whole = self.prove(spec["model"]["vocab"])

    def spell(self, piece: str) -> list[str]:
        return [self.letters[b] for b in piece.encode()]

    def merge_count(self, parts: list[str]) -> int:
        """Tokens left when the pair of lowest rank, the leftmost of equals, is merged again and again."""
        rank = self.rank.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
        return len(parts)

    def prove(self, vocab: dict[str, int]) -> frozenset[str]:
        """Vocabulary strings that are valid text and merge to exactly one token when alone."""
        back = {letter: b for b, letter in enumerate(self.letters)}
        found = []
        for word in vocab:
            if not all(c in back for c in word):
                continue  # a special string
            try:
                text = bytes(back[c] for c in word).decode()
            except UnicodeDecodeError:
                continue
            if self.merge_count(list(word)) == 1:
                found.append(text)
        return frozenset(found)

    def piece_count(self, piece: str) -> int:
        """Merge a piece; short ones are remembered."""
        if len(piece) > 200:
            return self._long(piece)
        if len(self.known) >= self.memory:
            self.known.clear()
        n = self.known[piece] = self.merge_count(self.spell(piece))
        return n

    def _long(self, piece: str) -> int:
        """The same count with a heap: long pieces need n log n steps, not n * n."""
        import heapq
        parts = self.spell(piece)
        nxt, prev = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < len(parts):
                r = self.rank.get((parts[i], parts[j]))
                if r is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(len(parts)):
            push(i)
        left = len(parts)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[i] < len(parts):
                prev[nxt[i]] = i
            left -= 1
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return left

    def count(self, text: str) -> int:
        n, rest = 0, [text]
        if self.special is not None and self.special.search(text):
            rest = self.special.split(text)
            n = len(rest) - 1
        whole, known, piece_count = self.whole, self.known.get, self.piece_count
        for part in rest:
            pieces = (self.ascii_pieces if part.isascii() else self.pieces).findall(part)
            n += len(pieces)
            for p in pieces:
                if p not in whole:
                    n += (known(p) or piece_count(p)) - 1
        return n


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Return id, n_bytes, n_tokens, over_limit for every row.

    ``vocabulary`` is the path of a byte-level tokenizer file; the driver reads it once, proves the
    whole tokens and broadcasts both (the size of a vocabulary, whatever the corpus). Null texts count as empty and have no tokens; repeated rows and null
    ids are counted like any other row; an empty table gives an empty result. Special strings inside texts are
    one token each, as the file's library does by default. Rows are counted where they are read, without any
    exchange; one text at a time is in memory besides its batch.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(ByteMerger(file.read()))

    def run(batches):
        merger = shared.value  # one copy for each Python worker, kept from task to task
        for batch in batches:
            counts = [merger.count(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                                  names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
