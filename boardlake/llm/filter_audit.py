"""Audit of how filters interact, with exact duplicates found by radix tries over whole texts.

Each text fails some of five filters, a mask of five bits. Four of them look at the text alone; the fifth asks whether
a smaller id has the same text anywhere in the table. For it the texts are dealt to ranges by adaptive prefixes: bytes
are counted for prefixes of 4 bytes, prefixes that are too heavy are counted again with 16, 64 and 256 bytes, and
neighbouring prefixes are joined to ranges of bounded weight. What is too heavy even at 256 bytes is divided further by
a checksum of the whole text.

Every task inserts whole texts into compressed tries that hold the smallest id at their terminals and a bounded
weight of texts. A row that meets a smaller id is a duplicate and leaves its text behind; the survivors go to the trie of
their range, which decides. Survivors of hot ranges first meet in salted groups, so copies in all tasks never
meet in one. Masks are then counted by part, mask and label, and every order of the filters is read off these counts.
"""

from __future__ import annotations

import bisect
import itertools
import json
import math
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import bounded, short_batches, stored

FILTERS = "ABCDE"
DUPLICATE = 16  # the bit of filter E
DEPTHS = (4, 16, 64, 256)  # bytes of the prefixes that are counted
RANGE = 2_000_000  # weight of a range: bytes and OVERHEAD for each row
RANGES = 1 << 20  # ranges at most, beyond that they weigh more
OVERHEAD = 400
CHUNK = 8_000_000  # weight of the texts of one trie of the first pass
SUB = 1 << 24  # parts of a range at most

UPPER_CASE = bytes(range(65, 91))
CONTINUED = bytes(range(128, 192))


class Node:
    """An edge label, the edges below by their first byte, and what stands at the terminal, if it is one."""

    __slots__ = ("label", "below", "held")

    def __init__(self, label: bytes):
        self.label, self.below, self.held = label, None, None


def common_length(a: bytes, b: bytes, at: int) -> int:
    """Bytes that ``a`` and ``b[at:]`` share from the start."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if b.startswith(a[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed trie of whole texts."""

    def __init__(self):
        self.root, self.weight = Node(b""), 0

    def insert(self, text: bytes) -> Node:
        """The node at which ``text`` ends."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            below = node.below
            child = below.get(text[at]) if below else None
            if child is None:
                child = Node(text[at:])
                node.below = below or {}
                node.below[text[at]] = child
                return child
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            same = common_length(child.label, text, at)
            fork = Node(child.label[:same])
            child.label = child.label[same:]
            fork.below = {child.label[0]: child}
            node.below[text[at]] = fork
            node, at = fork, at + same
        return node

    def terminals(self):
        """(text, what is held) of every terminal."""
        open_ = [(self.root, b"")]
        while open_:
            node, text = open_.pop()
            if node.held is not None:
                yield text, node.held
            if node.below:
                open_.extend((child, text + child.label) for child in node.below.values())


def earlier(a, b) -> bool:
    """Null ids stand after all others."""
    return a is not None and (b is None or a < b)


class Meeting:
    """A trie whose terminals hold [smallest id, mask, rows by part], and the rows that met a smaller id."""

    def __init__(self):
        self.trie, self.losers = Trie(), []

    def meet(self, doc, part: str, n: int, text: bytes, mask) -> None:
        node = self.trie.insert(text)
        held = node.held
        if held is None:
            self.trie.weight += len(text) + OVERHEAD
            node.held = [doc, mask(text) if callable(mask) else mask, {part: n}]
        elif earlier(doc, held[0]):
            self.losers += [(held[0], p, held[1] | DUPLICATE, k) for p, k in held[2].items()]
            held[0], held[2] = doc, {part: n}
        elif doc == held[0]:
            held[2][part] = held[2].get(part, 0) + n
        else:
            self.losers.append((doc, part, held[1] | DUPLICATE, n))

    def winners(self):
        """(id, part, mask, n, text): the rows of the smallest id of each text."""
        for text, (doc, mask, parts) in self.trie.terminals():
            for part, n in parts.items():
                yield doc, part, mask, n, text


def text_mask(words: int, distinct: int, upper: int, symbols: str):
    """Failed filters A to D of a text: too few words, too few distinct words, too many capitals, symbols."""
    signs = symbols.encode()

    def mask(text: bytes) -> int:
        found = text.split()  # bytes split at ASCII white space
        n = len(found)
        capitals = n and len(text) - len(text.translate(None, UPPER_CASE))
        return ((n < words) + 2 * (100 * len(set(found)) < distinct * n)
                + 4 * (100 * capitals > upper * len(text.translate(None, CONTINUED)))
                + 8 * (len(text.translate(None, signs)) < len(text)))

    return mask


def prefix_leaves(docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """Stored (prefix, weight) of prefixes that no other one begins with, each as short as ``most`` allows."""
    whole = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    leads = stored(docs.select(F.substring(whole, 1, DEPTHS[-1]).alias("lead"),
                               (F.octet_length(whole) + OVERHEAD).alias("weight")), "trie-leads")
    leaves, rows = None, leads
    for depth in DEPTHS:
        counted = stored(rows.groupBy(F.substring("lead", 1, depth).alias("prefix")).agg(
            F.sum("weight").alias("weight")), "trie-prefixes")
        deeper = (F.col("weight") > most) & (F.octet_length("prefix") == depth) & F.lit(depth < DEPTHS[-1])
        light = counted.where(~deeper)
        leaves = light if leaves is None else leaves.unionByName(light)
        heavy = stored(counted.where(deeper).select("prefix"), "trie-heavy")
        if heavy.isEmpty():
            break
        rows = leads.join(bounded(heavy, 200_000), F.substring("lead", 1, depth) == F.col("prefix"), "left_semi")
    return leaves


def text_ranges(docs: DataFrame, text_col: str) -> tuple[list[bytes], list[int], int]:
    """First prefix of every range, in order, the parts of each range, and the weight of all rows.

    There are at most some RANGES of them, whatever the table, each with a prefix of at most 256 bytes.
    """
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD), F.lit(0))).first()[0]
    most = max(RANGE, total // RANGES)

    def cut(batches):
        """Neighbouring prefixes of one task joined up to the weight of a range."""
        first, weight = None, 0
        for batch in batches:
            starts, weights = [], []
            for prefix, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is not None and weight + w > most:
                    starts.append(first)
                    weights.append(weight)
                    first, weight = prefix, w
                else:
                    first, weight = prefix if first is None else first, weight + w
            yield pa.record_batch([pa.array(starts, pa.binary()), pa.array(weights, pa.int64())], names=["start", "weight"])
        if first is not None:
            yield pa.record_batch([pa.array([first], pa.binary()), pa.array([weight], pa.int64())], names=["start", "weight"])

    leaves = prefix_leaves(docs, text_col, most)
    rows = leaves.repartitionByRange("prefix").sortWithinPartitions("prefix").mapInArrow(
        cut, "start binary, weight long").collect()
    found = sorted((bytes(r.start), r.weight) for r in rows)
    starts = [b"", *[s for s, _ in found[1:]]]
    parts = [1 if w <= 2 * most else min(SUB, -(-w // most)) for _, w in found] or [1]
    return starts, parts, total


def _batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    doc, part, mask, n, range_, salt, text = zip(*rows) if rows else [()] * 7
    return pa.record_batch([pa.array(doc, kind), pa.array(part, pa.string()), pa.array(mask, pa.int32()),
                            pa.array(n, pa.int64()), pa.array(range_, pa.int64()), pa.array(salt, pa.int32()),
                            pa.array(text, pa.binary())], names=["doc", "part", "mask", "n", "range", "salt", "text"])


def masks(docs: DataFrame, words: int = 200, distinct: int = 50, upper: int = 2, symbols: str = "#$%&*|",
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return doc, part, mask, n: the failed filters of all rows, n equal rows as one.

    Bits 1, 2, 4, 8, 16: fewer than ``words`` words; distinct words below ``distinct`` percent; capitals A-Z
    above ``upper`` percent of the code points; any of ``symbols``; the text of a smaller id.
    Nulls: a null text is the empty text, a null source the part with the empty name, a null id stands after all others.
    Rows that repeat an id and its text are no duplicates of each other, since none has a smaller id.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    starts, parts, total = text_ranges(docs, text_col)
    shared = spark.sparkContext.broadcast((starts, parts))
    salts = max(1, math.isqrt(total // CHUNK))
    mask = text_mask(words, distinct, upper, symbols)
    schema = f"doc {kind}, part string, mask int, n long, range long, salt int, text binary"

    def range_of(text: bytes) -> tuple[int, bool]:
        starts, parts = shared.value
        k = bisect.bisect_right(starts, text) - 1
        return k * SUB + zlib.crc32(text) % parts[k], parts[k] > 1

    def first_pass(batches):
        salt, meeting = TaskContext.get().partitionId() % salts, Meeting()

        def flush(kind):
            rows = [(*loser, None, None, None) for loser in meeting.losers]
            for *row, text in meeting.winners():
                number, hot = range_of(text)
                rows.append((*row, number, salt if hot else None, text))
            for a in range(0, len(rows), 1000):
                yield _batch(rows[a:a + 1000], kind)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                meeting.meet(doc, part, 1, text, mask)
            if meeting.trie.weight > CHUNK:
                yield from flush(id_type)
                meeting = Meeting()
        if id_type is not None:
            yield from flush(id_type)

    def merge(keep_texts: bool):
        def run(group: pa.Table) -> pa.Table:
            meeting = Meeting()
            for doc, part, m, n, number, salt, text in zip(*(c.to_pylist() for c in group.columns)):
                meeting.meet(doc, part, n, text, m)
            rows = [(*loser, None, None, None) for loser in meeting.losers]
            number = group.column("range")[0].as_py()
            rows += [(*row, number, None, text if keep_texts else None) for *row, text in meeting.winners()]
            return pa.Table.from_batches([_batch(rows, group.schema.field(0).type)])

        return run

    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with short_batches(spark):
        first = stored(rows.mapInArrow(first_pass, schema), "trie-first")
    left = first.where(F.col("text").isNotNull() & F.col("salt").isNull())
    done = [first.where(F.col("text").isNull())]
    if any(p > 1 for p in parts):
        hot = stored(first.where(F.col("salt").isNotNull()).groupBy("range", "salt").applyInArrow(
            merge(True), schema), "trie-hot")
        left = left.unionByName(hot.where(F.col("text").isNotNull()))
        done.append(hot.where(F.col("text").isNull()))
    out = left.groupBy("range").applyInArrow(merge(False), schema)
    for more in done:
        out = out.unionByName(more)
    return out.select("doc", "part", "mask", "n")


def orders() -> list[dict]:
    """All orders of the filters, step by step: the filters before it and up to it, as masks."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step, "f": f, "before": before,
                        "after": before | 1 << f})
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", **limits) -> DataFrame:
    """Return part, filter_order, step and the counts of every step of every order of the filters.

    Columns: kept after the step, removed at it, redundant (fails this filter, gone before), unique_fails
    (fails this one alone), good_lost and toxic_lost (removed with quality or toxic label 1), shapley (removed by this filter, summed
    over all orders). ``limits``: see :func:`masks`, also for nulls and repeated rows; rows with equal ids count
    one by one. Labels of one id count as 1 if any of its rows is; null ids have none. Very long texts are compared
    whole, one edge of the trie may hold most of one. A part without rows has no lines, an empty table an empty result.
    Columns of other names are not read.
    """
    flags = masks(docs, id_col=id_col, text_col=text_col, source_col=source_col, **limits)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")])
    by_mask = flags.groupBy("doc", "part", "mask").agg(F.sum("n").alias("n")).join(known, "doc", "left").groupBy(
        "part", "mask", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    ).agg(F.sum("n").alias("n"))
    passing = range(1 << len(FILTERS))

    def left(value: Column) -> Column:
        """Sums of ``value`` over rows that fail none of each set of filters."""
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, value).otherwise(0)) for s in passing])

    sums = by_mask.groupBy("part").agg(left(F.col("n")).alias("all"), left(F.col("n") * F.col("quality")).alias("good"),
                                       left(F.col("n") * F.col("toxic")).alias("toxic"))
    size = len(FILTERS)
    shares = []
    for f in range(size):
        terms = [F.lit(math.factorial(s.bit_count()) * math.factorial(size - 1 - s.bit_count()))
                 * (F.get("all", F.lit(s)) - F.get("all", F.lit(s | 1 << f))) for s in passing if not s >> f & 1]
        shares.append(sum(terms[1:], terms[0]))
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>")
    rows = sums.withColumn("shapley", F.array(*shares)).select("*", F.inline(steps))

    def lost(which: str) -> Column:
        return F.get(which, F.col("before")) - F.get(which, F.col("after"))

    alone = F.expr("shiftleft(1, f)")
    return rows.select(
        "part", "filter_order", "step", F.get("all", F.col("after")).alias("kept"), lost("all").alias("removed"),
        (F.get("all", F.lit(0)) - F.get("all", alone) - lost("all")).alias("redundant"),
        (F.get("all", F.lit((1 << size) - 1) - alone) - F.get("all", F.lit((1 << size) - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("f")).alias("shapley"))
