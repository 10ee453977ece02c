"""SimHash near-dedup: 64-bit fingerprints linked through the anchors of a covering code.

Two fingerprints that differ in at most 3 bits differ in at most one bit in one of their halves.
In a half of 32 bits, 31 are covered by the perfect [31,26] Hamming code, whose covering
radius is 1, and the last bit is kept as it is. A fingerprint is at home at the one anchor within the
covering radius, and is copied to every anchor within covering radius plus threshold (1 + 1): 17
anchors a half. If x and y differ in at most one bit of the half, y has a copy at the home of x, so
comparing homes with copies at each anchor finds every link.

Only distinct fingerprints are copied, so exact copies cost nothing. An anchor returns no pairs but
a path through each group that it connects. Anchors with more than ``hot`` copies are dealt again by
the four bytes of the other half: three differing bits leave one of four bytes equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import bounded, stored
from boardlake.llm.components import components

SEED = 42
THRESHOLD = 3
PIECE = 1 << 20
PAIRS = 1 << 21


def _words(data: bytes):
    """Lists of words of pieces of about a megabyte, so that no long text becomes one list."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not data[end:end + 1].isspace():
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles of ``text``; 0 without words."""
    bits, n, kept, total = np.zeros(64, dtype=np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest
    for words in _words((text or "").encode().lower()):
        total += len(words)
        words = kept + words
        if len(words) >= size:
            ends = np.cumsum([len(w) + 1 for w in words])
            joined = b" ".join(words)
            starts = [0, *(ends[:-size].tolist())]
            hashes = np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[size - 1:].tolist())],
                              dtype="<u8")
            bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64)
            n += len(hashes)
        kept = words[max(0, len(words) - size + 1):]
    if 0 < total < size:
        return digest(b" ".join(kept), SEED)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Return (doc_id, fp): one row for each row, computed where it is read."""
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long")


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, anchor, home) of every copy of the fingerprints (uint64)."""
    fps, keys, homes = [], [], []
    weights = np.arange(1, 32, dtype=np.uint64)
    for half in (0, 1):
        part = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        code, free = part & np.uint64(0x7FFFFFFF), part >> np.uint64(31)
        bits = (code[:, None] >> (weights - np.uint64(1))) & np.uint64(1)
        syndrome = np.bitwise_xor.reduce(bits * weights, axis=1)
        flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        home = code ^ flip

        def add(which, words, last, own):
            fps.append(fp[which])
            keys.append((np.uint64(half) << np.uint64(32)) | (last << np.uint64(31)) | words)
            homes.append(np.full(len(words), own))

        everyone = np.ones(len(fp), dtype=bool)
        add(everyone, home, free, True)
        add(everyone, home, np.uint64(1) - free, False)
        for i in range(1, 32):  # code words at distance two: flips of i and i ^ syndrome
            other = np.uint64(i) ^ syndrome
            pair = (syndrome > 0) & (other > np.uint64(i))
            second = np.uint64(1) << (np.maximum(other[pair], np.uint64(1)) - np.uint64(1))
            add(pair, code[pair] ^ (np.uint64(1) << np.uint64(i - 1)) ^ second, free[pair], False)
    return np.concatenate(fps), np.concatenate(keys), np.concatenate(homes)


def _paths(labels: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between neighbours in the order of (label, fingerprint): as many as needed, no hub."""
    order = np.lexsort((fp, labels))
    same = labels[order][1:] == labels[order][:-1]
    return fp[order][:-1][same], fp[order][1:][same]


def _group_links(fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths through the connected parts of one large anchor; memory is one block of comparisons."""
    labels = np.arange(len(fp))
    rows = np.flatnonzero(home)
    step = max(1, PAIRS // len(fp))
    while True:
        before = labels.copy()
        for a in range(0, len(rows), step):
            block = rows[a:a + step]
            near = np.bitwise_count(fp[block][:, None] ^ fp[None, :]) <= THRESHOLD
            least = np.where(near, labels[None, :], len(fp)).min(axis=1)
            labels[block] = np.minimum(labels[block], least)
            labels = np.minimum(labels, np.where(near, labels[block][:, None], len(fp)).min(axis=0))
        if (labels == before).all():
            return _paths(labels, fp)


def _links(fp: np.ndarray, home: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Links of many anchors, given as runs of rows."""
    large = size > 16
    for s, n in zip(start[large].tolist(), size[large].tolist()):
        if home[s:s + n].any():
            yield _group_links(fp[s:s + n], home[s:s + n])
    start, size = start[(size > 1) & ~large], size[(size > 1) & ~large]
    if not len(start):
        return
    run = np.repeat(np.arange(len(start)), size)
    row = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    own = home[row]
    left, group = row[own], run[own]
    width = size[group]
    cuts = np.flatnonzero(np.diff(np.cumsum(width) // PAIRS, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        w = width[a:b]
        x = np.repeat(left[a:b], w)
        y = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[group[a:b]], w)
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= THRESHOLD) & (fp[x] != fp[y])
        yield fp[x[near]], fp[y[near]]


def link_fingerprints(distinct: DataFrame, hot: int = 4096) -> DataFrame:
    """Links (a, b) that connect all rows of ``distinct`` (fp) within 3 bits of each other."""
    def copy(batches):
        for batch in batches:
            fp, key, home = anchors_of(batch.column(0).to_numpy().view(np.uint64))
            for a in range(0, len(fp), 1 << 17):
                yield pa.record_batch([pa.array(fp[a:a + (1 << 17)].view(np.int64)),
                                       pa.array(key[a:a + (1 << 17)].view(np.int64)),
                                       pa.array(home[a:a + (1 << 17)])], names=["fp", "anchor", "home"])

    copies = distinct.select("fp").mapInArrow(copy, "fp long, anchor long, home boolean")
    # Whether an anchor is hot is known before its rows are dealt: counts are summed map-side.
    crowded = stored(copies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(
        "anchor", F.lit(True).alias("crowded")), "simhash-hot")
    other = F.when(F.shiftright("anchor", 32) == 0, F.shiftright("fp", 32)).otherwise(F.col("fp"))
    byte = [F.struct(F.col("anchor"), F.lit(i).alias("byte"), F.shiftright(other, 8 * i).bitwiseAND(255).alias("value"))
            for i in range(4)]
    whole = F.array(F.struct(F.col("anchor"), F.lit(-1).alias("byte"), F.lit(0).cast("long").alias("value")))
    dealt = copies.join(crowded, "anchor", "left").select(
        "fp", "home", F.explode(F.when(F.col("crowded"), F.array(*byte)).otherwise(whole)).alias("k")).select(
        "fp", "home", F.xxhash64("k.anchor", "k.byte", "k.value").alias("key"))

    def compare(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                got = [batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False),
                       batch.column(2).to_numpy()]
                rest = got if rest is None else [np.concatenate(p) for p in zip(rest, got)]
            if rest is None:
                return
            fp, home, key = rest
            cut = np.flatnonzero(np.diff(key)) + 1
            start = np.concatenate(([0], cut))
            if batch is not None:  # the last anchor may go on in the next batch
                start, stop = start[:-1], start[-1]
            else:
                stop = len(fp)
            size = np.diff(np.concatenate((start, [stop])))
            for a, b in _links(fp, home, start, size):
                if len(a):
                    yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            rest = [p[stop:] for p in rest]

    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, fingerprint, component_id for every row of ``docs``.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any
    other. Repeated rows are returned each; rows with one id and different texts keep their own
    fingerprints. A row with a null id has a fingerprint and belongs to the component of its
    fingerprint, but names and links none (component_id is null if no row with an id shares its
    fingerprint). An empty table gives an empty result; other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-docs")
    nodes = stored(rows.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")),
                   "simhash-nodes")
    roots = components(link_fingerprints(nodes))
    linked = stored(roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "least"), "simhash-roots")
    least = stored(linked.groupBy("root").agg(F.min("least").alias("component")), "simhash-least")
    of = linked.join(least, "root").select("fp", "component")
    named = stored(nodes.join(of, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")),
                   "simhash-named")
    return rows.join(named, "fp", "left").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each component the row with the smallest id.

    Rows with a null id stay. If several rows have the id that stays, all of them stay.
    """
    found = stored(near_duplicates(docs, id_col, text_col), "simhash-found")
    gone = stored(found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "simhash-gone")
    return docs.join(bounded(gone), id_col, "left_anti")
