"""Exact repeat removal with a logarithmic family of sparse suffix arrays.

A repeat is a string of ``LENGTH`` bytes that also starts earlier: in a document with a smaller id, or
in the same one at an earlier place. Of all suffixes it is enough to keep those that start at the
minimizer of some window of LENGTH bytes (the leftmost HEAD-byte string of smallest hash): equal
windows have their minimizer at the same place. All neighbouring windows with one minimizer form an entry:
the fingerprint of the suffix's first HEAD bytes (its head), the document, the place, and the text that
these windows cover. A level of the family is such a suffix array as a stored table, in the order of heads and
text. Documents come in batches by ascending id. The entries of a new batch are merge-scanned
with all levels by head; what has an earlier equal window is a repeat, and entries with a new window
become a level of their own. Before the next batch, levels of equal size are merged, so that their sizes are
powers of two and their number is logarithmic.

Before the family is built, heads are counted over the whole corpus. A head that occurs once cannot lie in a
repeat, so only entries with repeated heads carry their text. Their set goes to the tasks as a bit
table of fixed size: the more heads, the more entries pass for nothing, but none is ever lost. Heads that are
very frequent would meet in one task; their entries are dealt window by window instead.

Entries travel in blocks: all entries of a task (or of some tens of megabytes of text) that belong to one range of heads are
one packed array, so tables and shuffles hold few rows of compressed numbers. The number of ranges follows from the bytes of the
corpus. As blocks are tasks times ranges, a range of a large corpus is wide and is scanned slice by slice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import bounded, short_batches, stored

LENGTH = 100
HEAD = 40
PIECE = 1 << 16
HELD = 1 << 20  # entries (or spans) that are held at a time before they are dealt to ranges
TEXT = 1 << 25  # bytes of text that entries held carry at most, about
BITS = 26
LAST = np.iinfo(np.int64).max  # stands for a null id: after all others
BLOCK = "level int, bucket long, blob binary"
SPAN, NEW = -1, 0  # level of a block of found repeats, of new entries; blocks of the family have 1 or more
RANGE = 16_000  # entries of one head range or of a slice of it, about
FEW = 256  # beyond so many ranges they become wider
WIDE = 128_000  # entries of one range, about, where there are more than FEW

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of the two hash bases and of their inverses, as long as a piece needs."""

    def __init__(self):
        self.size = 0

    def get(self, n: int):
        if n > self.size:
            self.size = n + 4096
            with np.errstate(over="ignore"):
                self.up = [np.cumprod(np.concatenate(([_U(1)], np.full(self.size, b))), dtype=_U) for b in _BASES]
                self.down = [np.cumprod(np.concatenate(([_U(1)], np.full(self.size, _U(_inverse(int(b)))))), dtype=_U)
                             for b in _BASES]
        return self.up, self.down


_POWERS = _Powers()
_TABLE = np.random.default_rng(20240229).integers(1, 2 ** 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)


def prefix_sums(x: np.ndarray, which: int) -> np.ndarray:
    up, _ = _POWERS.get(len(x) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, _U), np.cumsum(_TABLE[which][x] * up[which][:len(x)], dtype=_U)))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def span_hash(sums: np.ndarray, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of bytes a..b, whatever their place."""
    _, down = _POWERS.get(len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[b] - sums[a]) * down[which][a] + (b - a).astype(_U))


def entries_of(x: np.ndarray, ends: np.ndarray):
    """Entries of a buffer of texts that end at ``ends``: (start, n, anchor, head, g) arrays.

    A window that crosses the end of a text is none.
    """
    n = len(x) - LENGTH + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, _U)] * 2
    sums = prefix_sums(x, 0)
    k = np.arange(len(x) - HEAD + 1)
    heads = span_hash(sums, 0, k, k + HEAD)
    # Leftmost minimum of LENGTH - HEAD + 1 heads: minima of doubling spans, two of which cover the window.
    best, at, span, width = heads, k, 1, LENGTH - HEAD + 1
    while span * 2 <= width:
        right = best[span:] < best[:-span]
        best, at = np.where(right, best[span:], best[:-span]), np.where(right, at[span:], at[:-span])
        span *= 2
    rest = width - span
    if rest:
        right = best[rest:rest + n] < best[:n]
        at = np.where(right, at[rest:rest + n], at[:n])
    at = at[:n]
    inside = np.ones(n, dtype=bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - LENGTH + 1):e] = False
    # An entry is a run of windows with one minimizer inside one text.
    first = inside & np.concatenate(([True], (at[1:] != at[:-1]) | ~inside[:-1]))
    start = np.flatnonzero(first)
    last = inside & np.concatenate(((at[1:] != at[:-1]) | ~inside[1:], [True]))
    size = np.flatnonzero(last) - start + 1
    with np.errstate(over="ignore"):
        g = span_hash(prefix_sums(x, 1), 1, start, start + size + LENGTH - 1)
    # Minima are small numbers: mixed once more, heads spread over all ranges again.
    return start, size, at[start] - start, mixed(heads[at[start]] ^ _BASES[1]), g


def pack(columns: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Integer columns of one length, as byte planes, and a tail, compressed."""
    planes = [np.ascontiguousarray(c.astype(c.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(c), -1).T.tobytes()
              for c in columns]
    head = np.array([len(columns[0]) if columns else 0], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes) + tail)


def unpack(blob: bytes, kinds: str) -> tuple[list[np.ndarray], bytes]:
    """The columns of the given dtypes and the tail."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for kind in kinds.split():
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out, data[at:]


class Entries:
    """Columns head, g, doc, sig, start, size, and the texts of those entries that need one."""

    KINDS = "<u8 <u8 <i8 <i8 <i8 <i4 <i4"

    def __init__(self, columns: list[np.ndarray], text: np.ndarray):
        self.columns, self.text = columns, text
        self.head, self.g, self.doc, self.sig, self.start, self.size, self.length = columns

    def __len__(self) -> int:
        return len(self.head)

    def take(self, rows: np.ndarray) -> Entries:
        ends = np.cumsum(self.length, dtype=np.int64)
        begin, length = (ends - self.length)[rows], self.length[rows]
        return Entries([c[rows] for c in self.columns], gather(self.text, begin, length))

    def runs(self, bucket: np.ndarray):
        """(bucket, entries) of entries that stand in the order of ``bucket``."""
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(self))
        ends = np.concatenate(([0], np.cumsum(self.length, dtype=np.int64)))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield int(bucket[a]), Entries([c[a:b] for c in self.columns], self.text[ends[a]:ends[b]])

    def pack(self) -> bytes:
        return pack([c.astype(k) for c, k in zip(self.columns, self.KINDS.split())], self.text.tobytes())

    @staticmethod
    def unpack(blob: bytes) -> Entries:
        columns, tail = unpack(blob, Entries.KINDS)
        return Entries(columns, np.frombuffer(tail, np.uint8))

    @staticmethod
    def concat(parts: list[Entries]) -> Entries:
        return Entries([np.concatenate(c) for c in zip(*(p.columns for p in parts))],
                       np.concatenate([p.text for p in parts]))


def gather(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes x[start : start + size] of all rows in one array; indexes are made a few megabytes at a time."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a in range(0, len(ends), 8192):
        b = min(a + 8192, len(ends))
        low, high = int(ends[a] - size[a]), int(ends[b - 1])
        out[low:high] = x[np.arange(low, high) + np.repeat(start[a:b] - (ends[a:b] - size[a:b]), size[a:b])]
    return out


def dealt(bucket: np.ndarray):
    """(bucket, rows) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def blocks(level: int, found, batch: int = 2048):
    """Record batches of (bucket, blob)."""
    rows = []
    for row in found:
        rows.append(row)
        if len(rows) == batch:
            yield _blocks(level, rows)
            rows = []
    if rows:
        yield _blocks(level, rows)


def _blocks(level: int, rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([level] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int64()),
                            pa.array([x for _, x in rows], pa.binary())], names=["level", "bucket", "blob"])


def top(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


class Screen:
    """Bit tables of the heads that occur twice and of those with several texts, and the hot heads (40 bits)."""

    def __init__(self, bits: int, ranges: int, repeated: np.ndarray, several: np.ndarray, hot: np.ndarray):
        self.bits, self.ranges, self.repeated, self.several, self.hot = bits, ranges, repeated, several, hot

    def _in(self, table: np.ndarray, heads: np.ndarray) -> np.ndarray:
        at = top(heads, self.bits)
        return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def marks(self, heads: np.ndarray):
        return self._in(self.repeated, heads), self._in(self.several, heads), np.isin(heads >> _U(24), self.hot)


def _pieces(batch, width: int):
    """Buffers of about PIECE bytes: (bytes, ends, row of each text, its offset in the row's text)."""
    parts, ends, rows, offsets, total = [], [], [], [], 0
    for row, text in enumerate(batch.column(width)):
        data = (text.as_py() or "").encode()
        if len(data) < LENGTH:
            continue
        for a in range(0, len(data) - LENGTH + 1, PIECE):
            part = data[a:a + PIECE + LENGTH - 1]  # windows that start in this piece
            parts.append(part)
            total += len(part)
            ends.append(total)
            rows.append(row)
            offsets.append(a)
            if total >= PIECE:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(rows), np.array(offsets)
                parts, ends, rows, offsets, total = [], [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(rows), np.array(offsets)


def _spans(doc, sig, start, size, ranges: int):
    """Blocks of found repeats, dealt by document; those that touch in one text are joined."""
    doc, sig, start, end = joined_spans(doc, sig, start, size)
    with np.errstate(over="ignore"):
        bucket = top(mixed(doc.view(_U) * _BASES[0] + sig.view(_U)), ranges)
    return blocks(SPAN, ((b, pack([c[r].astype("<i8") for c in (doc, sig, start, end)])) for b, r in dealt(bucket)))


def joined_spans(doc, sig, start, size):
    """(doc, sig, start, end) of the maximal runs."""
    order = np.lexsort((start, sig, doc))
    doc, sig, start, end = doc[order], sig[order], start[order], (start + size)[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1])))
    rank = np.cumsum(new) - 1
    reach = np.maximum.accumulate(end + rank * (1 << 40)) - rank * (1 << 40)  # running end inside each text
    cut = np.flatnonzero(new | np.concatenate(([True], start[1:] > reach[:-1])))
    last = np.append(cut[1:], len(start)) - 1
    return doc[cut], sig[cut], start[cut], reach[last]


def _later(order, again, doc, sig, start):
    """Of rows equal to the one before them: those at another place than the first of their group.

    Rows of one document that is in the table twice stand at the same place; neither is earlier.
    """
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    lead = order[first]
    return again & ((doc[order] != doc[lead]) | (sig[order] != sig[lead]) | (start[order] != start[lead]))


def head_rows(batches, ranges: int):
    """Of HELD entries at a time: blocks of distinct (head, g), cut to 40 and 48 bits, and whether they occur twice in them.

    Heads that only agree in 40 bits count as repeated, which costs work and loses nothing.
    """
    parts, held = [], 0
    for batch in batches:
        for x, ends, _, _ in _pieces(batch, 0):
            parts.append(entries_of(x, ends)[3:])
            held += len(parts[-1][0])
            if held >= HELD:
                yield from _head_blocks(parts, ranges)
                parts, held = [], 0
    if held:
        yield from _head_blocks(parts, ranges)


def _head_blocks(parts: list, ranges: int):
    head, g = (np.concatenate(c) for c in zip(*parts))
    head, g = head >> _U(24), g >> _U(16)
    order = np.lexsort((g, head))
    head, g = head[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (g[1:] != g[:-1]))))
    twice = (np.diff(np.append(first, len(head))) > 1).astype(np.uint8)
    head, g = head[first], g[first]
    bucket = top(head << _U(24), ranges)
    yield from blocks(NEW, ((b, pack([head[r].view(np.uint8).reshape(-1, 8)[:, k].copy() for k in range(5)]
                                     + [g[r].view(np.uint8).reshape(-1, 8)[:, k].copy() for k in range(6)]
                                     + [twice[r]])) for b, r in dealt(bucket)))


def _wide(planes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, p in enumerate(planes):
        out[:, k] = p
    return out.view("<u8").reshape(-1)


def by_bucket(batches):
    """(bucket, levels, blobs) of rows sorted by bucket."""
    bucket, levels, blobs = None, [], []
    for batch in batches:
        for level, b, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if b != bucket and blobs:
                yield bucket, levels, blobs
                levels, blobs = [], []
            bucket = b
            levels.append(level)
            blobs.append(blob)
    if blobs:
        yield bucket, levels, blobs


def screen_blocks(batches, bits: int, ranges: int, hot: int):
    """Bit table slices of each head range, and its hot heads."""
    for bucket, _, blobs in by_bucket(batches):
        parts = [unpack(b, " ".join(["u1"] * 12))[0] for b in blobs]
        planes = [np.concatenate(c) for c in zip(*parts)]
        head, g, twice = _wide(planes[:5]), _wide(planes[5:11]), planes[11]
        order = np.lexsort((g, head))
        head, g, twice = head[order], g[order], twice[order]
        first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        n = np.diff(np.append(first, len(head)))
        several = np.maximum.reduceat((np.concatenate(([False], g[1:] != g[:-1]))
                                       & np.concatenate(([False], head[1:] == head[:-1]))).astype(np.uint8), first) > 0
        repeated = (n > 1) | (np.maximum.reduceat(twice, first) > 0)
        at = top(head[first] << _U(24), bits) - (bucket << (bits - ranges))
        out = []
        for rows in (repeated, repeated & several):
            bit = np.zeros(1 << (bits - ranges), np.uint8)
            bit[at[rows]] = 1
            out.append(np.packbits(bit, bitorder="little"))
        yield from blocks(NEW, [(bucket, pack([*out]))])
        if (n >= hot).any():
            yield from blocks(SPAN, [(bucket, pack([head[first][n >= hot]]))])


def entry_rows(batches, screen: Screen):
    """Blocks of entries with repeated heads; equal ones of those held together are settled here, all but the earliest."""
    parts, held, carried = [], 0, 0
    for batch in batches:
        ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        sigs = batch.column(1).to_numpy(zero_copy_only=False)
        for x, ends, rows, offsets in _pieces(batch, 2):
            start, size, _, head, g = entries_of(x, ends)
            repeated, several, hot = screen.marks(head)
            own = np.searchsorted(ends, start, side="right")
            base = offsets[own] - np.concatenate(([0], ends))[own]
            kept = np.flatnonzero(repeated & ~hot)
            length = np.where(several[kept], size[kept] + LENGTH - 1, 0)
            parts.append(Entries([head[kept], g[kept], ids[rows[own[kept]]], sigs[rows[own[kept]]], (start + base)[kept],
                                  size[kept], length], gather(x, start[kept], length)))
            carried += len(parts[-1].text)
            held += len(kept)
            kept = np.flatnonzero(repeated & hot)
            if len(kept):  # window by window: its own two hashes say all about it
                n = size[kept]
                at = np.repeat(start[kept], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(kept, n)
                parts.append(Entries([span_hash(prefix_sums(x, 0), 0, at, at + LENGTH), span_hash(prefix_sums(x, 1), 1, at, at + LENGTH),
                                      ids[rows[own[of]]], sigs[rows[own[of]]], at + base[of], np.ones(len(at), np.int64),
                                      np.zeros(len(at), np.int64)], np.zeros(0, np.uint8)))
                held += len(at)
            if held >= HELD or carried >= TEXT:
                yield from _settled(parts, screen.ranges)
                parts, held, carried = [], 0, 0
    if held:
        yield from _settled(parts, screen.ranges)


def _settled(parts: list[Entries], ranges: int):
    e = Entries.concat(parts)
    order = np.lexsort((e.start, e.sig, e.doc, e.g, e.head))
    again = np.concatenate(([False], (e.head[order][1:] == e.head[order][:-1]) & (e.g[order][1:] == e.g[order][:-1])))
    later = order[_later(order, again, e.doc, e.sig, e.start)]
    if len(later):
        yield from _spans(e.doc[later], e.sig[later], e.start[later], e.size[later] + LENGTH - 1, ranges)
    e = e.take(order[~again])  # in the order of heads, so a head range is a run
    yield from blocks(NEW, ((b, r.pack()) for b, r in e.runs(top(e.head, ranges))), 256)


def slices(head: np.ndarray):
    """(from, to) of runs of about RANGE sorted heads; equal heads stay together."""
    cut = np.unique(np.searchsorted(head, head[RANGE::RANGE]))
    return zip([0, *cut[cut > 0].tolist()], [*cut[cut > 0].tolist(), len(head)])


def scan(e: Entries, level: np.ndarray):
    """Merge-scan of one head range: (doc, sig, start, size) of the new entries' repeats, and the new level's entries."""
    # Suffix order: head, then text; the earliest of equal entries stands first.
    order = np.lexsort((e.start, e.sig, e.doc, e.g, e.head))
    same = np.concatenate(([False], (e.head[order][1:] == e.head[order][:-1]) & (e.g[order][1:] == e.g[order][:-1])))
    again = order[_later(order, same, e.doc, e.sig, e.start)]
    again = again[level[again] == NEW]
    gone = [np.stack((again, np.zeros(len(again), np.int64), e.size[again]))]
    reps = order[~same]
    fresh = np.zeros(len(e), np.int64)  # windows of an entry that are found
    # Heads with several texts: their windows are compared one by one.
    wide = reps[e.length[reps] > 0]
    if len(wide):
        place = np.lexsort((e.start[wide], e.sig[wide], e.doc[wide]))
        rank = np.empty(len(wide), np.int64)
        rank[place] = np.arange(len(wide))
        texts = e.take(wide)
        x, n = texts.text, texts.size.astype(np.int64)
        base = np.cumsum(texts.length, dtype=np.int64) - texts.length
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, of = np.repeat(base, n) + inner, np.repeat(np.arange(len(wide)), n)
        hashes = [span_hash(prefix_sums(x, k), k, at, at + LENGTH) for k in (0, 1)]
        by = np.lexsort((rank[of] * (1 << 24) + inner, hashes[1], hashes[0]))
        dup = np.concatenate(([False], (hashes[0][by][1:] == hashes[0][by][:-1]) & (hashes[1][by][1:] == hashes[1][by][:-1])))
        hit = np.sort(by[dup])
        hit = hit[level[wide[of[hit]]] == NEW]
        np.add.at(fresh, wide[of[hit]], 1)
        gone.append(np.stack((wide[of[hit]], inner[hit], np.ones(len(hit), np.int64))))
    of, inner, n = np.concatenate(gone, axis=1)
    keep = reps[(level[reps] == NEW) & (fresh[reps] < e.size[reps])]
    return (e.doc[of], e.sig[of], e.start[of] + inner, n + LENGTH - 1), e.take(keep)


def merge_scan(batches, ranges: int):
    """Blocks of repeats and of the new level, from blocks sorted by bucket."""
    spans, held = [], 0
    for bucket, levels, blobs in by_bucket(batches):
        yield from blocks(SPAN, [(bucket, b) for lv, b in zip(levels, blobs) if lv == SPAN])
        parts = [(lv, Entries.unpack(b)) for lv, b in zip(levels, blobs) if lv != SPAN]
        if not any(lv == NEW for lv, _ in parts):
            continue
        e, level = Entries.concat([p for _, p in parts]), np.concatenate([np.full(len(p), lv) for lv, p in parts])
        order, kept = np.argsort(e.head, kind="stable"), []
        for a, b in slices(e.head[order]):
            found, fresh = scan(e.take(order[a:b]), level[order[a:b]])
            kept.append(fresh)
            if len(found[0]):
                doc, sig, start, end = joined_spans(*found)
                spans.append((doc, sig, start, end - start))
                held += len(doc)
        kept = Entries.concat(kept)
        if len(kept):
            yield from blocks(NEW, [(bucket, kept.pack())])
        if held >= HELD:
            yield from _spans(*map(np.concatenate, zip(*spans)), ranges)
            spans, held = [], 0
    if held:
        yield from _spans(*map(np.concatenate, zip(*spans)), ranges)


def merge_blocks(batches):
    """One block, in suffix order, for each head range."""
    for bucket, _, blobs in by_bucket(batches):
        e = Entries.concat([Entries.unpack(b) for b in blobs])
        yield from blocks(NEW, [(bucket, e.take(np.lexsort((e.start, e.sig, e.doc, e.g, e.head))).pack())])


def _by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")


def screen_heads(docs: DataFrame, text_col: str = "text", hot: int = 2000, most_bits: int = BITS) -> Screen:
    """Count the heads of the whole corpus; see :class:`Screen`.

    A head is hot from ``hot`` different entries on, or from a ten-thousandth of all if that is more, so
    there are at most ten thousand. The driver gets the bit tables, at most 2^most_bits bits each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    entries = 1 + 2 * total // (LENGTH - HEAD + 2)
    ranges = max(0, max(min(entries // RANGE, FEW), entries // WIDE).bit_length() - 1)
    bits = max(ranges + 3, min(most_bits, max(16, (4 * entries).bit_length())))
    rows = docs.select(text.alias("text")).mapInArrow(lambda b: head_rows(b, ranges), BLOCK)
    most = max(hot, entries // 10_000)
    slices = _by_bucket(rows).mapInArrow(lambda b: screen_blocks(b, bits, ranges, most), BLOCK)
    tables, often = np.zeros((2, 1 << (bits - 3)), np.uint8), [np.zeros(0, _U)]
    with short_batches(docs.sparkSession):
        slices = stored(slices, "suffix-screen")
    for r in slices.toLocalIterator():
        if r.level == SPAN:
            often += unpack(bytes(r.blob), "<u8")[0]
        else:
            a, b = r.bucket << (bits - ranges - 3), (r.bucket + 1) << (bits - ranges - 3)
            tables[0, a:b], tables[1, a:b] = unpack(bytes(r.blob), "u1 u1")[0]
    return Screen(bits, ranges, tables[0], tables[1], np.concatenate(often))


class SuffixFamily:
    """Levels of sparse suffix arrays for texts that come in ascending order of ids.

    ``screen`` belongs to the corpus that the family takes; it decides which entries carry text and must
    not change between batches.
    """

    def __init__(self, spark, screen: Screen):
        self.screen, self.ranges = spark.sparkContext.broadcast(screen), screen.ranges
        self.levels: list[tuple[int, DataFrame]] = []  # (size in batches, stored table), largest first

    def merge(self) -> None:
        """Merge equal-sized levels, smallest first."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels[-2:]
            both = _by_bucket(a.unionByName(b)).mapInArrow(merge_blocks, BLOCK)
            with short_batches(both.sparkSession):
                self.levels[-2:] = [(2 * size, stored(both, "suffix-level"))]

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch (doc_id, sig, text); returns blocks of its repeats as a stored table."""
        self.merge()
        screen, ranges = self.screen, self.ranges
        rows = batch.select("doc_id", "sig", "text").mapInArrow(lambda b: entry_rows(b, screen.value), BLOCK)
        for number, (_, level) in enumerate(self.levels, 1):
            rows = rows.unionByName(level.withColumn("level", F.lit(number)))
        scanned = _by_bucket(rows).mapInArrow(lambda b: merge_scan(b, ranges), BLOCK)
        with short_batches(batch.sparkSession):
            scanned = stored(scanned, "suffix-scan")
        self.levels.append((1, scanned.where(F.col("level") == NEW)))
        return scanned.where(F.col("level") == SPAN)


def text_spans(batches):
    """(doc_id, sig, starts, ends) of every text with repeats, from blocks sorted by bucket."""
    for _, _, blobs in by_bucket(batches):
        doc, sig, start, end = (np.concatenate(c) for c in zip(*(unpack(b, "<i8 <i8 <i8 <i8")[0] for b in blobs)))
        doc, sig, start, end = joined_spans(doc, sig, start, end - start)
        cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]))))
        offsets = pa.array(np.append(cut, len(doc)), pa.int32())
        yield pa.record_batch([pa.array(doc[cut]), pa.array(sig[cut]), pa.ListArray.from_arrays(offsets, pa.array(start)),
                               pa.ListArray.from_arrays(offsets, pa.array(end))], names=["doc_id", "sig", "starts", "ends"])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sig, text): ``sig`` tells texts of one id apart, and is 0 where the id stands once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    doubled = stored(rows.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(
        "doc_id", F.lit(True).alias("doubled")), "suffix-doubled")
    shared = F.col("doc_id").isNull()
    if not doubled.isEmpty():
        rows, shared = rows.join(bounded(doubled), "doc_id", "left"), shared | F.col("doubled").isNotNull()
    return rows.select("doc_id", F.when(shared, F.xxhash64("text")).otherwise(F.lit(0)).alias("sig"), "text")


def remove_repeats(docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text",
                   hot: int = 2000, keep_text: bool = False) -> DataFrame:
    """Return doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) for every row.

    A byte is removed if it lies in a string of LENGTH bytes that also starts earlier; strings are compared
    by 128 bits of hash, judged on the input, and never cross texts. Null texts count as empty; texts
    under LENGTH bytes stay whole. Rows with a null id come after all others. Different texts of one id (or
    without id) are different documents in the order of their xxhash64; rows equal in id and text are
    one document and get the same result each. An empty table gives an empty result. Ids are integers.
    """
    rows = _documents(docs, id_col, text_col)
    family = SuffixFamily(docs.sparkSession, screen_heads(docs, text_col, hot))
    cuts = rows.where(F.col("doc_id").isNotNull()).approxQuantile(
        "doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    found = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if low is None else F.col("doc_id") > low
        if high is not None:
            inside = inside & (F.col("doc_id") <= high)
        elif low is not None:
            inside = inside | F.col("doc_id").isNull()
        spans = family.add(rows.where(inside))
        found = spans if found is None else found.unionByName(spans)
    cut = stored(_by_bucket(found).mapInArrow(
        text_spans, "doc_id long, sig long, starts array<long>, ends array<long>"), "suffix-spans")

    def finish(batches):
        for batch in batches:
            out = []
            for text, starts, ends in zip(*(batch.column(i) for i in (1, 2, 3))):
                data, starts, ends = text.as_py().encode(), starts.as_py() or [], ends.as_py() or []
                digest, at, kept = hashlib.sha256(), 0, []
                for a, b in zip([*starts, len(data)], [*ends, len(data)]):
                    digest.update(data[at:a])
                    if keep_text:
                        kept.append(data[at:a])
                    at = b
                out.append((len(data), sum(ends) - sum(starts), len(starts), digest.hexdigest(), b"".join(kept)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    key = F.coalesce("doc_id", F.lit(int(LAST)))
    named = rows.withColumn("at", key).join(bounded(cut.withColumnRenamed("doc_id", "at")), ["at", "sig"], "left")
    out = named.select("doc_id", "text", "starts", "ends").mapInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("doc_id", id_col)
    return out if keep_text else out.drop("kept")
