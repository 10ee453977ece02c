"""Quality classifier: a small convolutional network over the bytes of a document, in numpy.

A text becomes symbols: its UTF-8 bytes, and a second copy of the alphabet for bytes of a word that
repeats the word before it. Learned filters run over every window of ``WIDTH`` symbols; as the
input is one-hot, a filter is a table with one row for each offset and symbol, and a convolution is a sum
of looked-up rows. The document is cut into overlapping chunks that cover all of it; each filter
keeps its maximum in each chunk, the maxima are averaged over the chunks and combined into one
probability. Chunks overlap by WIDTH - 1 symbols, so every window lies in a chunk.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 6
FILTERS = 8
CHUNK = 256
PAD = 512  # a symbol of its own, so that the shortest text has one window
SYMBOLS = 513
PIECE = 1 << 18  # a multiple of CHUNK


def symbols(data: bytes) -> np.ndarray:
    """Bytes, plus 256 for the bytes of a word equal to the one before it."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
    if len(x) < WIDTH:
        return np.concatenate((x, np.full(WIDTH - len(x), PAD, dtype=np.int32)))
    space = (x == 32) | ((x >= 9) & (x <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(first) > 1:
        # Polynomial word hashes from prefix sums; the position's power is removed by scaling up.
        mix = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
        base = np.zeros(len(x), dtype=np.int64)
        base[first] = first
        local = np.arange(len(x)) - np.maximum.accumulate(base)
        with np.errstate(over="ignore"):
            mix *= np.uint64(2) * local.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix)))
            word = total[last] - total[first]
        again = np.flatnonzero((word[1:] == word[:-1]) & (np.diff(last - first) == 0)) + 1
        if len(again):
            turn = np.zeros(len(x) + 1, dtype=np.int32)
            turn[first[again]] += 256
            turn[last[again]] -= 256
            x += np.cumsum(turn[:-1], dtype=np.int32)
    return x


def repeated_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words equal to the one before them, for texts that are read in pieces."""
    spans, before = array("q"), None
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", data):
        word = m.group()
        if word == before:
            spans.extend(m.span())
        before = word
    spans = np.frombuffer(spans, np.int64) if spans else np.zeros(0, np.int64)
    return spans[0::2], spans[1::2]


def piece_symbols(data: bytes, a: int, b: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """:func:`symbols` of the whole text from a to b, given its repeated words."""
    x = np.frombuffer(data, dtype=np.uint8, count=b - a, offset=a).astype(np.int32)
    lo, hi = np.searchsorted(last, a, "right"), np.searchsorted(first, b, "left")
    if lo < hi:
        turn = np.zeros(b - a + 1, dtype=np.int32)
        turn[np.maximum(first[lo:hi], a) - a] += 256
        turn[np.minimum(last[lo:hi], b) - a] -= 256
        x += np.cumsum(turn[:-1], dtype=np.int32)
    return x


def chunk_maxima(x: np.ndarray, table: np.ndarray, where: bool = False):
    """(chunks, FILTERS) maxima of the filter responses; with ``where`` also their positions."""
    n = len(x) - WIDTH + 1
    chunks = -(-n // CHUNK)
    top, at = np.empty((chunks, FILTERS), np.float32), np.empty((chunks, FILTERS), np.int64)
    for a in range(0, chunks, 64):
        b = min(chunks, a + 64)
        lo, hi = a * CHUNK, min(n, b * CHUNK)
        out = np.take(table[0], x[lo:hi], axis=0, mode="clip")
        for k in range(1, WIDTH):
            out += np.take(table[k], x[lo + k:hi + k], axis=0, mode="clip")
        short = (b - a) * CHUNK - (hi - lo)
        if short:
            out = np.concatenate((out, np.full((short, FILTERS), -np.inf, np.float32)))
        out = out.reshape(b - a, CHUNK, FILTERS)
        if where:
            best = out.argmax(axis=1)
            at[a:b] = best + (np.arange(a, b) * CHUNK)[:, None]
            top[a:b] = np.take_along_axis(out, best[:, None, :], axis=1)[:, 0]
        else:
            top[a:b] = out.max(axis=1)
    return (top, at) if where else top


def probability(data: bytes, model: dict) -> float:
    """Score of one text. Long ones are read in overlapping pieces, which add up to the same mean; words that
    repeat the one before them are found in the whole text first, so no border hides one.
    """
    if len(data) <= PIECE:
        act = np.tanh(chunk_maxima(symbols(data), model["table"]))
        hidden, chunks = act.sum(axis=0, dtype=np.float64), len(act)
    else:
        hidden, chunks, again = np.zeros(FILTERS), 0, repeated_words(data)
        for a in range(0, len(data) - WIDTH + 1, PIECE):
            x = piece_symbols(data, a, min(len(data), a + PIECE + WIDTH - 1), *again)
            act = np.tanh(chunk_maxima(x, model["table"]))
            hidden += act.sum(axis=0, dtype=np.float64)
            chunks += len(act)
    logit = hidden / chunks @ model["out"] + model["bias"]
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.02,
        seed: int = 17) -> dict:
    """Fit filters and combination by Adam on the log loss; the result depends on the rows and the seed alone."""
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((WIDTH, SYMBOLS, FILTERS)) * 0.15).astype(np.float32)
    out, bias = rng.standard_normal(FILTERS) * 0.5, 0.0
    if not len(texts) or len(set(labels.tolist())) < 2:
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return {"table": table, "out": out * 0, "bias": float(np.log(share / (1 - share)))}
    # Both classes weigh the same.
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    xs = [symbols(t) for t in texts]
    m = [np.zeros_like(table), np.zeros(FILTERS), 0.0]
    v = [np.zeros_like(table), np.zeros(FILTERS), 0.0]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(xs))
        for s in range(0, len(order), batch):
            g_table, g_out, g_bias = np.zeros_like(table), np.zeros(FILTERS), 0.0
            for i in order[s:s + batch]:
                x = xs[i]
                top, at = chunk_maxima(x, table, where=True)
                act = np.tanh(top)
                hidden = act.mean(axis=0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ out + bias, -30, 30)))
                d = weight[i] * (p - labels[i])
                g_out += d * hidden
                g_bias += d
                d_top = (d * out / len(top) * (1 - act ** 2)).astype(np.float32)
                for k in range(WIDTH):
                    np.add.at(g_table[k], (x[at + k], np.arange(FILTERS)[None, :]), d_top)
            step += 1
            pace = rate * 0.5 * (1 + np.cos(np.pi * step / (epochs * -(-len(order) // batch))))
            params, grads = [table, out, bias], [g_table / batch, g_out / batch, g_bias / batch]
            for j in range(3):
                m[j] = 0.9 * m[j] + 0.1 * grads[j]
                v[j] = 0.999 * v[j] + 0.001 * grads[j] ** 2
                params[j] = params[j] - pace * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.999 ** step)) + 1e-8)
            table, out, bias = params[0].astype(np.float32), params[1], float(params[2])
    return {"table": table, "out": out, "bias": bias}


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, bytes_each: int) -> DataFrame:
    """At most ``rows`` labelled (text, quality), half of each class where there are enough.

    Rows are taken in order of a hash of the id, so the sample does not depend on partitions. Texts
    over ``bytes_each`` characters are left out of the fit (not out of the scoring): the driver's memory is
    bounded by rows * bytes_each.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.min("quality").alias("quality"))
    named = docs.where(F.length("text") <= bytes_each).select("doc_id", "text")
    order = [F.sha2(F.col("doc_id").cast("string"), 256), "doc_id", "text"]
    picked = [known.where(F.col("quality") == q).orderBy(*order[:2]).limit(rows) for q in (0, 1)]
    sample = picked[0].union(picked[1])
    both = named.join(F.broadcast(sample), "doc_id")
    return picked_half(both, rows, order)


def picked_half(both: DataFrame, rows: int, order: list) -> DataFrame:
    parts = [both.where(F.col("quality") == q).orderBy(*order).limit(rows // 2) for q in (0, 1)]
    return parts[0].union(parts[1]).select("text", "quality")


def train(docs: DataFrame, labels: DataFrame, rows: int = 1600, bytes_each: int = 8000) -> dict:
    """Fit on the bounded sample of :func:`training_rows`; held-out rows are never read."""
    sample = sorted((r["quality"], r["text"]) for r in training_rows(docs, labels, rows, bytes_each).collect())
    return fit([t.encode() for _, t in sample], np.array([q for q, _ in sample], dtype=np.float64))


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, held_out, score, predicted for every row, scored where it is read.

    Null texts count as empty; an empty text is scored from its padding. A null id is not held out.
    Repeated rows are scored each; an empty table gives an empty result. The model has a fixed size and is
    broadcast; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for batch in batches:
            scores = [probability((t.as_py() or "").encode(), net) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score of at least 0.5, all columns as they are; nothing is joined."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        net = shared.value
        for batch in batches:
            good = [probability((t.as_py() or "").encode(), net) >= 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
