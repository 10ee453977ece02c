"""Runs of repeating words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least LEAST words and FOLD periods long, that cannot be
extended. Periods up to SHORT are found by comparing every word with the one a lag before it. Longer
ones have a scale: for W = 16, 32, 64, ... periods above W/2 and up to W. At a scale every W-gram has a hash, and a place is a
minimizer if its hash is the least of some window of W/2 places. Inside a run of that scale two equal windows lie
within reach at the distance of the period, so their minimizers are equal W-grams one period apart; no equal
W-gram of the run lies between them, because W is at least the period. So each run holds two neighbouring equal minimizers at
the distance of its period. Each such pair is a seed, which is extended word by word in both directions.

Many texts are searched at once, one behind the other with a word of its own between two of them.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LEAST = 6
FOLD = 4
SHORT = 8  # periods that are scanned directly; a power of two
ROWS = 250  # texts whose words are held at a time
BUFFER = 1 << 17  # words that are searched at once, unless one text has more

_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        return h


def _true_runs(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of every stretch of true values."""
    edge = np.diff(np.concatenate(([0], equal.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def short_runs(words: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """(start, end, lag) of stretches that repeat at ``lag``, by comparing all words at that distance."""
    first, last = _true_runs(words[lag:] == words[:-lag])
    long = last - first + lag >= max(LEAST, FOLD * lag)
    return [(a, b + lag, lag) for a, b in zip(first[long].tolist(), last[long].tolist())]


def _windowed(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (minimum or maximum) of every window of ``width`` values; width is a power of two."""
    span = 1
    while span < width:
        values = least(values[span:], values[:-span])
        span *= 2
    return values


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some window of ``width`` places; equal least values are all taken."""
    low = _windowed(grams, width, np.minimum)  # low[i]: least of places i .. i + width - 1
    padded = np.concatenate((np.zeros(width - 1, _U), low, np.zeros(width - 1, _U)))
    return np.flatnonzero(_windowed(padded, width, np.maximum) == grams)  # the greatest least of the windows at a place


def seeds(grams: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of neighbouring equal minimizers more than ``low`` and at most ``high`` apart."""
    value = grams[places]
    order = np.argsort(value, kind="stable")
    value, at = value[order], places[order]
    gap = at[1:] - at[:-1]
    found = (value[1:] == value[:-1]) & (gap > low) & (gap <= high)
    return at[:-1][found], gap[found]


def _reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """Words from ``at`` on (or back from before ``at``) that equal the word ``lag`` later."""
    n, size = 0, 64
    while True:
        if step > 0:
            a, b = at + n, min(at + n + size, len(words) - lag)
        else:
            a, b = max(0, at - n - size), at - n
        if a >= b:
            return n
        differ = np.flatnonzero(words[a:b] != words[a + lag:b + lag])
        if len(differ):
            return n + int(differ[0] if step > 0 else b - a - 1 - differ[-1])
        n, size = n + b - a, size * 2


def extended(words: np.ndarray, places: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches around the seeds that are long enough."""
    out = []
    order = np.lexsort((places, gaps))
    lag, end = 0, 0
    for p, q in zip(places[order].tolist(), gaps[order].tolist()):
        if q == lag and p < end:
            continue  # inside the stretch of an earlier seed
        right = _reach(words, p, q, 1)
        left = _reach(words, p, q, -1)
        lag, end = q, p + right
        if left + right + q >= max(LEAST, FOLD * q):
            out.append((p - left, p + right + q, q))
    return out


def runs_of(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, in order; ``longest`` is the length of the longest text in ``words``."""
    found: dict[tuple[int, int], int] = {}

    def keep(rows):
        for a, b, q in rows:
            # A stretch that was found with a multiple of its period is the same stretch.
            found[a, b] = min(q, found.get((a, b), q))

    for lag in range(1, SHORT + 1):
        if max(LEAST, FOLD * lag) <= longest:
            keep(short_runs(words, lag))
    width, grams = 1, _mixed(words.astype(_U) + _U(0x632BE59BD9B4E019))
    while FOLD * (width + 1) <= longest:
        with np.errstate(over="ignore"):
            grams = _mixed(grams[:-width] * _U(0xD6E8FEB86659FD93) + grams[width:])  # doubles the length of the grams
        width *= 2
        if width > SHORT:
            places = minimizers(grams, width // 2)
            keep(extended(words, *seeds(grams, places, width // 2, width)))
    return sorted((a, b, q) for (a, b), q in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, the first of equals; compared without rounding."""
    best = None
    for a, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (a, n, q)
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for a, length, q in runs:
        edge[a + q] += 1
        edge[a + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _buffers(lengths: list[int]):
    """Lists of texts that are searched together: by length, as many as fit."""
    held, total = [], 0
    for k in sorted(range(len(lengths)), key=lengths.__getitem__):
        if held and total + lengths[k] + 1 > BUFFER:
            yield held
            held, total = [], 0
        held.append(k)
        total += lengths[k] + 1
    if held:
        yield held


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of every text, as words, its runs (start, length, period) in order."""
    out: list[list] = [[] for _ in texts]
    lengths = [len(t) for t in texts]
    for group in _buffers(lengths):
        number = defaultdict(count().__next__)
        words = np.empty(sum(lengths[k] + 1 for k in group), np.int64)
        begins, at = [], 0
        for k in group:
            begins.append(at)
            words[at:at + lengths[k]] = np.fromiter(map(number.__getitem__, texts[k]), np.int64, lengths[k])
            at += lengths[k]
            words[at] = -1 - k
            at += 1
        starts = np.array(begins)
        for a, b, q in runs_of(words, max(lengths[k] for k in group)):
            i = int(np.searchsorted(starts, a, "right")) - 1
            out[group[i]].append((a - begins[i], b - a, q))
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, runs (start, length, period), best (the strongest run or null) and collapsed, for every row.

    ``collapsed`` are the words, joined by one space, that no run holds after its first period. Words are what stands
    between ASCII white space. Null, empty and blank texts have no runs and an empty ``collapsed``. Repeated rows and null ids
    are treated row by row, equal words in neighbouring rows never meet. A very long text is searched by itself, with
    some 100 bytes of memory for each word. Empty tables give an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = "struct<start:long,length:long,period:long>"
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            texts = [t.split() for t in batch.column(1).to_pylist()]
            found = text_runs(texts)
            collapsed = []
            for words, runs in zip(texts, found):
                if runs:
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                collapsed.append(b" ".join(words).decode())
            flat = [r for runs in found for r in runs]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(item)))
            best = [None if b is None else dict(zip(("start", "length", "period"), b)) for b in map(strongest, found)]
            yield pa.record_batch([batch.column(0), lists, pa.array(best, item), pa.array(collapsed, pa.string())],
                                  names=["doc", "runs", "best", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(run, f"doc {kind}, runs array<{run_type}>, best {run_type}, collapsed string")
    return found.withColumnRenamed("doc", id_col)


def digest(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of :func:`find_runs` as counts, the strongest run and checksums."""
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return runs.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): a tenth of the documents, by checksum of the id, end with a repeated stretch of their words.

    h is the CRC-32 of the id as text and g = floor(h / 10). If h % 10 is 0, the words from a = g % n on repeat the p
    words at a, where p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.floor(h / 10).alias("g"), F.when(
        h % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    sized = words.withColumn("n", F.when(F.size("w") > 0, F.size("w"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    p = (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    sized = sized.withColumn("p", p)
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), F.col("n") - F.col("a"))), " ")
    return sized.select(id_col, F.when(F.col("n").isNotNull(), text).otherwise(F.col("text")).alias(text_col))
