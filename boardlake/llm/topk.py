"""Exact top-k search by inner product: distributed selection on score histograms.

Vectors are packed into blocks of small integers. Every query block meets every vector block, tile by tile as
matrix products, in a cartesian product of two stored tables: nothing is multiplied before it is shuffled or broadcast.
Scores are never stored: a round reduces the blocks of a task to counts of score bins, the counts of all tasks
add up to one global histogram for each query, and the bin that holds the k-th score becomes the range of the
next round. When the range is a single score, one more round returns the rows above it, and of its ties the smallest ids.

A task reports only the scores down to its own k-th one: the global k best are among them, so the
counts above the global k-th score stay exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import partitions_for, short_batches, stored

LIMIT = float(2 ** 62)
TILES = 8  # fixed value: tiles on each side of a pair of blocks
BYTES = 1 << 23  # fixed value: numbers of a block, unless a single row has more
PACKED = "block int, piece int, rows int, width int, kind string, ids binary, data binary"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows (id, v): floor(scale * x) as long; rows with null or non-finite parts are left out.

    A finite component whose scaled value has no place in a long is an error that names the row: any
    other value would give wrong scores.
    """
    x = F.col(vector_col)
    double = F.transform(x, lambda c: c.cast("double"))
    fine = F.forall(double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    refused = F.raise_error(F.concat(F.lit(f"{vector_col} of {id_col} "), F.col(id_col).cast("string"), F.lit(
        ": a component is beyond 2^62 after scaling"))).cast("long")
    whole = F.transform(double, lambda c: F.when(F.abs(c * scale) > F.lit(LIMIT), refused).otherwise(F.floor(c * scale)))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _packed(block: int, ids: np.ndarray, offsets: np.ndarray, values: np.ndarray, size: int):
    """Rows of PACKED: vectors padded with zeros, in the smallest kind of integer, at most ``size`` rows and about BYTES each."""
    length, done, piece = np.diff(offsets), 0, 0
    while done < len(ids):
        take = min(size, len(ids) - done)
        take = max(1, min(take, BYTES // max(1, 8 * int(length[done:done + take].max()))))
        width = int(length[done:done + take].max())
        data = np.zeros((take, width), dtype=np.int64)
        data[np.arange(width) < length[done:done + take, None]] = values[offsets[done]:offsets[done + take]]
        least, most = (data.min(), data.max()) if data.size else (0, 0)
        kind = next(k for k in map(np.dtype, ("i1", "i2", "i4", "i8")) if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
        yield block, piece, take, width, kind.str, ids[done:done + take].tobytes(), data.astype(kind).tobytes()
        done, piece = done + take, piece + 1


def _query_blocks(rows: DataFrame, count: int, size: int) -> DataFrame:
    """Rows (id, v) in ``count`` blocks by the hash of their id."""
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))

    def pack(key, pdf):
        # A hash block may exceed its mean size; it is cut into pieces.
        offsets = np.concatenate(([0], np.cumsum(pdf["v"].map(len))))
        values = np.concatenate([np.asarray(v, dtype=np.int64) for v in pdf["v"]])
        return pd.DataFrame(list(_packed(int(key[0]), pdf["id"].to_numpy(dtype=np.int64), offsets, values, size)),
                            columns=[c.split()[0] for c in PACKED.split(", ")])

    return stored(keyed.groupBy("block").applyInPandas(pack, PACKED), "topk-queries")


def _vector_blocks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Rows (id, v) in blocks, dealt out evenly whatever their ids: enough files for all tasks, many blocks in each of a large table."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    files = max(min(2 * tasks, partitions_for(n, 256)), partitions_for(n, 16 * size))
    kinds = pa.schema([("block", pa.int32()), ("piece", pa.int32()), ("rows", pa.int32()), ("width", pa.int32()), ("kind", pa.string()),
                       ("ids", pa.binary()), ("data", pa.binary())])

    def pack(batches):
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            for row in _packed(0, ids, v.offsets.to_numpy(), v.values.to_numpy(), size):
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, row))], schema=kinds)

    return stored(rows.select("id", "v").repartition(files).mapInArrow(pack, PACKED), "topk-candidates")


class _Met:
    """A query block with the rows that it has met in this task."""

    def __init__(self, row, real, tile: int, low: int | None):
        self.block, self.real, self.tile = (row.q_block, row.q_piece), real, tile
        self.ids = np.frombuffer(row.q_ids, dtype=np.int64)
        self.matrix = _matrix(row.q_data, row.q_kind, row.q_rows, row.q_width, real)
        self.low = np.full(len(self.ids), low, dtype=np.int64) if low is not None else _low(row, self.ids)

    def tiles(self, row, size: int):
        """(first query row, vector ids, scores) of each tile; a query's own rows get the least number."""
        least = -np.inf if self.real is not np.int64 else np.iinfo(np.int64).min
        ids = np.frombuffer(row.c_ids, dtype=np.int64)
        data = _matrix(row.c_data, row.c_kind, row.c_rows, row.c_width, self.real)
        width = min(data.shape[1], self.matrix.shape[1])  # what only one of them has meets zeros
        own = np.flatnonzero(np.isin(self.ids, ids))
        for b in range(0, len(ids), size):
            part, at = data[b:b + size, :width].T, ids[b:b + size]
            for a in range(0, len(self.ids), self.tile):
                scores = self.matrix[a:a + self.tile, :width] @ part
                here = own[(own >= a) & (own < a + self.tile)]
                if len(here):
                    q, c = np.nonzero(self.ids[here][:, None] == at[None, :])
                    scores[here[q] - a, c] = least
                yield a, at, scores


def _matrix(data: bytes, kind: str, rows: int, width: int, real) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(rows, width).astype(real)


def _low(row, ids: np.ndarray) -> np.ndarray:
    """The ranges' lower ends; a query without one has no row to find."""
    out = np.full(len(ids), np.iinfo(np.int64).max, dtype=np.int64)
    known, low = np.asarray(row.s_id, dtype=np.int64), np.asarray(row.s_low, dtype=np.int64)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], ids), len(known) - 1)
    found = known[order][at] == ids
    out[found] = low[order][at][found]
    return out


def _runs(batches, start, meet, finish):
    """Joined rows come query block by query block: one frame for each run of a block."""
    met = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if met is None or met.block != (row.q_block, row.q_piece):
                if met is not None:
                    yield finish(met)
                met = start(row)
            meet(met, row)
    if met is not None:
        yield finish(met)


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding", bins: int = 512, block: int = 1024, query_block: int = 512) -> DataFrame:
    """Return query_id, rank, vec_id, score: the ``k`` best rows for each query row.

    Queries are rows whose id is divisible by ``query_every``; candidates are all rows with
    another id. Score: inner product of ``floor(scale * x)``; shorter vectors count as padded with
    zeros, components beyond 2^62 are an error and sums wrap like a long. Ties go to the smaller
    vec_id; a candidate row that repeats another one (same id) takes a place of its own, and a
    query id that repeats is asked once, with its smallest vector. Rows with null id, null vector, null
    or non-finite component take no part; no query or no other row gives no result rows; empty vectors
    score zero.
    """
    rows = stored(integer_vectors(vectors, id_col, vector_col, scale), "topk-vectors")
    asked = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(norm), F.lit(0.0)).alias("norm"),
                    F.count_if(F.col("id") % query_every == 0).alias("q")).first()
    # |score| <= largest squared norm (Cauchy-Schwarz); below 2^53 a double product is exact, below 2^24 a float.
    bound = int(min(size["norm"], 2.0 ** 62)) + 1
    real = np.float32 if size["norm"] < 2.0 ** 24 else np.float64 if size["norm"] < 2.0 ** 53 else np.int64
    n_q = partitions_for(size["q"], query_block * TILES)
    c = _vector_blocks(rows, size["n"], block * TILES)
    q = _query_blocks(asked, n_q, query_block * TILES)
    c, q = (t.select([F.col(x).alias(f"{side}_{x}") for x in t.columns]) for t, side in ((c, "c"), (q, "q")))

    def grid(states: DataFrame | None) -> DataFrame:
        """Every query block with every vector block, both from stored tables; query blocks carry their ranges."""
        asking = q
        if states is not None:
            # One row of ranges for each query block: as many entries as it has queries.
            of = states.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("q_block")).agg(
                F.collect_list(F.struct("query_id", "low")).alias("state"))
            asking = stored(q.hint("merge").join(of, "q_block").select(
                "*", F.col("state.query_id").alias("s_id"), F.col("state.low").alias("s_low")).drop("state"), "topk-asking")
        # A broadcast would hold all blocks of one side on the driver; here tasks read pairs of partitions.
        return asking.hint("shuffle_replicate_nl").crossJoin(c)

    def counts(width: int, first: bool):
        """Counts of the bins of one task, down to the bin of the task's own k-th score in the range."""
        def start(row):
            met = _Met(row, real, query_block, -bound if first else None)
            # What is below the range does not count; it stands for missing rows.
            met.best = np.repeat((met.low - 1).astype(real)[:, None], k, axis=1)
            return met

        def meet(met, row):
            for a, _, scores in met.tiles(row, block):
                best = met.best[a:a + query_block]
                more = np.flatnonzero(scores.max(axis=1) > best[:, 0])
                if len(more):
                    best[more] = np.partition(np.concatenate((best[more], scores[more]), axis=1), -k, axis=1)[:, -k:]

        def finish(met):
            at = (met.best.astype(np.int64) - met.low[:, None]) // width
            asked = (met.low < np.iinfo(np.int64).max)[:, None]
            of, place = np.nonzero(asked & (at >= 0) & (at < bins))
            code, n = np.unique(of * bins + at[of, place], return_counts=True)
            return pd.DataFrame({"query_id": met.ids[code // bins], "bin": code % bins, "n": n})

        return lambda batches: _runs(batches, start, meet, finish)

    span = 2 * bound + 1
    width = 1
    while width * bins < span:
        width *= bins
    states, first = None, True
    while True:
        with short_batches(vectors.sparkSession, TILES):
            found = stored(grid(states).mapInPandas(counts(width, first), "query_id long, bin long, n long"), "topk-counts")
        # At most ``bins`` rows for each query after the sum.
        total = found.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        total = total.withColumn("upto", F.sum("n").over(down))
        if states is None:
            total = total.withColumn("low", F.lit(-bound).cast("long")).withColumn("above", F.lit(0).cast("long"))
        else:
            total = total.join(states, "query_id")
        # The k-th score's bin; with fewer than k rows, the lowest bin that has any.
        reach = F.when(F.col("above") + F.col("upto") >= k, F.struct(F.lit(1).alias("ok"), F.col("bin").alias("bin"))
                       ).otherwise(F.struct(F.lit(0).alias("ok"), (-F.col("bin")).alias("bin")))
        best = total.groupBy("query_id").agg(F.max(F.struct(
            reach.alias("reach"), "bin", "n", "upto", "low", "above")).alias("t"))
        states = stored(best.select("query_id", (F.col("t.low") + F.col("t.bin") * width).alias("low"),
                                    (F.col("t.above") + F.col("t.upto") - F.col("t.n")).alias("above")), "topk-state")
        first = False
        if width == 1:
            break
        width //= bins

    def start(row):
        met = _Met(row, real, query_block, None)
        met.least, met.found, met.held = met.low.astype(real), [], 0
        if real is not np.int64:
            met.least[met.low == np.iinfo(np.int64).max] = np.inf
        return met

    def best_of(met):
        """Of a task at most k rows can be among the k best."""
        of, ids, scores = (np.concatenate(c) for c in zip(*met.found))
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        keep = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) < k
        met.found = [(of[keep], ids[keep], scores[keep])]
        met.held = 2 * int(keep.sum()) + 100_000  # gathered anew beyond that

    def pick(met, row):
        for a, ids, scores in met.tiles(row, block):
            of, at = np.nonzero(scores >= met.least[a:a + query_block, None])
            if len(of):
                met.found.append((of + a, ids[at], scores[of, at].astype(np.int64)))
                if sum(len(f[0]) for f in met.found) > max(met.held, 100_000):
                    best_of(met)

    def picked(met):
        if not met.found:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        best_of(met)
        of, ids, scores = met.found[0]
        return pd.DataFrame({"query_id": met.ids[of], "vec_id": ids, "score": scores})

    with short_batches(vectors.sparkSession, TILES):
        rows = stored(grid(states).mapInPandas(lambda batches: _runs(batches, start, pick, picked),
                                               "query_id long, vec_id long, score long"), "topk-found")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
