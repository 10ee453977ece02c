"""Deterministic picks, quotas, permutations and plans (family W).

All choices order rows by SHA-256 of (seed, identity), so they do not depend on the
number or order of partitions. Unlimited ranks use the bucketed rank of
``functions.hashing``; ranks with a small limit use a window whose limit Spark applies
before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.functions.hashing import bucket_rank, hash_number, spread_rank, stable_hash, value_bucket
from boardlake.functions.placement import background, literal_array
from boardlake.operators.joins import _stored
from boardlake.session import cut_lineage

ONE = "*"  # counted as rows; a name, so importing needs no session


def hash_pick(df: DataFrame, by: Sequence[str], identity: Sequence[str], salt: str,
              carry: Sequence[str] = ()) -> DataFrame:
    """One row per group: the minimum salted hash. Partial minima, no sort of the group."""
    fields = list(dict.fromkeys([*identity, *carry]))
    digest = stable_hash(F.lit(salt), *identity)
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*fields), digest).alias("_p"))
    return picked.select(*by, *[F.col("_p").getField(f).alias(f) for f in fields])


def hash_pick_covering(df: DataFrame, by: Sequence[str], identity: Sequence[str], salt: str,
                       grid: DataFrame, bound: str = "001") -> DataFrame:
    """:func:`hash_pick` over a required grid; buckets without a row keep null identities.

    A bucket that has a digest below ``bound`` has its minimum there, so only these few rows are ordered. The buckets of
    the grid that have none are picked from all of their rows.
    """
    low = _stored(hash_pick(df.where(stable_hash(F.lit(salt), *identity) < bound), by, identity, salt), "picked")
    missing = _stored(grid.select(*by).distinct().join(low, list(by), "left_anti"), "unpicked")
    rest = hash_pick(df.join(missing, list(by), "left_semi"), by, identity, salt)
    return grid.join(low.unionByName(rest), list(by), "left")


def hash_fraction(df: DataFrame, identity: Sequence[str], n: int) -> DataFrame:
    """Rows whose first 8 hash digits are divisible by n: about 1/n of the rows."""
    return df.where(hash_number(stable_hash(*identity), 8) % n == 0)


def assign_scenario(df: DataFrame, identity: Sequence[str], seed: int, n: int, valid) -> DataFrame:
    """Scenario chosen by hash, then the next valid one cyclically; null when none is.

    ``valid(i)`` maps a scenario number column (0-based) to a boolean column.
    """
    start = hash_number(stable_hash(F.lit(seed), *identity)) % n
    order = F.transform(literal_array(range(n)).cast("array<bigint>"), lambda j: (F.col("_start") + j) % n)
    return (df.withColumn("_start", start)
            .withColumn("scenario", F.get(F.filter(order, valid), F.lit(0))).drop("_start"))


def allocate(children: DataFrame, parent: Sequence[str], child: str, quota: str,
             seed: Sequence[object]) -> DataFrame:
    """Split each parent's quota evenly over its children, remainder by hash order.

    Children left with nothing are dropped.
    """
    keyed = children.withColumn("_h", stable_hash(*[F.lit(s) for s in seed], *parent, child))
    ranked = spread_rank(keyed, list(parent), "_h", [child], out="_rank", size="_size")
    share = F.floor(F.col(quota) / F.col("_size")) + F.when(
        F.col("_rank") <= F.col(quota) % F.col("_size"), 1).otherwise(0)
    return (ranked.withColumn(quota, share.cast("long")).where(F.col(quota) > 0)
            .drop("_h", "_rank", "_size"))


def sample_epoch(boards: DataFrame, quotas: DataFrame, pool: str, levels: Sequence[str], cells: str,
                 seed: int, epoch: int) -> DataFrame:
    """Exact pool quotas shared evenly down ``levels`` (the last one identifies a board).

    Each level is one distinct + ranked pass over the keys still in play. A board's
    cells are shuffled anew for every cycle and no cell repeats before all were used;
    that part is a row-level expression because a board has at most 64 cells. A pool with a quota but without
    boards is an error at once; drawing from a board without eligible cells fails the job by name.
    """
    lacking = [r[0] for r in quotas.where("quota > 0").join(
        boards.select(pool).distinct(), pool, "left_anti").select(pool).limit(10).collect()]
    if lacking:
        raise ValueError(f"pools without boards: {sorted(map(str, lacking))}")
    path, current = [pool], quotas.select(pool, F.col("quota").cast("long"))
    for level in levels:
        children = boards.select(*path, level).distinct()
        current = allocate(children.join(current, path), path, level, "quota", (seed, epoch))
        path.append(level)
    drawn = boards.select(*path, cells).join(current, path)
    size = F.when(F.size(cells) > 0, F.size(cells)).otherwise(F.raise_error(F.concat(
        F.lit("board without eligible cells: "), F.col(levels[-1]).cast("string"))).cast("int"))
    cycles = drawn.withColumn("cycle", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / size))))
    order = F.array_sort(F.transform(cells, lambda c: F.struct(
        stable_hash(F.lit(seed), F.lit(epoch), *levels, "cycle", c).alias("h"), c.alias("idx"))))
    left = F.least(size.cast("long"), F.col("quota") - F.col("cycle") * size)
    picked = F.slice(order, F.lit(1), left.cast("int"))
    return (cycles.select(*path, "cycle", F.explode(picked).alias("_c"))
            .select(*path, "cycle", F.col("_c.idx").alias("idx")))


def shuffle_batches(df: DataFrame, identity: Sequence[str], seed: int, epoch: int, size: int) -> DataFrame:
    """Global permutation for an epoch and batch numbers, without a single-task sort."""
    keyed = df.withColumn("_h", stable_hash(F.lit(seed), F.lit(epoch), *identity))
    ranked = spread_rank(keyed, [], "_h", list(identity), out="position", buckets=4096)
    return ranked.withColumn("batch", F.floor((F.col("position") - 1) / size)).drop("_h")


def round_robin(df: DataFrame, bucket: str, order: Sequence[str], n: int) -> DataFrame:
    """n rows taken in turn from the buckets; at most n rows per bucket leave a task."""
    w = Window.partitionBy(bucket).orderBy(*order)
    turns = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return turns.orderBy("turn", bucket).limit(n).withColumn("turn", F.col("turn").cast("long"))


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


def missing_buckets(df: DataFrame, grid: DataFrame, by: Sequence[str]) -> DataFrame:
    return grid.join(df.select(*by).distinct(), list(by), "left_anti")


def group_profile(cells: DataFrame, group: str, class_id: str, idx: str) -> DataFrame:
    """One row per group with 26 class x colour counts."""
    light = background(idx) == "light"
    return cells.groupBy(group).agg(*[
        F.count_if((F.col(class_id) == c) & (light if colour == "light" else ~light)).alias(f"c{c}_{colour}")
        for c in range(13) for colour in ("light", "dark")])


SELECT_DIGITS = 3  # hex digits by which a round of the selection narrows the hashes
SELECT_ROWS = 64  # rows of a boundary bin, about, that are ranked exactly


def trial_hashes(groups: DataFrame, group: str, low: int, high: int, seed: int) -> DataFrame:
    """Each group with the hash that places it in each of the trials; one row is exploded inside its task."""
    rows = groups.withColumn("trial", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    return rows.withColumn("_h", stable_hash(F.lit(seed), "trial", group))


def trial_thresholds(groups: DataFrame, group: str, low: int, high: int, seed: int, ranks: Sequence[int], rows: int) -> DataFrame:
    """(trial, t0, t1, ...): the (hash, group) that holds each rank in each trial, null where there are fewer groups.

    Counts of hash prefixes, added up inside the tasks, tell in which bin each rank lies; the bins of all trials are
    narrowed at once until they hold a few rows, and only those rows are exchanged and ranked.
    """
    digits = SELECT_DIGITS
    hashed = trial_hashes(groups.select(group), group, low, high, seed)
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).cast("long").alias("rank")) for k, r in enumerate(ranks)])
    found = None  # (trial, k, bin, rank): the rank still to be found inside the bin
    while True:
        bin_ = F.substring("_h", 1, digits)
        part = hashed.withColumn("bin", bin_)
        if found is None:
            counts = part.groupBy("trial", "bin").agg(F.count(ONE).alias("n")).withColumn("w", F.explode(wanted)).select(
                "trial", "w.*", "bin", "n")
        else:
            inside = found.withColumnRenamed("bin", "above")
            counts = part.withColumn("above", F.substring("_h", 1, digits - SELECT_DIGITS)).groupBy("trial", "above", "bin").agg(
                F.count(ONE).alias("n")).join(F.broadcast(inside), ["trial", "above"]).select("trial", "k", "rank", "bin", "n")
        run = Window.partitionBy("trial", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("n").over(run))
        found = cut_lineage(upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(
            "trial", "k", "bin", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
        if rows <= SELECT_ROWS * 16 ** digits or digits >= 15:
            break
        digits += SELECT_DIGITS
    near = hashed.withColumn("bin", bin_).join(F.broadcast(found), ["trial", "bin"])
    place = Window.partitionBy("trial", "k").orderBy("_h", group)
    exact = near.withColumn("_r", F.row_number().over(place)).where(F.col("_r") == F.col("rank"))
    return exact.groupBy("trial").agg(*[F.max(F.when(F.col("k") == k, F.struct("_h", group))).alias(f"t{k}")
                                        for k in range(len(ranks))])


def assign_splits(profile: DataFrame, group: str, sizes: Sequence[tuple[str, int]], minimum: int,
                  seed: int, trials: int = 10_000, block: int = 64, required: Sequence[str] = ()) -> DataFrame:
    """First seeded allocation whose every split holds ``minimum`` of each class and colour.

    ``profile`` has one row per group; of the counts named in ``required`` (promotions of either
    colour) one is enough. ``block`` trials are tried first, then a thousand at a time: the hashes that end each split are
    selected for all trials of a block together (:func:`trial_thresholds`), and the sums of a (trial, split) are added up inside
    the tasks, so groups times trials are never exchanged. Only the smallest passing trial number
    returns to the driver. No passing trial is an error.
    """
    counts = [c for c in profile.columns if c != group and c not in required]
    names, ranks = [n for n, _ in sizes], [sum(k for _, k in sizes[:i + 1]) for i in range(len(sizes))]
    profile = cut_lineage(profile)
    rows = profile.count()

    def named(bounds: Sequence[Column]) -> Column:
        out = None
        for name, within in zip(names, bounds):
            out = F.when(within, name) if out is None else out.when(within, name)
        return out

    low = 0
    while low < trials:
        high = min(trials, low + (block if not low else 1000))
        ends = trial_thresholds(profile, group, low, high, seed, ranks, rows).withColumnRenamed("trial", "_trial")
        placed = trial_hashes(profile, group, low, high, seed).join(F.broadcast(ends), F.col("trial") == F.col("_trial"), "left")
        own = F.struct("_h", group)
        alloc = placed.withColumn("split", named([F.coalesce(own <= F.col(f"t{k}"), F.lit(True)) for k in range(len(names))]))
        sums = (alloc.where(F.col("split").isNotNull()).groupBy("trial", "split").agg(
            F.least(*[F.sum(c) for c in counts], *[F.when(F.sum(c) > 0, F.lit(minimum)).otherwise(F.lit(minimum - 1))
                                                   for c in required]).alias("_least")))
        passing = (sums.groupBy("trial").agg(F.count(ONE).alias("_s"), F.min("_least").alias("_m"))
                   .where((F.col("_s") == len(sizes)) & (F.col("_m") >= minimum)))
        first = passing.agg(F.min("trial")).first()[0]
        if first is not None:
            chosen = trial_hashes(profile.select(group), group, first, first + 1, seed)
            ranked = spread_rank(chosen, ["trial"], "_h", [group], out="_rank")
            return ranked.select("trial", group, named([F.col("_rank") <= r for r in ranks]).alias("split")).where(
                F.col("split").isNotNull())
        low = high
    raise ValueError(f"none of {trials} allocations gives every split {minimum} of each class and colour")


def mark_plan(cells: DataFrame, board: str, class_id: str, idx: str, count: int, seed: int,
              only: Sequence[int] | None = None) -> DataFrame:
    """Random buckets of (class, colour) per board, one random cell from each, first ``count``."""
    rows = cells if only is None else cells.where(F.col(class_id).isin(*only))
    bucket = rows.groupBy(board, class_id, background(idx).alias("background")).agg(
        F.min_by(idx, stable_hash(F.lit(seed), F.lit("cell"), board, idx)).alias("idx"))
    keyed = bucket.withColumn("_h", stable_hash(F.lit(seed), F.lit("bucket"), board, class_id, "background"))
    w = Window.partitionBy(board).orderBy("_h")
    return (keyed.withColumn("mark_rank", F.row_number().over(w)).where(F.col("mark_rank") <= count)
            .withColumn("mark_rank", F.col("mark_rank").cast("long")).drop("_h"))


def arrow_plan(boards: DataFrame, routes: DataFrame, board: str, occupied_mask: str, case: str, seed: int,
               most: int = 200_000) -> DataFrame:
    """Arrows for each board and its ``case``: one row per arrow, or one with ``reason`` no-route.

    The geometry follows from a hash of seed and board, before occupancy is looked at. ``arrow-empty`` asks for a route
    over empty cells only, ``arrow-piece`` and ``arrow-combined`` for one that touches a piece; of the fitting
    routes, in the order of start, end, bend and width, the hash picks one. ``arrow-crossed`` takes two
    arrows of four steps that cross in a square off the border. ``routes`` is the table of legal arrows with
    64-bit masks of touched cells; its size depends on the widths alone, and more than ``most`` rows are refused. It is sent to the
    tasks once, and each board is settled inside its batch: no route rows are made.
    """
    names = ("horizontal", "vertical", "diagonal", "knight")
    table = routes.select("geometry", "start", "end", "bend", "width", "touched").limit(most + 1).collect()
    if len(table) > most:
        raise ValueError(f"more than {most} routes")
    table = sorted(table, key=lambda r: (r.start, r.end, r.bend or "", r.width))
    masks = np.array([r.touched for r in table], dtype=np.int64)
    of = {g: np.array([i for i, r in enumerate(table) if r.geometry == g], dtype=np.int64) for g in names}
    widths = sorted({r.width for r in table})
    at = {(r.start, r.end, r.width): i for i, r in enumerate(table) if r.bend is None}

    def crossed(n: int) -> list[int]:
        x, y, w = 2 + n // 4 % 4, 2 + n // 16 % 4, widths[n // 128 % len(widths)]
        straight = n // 64 % 2
        ends = [((x - 2, y), (x + 2, y)), ((x, y - 2), (x, y + 2))] if straight else [
            ((x - 2, y - 2), (x + 2, y + 2)), ((x - 2, y + 2), (x + 2, y - 2))]
        return [at[8 * a[1] + a[0], 8 * b[1] + b[0], w] for a, b in ends]

    def fitting(occupied: np.ndarray, empty: np.ndarray, number: np.ndarray, geometry: str) -> np.ndarray:
        """Route of each board, -1 without one."""
        known, out = of[geometry], np.full(len(occupied), -1, dtype=np.int64)
        for a in range(0, len(occupied) if len(known) else 0, 512):
            part = slice(a, a + 512)
            fits = ((masks[known][None, :] & occupied[part, None]) == 0) == empty[part, None]
            count = fits.sum(axis=1)
            nth = number[part] // 128 % np.maximum(count, 1) + 1
            out[part] = np.where(count > 0, known[(fits.cumsum(axis=1) == nth[:, None]).argmax(axis=1)], -1)
        return out

    def run(batches):
        for batch in batches:
            occupied, number = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 3))
            asked = np.array(batch.column(2).to_pylist(), dtype=object)
            chosen = np.full(len(asked), -1, dtype=np.int64)
            for k, geometry in enumerate(names):
                rows = np.flatnonzero((number % 4 == k) & (asked != "arrow-crossed"))
                chosen[rows] = fitting(occupied[rows], asked[rows] == "arrow-empty", number[rows], geometry)
            rows, arrows, routes_of = [], [], []
            for i, (name, route) in enumerate(zip(asked, chosen.tolist())):
                for no, r in enumerate(crossed(int(number[i])) if name == "arrow-crossed" else [route], 1):
                    rows.append(i)
                    arrows.append(no)
                    routes_of.append(table[r] if r >= 0 else None)
            kept = batch.take(pa.array(rows, pa.int64()))
            column = lambda f, kind: pa.array([None if r is None else r[f] for r in routes_of], kind)
            yield pa.record_batch([
                kept.column(0), kept.column(2), pa.array(arrows, pa.int32()),
                pa.array([names[int(number[i]) % 4] if r is None else r.geometry for i, r in zip(rows, routes_of)]),
                column("start", pa.int64()), column("end", pa.int64()), column("bend", pa.string()),
                column("width", pa.float64()), column("touched", pa.int64()),
                pa.array(["no-route" if r is None else None for r in routes_of], pa.string())],
                names=[board, "case", "arrow_no", "geometry", "start", "end", "bend", "width", "touched", "reason"])

    kind = boards.schema[board].dataType.simpleString()
    asked = boards.select(board, F.col(occupied_mask).cast("long"), F.col(case).alias("case"),
                          hash_number(stable_hash(F.lit(seed), board)))
    return asked.mapInArrow(run, f"{board} {kind}, case string, arrow_no int, geometry string, start long, end long, "
                                 "bend string, width double, touched long, reason string")


def combined_marks(plan: DataFrame, board: str) -> DataFrame:
    """The box marks under a combined arrow: its ends as last move, its tip in a circle."""
    rows = plan.where((F.col("case") == "arrow-combined") & F.col("start").isNotNull())
    marks = F.array(F.struct(F.lit("last-move").alias("kind"), F.array("start", "end").alias("squares")),
                    F.struct(F.lit("circle").alias("kind"), F.array("end").alias("squares")))
    return rows.select(board, F.inline(marks))


def arrow_into(routes: DataFrame, keys: Sequence[str], start: str, seed: int) -> DataFrame:
    """One random legal route into each target square."""
    return (routes.groupBy(*keys).agg(
        F.min_by(F.struct(start, "geometry"), stable_hash(F.lit(seed), *keys, start)).alias("_r"))
        .select(*keys, F.col("_r").getField(start).alias(start), F.col("_r.geometry").alias("geometry")))


def compact_pick(df: DataFrame, group: str, position: str) -> DataFrame:
    """The (group index mod group size)-th position of each group; ids are numbers or strings."""
    ranked = bucket_rank(df.select(group, position), [group], value_bucket(df, position),
                         [position], out="_r", size="_n")
    groups = bucket_rank(df.select(group).distinct(), [], value_bucket(df, group), [group], out="_g")
    return (ranked.join(groups, group).where(F.col("_r") - 1 == (F.col("_g") - 1) % F.col("_n"))
            .select(group, position))


def dedupe_aliases(df: DataFrame, key: Sequence[str], row_id: str) -> DataFrame:
    """Each request beside the one that stands for it; aliases stay rows, not a list."""
    first = df.groupBy(*key).agg(F.min(row_id).alias("request"), F.count(ONE).alias("aliases"))
    return df.select(row_id, *key).join(first, list(key)).select(row_id, "request", "aliases")


def training_cells(boards: DataFrame, marks: DataFrame, board: str, is_clean: Column, kind: str, squares: str,
                   touched: DataFrame | None = None) -> DataFrame:
    """Cells kept for training: clean boards whole, of marked ones the cells that a mark can change.

    ``squares`` holds the cell indexes of a box mark. Last moves and selections are whole squares whose colour
    bleeds into the 8 neighbours when an image is scaled; other marks keep to their cell. ``touched``
    adds (board, idx) rows for arrows, halo included.
    """
    whole = boards.where(is_clean).select(board, F.explode(literal_array(range(64)).cast("array<bigint>")).alias("idx"))
    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    wide = F.coalesce(F.col(kind).isin("last-move", "selection"), F.lit(False))
    spots = marks.where(~F.coalesce(F.col(kind) == "arrow", F.lit(False))).select(
        board, wide.alias("_wide"), F.explode(squares).alias("_s"))
    near = F.array(*[F.struct((F.floor(F.col("_s") / 8) + r).alias("r"), (F.col("_s") % 8 + c).alias("c"),
                              F.lit((r, c) == (0, 0)).alias("own")) for r, c in steps])
    around = (spots.select(board, "_wide", F.inline(near)).where(
        (F.col("_wide") | F.col("own")) & F.col("r").between(0, 7) & F.col("c").between(0, 7))
        .select(board, (F.col("r") * 8 + F.col("c")).cast("long").alias("idx")))
    out = around if touched is None else around.unionByName(touched.select(board, "idx"))
    return whole.unionByName(out.distinct())


def changed_cells(predictions: DataFrame, keys: Sequence[str], epoch: str, value: str) -> DataFrame:
    """Cells whose prediction differs from the previous epoch, per epoch."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    prev = predictions.withColumn("_p", F.lag(value).over(w))
    return prev.groupBy(epoch).agg(
        F.count_if(F.col("_p").isNotNull() & (F.col("_p") != F.col(value))).alias("changed_cells"),
        F.count(ONE).alias("cells"))


def epoch_history(metrics: DataFrame, epoch: str, exact: str, squares: str, base_exact: int,
                  base_squares: int) -> DataFrame:
    """Safe epochs, change from the previous one, and best so far; one row per epoch."""
    w = Window.partitionBy(F.lit(0)).orderBy(epoch)
    safe = (F.col(exact) >= base_exact) & (F.col(squares) >= base_squares)
    best = F.max(F.when(F.col("safe"), F.col(exact))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (metrics.withColumn("safe", safe)
            .withColumn("exact_change", F.col(exact) - F.lag(exact).over(w))
            .withColumn("accepted", F.col("safe") & (F.col(exact) > F.coalesce(best, F.lit(-1)))))
