"""Counting operators: confusion, class, stratified, coverage and latency metrics.

All inputs are long cell tables. Group-bys are on primitive keys and use partial
aggregation, so a hot stratum costs one row per map task. Board-level results first
reduce the 64 cells of a board, which normally sit in one partition, before any
exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.functions.constants import FAILED, MARK_KINDS, N_CLASSES, SPLITS
from boardlake.functions.hashing import value_bucket
from boardlake.functions.placement import background, class_label, literal_array
from boardlake.operators.audits import full_grid
from boardlake.operators.joins import _stored

ONE = "*"  # counted as rows; a name, so importing needs no session
BITS = 16  # classes that have a bit for each colour


def ratio(num: Column | str, den: Column | str) -> Column:
    """Double ratio, null on a zero denominator."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return n.cast("double") / F.when(d != 0, d)


def count_of(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def confusion(cells: DataFrame, expected: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per expected class, one column per predicted class, ``p_error`` last."""
    pred = F.when(F.col(predicted) < 0, N_CLASSES).otherwise(F.col(predicted))
    return (cells.groupBy(*by, F.col(expected).alias("expected")).agg(*[
        count_of(pred == i).alias("p_error" if i == N_CLASSES else f"p_{i}")
        for i in range(N_CLASSES + 1)]))


def class_grid(spark) -> DataFrame:
    """The 13 class ids (fixed size)."""
    return spark.range(N_CLASSES).withColumnRenamed("id", "class_id")


def class_metrics(cells: DataFrame, expected: str, predicted: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Support, hits, predictions, precision, recall and F1 for all 13 classes.

    One pass: each cell contributes its expected class and, if different, its
    predicted class; -1 predictions only count as misses.
    """
    e, p = F.col(expected), F.col(predicted)
    pairs = cells.groupBy(*by, e.alias("_e"), p.alias("_p")).agg(F.count(ONE).alias("_n"))
    sides = F.array(
        F.struct(F.col("_e").alias("class_id"), F.col("_n").alias("total"),
                 F.when(F.col("_e") == F.col("_p"), F.col("_n")).otherwise(0).alias("correct"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("_p").alias("class_id"), F.lit(0).cast("long").alias("total"),
                 F.lit(0).cast("long").alias("correct"), F.col("_n").alias("predicted")))
    sums = (pairs.select(*by, F.inline(sides)).where(F.col("class_id") != FAILED)
            .groupBy(*by, "class_id")
            .agg(*[F.sum(c).alias(c) for c in ("total", "correct", "predicted")]))
    if not by:
        sums = (class_grid(cells.sparkSession).join(sums, "class_id", "left")
                .na.fill(0, ["total", "correct", "predicted"]))
    return sums.select(
        *by, "class_id", class_label("class_id").alias("label"), "total", "correct", "predicted",
        ratio("correct", "total").alias("recall"), ratio("correct", "predicted").alias("precision"),
        ratio(2 * F.col("correct"), F.col("total") + F.col("predicted")).alias("f1"))


def macro_recall(cells: DataFrame, expected: str, predicted: str,
                 by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over classes that have support."""
    m = class_metrics(cells, expected, predicted, by).where("total > 0")
    return m.groupBy(*by).agg(F.round(F.avg("recall"), 9).alias("macro_recall"))


def background_metrics(cells: DataFrame, expected: str, predicted: str, idx: str = "idx") -> DataFrame:
    """Correct/total per class, per class x background, and over occupied cells."""
    ok = F.col(expected) == F.col(predicted)
    rows = cells.select(class_label(expected).alias("label"), background(idx).alias("background"),
                        ok.alias("_ok"), (F.col(expected) > 0).alias("_occ"))
    return (rows.rollup("label", "background")
            .agg(count_of(F.col("_ok")).alias("correct"), F.count(ONE).alias("total"),
                 count_of(F.col("_ok") & F.col("_occ")).alias("occupied_correct"),
                 count_of(F.col("_occ")).alias("occupied_total"))
            .withColumn("occupied_accuracy", ratio("occupied_correct", "occupied_total")))


def per_board(cells: DataFrame, expected: str, predicted: str, keys: Sequence[str]) -> DataFrame:
    """Cells reduced to one row per board with its error counts."""
    e, p = F.col(expected), F.col(predicted)
    return cells.groupBy(*keys).agg(
        F.count(ONE).alias("squares"), count_of(e == p).alias("correct"),
        count_of((e == 0) & (p != 0)).alias("false_pieces"),
        count_of((e != 0) & (p == 0)).alias("missed_pieces"))


def exact_rates(cells: DataFrame, expected: str, predicted: str, board: str, position: str) -> DataFrame:
    """Exact boards, and positions exact in all of their variants."""
    boards = per_board(cells, expected, predicted, [board, position])
    exact = F.col("squares") == F.col("correct")
    positions = boards.groupBy(position).agg(
        F.count(ONE).alias("_b"), count_of(exact).alias("_x"), F.sum("correct").alias("_c"),
        F.sum("squares").alias("_s"))
    return positions.agg(
        F.sum("_b").alias("images"), F.count(ONE).alias("positions"),
        F.sum("_x").alias("exact_boards"),
        count_of(F.col("_b") == F.col("_x")).alias("exact_positions"),
        F.sum("_c").alias("correct_squares"), F.sum("_s").alias("total_squares"),
        ratio(F.sum("_c"), F.sum("_s")).alias("square_accuracy"))


def board_error_metrics(cells: DataFrame, expected: str, predicted: str, board: str,
                        by: Sequence[str] = ()) -> DataFrame:
    """Boards, squares, exact boards, false and missed pieces."""
    b = per_board(cells, expected, predicted, [*by, board])
    return b.groupBy(*by).agg(
        F.count(ONE).alias("boards"), F.sum("squares").alias("squares"),
        count_of(F.col("squares") == F.col("correct")).alias("exact_boards"),
        F.sum("correct").alias("correct_squares"), F.sum("false_pieces").alias("false_pieces"),
        F.sum("missed_pieces").alias("missed_pieces"))


def omission_metrics(cells: DataFrame, expected: str, predicted: str,
                     classes: Sequence[int]) -> DataFrame:
    """Of the named classes: how many were read empty and how many as another piece."""
    e, p = F.col(expected), F.col(predicted)
    return (cells.where(e.isin(*classes)).groupBy(class_label(expected).alias("label"))
            .agg(F.count(ONE).alias("total"), count_of(p == 0).alias("omitted"),
                 count_of((p > 0) & (p != e)).alias("mistyped"),
                 count_of(p < 0).alias("unprocessed")))


def latency(df: DataFrame, seconds: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample count, exact median and p95 in milliseconds (linear interpolation).

    For small groups: ``percentile`` keeps a value histogram per group. Groups of any
    size go through :func:`latency_by_rank`.
    """
    q = F.percentile(seconds, F.array(F.lit(0.5), F.lit(0.95)))
    return (df.groupBy(*by).agg(F.count(seconds).alias("samples"), q.alias("_q"))
            .select(*by, "samples", F.round(F.col("_q")[0] * 1000, 6).alias("median_ms"),
                    F.round(F.col("_q")[1] * 1000, 6).alias("p95_ms")))


QUANTILES = (("q50", 0.5), ("q95", 0.95))


def quantiles_by_rank(df: DataFrame, value: str, by: Sequence[str], rows: int = 20_000) -> DataFrame:
    """Exact median and p95 per group (linear interpolation) without a group in one task.

    Equal values collapse to one counted row. Bands of about ``rows`` rows are placed by a quantile sketch of all values,
    so they are even for any distribution. Counts per band locate the few bands holding the neighbours of each
    quantile; only those are ordered.
    """
    by, known = list(by), df.where(F.col(value).isNotNull())
    band = value_bucket(known, value, rows)
    vals = (known.groupBy(*by, F.col(value).alias("_v"), band.alias("_band")).agg(F.count(ONE).alias("_n")))
    before = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = (vals.groupBy(*by, "_band").agg(F.sum("_n").alias("_bn"))
             .withColumn("_lo", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
             .withColumn("_all", F.sum("_bn").over(Window.partitionBy(*by))))
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), ((F.col("_all") - 1) * f).alias("pos")) for q, f in QUANTILES])
    targets = (bands.select(*by, "_band", "_bn", "_lo", "_all", F.inline(wanted))
               .where((F.col("_lo") <= F.ceil("pos")) & (F.col("_lo") + F.col("_bn") > F.floor("pos"))))
    on = [*by, "_band"]
    upto = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = vals.join(targets.select(*on).distinct(), on, "left_semi").withColumn("_upto", F.sum("_n").over(upto))
    last = F.col("_lo") + F.col("_upto") - 1
    first = F.col("_lo") + F.col("_upto") - F.col("_n")
    low, high = F.floor("pos"), F.ceil("pos")
    frac = F.col("pos") - low
    weight = (F.when(low.between(first, last), 1 - frac).otherwise(0.0)
              + F.when(high.between(first, last), frac).otherwise(0.0))
    hits = ranked.join(targets.select(*on, "_lo", "_all", "q", "pos"), on).withColumn("_wt", weight)
    return hits.groupBy(*by, "_all").agg(*[
        F.sum(F.when(F.col("q") == q, F.col("_v") * F.col("_wt"))).alias(q) for q, _ in QUANTILES]
    ).withColumnRenamed("_all", "samples")


def latency_by_rank(df: DataFrame, seconds: str, by: Sequence[str], rows: int = 20_000) -> DataFrame:
    """Same result as :func:`latency` for groups of any size."""
    q = quantiles_by_rank(df, seconds, by, rows)
    return q.select(*by, "samples", F.round(F.col("q50") * 1000, 6).alias("median_ms"),
                    F.round(F.col("q95") * 1000, 6).alias("p95_ms"))


def trial_aggregate(df: DataFrame, trial: str, model: str, value: str, baseline: str,
                    limit: float = 1.25, rows: int = 20_000) -> DataFrame:
    """Median over trials of the trial median and p95, and the ratio gate.

    Only the trial rows (a handful per model) reach the exact ``percentile``.
    """
    trials = quantiles_by_rank(df, value, [model, trial], rows)
    models = trials.groupBy(model).agg(F.percentile("q50", 0.5).alias("_m"), F.percentile("q95", 0.5).alias("_p"))
    is_base = F.col(model) == baseline
    every = Window.partitionBy(F.lit(0))
    both = models.withColumn("_bm", F.max(F.when(is_base, F.col("_m"))).over(every)).withColumn(
        "_bp", F.max(F.when(is_base, F.col("_p"))).over(every))
    return (both.select(model, F.round("_m", 6).alias("median"), F.round("_p", 6).alias("p95"),
                        F.round(F.col("_m") / F.col("_bm"), 6).alias("median_ratio"),
                        F.round(F.col("_p") / F.col("_bp"), 6).alias("p95_ratio"))
            .withColumn("passed", F.coalesce((F.col("median_ratio") <= limit)
                                             & (F.col("p95_ratio") <= limit), F.lit(False))))


def _stratum(label: Column):
    return lambda v: F.struct(label, v.cast("string").alias("value"))


def stratify(df: DataFrame, dims: Sequence[str], multi: Sequence[str] = ()) -> DataFrame:
    """One (dimension, value) row per stratum a row belongs to.

    ``multi`` columns are arrays: the row counts in each of their values.
    """
    single = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                       for d in dims])
    parts = [single] if dims else []
    for name in multi:
        label = F.lit(name).alias("dimension")
        parts.append(F.transform(F.array_distinct(name), _stratum(label)))
    return df.select("*", F.inline(F.concat(*parts)))


def stratified_metrics(cells: DataFrame, expected: str, predicted: str, board: str,
                       dims: Sequence[str], multi: Sequence[str] = ()) -> DataFrame:
    """Board error metrics over several dimensions at once.

    Cells are reduced to boards before the strata multiply the rows.
    """
    b = per_board(cells, expected, predicted, [board, *dims, *multi])
    return stratify(b, dims, multi).groupBy("dimension", "value").agg(
        F.count(ONE).alias("boards"), F.sum("squares").alias("squares"),
        count_of(F.col("squares") == F.col("correct")).alias("exact_boards"),
        F.sum("correct").alias("correct_squares"), F.sum("false_pieces").alias("false_pieces"),
        F.sum("missed_pieces").alias("missed_pieces"))


def coverage(cells: DataFrame, class_id: str, idx: str, board: str, position: str, group: str,
             split: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Squares, boards, positions and groups per split x class x colour (full grid of ``splits``).

    The (class, colour) pairs of a board are bits of one number, so its 64 cells become one row before any distinct
    counting, and positions and groups join the bits of their boards. Cells of classes without a bit are counted as rows.
    """
    by, keys = [split, class_id, "background"], [split, board, position, group]
    with_bit = F.coalesce(F.col(class_id).between(0, BITS - 1), F.lit(False))
    place = (2 * F.col(class_id) + F.when(background(idx) == "dark", 1).otherwise(0)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    pairs = F.array(*[F.struct(F.lit(c).cast(cells.schema[class_id].dataType).alias(class_id), F.lit(b).alias("background"),
                               F.lit(2 * c + i).alias("_bit")) for c in range(BITS) for i, b in enumerate(("light", "dark"))])

    def held(rows: DataFrame, name: str) -> DataFrame:
        """How many of ``rows`` have each bit."""
        sums = rows.groupBy(split).agg(*[F.sum(F.getbit("_bits", F.lit(b)).cast("long")).alias(f"_{b}") for b in range(2 * BITS)])
        listed = sums.select(split, F.array(*[f"_{b}" for b in range(2 * BITS)]).alias("_sums"), F.inline(pairs))
        return listed.select(*by, F.get("_sums", "_bit").alias(name)).where(F.col(name) > 0)

    def of(rows: DataFrame, key: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy(split, key).agg(F.bit_or("_bits").alias("_bits"))

    squares = _stored(cells.groupBy(split, class_id, background(idx).alias("background")).agg(F.count(ONE).alias("squares")),
                      "coverage-squares")
    boards = _stored(cells.where(with_bit).groupBy(*keys).agg(F.bit_or(bit).alias("_bits")), "coverage-boards")
    counts = squares.where(with_bit)
    for rows, name in ((boards, "boards"), (of(boards, position), "positions"), (of(boards, group), "groups")):
        counts = counts.join(held(rows, name), by, "left")
    if squares.where(~with_bit).isEmpty():
        return _coverage_grid(cells, counts, by, split, splits, class_id)
    rows = cells.where(~with_bit).groupBy(split, class_id, background(idx).alias("background"), board, position, group).agg(
        F.count(ONE).alias("_n"))
    counts = counts.unionByName(rows.groupBy(*by).agg(
        F.sum("_n").alias("squares"), F.count(ONE).alias("boards"), F.countDistinct(position).alias("positions"),
        F.countDistinct(group).alias("groups")))
    return _coverage_grid(cells, counts, by, split, splits, class_id)


def _coverage_grid(cells: DataFrame, counts: DataFrame, by: list[str], split: str, splits: Sequence[str], class_id: str) -> DataFrame:
    return (full_grid(cells, {split: splits}, class_id).join(counts, by, "full").na.fill(0, ["squares", "boards", "positions", "groups"])
            .withColumn("label", class_label(class_id)))


def tag_coverage(cells: DataFrame, tags: str, archive: str, position: str, group: str,
                 class_id: str, idx: str, selected: str) -> DataFrame:
    """Per tag: unique archives, positions, groups, squares and selected squares."""
    e = cells.select(F.explode(F.array_distinct(tags)).alias("tag"), archive, position, group,
                     F.col(class_id).alias("_c"), F.col(selected).alias("_s"))
    by_board = e.groupBy("tag", archive, position, group).agg(
        F.count(ONE).alias("_n"), count_of(F.col("_c") == 0).alias("_e"),
        count_of(F.col("_s")).alias("_sel"))
    return by_board.groupBy("tag").agg(
        F.countDistinct(archive).alias("archives"), F.countDistinct(position).alias("positions"),
        F.countDistinct(group).alias("groups"), F.sum("_n").alias("squares"),
        F.sum("_e").alias("empty_squares"),
        (F.sum("_n") - F.sum("_e")).alias("occupied_squares"),
        F.sum("_sel").alias("selected_squares"))


def tag_examples(cells: DataFrame, tags: str, archive: str, class_id: str, idx: str) -> DataFrame:
    """First board and cell of every (tag, class, colour)."""
    e = cells.select(F.explode(F.array_distinct(tags)).alias("tag"), class_label(class_id).alias("label"),
                     background(idx).alias("background"),
                     F.struct(F.col(archive).alias("a"), F.col(idx).alias("i")).alias("_at"))
    return (e.groupBy("tag", "label", "background").agg(F.min("_at").alias("_at"))
            .select("tag", "label", "background", F.col("_at.a").alias(archive),
                    F.col("_at.i").alias(idx)))


def marked_cells(cells: DataFrame, marks: DataFrame, board: str, idx: str, squares: str) -> DataFrame:
    """Each cell beside each mark of its board that lies on it, once, however often the mark names the square.

    Both sides meet by the board alone, on the partitioning they may have already. Which side is small is not known
    before the marks are made, so none of them is left to a broadcast.
    """
    return cells.join(marks.hint("shuffle_hash"), board).where(F.array_contains(squares, F.col(idx))).drop(squares)


def marked_coverage(marked: DataFrame, split: str, kind: str, class_id: str, idx: str,
                    splits: Sequence[str] = SPLITS, kinds: Sequence[str] = ("arrow", *MARK_KINDS)) -> DataFrame:
    """Marked cells per split x kind x class x colour with zero rows for missing pairs."""
    by = [split, kind, class_id, "background"]
    counts = marked.groupBy(split, kind, class_id, background(idx).alias("background")).agg(
        F.count(ONE).alias("squares"))
    return (full_grid(marked, {split: splits, kind: kinds}, class_id).join(counts, by, "full").na.fill(0, ["squares"])
            .withColumn("missing", F.col("squares") == 0))


def class_weights(counts: DataFrame, keys: Sequence[str], n: str = "squares",
                  mode: str = "inverse") -> DataFrame:
    """total / (cells x count), optionally square-root tempered; null on zero count.

    ``counts`` is already one row per class (or class x colour): a fixed-size table.
    """
    everything = Window.partitionBy(F.lit(0))
    raw = F.sum(n).over(everything) / (F.count(ONE).over(everything) * F.when(F.col(n) > 0, F.col(n)))
    weight = F.sqrt(raw) if mode == "sqrt" else raw
    return counts.select(*keys, n, F.round(weight, 9).alias("weight"))


def weight_mass(counts: DataFrame, weights: DataFrame, key: str, n: str = "squares") -> DataFrame:
    """Share of total weight per class, and its weight relative to the empty class."""
    j = counts.join(weights.select(key, "weight"), key)
    mass = F.col(n) * F.coalesce("weight", F.lit(0.0))
    all_rows = Window.partitionBy(F.lit(0))
    empty = F.max(F.when(F.col(key) == 0, F.col("weight"))).over(all_rows)
    return j.select(key, n, "weight", F.round(mass / F.sum(mass).over(all_rows), 9).alias("share"),
                    F.round(F.col("weight") / empty, 9).alias("to_empty"))


def confusion_pairs(cells: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Wrong (expected, predicted) label pairs, most common first."""
    wrong = cells.where(F.col(expected) != F.col(predicted))
    return (wrong.groupBy(class_label(expected).alias("expected"),
                          class_label(predicted).alias("predicted"))
            .agg(F.count(ONE).alias("n")).orderBy(F.desc("n"), "expected", "predicted"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counter per value of each column in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(ONE).alias("n"))


def detection_summary(df: DataFrame, by: Sequence[str], found: Column, within: Column, iou: str,
                      error: str) -> DataFrame:
    """Images, detections, in-tolerance count, mean IoU and worst error of localised rows."""
    return df.groupBy(*by).agg(
        F.count(ONE).alias("images"), count_of(found).alias("detected"),
        count_of(found & within).alias("within_tolerance"),
        count_of(~found).alias("failed"), count_of(found & ~within).alias("out_of_tolerance"),
        F.round(F.avg(F.when(found, F.col(iou))), 6).alias("mean_iou"),
        F.max(F.when(found, F.col(error))).alias("max_edge_error"))


def detection_failures(df: DataFrame, found: Column, within: Column) -> DataFrame:
    """The ids behind the failure counts, as rows instead of an unbounded list."""
    reason = F.when(~found, "not-detected").when(~within, "out-of-tolerance")
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def negative_summary(df: DataFrame, by: Sequence[str], detected: Column) -> DataFrame:
    """False detections on images that contain no board."""
    return df.groupBy(*by).agg(
        F.count(ONE).alias("images"), count_of(detected).alias("false_detections"),
        ratio(count_of(detected), F.count(ONE)).alias("false_detection_rate"))


def teacher_audit(draws: DataFrame, cell_keys: Sequence[str], pool: str, label: str,
                  target_class: str, target_digest: str) -> DataFrame:
    """Coverage per pool: exposures, distinct cells, conflicts with the label, repeats.

    ``target_class`` is the argmax of a soft target (null when there is none) and
    ``target_digest`` identifies the target vector, so repeated cells can be checked
    for consistency without comparing arrays pairwise.
    """
    conflict = F.col(target_class).isNotNull() & (F.col(target_class) != F.col(label))
    known = F.col(target_digest).isNotNull()  # numbers, as strings cannot be aggregated by hash
    digest = [F.when(known, F.xxhash64(target_digest)), F.when(known, F.hash(target_digest))]
    per_cell = draws.groupBy(pool, *cell_keys).agg(
        F.count(ONE).alias("_n"), F.count(target_class).alias("_t"),
        count_of(conflict).alias("_c"),
        count_of(conflict & (F.col(label) == 0)).alias("_f"),
        reduce(or_, [F.min(d) != F.max(d) for d in digest]).alias("_diff"))
    return per_cell.groupBy(pool).agg(
        F.sum("_n").alias("exposures"), F.count(ONE).alias("distinct_cells"),
        F.sum("_t").alias("soft_exposures"), F.sum("_c").alias("conflicting_targets"),
        F.sum("_f").alias("false_piece_targets"),
        count_of(F.col("_diff")).alias("inconsistent_cells"))


def pool_report(boards: DataFrame, draws: DataFrame, quotas: DataFrame, pool: str, board: str,
                position: str, group: str, squares: str) -> DataFrame:
    """Quota and share per pool beside what is eligible and what was drawn."""
    have = boards.groupBy(pool).agg(
        F.count(ONE).alias("boards"), F.countDistinct(position).alias("positions"),
        F.countDistinct(group).alias("groups"), F.sum(squares).alias("squares"))
    drawn = (draws.groupBy(pool, board).agg(F.count(ONE).alias("_n"))
             .groupBy(pool).agg(F.sum("_n").alias("drawn"), F.count(ONE).alias("drawn_boards")))
    total = F.sum("quota").over(Window.partitionBy(F.lit(0)))
    return (quotas.withColumn("fraction", F.round(F.col("quota") / total, 9))
            .join(have, pool, "left").join(drawn, pool, "left"))


def composition(df: DataFrame, cohort: str, label: str) -> DataFrame:
    return df.groupBy(cohort, label).agg(F.count(ONE).alias("n"))
