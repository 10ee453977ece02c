"""Paired comparisons of two runs (family P).

``paired_boards`` reduces the cells of a board once; every report reads those rows.
Strata columns belong to the baseline board, never to the candidate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions.placement import class_label, let, square_name, wrong_squares
from boardlake.operators.joins import pair_clean
from boardlake.operators.metrics import count_of

ONE = "*"


def paired_boards(cells: DataFrame, expected: str, baseline: str, candidate: str,
                  keys: Sequence[str]) -> DataFrame:
    """One row per board with both runs' correct, false and missed counts."""
    e = F.col(expected)
    out = [F.count(ONE).alias("squares")]
    for name, col in (("base", baseline), ("cand", candidate)):
        p = F.col(col)
        out += [count_of(e == p).alias(f"{name}_correct"),
                count_of((e == 0) & (p != 0)).alias(f"{name}_false"),
                count_of((e != 0) & (p == 0)).alias(f"{name}_missed")]
    rows = cells.groupBy(*keys).agg(*out)
    return (rows.withColumn("base_exact", F.col("base_correct") == F.col("squares"))
            .withColumn("cand_exact", F.col("cand_correct") == F.col("squares")))


def outcome(base: str = "base_exact", cand: str = "cand_exact") -> Column:
    b, c = F.col(base), F.col(cand)
    return (F.when(b & c, "both").when(b, "lost").when(c, "gained").otherwise("neither"))


def paired_changes(boards: DataFrame, board: str) -> DataFrame:
    """Boards that became exact or stopped being exact."""
    return (boards.select(board, outcome().alias("outcome"))
            .where(F.col("outcome").isin("gained", "lost")))


def paired_counts(boards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return boards.groupBy(*by).agg(
        F.count(ONE).alias("boards"), count_of(F.col("base_exact")).alias("base_exact_boards"),
        count_of(F.col("cand_exact")).alias("cand_exact_boards"),
        count_of(outcome() == "gained").alias("gained"), count_of(outcome() == "lost").alias("lost"))


def cell_changes(cells: DataFrame, expected: str, baseline: str, candidate: str,
                 keys: Sequence[str], idx: str = "idx") -> DataFrame:
    """Cells whose prediction changed: regression, recovery or another error."""
    e, a, b = F.col(expected), F.col(baseline), F.col(candidate)
    change = F.when(a == e, "regression").when(b == e, "recovery").otherwise("changed-error")
    return cells.where(a != b).select(
        *keys, idx, square_name(idx).alias("square"), class_label(expected).alias("expected"),
        class_label(baseline).alias("baseline"), class_label(candidate).alias("candidate"),
        change.alias("change"))


def paired_contingency(boards: DataFrame, pair: str, board: str, is_clean: Column, conditions: Column,
                       exact: str, prediction: str) -> DataFrame:
    """2 x 2 outcomes of marked boards against their clean control, per condition."""
    pairs = pair_clean(boards.withColumn("_conditions", conditions), pair, is_clean, board,
                       [exact, prediction, "_conditions"])
    a, b = F.col(f"clean_{exact}"), F.col(exact)
    rows = pairs.select(F.explode("_conditions").alias("condition"), a.alias("a"), b.alias("b"),
                        F.col(f"clean_{board}").isNull().alias("orphan"),
                        F.col(prediction).eqNullSafe(F.col(f"clean_{prediction}")).alias("same"))
    a, b = F.col("a"), F.col("b")
    return rows.groupBy("condition").agg(
        F.count(ONE).alias("pairs"), count_of(F.col("orphan")).alias("without_control"),
        count_of(a & b).alias("both_correct"), count_of(a & ~b).alias("clean_only_correct"),
        count_of(~a & b).alias("marked_only_correct"), count_of(~a & ~b).alias("neither_correct"),
        count_of(F.col("same") & ~F.col("orphan")).alias("identical_predictions"))


def stage_failures(boards: DataFrame, keys: Sequence[str], expected: str, annotated: str,
                   automatic: str) -> DataFrame:
    """Where a board fails: detection, crop, classifier; and which squares moved.

    A board without automatic result has null automatic errors, not zero.
    """
    def squares(actual: str) -> Column:
        return F.transform(wrong_squares(expected, actual), lambda w: w["square"])

    def describe(both: Column) -> Column:
        m, a = F.size(both["m"]), F.when(both["a"].isNotNull(), F.size(both["a"]))
        stage = (F.when(a.isNull(), "detection-failed").when((a > 0) & (m == 0), "crop-sensitive-failure")
                 .when(a > 0, "classification-fails-with-both-geometries")
                 .when(m > 0, "automatic-crop-recovers-position").otherwise("both-correct"))

        def text(c: Column) -> Column:
            return F.when(both["a"].isNotNull(), F.array_join(c, "; ")).otherwise("")

        return F.struct(
            stage.alias("stage"), m.cast("long").alias("annotated_errors"), a.cast("long").alias("automatic_errors"),
            text(F.array_except(both["m"], both["a"])).alias("recovered_squares"),
            text(F.array_except(both["a"], both["m"])).alias("introduced_squares"),
            text(F.array_intersect(both["m"], both["a"])).alias("persistent_squares"))

    both = F.struct(squares(annotated).alias("m"), squares(automatic).alias("a"))
    return boards.select(*keys, let(both, describe).alias("_r")).select(*keys, "_r.*")


def stage_summary(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(
        F.count(ONE).alias("images"), F.sum("annotated_errors").alias("annotated_errors"),
        F.sum("automatic_errors").alias("automatic_errors"))


def geometry_gaps(samples: DataFrame, detections: DataFrame, key: str, found: str, within: str,
                  carry: Sequence[str]) -> DataFrame:
    """Development images without a detection inside the geometry policy."""
    j = samples.select(key, *carry).join(detections.select(key, found, within), key, "left")
    code = F.when(~F.coalesce(found, F.lit(False)), "BOARD_NOT_FOUND").otherwise("OUTSIDE_GEOMETRY_POLICY")
    return j.where(~(F.coalesce(found, F.lit(False)) & F.coalesce(within, F.lit(False)))).select(
        key, *carry, code.alias("error_code"))


def scenario_report(rows: DataFrame, board: str, scenario: str, reference: str, exact: str, correct: str,
                    squares: str, invalid: str) -> DataFrame:
    """Metrics per perturbation, boards lost against the reference, invalid crops."""
    base = rows.where(F.col(scenario) == reference).select(board, F.col(exact).alias("_ref"))
    j = rows.join(base, board, "left")
    ok = ~F.col(invalid)
    return j.groupBy(scenario).agg(
        F.count(ONE).alias("boards"), count_of(ok).alias("applicable"),
        count_of(F.col(invalid)).alias("invalid_crops"),
        count_of(ok & F.col(exact)).alias("exact_boards"),
        F.sum(F.when(ok, F.col(correct)).otherwise(0)).alias("correct_squares"),
        F.sum(F.when(ok, F.col(squares)).otherwise(0)).alias("squares"),
        count_of(ok & F.col("_ref") & ~F.col(exact)).alias("previously_correct_lost"))


def scenario_cases(rows: DataFrame, scenario: str, case: str, exact: str, correct: str, squares: str,
                   invalid: str) -> DataFrame:
    """Metrics of the applicable boards per perturbation and case; a case without any keeps its row."""
    ok = ~F.col(invalid)
    return rows.groupBy(scenario, case).agg(
        count_of(ok).alias("applicable"), count_of(ok & F.col(exact)).alias("exact_boards"),
        F.sum(F.when(ok, F.col(correct)).otherwise(0)).alias("correct_squares"),
        F.sum(F.when(ok, F.col(squares)).otherwise(0)).alias("squares"))


def recovery_positions(before: DataFrame, after: DataFrame, key: str, result: str, expected: str,
                       by: Sequence[str] = ()) -> DataFrame:
    """Lost and gained exact boards, and returned positions that changed, of two pipeline versions.

    ``result`` is null where nothing was returned. Accepted: no board lost, no returned position changed, at least one
    board gained, and every board in both versions.
    """
    new = after.select(key, F.col(result).alias("_r"), F.lit(True).alias("_n"))
    j = before.select(key, *by, result, expected, F.lit(True).alias("_o")).join(new, key, "full")
    was, now = (F.coalesce(F.col(c) == F.col(expected), F.lit(False)) for c in (result, "_r"))
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    out = j.groupBy(*by).agg(
        count_of(was & ~now).alias("lost_boards"), count_of(~was & now).alias("gained_boards"),
        count_of(both & F.col(result).isNotNull() & ~F.col(result).eqNullSafe(F.col("_r"))).alias("changed_positions"),
        count_of(~both).alias("unmatched"))
    return out.withColumn("accepted", (F.col("lost_boards") == 0) & (F.col("changed_positions") == 0)
                          & (F.col("gained_boards") > 0) & (F.col("unmatched") == 0))


def recovery_compare(before: DataFrame, after: DataFrame, key: str, found: str, corners: str,
                     by: Sequence[str] = ()) -> DataFrame:
    """Lost and new detections and changed corners of two detector versions."""
    new = after.select(key, F.col(found).alias("_f"), F.col(corners).alias("_c"), F.lit(True).alias("_n"))
    j = before.select(key, *by, found, corners, F.lit(True).alias("_o")).join(new, key, "full")
    was, now = F.coalesce(found, F.lit(False)), F.coalesce("_f", F.lit(False))
    out = j.groupBy(*by).agg(
        F.count(ONE).alias("images"), count_of(was).alias("before"), count_of(now).alias("after"),
        count_of(was & ~now).alias("lost"), count_of(~was & now).alias("new"),
        count_of(was & now & (F.col(corners) != F.col("_c"))).alias("changed_corners"),
        count_of(F.col("_o").isNull() | F.col("_n").isNull()).alias("unmatched"))
    return out.withColumn("accepted", (F.col("lost") == 0) & (F.col("changed_corners") == 0)
                          & (F.col("unmatched") == 0) & (F.col("new") > 0))


def regression_cases(cells: DataFrame, boards: DataFrame, board: str, pair: str, is_clean: Column,
                     expected: str, baseline: str, candidate: str, carry: Sequence[str]) -> DataFrame:
    """Boards lost by the candidate with their changed squares and clean control."""
    runs = paired_boards(cells, expected, baseline, candidate, [board]).select(
        board, "base_exact", "cand_exact")
    lost = runs.where("base_exact AND NOT cand_exact").select(board)
    changes = (cell_changes(cells.join(lost, board, "left_semi"), expected, baseline, candidate, [board])
               .groupBy(board).agg(F.array_sort(F.collect_list(F.struct(
                   "idx", F.concat("square", F.lit(":"), "expected", F.lit("->"), "candidate").alias("t"))))
                   .alias("_c"))
               .select(board, F.array_join(F.transform("_c", lambda c: c["t"]), "; ").alias("changes")))
    control = (boards.where(is_clean).join(runs, board).groupBy(pair).agg(
        F.count(ONE).alias("controls"), F.min(board).alias("control"),
        F.bool_and("base_exact").alias("control_base_exact"),
        F.bool_and("cand_exact").alias("control_cand_exact")))
    single = F.col("controls") == 1
    return (boards.select(board, pair, *carry).join(changes, board).join(control, pair, "left")
            .select(board, *carry, "changes", F.when(single, F.col("control")).alias("control"),
                    F.when(single, F.col("control_base_exact")).alias("control_base_exact"),
                    F.when(single, F.col("control_cand_exact")).alias("control_cand_exact")))


def ablation_report(boards: DataFrame, by: Sequence[str]) -> DataFrame:
    """Control against candidate per epoch and domain."""
    def total(c):
        return F.sum(c).alias(c)
    return boards.groupBy(*by).agg(
        F.count(ONE).alias("boards"), total("base_correct"), total("cand_correct"), total("base_false"),
        total("cand_false"), total("base_missed"), total("cand_missed"),
        count_of(outcome() == "gained").alias("gained"), count_of(outcome() == "lost").alias("lost"))


def recheck(rows: DataFrame, failures: DataFrame, key: str, bounds_ok: Column,
            position_ok: Column) -> DataFrame:
    """Previously failing items again: counts and one overall verdict."""
    again = rows.join(failures.select(key), key, "left_semi")
    return again.agg(F.count(ONE).alias("images"), count_of(bounds_ok).alias("bounds_correct"),
                     count_of(position_ok).alias("positions_correct"),
                     F.coalesce(F.bool_and(F.coalesce(bounds_ok & position_ok, F.lit(False))), F.lit(False)).alias("passed"))


def appearance_status(boards: DataFrame, group: str, exact: str) -> DataFrame:
    return boards.groupBy(group).agg(
        F.count(ONE).alias("boards"), count_of(F.col(exact)).alias("exact_boards")).withColumn(
        "status", F.when(F.col("boards") == F.col("exact_boards"), "all-observed-boards-correct")
        .otherwise("observed-failures"))
