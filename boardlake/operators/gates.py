"""Fail-closed acceptance gates over metric tables (family Q)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.functions.placement import class_label
from boardlake.functions.rules import broken
from boardlake.operators.compare import outcome
from boardlake.operators.metrics import count_of, stratify

ONE = "*"


def passes(actual: Column, threshold: Column, comparison: Column) -> Column:
    """Null and NaN never pass."""
    valid = actual.isNotNull() & ~F.isnan(actual) & (F.abs(actual) != F.lit(float("inf")))
    return F.coalesce(valid & F.when(comparison == ">=", actual >= threshold)
                      .when(comparison == "<=", actual <= threshold), F.lit(False))


def apply_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Every gate with its metric; a missing metric fails."""
    j = gates.join(metrics.select("name", F.col("actual").cast("double").alias("actual")), "name", "left")
    return j.select("name", "actual", "threshold", "comparison",
                    passes(F.col("actual"), F.col("threshold"), F.col("comparison")).alias("passed"))


def verdict(gates: DataFrame) -> DataFrame:
    return gates.agg(F.count(ONE).alias("gates"), count_of(~F.col("passed")).alias("failed"),
                     F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ready"))


def class_recall_losses(cells: DataFrame, domain: str, expected: str, baseline: str,
                        candidate: str) -> DataFrame:
    """Classes a domain now gets right less often."""
    e = F.col(expected)
    per = cells.groupBy(domain, expected).agg(
        F.count(ONE).alias("total"), count_of(e == F.col(baseline)).alias("base_correct"),
        count_of(e == F.col(candidate)).alias("cand_correct"))
    return per.groupBy(domain).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(
            F.col("cand_correct") < F.col("base_correct"), class_label(expected)))), ",").alias("lost_classes"),
        F.round(F.avg(F.col("cand_correct") / F.col("total")), 9).alias("cand_macro_recall"))


def worse_strata(boards: DataFrame, domain: str, dims: Sequence[str], multi: Sequence[str] = ()) -> DataFrame:
    """Frozen strata with fewer exact boards or squares, or more false or missed pieces."""
    s = stratify(boards, dims, multi).groupBy(domain, "dimension", "value").agg(
        (count_of(F.col("cand_exact")) - count_of(F.col("base_exact"))).alias("exact"),
        *[F.sum(F.col(f"cand_{c}") - F.col(f"base_{c}")).alias(c) for c in ("correct", "false", "missed")])
    return s.where((F.col("exact") < 0) | (F.col("correct") < 0) | (F.col("false") > 0) | (F.col("missed") > 0))


def safety_gate(cells: DataFrame, boards: DataFrame, domain: str, dims: Sequence[str], expected: str,
                baseline: str, candidate: str, domains: Sequence[str], multi: Sequence[str] = ()) -> DataFrame:
    """Per domain of ``domains``: all reasons a checkpoint is unsafe, and its ranking values.

    A domain without boards is a row that is not safe. Rows of other domains are judged as well.
    """
    totals = boards.groupBy(domain).agg(
        F.count(ONE).alias("boards"), count_of(outcome() == "lost").alias("lost_boards"),
        count_of(outcome() == "gained").alias("gained_boards"),
        count_of(F.col("cand_exact")).alias("cand_exact_boards"),
        F.sum("cand_correct").alias("cand_correct_squares"),
        *[F.sum(F.col(f"cand_{c}") - F.col(f"base_{c}")).alias(f"{c}_change")
          for c in ("correct", "false", "missed")])
    strata = worse_strata(boards, domain, dims, multi).groupBy(domain).agg(F.count(ONE).alias("worse_strata"))
    j = (totals.join(class_recall_losses(cells, domain, expected, baseline, candidate), domain)
         .join(strata, domain, "left").na.fill(0, ["worse_strata"]))
    required = cells.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domains))).alias(domain))
    j = required.join(j, domain, "full")
    rules = {"missing domain": F.col("boards").isNull(), "lost baseline-correct boards": F.col("lost_boards") != 0,
             "fewer correct squares": F.col("correct_change") < 0, "increased false pieces": F.col("false_change") > 0,
             "increased missed pieces": F.col("missed_change") > 0, "decreased class recall": F.col("lost_classes") != "",
             "worsened strata": F.col("worse_strata") != 0}
    missing = F.col("boards").isNull()
    reasons = F.when(missing, F.array(F.lit("missing domain"))).otherwise(broken(rules))
    return j.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("safe", F.col("reasons") == "")


def assess_accuracy(gate: DataFrame, domain: str, gain_domain: str, minimum_gain: int = 1) -> DataFrame:
    """One row over a :func:`safety_gate`: safe checkpoint, accuracy accepted, all reasons with their domain.

    Accepted means safe in every domain and at least ``minimum_gain`` more exact boards in ``gain_domain``;
    losses elsewhere are never offset, and no row at all is neither safe nor accepted.
    """
    if minimum_gain < 1:
        raise ValueError("require at least one additional correct board")
    gain = F.when(F.col(domain) == gain_domain, F.col("gained_boards") - F.col("lost_boards"))
    one = gate.agg(F.coalesce(F.bool_and("safe"), F.lit(False)).alias("safe_checkpoint"),
                   F.coalesce(F.max(gain) >= minimum_gain, F.lit(False)).alias("_gain"),
                   F.array_sort(F.collect_list(F.when(~F.col("safe"), F.concat(domain, F.lit(": "), "reasons")))).alias("_r"))
    short = F.when(~F.col("_gain"), F.array(F.lit(f"{gain_domain}: insufficient exact-board improvement"))).otherwise(
        F.array().cast("array<string>"))
    return one.select("safe_checkpoint", (F.col("safe_checkpoint") & F.col("_gain")).alias("accuracy_accepted"),
                      F.array_join(F.concat("_r", short), "; ").alias("reasons"))


def tolerance_gate(rows: DataFrame, board: str, scenario: str, reference: str, case: str) -> DataFrame:
    """Reference preserved, same applicable inputs, strict perturbed gain, no case loss.

    ``rows`` holds per (board, scenario) the two runs' exact flag, correct squares and
    validity.
    """
    ref = F.col(scenario) == reference
    ok_a, ok_b = F.col("base_valid"), F.col("cand_valid")
    gain = (F.when(ok_b & F.col("cand_exact"), 1).otherwise(0)
            - F.when(ok_a & F.col("base_exact"), 1).otherwise(0))
    squares = (F.when(ok_b, F.col("cand_correct")).otherwise(0)
               - F.when(ok_a, F.col("base_correct")).otherwise(0))
    cases = rows.groupBy(case).agg(
        F.sum(gain).alias("_g"), F.sum(squares).alias("_q"),
        count_of(ref & F.col("base_exact") & ~F.col("cand_exact")).alias("_lost"),
        F.sum(F.when(ref, F.col("cand_correct") - F.col("base_correct")).otherwise(0)).alias("_rq"),
        F.sum(F.when(~ref, gain).otherwise(0)).alias("_pg"),
        count_of(ok_a != ok_b).alias("_diff"))
    out = cases.agg(
        F.sum("_lost").alias("reference_lost"), F.sum("_rq").alias("reference_squares_change"),
        F.sum("_pg").alias("perturbed_gain"), F.sum("_diff").alias("different_inputs"),
        count_of((F.col("_g") < 0) | (F.col("_q") < 0)).alias("cases_lost"))
    return out.withColumn("passed", F.coalesce(
        (F.col("reference_lost") == 0) & (F.col("reference_squares_change") >= 0)
        & (F.col("perturbed_gain") > 0) & (F.col("different_inputs") == 0) & (F.col("cases_lost") == 0),
        F.lit(False)))


def readiness(before_errors: DataFrame, after_errors: DataFrame, key: str, detections: DataFrame,
              within: Column, extra: DataFrame, max_new: float, max_missed: float) -> DataFrame:
    """New board errors against the old set, unresolved misses, and further evidence gates."""
    new = (after_errors.select(key).distinct().join(before_errors.select(key), key, "left_anti")
           .agg(F.count(ONE).cast("double").alias("actual")).withColumn("name", F.lit("new-regression-board-errors")))
    missed = (detections.agg(count_of(~F.coalesce(within, F.lit(False))).cast("double").alias("actual"))
              .withColumn("name", F.lit("unresolved-detection-misses")))
    own = new.withColumn("threshold", F.lit(float(max_new))).unionByName(
        missed.withColumn("threshold", F.lit(float(max_missed)))).withColumn("comparison", F.lit("<="))
    rows = own.select("name", "actual", "threshold", "comparison", passes(
        F.col("actual"), F.col("threshold"), F.col("comparison")).alias("passed"))
    return rows.unionByName(extra)


def control_deltas(boards: DataFrame, case: str, controls: Sequence[str]) -> DataFrame:
    """Change of exact boards and squares per control case; clean must not lose either."""
    d = boards.where(F.col(case).isin(*controls)).groupBy(case).agg(
        (count_of(F.col("cand_exact")) - count_of(F.col("base_exact"))).alias("exact_boards_delta"),
        F.sum(F.col("cand_correct") - F.col("base_correct")).alias("correct_squares_delta"))
    return d.withColumn("maintained", (F.col("exact_boards_delta") >= 0) & (F.col("correct_squares_delta") >= 0))


def dual_acceptance(boards: DataFrame, variant: str, geometry: str) -> DataFrame:
    """A variant is accepted when, in every geometry, it gains boards and loses nothing."""
    modes = boards.groupBy(variant, geometry).agg(
        count_of(outcome() == "lost").alias("lost"), count_of(outcome() == "gained").alias("gained"),
        F.sum(F.col("cand_correct") - F.col("base_correct")).alias("squares_change"))
    modes = modes.withColumn("passes", (F.col("lost") == 0) & (F.col("gained") > 0)
                             & (F.col("squares_change") >= 0))
    return modes.withColumn("accepted", F.bool_and("passes").over(Window.partitionBy(variant)))
