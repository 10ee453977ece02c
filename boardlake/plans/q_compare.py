"""Paired comparison and gate queries (families P and Q)."""

from pyspark.sql import functions as F

from boardlake.operators import compare as P
from boardlake.operators import gates as Q
from boardlake.operators import metrics as M
from boardlake.plans.q_labels import SQUARE
from boardlake.plans.q_metrics import label
from boardlake.plans.registry import query, sql

_KEYS = ["board_id", "category", "orientation", "pair_id", "split"]
_PB = ("SELECT *, base_correct = squares AS base_exact, cand_correct = squares AS cand_exact FROM (SELECT board_id, category, "
       "orientation, pair_id, split, count(*) AS squares, "
       + ", ".join(f"count(*) FILTER (class_id = {c}) AS {n}_correct, count(*) FILTER (class_id = 0 AND {c} <> 0) AS {n}_false, "
                   f"count(*) FILTER (class_id <> 0 AND {c} = 0) AS {n}_missed" for n, c in (("base", "pred_id"), ("cand", "cand_id")))
       + " FROM cells GROUP BY 1, 2, 3, 4, 5)")
_CLEAN = "conditions = ['clean']"


def boards(t):
    return P.paired_boards(t.cells, "class_id", "pred_id", "cand_id", _KEYS)


def clean():
    return F.col("conditions") == F.array(F.lit("clean"))


@query("p1_paired_changes", sql(
    "SELECT board_id, CASE WHEN base_exact THEN 'lost' ELSE 'gained' END AS outcome FROM pb WHERE base_exact <> cand_exact", pb=_PB))
def p1(t):
    return P.paired_changes(boards(t), "board_id")


@query("p1_paired_counts", sql(
    "SELECT category, count(*) AS boards, count(*) FILTER (base_exact) AS base_exact_boards, count(*) FILTER (cand_exact) AS "
    "cand_exact_boards, count(*) FILTER (cand_exact AND NOT base_exact) AS gained, count(*) FILTER (base_exact AND NOT cand_exact) AS "
    "lost FROM pb GROUP BY 1", pb=_PB))
def p1b(t):
    return P.paired_counts(boards(t), ["category"])


_CH = ("CASE WHEN pred_id = class_id THEN 'regression' WHEN cand_id = class_id THEN 'recovery' ELSE 'changed-error' END")


@query("p2_cell_changes", sql(
    f"SELECT board_id, idx, {SQUARE} AS square, {label('class_id')} AS expected, {label('pred_id')} AS baseline, {label('cand_id')} "
    f"AS candidate, {_CH} AS change FROM cells WHERE pred_id <> cand_id"))
def p2(t):
    return P.cell_changes(t.cells, "class_id", "pred_id", "cand_id", ["board_id"])


_CTRL = "SELECT pair_id, min(board_id) AS c FROM boards WHERE conditions = ['clean'] GROUP BY 1"


@query("p3_paired_contingency", sql(
    "SELECT condition, count(*) AS pairs, count(*) FILTER (c IS NULL) AS without_control, count(*) FILTER (a AND b) AS both_correct, "
    "count(*) FILTER (a AND NOT b) AS clean_only_correct, count(*) FILTER (NOT a AND b) AS marked_only_correct, count(*) FILTER (NOT a "
    "AND NOT b) AS neither_correct, count(*) FILTER (c IS NOT NULL AND pg IS NOT DISTINCT FROM cg) AS identical_predictions FROM (SELECT unnest("
    "p.conditions) AS condition, c, g.grid = g.pred_grid AS b, cgr.grid = cgr.pred_grid AS a, p.pred_grid AS pg, cgr.pred_grid AS cg "
    "FROM placements p JOIN grids g USING (board_id) LEFT JOIN ct ON p.pair_id = ct.pair_id LEFT JOIN grids cgr ON cgr.board_id = ct.c "
    "WHERE p.conditions <> ['clean']) GROUP BY 1", ct=_CTRL))
def p3(t):
    p = t.placed("grid", "pred_grid").withColumn("exact", F.col("grid") == F.col("pred_grid"))
    return P.paired_contingency(p, "pair_id", "board_id", clean(), F.col("conditions"), "exact", "pred_grid")


_STAGE = ("SELECT board_id, category, CASE WHEN x THEN 'detection-failed' WHEN a > 0 AND m = 0 THEN 'crop-sensitive-failure' WHEN a > 0 THEN "
          "'classification-fails-with-both-geometries' WHEN m > 0 THEN 'automatic-crop-recovers-position' ELSE 'both-correct' END AS stage, "
          "m AS annotated_errors, CASE WHEN NOT x THEN a END AS automatic_errors, CASE WHEN NOT x THEN coalesce(r, '') ELSE '' END AS "
          "recovered_squares, CASE WHEN NOT x THEN coalesce(i, '') ELSE '' END AS introduced_squares, CASE WHEN NOT x THEN coalesce(p, '') "
          "ELSE '' END AS persistent_squares FROM (SELECT board_id, category, min(cand_id) < 0 AS x, count(*) FILTER (ann <> class_id) AS m, "
          "count(*) FILTER (cand_id <> class_id) AS a, "
          + ", ".join(f"string_agg({SQUARE}, '; ' ORDER BY idx) FILTER ({c}) AS {n}" for n, c in (
              ("r", "ann <> class_id AND cand_id = class_id"), ("i", "ann = class_id AND cand_id <> class_id"),
              ("p", "ann <> class_id AND cand_id <> class_id")))
          + " FROM (SELECT *, CASE WHEN pred_id < 0 THEN class_id ELSE pred_id END AS ann FROM cells) GROUP BY 1, 2)")


def stages(t):
    p = t.placed("grid", "pred_grid", "cand_grid").withColumn("annotated", F.coalesce("pred_grid", "grid"))
    return P.stage_failures(p, ["board_id", "category"], "grid", "annotated", "cand_grid")


@query("p4_stage_failures", sql(_STAGE))
def p4(t):
    return stages(t)


@query("p4_stage_summary", sql(
    "SELECT stage, count(*) AS images, CAST(sum(annotated_errors) AS BIGINT) AS annotated_errors, CAST(sum(automatic_errors) AS BIGINT) "
    "AS automatic_errors FROM s GROUP BY 1", s=_STAGE))
def p4b(t):
    return P.stage_summary(stages(t))


@query("p5_geometry_gaps", sql(
    "SELECT board_id, category, CASE WHEN found IS NULL OR NOT found THEN 'BOARD_NOT_FOUND' ELSE 'OUTSIDE_GEOMETRY_POLICY' END AS "
    "error_code FROM boards LEFT JOIN (SELECT board_id, bool_or(found) AS found, max(abs(w - dw)) <= 3 AS within FROM rects GROUP BY 1) "
    "USING (board_id) WHERE NOT (coalesce(found, false) AND coalesce(within, false))"))
def p5(t):
    d = t.rects.groupBy("board_id").agg(F.bool_or("found").alias("found"),
                                        (F.max(F.abs(F.col("w") - F.col("dw"))) <= 3).alias("within"))
    return P.geometry_gaps(t.boards, d, "board_id", "found", "within", ["category"])


_SC = ("SELECT board_id, category, unnest(['reference', 'shift', 'resample']) AS scenario, unnest([b.base_correct, b.cand_correct, "
       "(b.base_correct + b.cand_correct) // 2]) AS correct, unnest([false, board_id % 29 = 0, board_id % 31 = 0]) AS invalid, squares "
       "FROM pb b")


def scenarios(t):
    b = boards(t)
    k = F.col("board_id")
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), c.alias("correct"), i.alias("invalid")) for n, c, i in (
        ("reference", F.col("base_correct"), F.lit(False)), ("shift", F.col("cand_correct"), k % 29 == 0),
        ("resample", F.floor((F.col("base_correct") + F.col("cand_correct")) / 2), k % 31 == 0))])
    return b.select("board_id", "category", "squares", F.inline(rows)).withColumn(
        "exact", F.col("correct") == F.col("squares"))


@query("p6_scenario_report", sql(
    "SELECT scenario, count(*) AS boards, count(*) FILTER (NOT invalid) AS applicable, count(*) FILTER (invalid) AS invalid_crops, "
    "count(*) FILTER (NOT invalid AND correct = squares) AS exact_boards, CAST(sum(CASE WHEN invalid THEN 0 ELSE correct END) AS BIGINT) AS "
    "correct_squares, CAST(sum(CASE WHEN invalid THEN 0 ELSE squares END) AS BIGINT) AS squares, count(*) FILTER (NOT invalid AND ref AND "
    "correct <> squares) AS previously_correct_lost FROM (SELECT *, bool_or(scenario = 'reference' AND correct = squares) OVER (PARTITION BY "
    "board_id) AS ref FROM s) GROUP BY 1", pb=_PB, s=_SC))
def p6(t):
    return P.scenario_report(scenarios(t), "board_id", "scenario", "reference", "exact", "correct", "squares", "invalid")


@query("p6_scenario_cases", sql(
    "SELECT scenario, board_id % 5 AS case_no, count(*) FILTER (NOT invalid) AS applicable, count(*) FILTER (NOT invalid AND correct = squares) AS exact_boards, "
    "CAST(sum(CASE WHEN invalid THEN 0 ELSE correct END) AS BIGINT) AS correct_squares, CAST(sum(CASE WHEN invalid THEN 0 ELSE squares END) AS BIGINT) AS squares "
    "FROM s GROUP BY 1, 2", pb=_PB, s=_SC))
def p6b(t):
    rows = scenarios(t).withColumn("case_no", F.col("board_id") % 5)
    return P.scenario_cases(rows, "scenario", "case_no", "exact", "correct", "squares", "invalid")


@query("p7_recovery_positions", sql(
    "SELECT *, lost_boards = 0 AND changed_positions = 0 AND gained_boards > 0 AND unmatched = 0 AS accepted FROM (SELECT category, count(*) FILTER "
    "(coalesce(pred_grid = grid, false) AND NOT coalesce(now = grid, false)) AS lost_boards, count(*) FILTER (NOT coalesce(pred_grid = grid, false) AND "
    "coalesce(now = grid, false)) AS gained_boards, count(*) FILTER (NOT miss AND pred_grid IS NOT NULL AND pred_grid IS DISTINCT FROM now) AS "
    "changed_positions, count(*) FILTER (miss) AS unmatched FROM (SELECT *, board_id % 41 = 0 AND category = '5-LOW' AS miss, CASE WHEN board_id % 41 = 0 "
    "AND category = '5-LOW' THEN NULL WHEN category = '1-URGENT' THEN coalesce(pred_grid, grid) ELSE cand_grid END AS now FROM placements) GROUP BY 1)"))
def p7b(t):
    p = t.placed("grid", "pred_grid", "cand_grid").select("board_id", "category", "grid", "pred_grid", "cand_grid")
    now = F.when(F.col("category") == "1-URGENT", F.coalesce("pred_grid", "grid")).otherwise(F.col("cand_grid"))
    new = p.where(~((F.col("board_id") % 41 == 0) & (F.col("category") == "5-LOW"))).select("board_id", now.alias("pred_grid"))
    return P.recovery_positions(p, new, "board_id", "pred_grid", "grid", ["category"])


@query("p7_recovery_compare", sql(
    "SELECT category, count(*) AS images, count(*) FILTER (f) AS before, count(*) FILTER (n) AS after, count(*) FILTER (f AND NOT n) AS lost, "
    "count(*) FILTER (NOT f AND n) AS new, count(*) FILTER (f AND n AND board_id % 7 = 0) AS changed_corners, count(*) FILTER (miss) AS unmatched, "
    "count(*) FILTER (f AND NOT n) = 0 AND count(*) FILTER (f AND n AND board_id % 7 = 0) = 0 AND count(*) FILTER (miss) = 0 AND count(*) "
    "FILTER (NOT f AND n) > 0 AS accepted FROM (SELECT category, board_id, found AS f, board_id % 29 <> 0 AND board_id % 31 <> 0 AS n, "
    "board_id % 31 = 0 AS miss FROM quads) GROUP BY 1"))
def p7(t):
    k = F.col("board_id")
    old = t.quads.select("board_id", "category", "found", F.concat_ws(",", "ex0", "ey0").alias("corners"))
    new = t.quads.where(k % 31 != 0).select("board_id", (k % 29 != 0).alias("found"), F.when(
        k % 7 == 0, F.lit("moved")).otherwise(F.concat_ws(",", "ex0", "ey0")).alias("corners"))
    return P.recovery_compare(old, new, "board_id", "found", "corners", ["category"])


@query("p8_regression_cases", sql(
    "SELECT b.board_id, b.category, changes, CASE WHEN n = 1 THEN ctl END AS control, CASE WHEN n = 1 THEN be END AS control_base_exact, CASE WHEN "
    "n = 1 THEN ce END AS control_cand_exact FROM pb b JOIN (SELECT board_id, string_agg(" + SQUARE + f" || ':' || {label('class_id')} || '->' || "
    f"{label('cand_id')}, '; ' ORDER BY idx) AS changes FROM cells WHERE pred_id <> cand_id GROUP BY 1) USING (board_id) LEFT JOIN (SELECT pair_id, "
    "count(*) AS n, min(board_id) AS ctl, bool_and(base_exact) AS be, bool_and(cand_exact) AS ce FROM pb JOIN (SELECT board_id, conditions FROM boards) "
    "USING (board_id) WHERE conditions = ['clean'] GROUP BY 1) c ON c.pair_id = b.pair_id WHERE base_exact AND NOT cand_exact", pb=_PB))
def p8(t):
    return P.regression_cases(t.cells, t.boards, "board_id", "pair_id", clean(), "class_id", "pred_id", "cand_id", ["category"])


@query("p9_ablation_report", sql(
    "SELECT split, orientation, count(*) AS boards, " + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("base_correct", "cand_correct", "base_false", "cand_false", "base_missed", "cand_missed"))
    + ", count(*) FILTER (cand_exact AND NOT base_exact) AS gained, count(*) FILTER (base_exact AND NOT cand_exact) AS lost FROM pb GROUP BY 1, 2",
    pb=_PB))
def p9(t):
    return P.ablation_report(boards(t), ["split", "orientation"])


@query("p10_recheck", sql(
    "SELECT count(*) AS images, count(*) FILTER (found) AS bounds_correct, count(*) FILTER (cand_exact) AS positions_correct, "
    "coalesce(bool_and(coalesce(found AND cand_exact, false)), false) AS passed FROM (SELECT board_id, found, cand_exact FROM pb LEFT JOIN (SELECT "
    "board_id, bool_and(found) AS found FROM rects GROUP BY 1) USING (board_id) WHERE NOT base_exact)", pb=_PB))
def p10(t):
    b = boards(t)
    geo = t.rects.groupBy("board_id").agg(F.bool_and("found").alias("found"))
    return P.recheck(b.join(geo, "board_id", "left"), b.where("NOT base_exact"), "board_id", F.col("found"), F.col("cand_exact"))


@query("p11_appearance_status", sql(
    "SELECT config_id, count(*) AS boards, count(*) FILTER (base_exact) AS exact_boards, CASE WHEN bool_and(base_exact) THEN "
    "'all-observed-boards-correct' ELSE 'observed-failures' END AS status FROM pb JOIN (SELECT board_id, group_id AS config_id FROM boards) USING "
    "(board_id) GROUP BY 1", pb=_PB))
def p11(t):
    b = boards(t).join(t.boards.select("board_id", F.col("group_id").alias("config_id")), "board_id")
    return P.appearance_status(b, "config_id", "base_exact")


_GATES = [("category/1-URGENT/exact", 0.5, ">="), ("category/5-LOW/exact", 0.99, ">="), ("category/none/exact", 0.1, ">="),
          ("category/2-HIGH/exact", 0.9, "<="), ("empty-ratio", 1.0, "<=")]
_MET = ("SELECT 'category/' || category || '/exact' AS name, count(*) FILTER (base_exact) / CAST(count(*) AS DOUBLE) AS actual FROM pb GROUP BY 1 "
        "UNION ALL SELECT 'empty-ratio', CAST(NULL AS DOUBLE)")


def _gates(t):
    rate = M.ratio(M.count_of(F.col("base_exact")), F.count("*"))
    metrics = boards(t).groupBy(F.concat(F.lit("category/"), "category", F.lit("/exact")).alias("name")).agg(rate.alias("actual"))
    nothing = t.literal("name string, actual double", [("empty-ratio", None)])
    return Q.apply_gates(metrics.unionByName(nothing), t.literal("name string, threshold double, comparison string", _GATES))


_GSQL = ("SELECT g.name, actual, threshold, comparison, coalesce(CASE comparison WHEN '>=' THEN actual >= threshold ELSE actual <= threshold "
         "END, false) AS passed FROM (VALUES " + ", ".join(f"('{n}', CAST({v} AS DOUBLE), '{c}')" for n, v, c in _GATES)
         + ") g(name, threshold, comparison) LEFT JOIN mt ON g.name = mt.name")


@query("q1_apply_gates", sql(_GSQL, pb=_PB, mt=_MET))
def q1(t):
    return _gates(t)


@query("q1_verdict", sql("SELECT count(*) AS gates, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS ready FROM x",
                         pb=_PB, mt=_MET, x=_GSQL))
def q1b(t):
    return Q.verdict(_gates(t))


_WS = ("SELECT orientation, count(*) AS n FROM (SELECT orientation, d, v FROM (SELECT *, unnest(['category', 'split']) AS d, unnest([category, split]) AS v "
       "FROM pb) GROUP BY 1, 2, 3 HAVING count(*) FILTER (cand_exact) < count(*) FILTER (base_exact) OR sum(cand_correct) < sum(base_correct) OR "
       "sum(cand_false) > sum(base_false) OR sum(cand_missed) > sum(base_missed)) GROUP BY 1")
_CR = (f"SELECT orientation, coalesce(string_agg({label('class_id')}, ',' ORDER BY {label('class_id')}) FILTER (cc < bc), '') AS lost_classes, "
       "round(avg(cc / CAST(n AS DOUBLE)), 9) AS cand_macro_recall FROM (SELECT orientation, class_id, count(*) AS n, count(*) FILTER (class_id = pred_id) AS "
       "bc, count(*) FILTER (class_id = cand_id) AS cc FROM cells GROUP BY 1, 2) GROUP BY 1")


_SAFE = ("SELECT d.orientation, boards, lost_boards, gained_boards, cand_exact_boards, cand_correct_squares, correct_change, false_change, missed_change, "
         "lost_classes, cand_macro_recall, worse_strata, CASE WHEN boards IS NULL THEN 'missing domain' ELSE concat_ws('; ', CASE WHEN lost_boards <> 0 THEN "
         "'lost baseline-correct boards' END, CASE WHEN correct_change < 0 THEN 'fewer correct squares' END, CASE WHEN false_change > 0 THEN "
         "'increased false pieces' END, CASE WHEN missed_change > 0 THEN 'increased missed pieces' END, CASE WHEN lost_classes <> '' THEN "
         "'decreased class recall' END, CASE WHEN worse_strata <> 0 THEN 'worsened strata' END) END AS reasons FROM (SELECT unnest(['white-bottom', "
         "'black-bottom', 'unknown']) AS orientation) d LEFT JOIN (SELECT orientation, count(*) AS boards, count(*) FILTER (base_exact AND NOT cand_exact) AS "
         "lost_boards, count(*) FILTER (cand_exact AND NOT base_exact) AS gained_boards, count(*) FILTER (cand_exact) AS cand_exact_boards, "
         "CAST(sum(cand_correct) AS BIGINT) AS cand_correct_squares, "
         + ", ".join(f"CAST(sum(cand_{c} - base_{c}) AS BIGINT) AS {c}_change" for c in ("correct", "false", "missed"))
         + ", lost_classes, cand_macro_recall, coalesce(max(ws.n), 0) AS worse_strata FROM pb JOIN cr USING (orientation) LEFT JOIN ws USING (orientation) "
         "GROUP BY orientation, lost_classes, cand_macro_recall) x ON d.orientation = x.orientation")


def safety(t):
    return Q.safety_gate(t.cells, boards(t), "orientation", ["category", "split"], "class_id", "pred_id", "cand_id",
                         ["white-bottom", "black-bottom", "unknown"])


@query("q2_safety_gate", sql("SELECT *, reasons = '' AS safe FROM sg", pb=_PB, ws=_WS, cr=_CR, sg=_SAFE))
def q2(t):
    return safety(t)


@query("q2_accuracy", sql(
    "SELECT bool_and(reasons = '') AS safe_checkpoint, bool_and(reasons = '') AND coalesce(max(gained_boards - lost_boards) FILTER (orientation = "
    "'white-bottom') >= 2, false) AS accuracy_accepted, concat_ws('; ', string_agg(orientation || ': ' || reasons, '; ' ORDER BY orientation) FILTER "
    "(reasons <> ''), CASE WHEN NOT coalesce(max(gained_boards - lost_boards) FILTER (orientation = 'white-bottom') >= 2, false) THEN "
    "'white-bottom: insufficient exact-board improvement' END) AS reasons FROM sg", pb=_PB, ws=_WS, cr=_CR, sg=_SAFE))
def q2b(t):
    return Q.assess_accuracy(safety(t), "orientation", "white-bottom", 2)


_TG = ("SELECT board_id, category, unnest(['reference', 'shift', 'resample']) AS scenario, unnest([base_correct, base_correct, cand_correct]) AS a, "
       "unnest([cand_correct, squares, squares]) AS b, unnest([true, board_id % 29 <> 0, board_id % 31 <> 0]) AS va, unnest([true, board_id % 29 <> 0, "
       "board_id % 37 <> 0]) AS vb, squares FROM pb")


@query("q3_tolerance_gate", sql(
    "SELECT *, reference_lost = 0 AND reference_squares_change >= 0 AND perturbed_gain > 0 AND different_inputs = 0 AND cases_lost = 0 AS passed FROM "
    "(SELECT CAST(sum(l) AS BIGINT) AS reference_lost, CAST(sum(rq) AS BIGINT) AS reference_squares_change, CAST(sum(pg) AS BIGINT) AS perturbed_gain, "
    "CAST(sum(d) AS BIGINT) AS different_inputs, count(*) FILTER (g < 0 OR q < 0) AS cases_lost FROM (SELECT category, sum(CAST(vb AND b = squares AS INT) - "
    "CAST(va AND a = squares AS INT)) AS g, sum(CASE WHEN vb THEN b ELSE 0 END - CASE WHEN va THEN a ELSE 0 END) AS q, count(*) FILTER (scenario = 'reference' "
    "AND a = squares AND b <> squares) AS l, sum(CASE WHEN scenario = 'reference' THEN b - a ELSE 0 END) AS rq, sum(CASE WHEN scenario <> 'reference' THEN "
    "CAST(vb AND b = squares AS INT) - CAST(va AND a = squares AS INT) ELSE 0 END) AS pg, count(*) FILTER (va <> vb) AS d FROM x GROUP BY 1))", pb=_PB, x=_TG))
def q3(t):
    k, sq = F.col("board_id"), F.col("squares")
    b, c = F.col("base_correct"), F.col("cand_correct")
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), x.alias("base_correct"), y.alias("cand_correct"), va.alias("base_valid"),
                              vb.alias("cand_valid")) for n, x, y, va, vb in (
        ("reference", b, c, F.lit(True), F.lit(True)), ("shift", b, sq, k % 29 != 0, k % 29 != 0),
        ("resample", c, sq, k % 31 != 0, k % 37 != 0))])
    r = boards(t).select("board_id", "category", "squares", F.inline(rows)) \
        .withColumn("base_exact", F.col("base_correct") == sq).withColumn("cand_exact", F.col("cand_correct") == sq)
    return Q.tolerance_gate(r, "board_id", "scenario", "reference", "category")


@query("q4_readiness", sql(
    "SELECT 'new-regression-board-errors' AS name, CAST(count(*) AS DOUBLE) AS actual, CAST(0 AS DOUBLE) AS threshold, '<=' AS comparison, count(*) <= 0 AS "
    "passed FROM pb WHERE NOT cand_exact AND base_exact UNION ALL SELECT 'unresolved-detection-misses', CAST(count(*) AS DOUBLE), 1000000, '<=', count(*) <= "
    "1000000 FROM rects WHERE NOT found UNION ALL SELECT * FROM x", pb=_PB, mt=_MET, x=_GSQL))
def q4(t):
    b = boards(t)
    return Q.readiness(b.where("NOT base_exact"), b.where("NOT cand_exact"), "board_id", t.rects, F.col("found"), _gates(t), 0, 1000000)


@query("q5_control_deltas", sql(
    "SELECT *, exact_boards_delta >= 0 AND correct_squares_delta >= 0 AS maintained FROM (SELECT overlay_case, count(*) FILTER (cand_exact) - count(*) FILTER "
    "(base_exact) AS exact_boards_delta, CAST(sum(cand_correct - base_correct) AS BIGINT) AS correct_squares_delta FROM pb JOIN (SELECT board_id, "
    "array_to_string(conditions, '+') AS overlay_case FROM boards) USING (board_id) WHERE overlay_case IN ('clean', 'circle') GROUP BY 1)", pb=_PB))
def q5(t):
    b = boards(t).join(t.boards.select("board_id", F.array_join("conditions", "+").alias("overlay_case")), "board_id")
    return Q.control_deltas(b, "overlay_case", ["clean", "circle"])


@query("q6_dual_acceptance", sql(
    "SELECT category, orientation, lost, gained, squares_change, passes, bool_and(passes) OVER (PARTITION BY category) AS accepted FROM (SELECT *, lost = 0 AND "
    "gained > 0 AND squares_change >= 0 AS passes FROM (SELECT category, orientation, count(*) FILTER (base_exact AND NOT cand_exact) AS lost, count(*) FILTER "
    "(cand_exact AND NOT base_exact) AS gained, CAST(sum(cand_correct - base_correct) AS BIGINT) AS squares_change FROM pb GROUP BY 1, 2))", pb=_PB))
def q6(t):
    return Q.dual_acceptance(boards(t), "category", "orientation")
