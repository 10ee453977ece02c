"""Metric queries over the derived cells (family A)."""

from pyspark.sql import functions as F

from boardlake.functions.constants import CLASSES
from boardlake.functions.hashing import stable_hash
from boardlake.operators import metrics as M
from boardlake.plans.registry import query, sql

LABEL = "CASE WHEN {c} < 0 THEN 'processing-error' ELSE [" + \
    ",".join(f"'{c}'" for c in CLASSES) + "][{c} + 1] END"


def label(c):
    return LABEL.format(c=c)


BACKGROUND = "CASE WHEN (idx // 8 + idx % 8) % 2 = 0 THEN 'light' ELSE 'dark' END"
_PIVOT = ", ".join(f"count(*) FILTER (pred_id = {i}) AS p_{i}" for i in range(13))


@query("a1_confusion", sql(
    f"SELECT class_id AS expected, {_PIVOT}, count(*) FILTER (pred_id < 0) AS p_error "
    "FROM cells GROUP BY 1"))
def a1(t):
    return M.confusion(t.cells, "class_id", "pred_id")


_CLASS = """SELECT c.class_id, {label} AS label, coalesce(total, 0) AS total,
   coalesce(correct, 0) AS correct, coalesce(predicted, 0) AS predicted,
   CAST(correct AS DOUBLE) / nullif(total, 0) AS recall,
   CAST(coalesce(correct, 0) AS DOUBLE) / nullif(coalesce(predicted, 0), 0) AS precision,
   CAST(2 * coalesce(correct, 0) AS DOUBLE) / nullif(coalesce(total, 0) + coalesce(predicted, 0), 0) AS f1
 FROM (SELECT CAST(range AS BIGINT) AS class_id FROM range(13)) c
 LEFT JOIN (SELECT class_id, count(*) AS total, count(*) FILTER (class_id = pred_id) AS correct
            FROM cells GROUP BY 1) e USING (class_id)
 LEFT JOIN (SELECT pred_id AS class_id, count(*) AS predicted FROM cells GROUP BY 1) p
   USING (class_id)""".format(label=label("c.class_id"))


@query("a2_class_metrics", sql(_CLASS))
def a2(t):
    return M.class_metrics(t.cells, "class_id", "pred_id")


@query("a2_macro_recall", sql(
    "SELECT round(avg(r), 9) AS macro_recall FROM (SELECT "
    "count(*) FILTER (class_id = pred_id) / CAST(count(*) AS DOUBLE) AS r FROM cells GROUP BY class_id)"))
def a2b(t):
    return M.macro_recall(t.cells, "class_id", "pred_id")


@query("a3_background_metrics", sql(
    f"SELECT label, background, count(*) FILTER (ok) AS correct, count(*) AS total, "
    "count(*) FILTER (ok AND occ) AS occupied_correct, count(*) FILTER (occ) AS occupied_total, "
    "CAST(count(*) FILTER (ok AND occ) AS DOUBLE) / nullif(count(*) FILTER (occ), 0) AS occupied_accuracy "
    f"FROM (SELECT {label('class_id')} AS label, {BACKGROUND} AS background, "
    "class_id = pred_id AS ok, class_id > 0 AS occ FROM cells) GROUP BY ROLLUP (label, background)"))
def a3(t):
    return M.background_metrics(t.cells, "class_id", "pred_id")


_BOARD = ("SELECT board_id, position_id, category, orientation, count(*) AS squares, "
          "count(*) FILTER (class_id = pred_id) AS correct, "
          "count(*) FILTER (class_id = 0 AND pred_id <> 0) AS false_pieces, "
          "count(*) FILTER (class_id <> 0 AND pred_id = 0) AS missed_pieces "
          "FROM cells GROUP BY 1, 2, 3, 4")


@query("a4_exact_rates", sql(
    "SELECT CAST(sum(n) AS BIGINT) AS images, count(*) AS positions, CAST(sum(x) AS BIGINT) AS exact_boards, "
    "count(*) FILTER (n = x) AS exact_positions, CAST(sum(c) AS BIGINT) AS correct_squares, "
    "CAST(sum(s) AS BIGINT) AS total_squares, CAST(sum(c) AS DOUBLE) / sum(s) AS square_accuracy "
    "FROM (SELECT position_id, count(*) AS n, count(*) FILTER (squares = correct) AS x, "
    "sum(correct) AS c, sum(squares) AS s FROM b GROUP BY 1)", b=_BOARD))
def a4(t):
    return M.exact_rates(t.cells, "class_id", "pred_id", "board_id", "position_id")


_ERR = ("count(*) AS boards, CAST(sum(squares) AS BIGINT) AS squares, "
        "count(*) FILTER (squares = correct) AS exact_boards, "
        "CAST(sum(correct) AS BIGINT) AS correct_squares, "
        "CAST(sum(false_pieces) AS BIGINT) AS false_pieces, "
        "CAST(sum(missed_pieces) AS BIGINT) AS missed_pieces")


@query("a5_board_error_metrics", sql(f"SELECT category, {_ERR} FROM b GROUP BY 1", b=_BOARD))
def a5(t):
    return M.board_error_metrics(t.cells, "class_id", "pred_id", "board_id", ["category"])


@query("a6_omission_metrics", sql(
    f"SELECT {label('class_id')} AS label, count(*) AS total, count(*) FILTER (pred_id = 0) AS omitted, "
    "count(*) FILTER (pred_id > 0 AND pred_id <> class_id) AS mistyped, "
    "count(*) FILTER (pred_id < 0) AS unprocessed FROM cells WHERE class_id IN (1, 7) GROUP BY 1"))
def a6(t):
    return M.omission_metrics(t.cells, "class_id", "pred_id", [1, 7])


_LAT = ("count({v}) AS samples, round(quantile_cont({v}, 0.5) * 1000, 6) AS median_ms, "
        "round(quantile_cont({v}, 0.95) * 1000, 6) AS p95_ms")


@query("a7_latency", sql(
    f"SELECT category, {_LAT.format(v='seconds')} FROM boards GROUP BY 1"))
def a7(t):
    return M.latency_by_rank(t.boards, "seconds", ["category"])


@query("a7_latency_by_event", sql(
    f"SELECT event_type, {_LAT.format(v='value')} FROM events GROUP BY 1"))
def a7b(t):
    return M.latency_by_rank(t.events, "value", ["event_type"])


@query("a8_trial_aggregate", sql(
    "SELECT model, round(m, 6) AS median, round(p, 6) AS p95, "
    "round(m / (SELECT m FROM a WHERE model = 'click'), 6) AS median_ratio, "
    "round(p / (SELECT p FROM a WHERE model = 'click'), 6) AS p95_ratio, "
    "coalesce(round(m / (SELECT m FROM a WHERE model = 'click'), 6) <= 1.25 AND "
    "round(p / (SELECT p FROM a WHERE model = 'click'), 6) <= 1.25, false) AS passed FROM a",
    tr="SELECT event_type AS model, event_id % 3 AS trial, quantile_cont(value, 0.5) AS m, "
       "quantile_cont(value, 0.95) AS p FROM events GROUP BY 1, 2",
    a="SELECT model, quantile_cont(m, 0.5) AS m, quantile_cont(p, 0.5) AS p FROM tr GROUP BY 1"))
def a8(t):
    e = t.events.select(F.col("event_type").alias("model"), (F.col("event_id") % 3).alias("trial"), "value")
    return M.trial_aggregate(e, "trial", "model", "value", "click")


@query("a9_stratified_metrics", sql(
    f"SELECT 'category' AS dimension, category AS value, {_ERR} FROM b GROUP BY ALL UNION ALL "
    f"SELECT 'orientation', orientation, {_ERR} FROM b GROUP BY ALL", b=_BOARD))
def a9(t):
    return M.stratified_metrics(t.cells, "class_id", "pred_id", "board_id", ["category", "orientation"])


@query("a10_condition_metrics", sql(
    f"SELECT 'conditions' AS dimension, value, {_ERR} FROM (SELECT b.*, unnest(conditions) AS value "
    "FROM b JOIN boards USING (board_id)) GROUP BY 2", b=_BOARD))
def a10(t):
    b = M.per_board(t.cells, "class_id", "pred_id", ["board_id"]).join(
        t.boards.select("board_id", "conditions"), "board_id")
    return M.stratify(b, [], ["conditions"]).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("boards"), F.sum("squares").alias("squares"),
        M.count_of(F.col("squares") == F.col("correct")).alias("exact_boards"),
        F.sum("correct").alias("correct_squares"), F.sum("false_pieces").alias("false_pieces"),
        F.sum("missed_pieces").alias("missed_pieces"))


@query("a11_coverage", sql(
    f"SELECT split, class_id, background, {label('class_id')} AS label, coalesce(squares, 0) AS squares, "
    "coalesce(boards, 0) AS boards, coalesce(positions, 0) AS positions, coalesce(groups, 0) AS groups FROM g "
    "LEFT JOIN c USING (split, class_id, background)",
    g="SELECT split, class_id, background FROM (SELECT unnest(['training', 'validation', 'evaluation']) AS split), "
      "(SELECT CAST(range AS BIGINT) AS class_id FROM range(13)), "
      "(SELECT unnest(['light', 'dark']) AS background)",
    c=f"SELECT split, class_id, {BACKGROUND} AS background, count(*) AS squares, "
      "count(DISTINCT board_id) AS boards, count(DISTINCT position_id) AS positions, "
      "count(DISTINCT group_id) AS groups FROM cells GROUP BY 1, 2, 3"))
def a11(t):
    return M.coverage(t.cells, "class_id", "idx", "board_id", "position_id", "group_id", "split")


def tagged_cells(t):
    return t.cells.withColumnRenamed("conditions", "tags").withColumn("selected", F.col("idx") % 8 < 3)


_TAGGED = ("SELECT cells.*, unnest(conditions) AS tag, idx % 8 < 3 AS selected "
           "FROM cells JOIN boards USING (board_id)")


@query("a12_tag_coverage", sql(
    "SELECT tag, count(DISTINCT board_id) AS archives, count(DISTINCT position_id) AS positions, "
    "count(DISTINCT group_id) AS groups, count(*) AS squares, "
    "count(*) FILTER (class_id = 0) AS empty_squares, count(*) FILTER (class_id <> 0) AS occupied_squares, "
    "count(*) FILTER (selected) AS selected_squares FROM (SELECT cells.*, unnest(conditions) AS tag, "
    "cells.idx % 8 < 3 AS selected FROM cells JOIN boards USING (board_id)) GROUP BY 1"))
def a12(t):
    return M.tag_coverage(tagged_cells(t), "tags", "board_id", "position_id", "group_id", "class_id",
                          "idx", "selected")


@query("a12_tag_examples", sql(
    f"SELECT tag, {label('class_id')} AS label, {BACKGROUND} AS background, "
    "min(board_id) AS board_id, arg_min(idx, board_id * 64 + idx) AS idx FROM x GROUP BY 1, 2, 3",
    x="SELECT c.board_id, c.class_id, c.idx, unnest(b.conditions) AS tag FROM cells c JOIN boards b "
      "USING (board_id)"))
def a12b(t):
    return M.tag_examples(tagged_cells(t), "tags", "board_id", "class_id", "idx")


@query("a13_marked_coverage", sql(
    "SELECT split, kind, class_id, background, coalesce(n, 0) AS squares, n IS NULL AS missing FROM g "
    "LEFT JOIN c USING (split, kind, class_id, background)",
    mk="SELECT split, kind, class_id, " + BACKGROUND + " AS background FROM cells JOIN (SELECT board_id, kind, "
       "unnest(list_distinct([sq1, sq2])) AS idx FROM marks) USING (board_id, idx)",
    c="SELECT split, kind, class_id, background, count(*) AS n FROM mk GROUP BY 1, 2, 3, 4",
    g="SELECT split, kind, class_id, background FROM (SELECT unnest(['training', 'validation', 'evaluation']) AS split), "
      "(SELECT unnest(['arrow', 'last-move', 'selection', 'check', 'circle', 'move-dot']) AS kind), (SELECT CAST(range AS BIGINT) AS class_id FROM range(13)), "
      "(SELECT unnest(['light', 'dark']) AS background)"))
def a13(t):
    marked = M.marked_cells(t.cells, t.marks.select("board_id", "kind", F.array("sq1", "sq2").alias("squares")), "board_id", "idx", "squares")
    return M.marked_coverage(marked, "split", "kind", "class_id", "idx")


_COUNTS = "SELECT class_id, count(*) AS squares FROM cells GROUP BY 1"


def class_counts(t):
    return t.cells.groupBy("class_id").agg(F.count(F.lit(1)).alias("squares"))


@query("a14_class_weights", sql(
    "SELECT class_id, squares, round(sum(squares) OVER () / CAST(count(*) OVER () * squares AS DOUBLE), 9) "
    "AS weight FROM n", n=_COUNTS))
def a14(t):
    return M.class_weights(class_counts(t), ["class_id"])


@query("a14_class_weights_sqrt", sql(
    "SELECT class_id, background, squares, round(sqrt(sum(squares) OVER () / "
    "CAST(count(*) OVER () * squares AS DOUBLE)), 9) AS weight FROM n",
    n=f"SELECT class_id, {BACKGROUND} AS background, count(*) AS squares FROM cells GROUP BY 1, 2"))
def a14b(t):
    counts = t.cells.groupBy("class_id", M.background("idx").alias("background")).agg(
        F.count(F.lit(1)).alias("squares"))
    return M.class_weights(counts, ["class_id", "background"], mode="sqrt")


@query("a15_weight_mass", sql(
    "SELECT class_id, squares, weight, round(squares * weight / sum(squares * weight) OVER (), 9) AS share, "
    "round(weight / max(weight) FILTER (class_id = 0) OVER (), 9) AS to_empty FROM w", n=_COUNTS,
    w="SELECT class_id, squares, round(sqrt(sum(squares) OVER () / "
      "CAST(count(*) OVER () * squares AS DOUBLE)), 9) AS weight FROM n"))
def a15(t):
    counts = class_counts(t)
    return M.weight_mass(counts, M.class_weights(counts, ["class_id"], mode="sqrt"), "class_id")


@query("a16_confusion_pairs", sql(
    f"SELECT {label('class_id')} AS expected, {label('pred_id')} AS predicted, count(*) AS n FROM cells "
    "WHERE class_id <> pred_id GROUP BY 1, 2 ORDER BY n DESC, 1, 2"))
def a16(t):
    return M.confusion_pairs(t.cells, "class_id", "pred_id")


@query("a17_value_counts", sql(
    " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM boards GROUP BY 2"
                       for c in ("split", "category", "config_id", "orientation", "status"))))
def a17(t):
    return M.value_counts(t.boards, ["split", "category", "config_id", "orientation", "status"])


@query("a20_teacher_audit", sql(
    "SELECT pool, CAST(sum(n) AS BIGINT) AS exposures, count(*) AS distinct_cells, "
    "CAST(sum(tt) AS BIGINT) AS soft_exposures, CAST(sum(c) AS BIGINT) AS conflicting_targets, "
    "CAST(sum(f) AS BIGINT) AS false_piece_targets, count(*) FILTER (d) AS inconsistent_cells FROM "
    "(SELECT pool, seed_key, idx, count(*) AS n, count(tc) AS tt, "
    "count(*) FILTER (tc <> class_id) AS c, count(*) FILTER (tc <> class_id AND class_id = 0) AS f, "
    "min(dg) <> max(dg) AS d FROM x GROUP BY 1, 2, 3) GROUP BY 1",
    x="SELECT c.category AS pool, seed_key, idx, class_id, CASE WHEN pred_id >= 0 THEN pred_id END AS tc, "
      "sha256(concat_ws('|', CASE WHEN pred_id >= 0 THEN CAST(pred_id AS VARCHAR) END)) AS dg "
      "FROM cells c JOIN boards USING (board_id)"))
def a20(t):
    draws = t.cells_by("seed_key").select(
        F.col("category").alias("pool"), "seed_key", "idx", "class_id",
        F.when(F.col("pred_id") >= 0, F.col("pred_id")).alias("tc")) \
        .withColumn("dg", stable_hash("tc"))
    return M.teacher_audit(draws, ["seed_key", "idx"], "pool", "class_id", "tc", "dg")


@query("a22_composition", sql(
    f"SELECT split AS cohort, {label('class_id')} AS label, count(*) AS n FROM cells GROUP BY 1, 2"))
def a22(t):
    return M.composition(t.cells.select(F.col("split").alias("cohort"),
                                        M.class_label("class_id").alias("label")), "cohort", "label")
