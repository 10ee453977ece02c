"""Sampling and selection queries (family W, A21)."""

from pyspark.sql import functions as F

from boardlake.functions.placement import literal_array
from boardlake.operators import metrics as M
from boardlake.operators import sampling as W
from boardlake.operators.joins import arrow_routes
from boardlake.plans.q_metrics import BACKGROUND
from boardlake.plans.registry import query, sql
from boardlake.session import cut_lineage


def digest(*parts):
    return "sha256(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def number(expr, digits=15):
    return f"CAST(('0x' || substr({expr}, 1, {digits})) AS BIGINT)"


@query("w1_hash_pick", sql(
    f"SELECT group_id, arg_min(board_id, {digest(repr('pick'), 'board_id')}) AS board_id FROM boards GROUP BY 1"))
def w1(t):
    return W.hash_pick(t.boards, ["group_id"], ["board_id"], "pick")


_GRID = ("SELECT category, class_id, background FROM (SELECT DISTINCT category FROM boards), (SELECT CAST(range AS BIGINT) AS "
         "class_id FROM range(14)), (SELECT unnest(['light', 'dark']) AS background)")


@query("w2_hash_pick_covering", sql(
    "SELECT category, class_id, background, board_id, idx FROM g LEFT JOIN (SELECT category, class_id, background, "
    f"arg_min(board_id, h) AS board_id, arg_min(idx, h) AS idx FROM (SELECT *, {BACKGROUND} AS background, "
    f"{digest(repr('cover'), 'board_id', 'idx')} AS h FROM cells) GROUP BY 1, 2, 3) USING (category, class_id, background)",
    g=_GRID))
def w2(t):
    cells = t.cells.withColumn("background", M.background("idx"))
    grid = (t.boards.select("category").distinct()
            .select("category", F.explode(literal_array(range(14)).cast("array<bigint>")).alias("class_id"))
            .select("*", F.explode(literal_array(["light", "dark"])).alias("background")))
    return W.hash_pick_covering(cells, ["category", "class_id", "background"], ["board_id", "idx"], "cover", grid)


@query("w3_hash_fraction", sql(
    f"SELECT board_id FROM boards WHERE {number(digest('board_id'), 8)} % 4 = 0"))
def w3(t):
    return W.hash_fraction(t.boards.select("board_id"), ["board_id"], 4)


_EDGES = [(-1, 0), (1, 0), (0, -1), (0, 1), (-3, 1), (3, -1), (1, 4), (-2, -2)]  # test values of this file


@query("w4_assign_scenario", sql(
    f"SELECT box_id, [((s + j) % 8) FOR j IN range(8) IF x + [-1,1,0,0,-3,3,1,-2][(s + j) % 8 + 1] >= 10 AND y + "
    "[0,0,-1,1,1,-1,4,-2][(s + j) % 8 + 1] >= 0 AND x + w + [-1,1,0,0,-3,3,1,-2][(s + j) % 8 + 1] <= 300 AND y + h + "
    "[0,0,-1,1,1,-1,4,-2][(s + j) % 8 + 1] <= 260][1] AS scenario FROM "
    f"(SELECT *, {number(digest(7, 'box_id'))} % 8 AS s FROM rects)"))
def w4(t):
    dx, dy = (literal_array([e[i] for e in _EDGES]) for i in (0, 1))

    def valid(i):
        x, y = F.col("x") + F.get(dx, i.cast("int")), F.col("y") + F.get(dy, i.cast("int"))
        return (x >= 10) & (y >= 0) & (x + F.col("w") <= 300) & (y + F.col("h") <= 260)
    return W.assign_scenario(t.rects, ["box_id"], 7, 8, valid).select("box_id", "scenario")


def _alloc(parent, child, src):
    h = digest(11, 0, *parent, child)
    p = ", ".join(parent)
    return (f"SELECT * FROM (SELECT {p}, {child}, quota // n + CASE WHEN r <= quota % n THEN 1 ELSE 0 END AS quota FROM "
            f"(SELECT {p}, {child}, quota, count(*) OVER (PARTITION BY {p}) AS n, row_number() OVER (PARTITION BY {p} "
            f"ORDER BY {h}, {child}) AS r FROM ({src}))) WHERE quota > 0")


_QUOTAS = [("1-URGENT", 4000), ("2-HIGH", 2500), ("3-MEDIUM", 1001), ("4-NOT SPECIFIED", 777), ("5-LOW", 300)]
_Q = " UNION ALL ".join(f"SELECT '{p}' AS category, CAST({q} AS BIGINT) AS quota" for p, q in _QUOTAS)


@query("w5_allocate", sql(_alloc(["category"], "group_id",
                                 "SELECT DISTINCT category, group_id, quota FROM boards JOIN q USING (category)"), q=_Q))
def w5(t):
    quotas = t.literal("category string, quota bigint", _QUOTAS)
    children = t.boards.select("category", "group_id").distinct().join(quotas, "category")
    return W.allocate(children, ["category"], "group_id", "quota", (11, 0))


def _level(parent, child, prev):
    using = ", ".join(parent)
    return _alloc(parent, child, f"SELECT DISTINCT {using}, {child}, quota FROM sb JOIN {prev} USING ({using})")


_LV = ["group_id", "position_id", "config_id", "board_id"]
_ELIG = "[i FOR i IN range(64) IF (i + board_id) % 3 = 0]"
_EPOCH = {
    "q": _Q, "sb": f"SELECT category, group_id, position_id, config_id, board_id, {_ELIG} AS el FROM boards "
                   "WHERE split = 'training'",
    "l1": _level(["category"], "group_id", "q"),
    "l2": _level(["category", "group_id"], "position_id", "l1"),
    "l3": _level(["category", "group_id", "position_id"], "config_id", "l2"),
    "l4": _level(["category", "group_id", "position_id", "config_id"], "board_id", "l3"),
    "dr": "SELECT category, l4.group_id, l4.position_id, l4.config_id, board_id, quota, el, len(el) AS n FROM l4 JOIN sb "
          "USING (category, group_id, position_id, config_id, board_id)",
    "cy": "SELECT *, unnest(range(0, (quota - 1) // n + 1)) AS cycle FROM dr",
    "ce": "SELECT *, unnest(el) AS idx FROM cy",
}
_DRAW = ("SELECT category, group_id, position_id, config_id, board_id, cycle, idx FROM (SELECT *, row_number() OVER (PARTITION BY "
         f"board_id, cycle ORDER BY {digest(11, 0, *_LV, 'cycle', 'idx')}, idx) AS r FROM ce) WHERE r <= least(n, quota - cycle * n)")


def draws(t):
    eligible = F.filter(literal_array(range(64)).cast("array<bigint>"), lambda i: (i + F.col("board_id")) % 3 == 0)
    boards = t.boards.where("split = 'training'").withColumn("eligible", eligible)
    quotas = t.literal("category string, quota bigint", _QUOTAS)
    return W.sample_epoch(boards, quotas, "category", _LV, "eligible", 11, 0)


@query("w6_sample_epoch", sql(_DRAW, **_EPOCH))
def w6(t):
    return draws(t)


@query("a21_pool_report", sql(
    "SELECT category, quota, round(quota / CAST(sum(quota) OVER () AS DOUBLE), 9) AS fraction, boards, positions, groups, "
    "squares, drawn, drawn_boards FROM q LEFT JOIN (SELECT category, count(*) AS boards, count(DISTINCT position_id) AS "
    "positions, count(DISTINCT group_id) AS groups, CAST(sum(len(el)) AS BIGINT) AS squares FROM sb GROUP BY 1) USING (category) LEFT JOIN "
    f"(SELECT category, count(*) AS drawn, count(DISTINCT board_id) AS drawn_boards FROM ({_DRAW}) GROUP BY 1) USING (category)",
    **_EPOCH))
def a21(t):
    eligible = F.filter(literal_array(range(64)).cast("array<bigint>"), lambda i: (i + F.col("board_id")) % 3 == 0)
    boards = t.boards.where("split = 'training'").withColumn("squares", F.size(eligible))
    quotas = t.literal("category string, quota bigint", _QUOTAS)
    return M.pool_report(boards, draws(t), quotas, "category", "board_id", "position_id", "group_id", "squares")


@query("w7_shuffle_batches", sql(
    f"SELECT board_id, r AS position, (r - 1) // 256 AS batch FROM (SELECT board_id, row_number() OVER (ORDER BY "
    f"{digest(5, 2, 'board_id')}, board_id) AS r FROM boards)"))
def w7(t):
    return W.shuffle_batches(t.boards.select("board_id"), ["board_id"], 5, 2, 256)


@query("w8_round_robin", sql(
    "SELECT config_id, board_id, turn FROM (SELECT config_id, board_id, row_number() OVER (PARTITION BY config_id ORDER BY "
    "board_id) AS turn FROM boards) ORDER BY turn, config_id LIMIT 40"))
def w8(t):
    return W.round_robin(t.boards.select("config_id", "board_id"), "config_id", ["board_id"], 40)


@query("w9_first_k", sql(
    f"SELECT category, class_id, background, board_id, idx, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category, "
    f"class_id, background ORDER BY board_id, idx) AS r FROM (SELECT *, {BACKGROUND} AS background FROM cells)) WHERE r <= 4"))
def w9(t):
    cells = t.cells.select("category", "class_id", M.background("idx").alias("background"), "board_id", "idx")
    return W.first_k(cells, ["category", "class_id", "background"], ["board_id", "idx"], 4)


_SIZES = [("training", 15), ("validation", 5), ("evaluation", 5)]
_CLS = [(c, b) for c in range(13) for b in ("light", "dark")]


@query("w10_assign_splits", sql(
    "SELECT trial, c_nationkey, split FROM al WHERE trial = (SELECT min(trial) FROM (SELECT trial FROM (SELECT trial, split, "
    "class_id, background, sum(n) AS n FROM al JOIN pr USING (c_nationkey) GROUP BY 1, 2, 3, 4) GROUP BY 1 HAVING "
    "min(n) >= (SELECT sum(n) // 260 FROM pr) AND count(*) = 78))",
    pr=f"SELECT c_nationkey, class_id, {BACKGROUND} AS background, count(*) AS n FROM cells JOIN customer ON c_custkey = group_id "
       "GROUP BY 1, 2, 3",
    al="SELECT trial, c_nationkey, CASE WHEN r <= 15 THEN 'training' WHEN r <= 20 THEN 'validation' ELSE 'evaluation' END AS split "
       "FROM (SELECT CAST(trial AS INTEGER) AS trial, c_nationkey, row_number() OVER (PARTITION BY trial ORDER BY "
       f"{digest(3, 'trial', 'c_nationkey')}, c_nationkey) AS r FROM (SELECT DISTINCT c_nationkey FROM pr), "
       "(SELECT range AS trial FROM range(200)))"))
def w10(t):
    nation = t.customer.select(F.col("c_custkey").alias("group_id"), "c_nationkey")
    profile = cut_lineage(W.group_profile(t.cells.join(nation, "group_id"), "c_nationkey", "class_id", "idx"))
    total = sum(F.sum(f"c{c}_{b}") for c, b in _CLS)
    minimum = profile.agg(F.floor(total / 260)).first()[0]
    return W.assign_splits(profile, "c_nationkey", _SIZES, minimum, 3)


@query("w11_mark_plan", sql(
    "SELECT board_id, class_id, background, idx, r AS mark_rank FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY "
    f"{digest(9, repr('bucket'), 'board_id', 'class_id', 'background')}) AS r FROM (SELECT board_id, class_id, background, "
    f"arg_min(idx, {digest(9, repr('cell'), 'board_id', 'idx')}) AS idx FROM (SELECT *, {BACKGROUND} AS background FROM cells) "
    "GROUP BY 1, 2, 3)) WHERE r <= 6"))
def w11(t):
    return W.mark_plan(t.cells, "board_id", "class_id", "idx", 6, 9)


@query("w13_arrow_into", sql(
    "SELECT board_id, idx, arg_min(start, h) AS start, arg_min(geometry, h) AS geometry FROM (SELECT *, "
    f"{digest(13, 'board_id', 'idx', 'start')} AS h FROM (SELECT board_id, idx, i AS start, CASE WHEN dx > 0 AND dy = 0 THEN "
    "'horizontal' WHEN dx = 0 AND dy > 0 THEN 'vertical' WHEN dx = dy AND dx > 0 THEN 'diagonal' WHEN dx * dy = 2 "
    "THEN 'knight' END AS geometry FROM (SELECT board_id, idx, i, abs(i % 8 - idx % 8) AS dx, abs(i // 8 - idx // 8) AS dy "
    "FROM cells, idx WHERE class_id = 12)) WHERE geometry IS NOT NULL) GROUP BY 1, 2"))
def w13(t):
    targets = t.cells.where("class_id = 12").select("board_id", "idx")
    return W.arrow_into(arrow_routes(targets, "idx"), ["board_id", "idx"], "start", 13)


@query("w14_compact_pick", sql(
    "SELECT group_id, board_id FROM (SELECT group_id, board_id, row_number() OVER (PARTITION BY group_id ORDER BY board_id) AS r, "
    "count(*) OVER (PARTITION BY group_id) AS n, dense_rank() OVER (ORDER BY group_id) AS g FROM boards) WHERE r - 1 = (g - 1) % n"))
def w14(t):
    return W.compact_pick(t.boards, "group_id", "board_id")


@query("w15_dedupe_aliases", sql(
    "SELECT board_id, min(board_id) OVER w AS request, count(*) OVER w AS aliases FROM grids JOIN boards USING (board_id) "
    "WINDOW w AS (PARTITION BY grid, orientation)"))
def w15(t):
    return W.dedupe_aliases(t.placed("grid").select("board_id", F.sha2("grid", 256).alias("sha"), "orientation"),
                            ["sha", "orientation"], "board_id")


_EP = ("SELECT board_id, idx, class_id, unnest([0, 1, 2]) AS epoch, unnest([pred_id, cand_id, CASE WHEN board_id % 5 = 0 THEN pred_id "
       "ELSE class_id END]) AS pred FROM cells")


def epochs(t):
    third = F.when(F.col("board_id") % 5 == 0, F.col("pred_id")).otherwise(F.col("class_id"))
    rows = F.array(*[F.struct(F.lit(i).alias("epoch"), c.alias("pred"))
                     for i, c in enumerate([F.col("pred_id"), F.col("cand_id"), third])])
    return t.cells.select("board_id", "idx", "class_id", F.inline(rows))


@query("w17_changed_cells", sql(
    "SELECT epoch, count(*) FILTER (p <> pred) AS changed_cells, count(*) AS cells FROM (SELECT *, lag(pred) OVER (PARTITION BY "
    "board_id, idx ORDER BY epoch) AS p FROM e) GROUP BY 1", e=_EP))
def w17(t):
    return W.changed_cells(epochs(t), ["board_id", "idx"], "epoch", "pred")


@query("w17_epoch_history", sql(
    "SELECT epoch, boards, squares, exact_boards, correct_squares, false_pieces, missed_pieces, safe, exact_boards - lag(exact_boards) "
    "OVER (ORDER BY epoch) AS exact_change, safe AND exact_boards > coalesce(max(CASE WHEN safe THEN exact_boards END) OVER (ORDER BY "
    "epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM (SELECT *, exact_boards >= 100 AND correct_squares >= "
    "1000 AS safe FROM (SELECT epoch, count(*) AS boards, CAST(sum(s) AS BIGINT) AS squares, count(*) FILTER (s = c) AS exact_boards, "
    "CAST(sum(c) AS BIGINT) AS correct_squares, CAST(sum(f) AS BIGINT) AS false_pieces, CAST(sum(m) AS BIGINT) AS missed_pieces FROM "
    "(SELECT epoch, board_id, count(*) AS s, count(*) FILTER (pred = class_id) AS c, count(*) FILTER (class_id = 0 AND pred <> 0) AS f, "
    "count(*) FILTER (class_id <> 0 AND pred = 0) AS m FROM e GROUP BY 1, 2) GROUP BY 1))", e=_EP))
def w17b(t):
    m = M.board_error_metrics(epochs(t), "class_id", "pred", "board_id", ["epoch"])
    return W.epoch_history(m, "epoch", "exact_boards", "correct_squares", 100, 1000)
