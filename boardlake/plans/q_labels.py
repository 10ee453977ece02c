"""Label, ordering and set queries (families B, O, U)."""

from pyspark.sql import functions as F

from boardlake.functions import placement as P
from boardlake.functions.constants import ERROR_STATUS
from boardlake.operators import labels as B
from boardlake.operators import setops as S
from boardlake.plans.fixtures import expand_sql
from boardlake.plans.q_metrics import BACKGROUND, label
from boardlake.plans.registry import query, sql

SQUARE = "substr('abcdefgh', idx % 8 + 1, 1) || CAST(8 - idx // 8 AS VARCHAR)"
SYMBOL = "substr({g}, idx + 1, 1)"
SYM_LABEL = "CASE WHEN {s} = '.' THEN 'empty' ELSE {s} END"


@query("b1_encode_placement", sql("SELECT board_id, placement FROM placements"))
def b1(t):
    return B.encode_cells(t.cells, "board_id")


_EXP = "replace(" + expand_sql("placement") + ", '/', '')"


@query("b2_expand_placement", sql(
    f"SELECT board_id, i AS idx, substr(g, i + 1, 1) AS symbol FROM (SELECT board_id, {_EXP} AS g "
    "FROM placements), idx"))
def b2(t):
    return B.expand_placement(t.placed("placement"), ["board_id"])


@query("b2_invalid_placements", sql(
    "SELECT l_orderkey, l_linenumber, ok FROM (SELECT l_orderkey, l_linenumber, p, "
    "regexp_full_match(p, '[1-8PNBRQKpnbrqk]{1,8}(/[1-8PNBRQKpnbrqk]{1,8}){7}') AND NOT "
    "regexp_matches(p, '[1-8][1-8]') AND regexp_full_match(" + expand_sql("p") +
    ", '[.A-Za-z]{8}(/[.A-Za-z]{8}){7}') AS ok FROM (SELECT l_orderkey, l_linenumber, "
    "placement || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '/8' ELSE 'x' END AS p "
    "FROM lineitem JOIN placements ON l_orderkey = board_id)) WHERE NOT ok"))
def b2b(t):
    tail = F.when(F.col("l_linenumber") % 4 == 0, "").when(F.col("l_linenumber") % 4 == 1, "1") \
        .when(F.col("l_linenumber") % 4 == 2, "/8").otherwise("x")
    rows = t.lineitem.select(F.col("l_orderkey"), "l_linenumber").join(
        t.placed("placement").select(F.col("board_id").alias("l_orderkey"), "placement"), "l_orderkey")
    ok = P.is_canonical(F.concat("placement", tail))
    return rows.select("l_orderkey", "l_linenumber", ok.alias("ok")).where(~F.col("ok"))


_LABELS = f"""SELECT board_id, idx, {SQUARE} AS square, {label('class_id')} AS label, class_id,
    {BACKGROUND} AS background, im // 8 AS image_row, im % 8 AS image_column
  FROM (SELECT *, CASE WHEN orientation = 'black-bottom' THEN 63 - idx ELSE idx END AS im FROM cells)"""


@query("b3_square_labels", sql(_LABELS))
def b3(t):
    return B.square_labels(t.placed("placement"), ["board_id"], "placement", "orientation")


@query("b4_to_canonical", sql(
    "SELECT board_id, CASE WHEN orientation = 'black-bottom' THEN 63 - idx ELSE idx END AS idx, class_id "
    "FROM cells"))
def b4(t):
    return B.to_canonical(t.cells, "idx", "orientation").select("board_id", "idx", "class_id")


def _perm(order):
    return "array_to_string([substr(grid, j + 1, 1) FOR j IN [" + ",".join(map(str, order)) + "]], '')"


_R90 = [(7 - i % 8) * 8 + i // 8 for i in range(64)]
_MIR = [i - i % 8 + 7 - i % 8 for i in range(64)]


def _compose():
    forms, cur = [], list(range(64))
    for _ in range(4):
        forms += [cur, [cur[j] for j in _MIR]]
        cur = [cur[j] for j in _R90]
    return forms


_SWAP = "translate({}, 'PNBRQKpnbrqk', 'pnbrqkPNBRQK')"
FAMILY_SQL = ("least(" + ", ".join(f"{_perm(o)}, {_SWAP.format(_perm(o))}" for o in _compose()) + ")")


@query("b5_placement_family", sql(f"SELECT board_id, {FAMILY_SQL} AS family FROM grids"))
def b5(t):
    return B.placement_family(t.placed("grid"), ["board_id"], "grid")


@query("b6_placement_ids", sql(
    "SELECT board_id, string_agg(CAST(class_id AS VARCHAR), ',' ORDER BY idx) AS ids FROM cells GROUP BY 1"))
def b6(t):
    ids = B.placement_ids(t.placed("grid"), ["board_id"], "grid")
    return ids.select("board_id", F.array_join("ids", ",").alias("ids"))


@query("b7_diff_placement", sql(
    f"SELECT board_id, idx, {SQUARE} AS square, {label('class_id')} AS expected, {label('pred_id')} AS actual "
    "FROM cells WHERE pred_id >= 0 AND pred_id <> class_id"))
def b7(t):
    return B.diff_placement(t.placed("grid", "pred_grid"), ["board_id"], "grid", "pred_grid")


@query("b7_diff_summary", sql(
    "SELECT board_id, CASE WHEN min(pred_id) >= 0 THEN count(*) FILTER (pred_id = class_id) END AS correct, "
    "CASE WHEN min(pred_id) >= 0 THEN count(*) FILTER (pred_id <> class_id) END AS wrong "
    "FROM cells GROUP BY 1"))
def b7b(t):
    return B.diff_summary(t.placed("grid", "pred_grid"), ["board_id"], "grid", "pred_grid")


@query("b8_square_names", sql(
    f"SELECT board_id, {SQUARE} AS square, idx AS back FROM (SELECT board_id, (group_id * 7 + board_id) % 64 "
    "AS idx FROM boards)"))
def b8(t):
    sq = P.square_name((F.col("group_id") * 7 + F.col("board_id")) % 64)
    return t.boards.select("board_id", sq.alias("square"), P.square_index(sq).alias("back"))


@query("b9_raster_bounds", sql(
    "SELECT l_orderkey, l_linenumber, l AS \"left\", tp AS top, r AS \"right\", b AS bottom, r - l AS width, "
    "b - tp AS height FROM (SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS l, "
    "CAST(round_even(l_quantity / 8, 0) AS BIGINT) AS tp, "
    "CAST(round_even(l_quantity / 4 + l_quantity * 10.25, 0) AS BIGINT) AS r, "
    "CAST(round_even(l_quantity / 8 + l_quantity * 10.25, 0) AS BIGINT) AS b FROM lineitem)"))
def b9(t):
    q = F.col("l_quantity")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (q / 4).alias("x"), (q / 8).alias("y"),
                             (q * 10.25).alias("w"), (q * 10.25).alias("h"))
    return B.raster_bounds(rows, ["l_orderkey", "l_linenumber"], "x", "y", "w", "h")


_OCC = "length(replace(grid, '.', ''))"
_PLY = "(board_id % 60 + 1)"
_TAGS = (f"concat_ws(',', CASE WHEN {_PLY} = 12 AND n >= 28 THEN 'opening' END, "
         f"CASE WHEN {_PLY} >= 32 AND n BETWEEN 12 AND 26 THEN 'middlegame' END, "
         "CASE WHEN n BETWEEN 3 AND 10 THEN 'endgame' END, CASE WHEN board_id % 5 = 0 THEN 'promotion' END, "
         "CASE WHEN n >= 28 THEN 'dense' END, CASE WHEN n <= 10 THEN 'sparse' END)")


@query("b10_position_tags", sql(
    f"SELECT board_id, n AS occupied, {_TAGS} AS tags FROM (SELECT board_id, {_OCC} AS n FROM grids)"))
def b10(t):
    df = t.placed("grid").withColumn("ply", F.col("board_id") % 60 + 1)
    tags = B.position_tags(df, ["board_id"], "grid", "ply", F.col("board_id") % 5 == 0)
    return tags.withColumn("tags", F.array_join("tags", ","))


@query("b10_tag_violations", sql(
    f"SELECT board_id, problem FROM (SELECT board_id, unnest([CASE WHEN dense <> (n >= 28) OR (n <= 10) "
    f"THEN 'density' END, CASE WHEN opening AND NOT ({_PLY} = 12 AND n >= 28) THEN 'opening' END, "
    f"CASE WHEN middle AND NOT ({_PLY} >= 32 AND n BETWEEN 12 AND 26) THEN 'middlegame' END]) AS problem "
    f"FROM (SELECT board_id, {_OCC} AS n, board_id % 3 = 0 AS dense, board_id % 3 = 1 AS opening, "
    "board_id % 3 = 2 AS middle FROM grids)) WHERE problem IS NOT NULL"))
def b10b(t):
    tags = F.get(P.literal_array(["dense", "opening", "middlegame"]), (F.col("board_id") % 3).cast("int"))
    df = t.placed("grid").withColumn("ply", F.col("board_id") % 60 + 1).withColumn("tags", F.array(tags))
    return B.tag_violations(df, ["board_id"], "grid", "ply", F.lit(False), "tags")


@query("b11_style_dimensions", sql(
    "SELECT board_id, p[1] AS platform, p[1] || '/' || p[2] AS background, p[1] || '/' || p[3] AS pieces, "
    "p[1] || '/' || p[2] || '/' || p[3] AS combination, p[1] || '-' || p[2] || '-' || p[3] AS base_config, "
    "p[4] AS board_side, CASE WHEN p[1] || '/' || p[2] || '/' || p[3] = 'beta/green/carved' "
    "THEN 'held-out-combination' ELSE 'seen-combination' END AS generalization "
    "FROM (SELECT board_id, string_split(config_id, '-') AS p FROM boards)"))
def b11(t):
    return B.style_dimensions(t.boards, ["board_id"], "config_id", ["beta/green/carved"])


@query("b12_mark_case", sql(
    "SELECT board_id, CASE WHEN len(conditions) = 2 THEN 'arrow+circle' ELSE conditions[1] END AS overlay_case "
    "FROM boards"))
def b12(t):
    doubled = F.concat("conditions", "conditions")  # repeated kinds collapse in drawing order
    return t.boards.select("board_id", B.mark_case(doubled).alias("overlay_case"))


@query("b13_assign_pool", sql(
    "SELECT board_id, CASE WHEN ds = 'photo' AND board_id % 4 = 0 THEN 'photo-targeted' "
    "WHEN ds = 'photo' AND a IS NULL THEN NULL WHEN ds = 'photo' AND a = 'wood-texture' THEN 'photo-old-wood' "
    "WHEN ds = 'photo' THEN 'photo-old-other' WHEN ds = 'heads' THEN 'digital-arrowheads' "
    "WHEN conditions = ['clean'] THEN 'digital-clean' WHEN list_contains(conditions, 'arrow') "
    "THEN 'digital-arrows' ELSE 'digital-simple-marks' END AS pool FROM (SELECT boards.*, "
    "['photo', 'heads', 'digital', 'digital'][board_id % 4 % 3 + 1] AS ds, CASE c_mktsegment WHEN 'BUILDING' "
    "THEN 'wood-texture' WHEN 'MACHINERY' THEN NULL ELSE 'plain' END AS a FROM boards LEFT JOIN customer "
    "ON group_id = c_custkey)"))
def b13(t):
    ds = F.get(P.literal_array(["photo", "heads", "digital"]), (F.col("board_id") % 4 % 3).cast("int"))
    df = t.boards.withColumn("ds", ds).withColumn("c_custkey", F.col("group_id")).withColumn(
        "kinds", F.filter("conditions", lambda c: c != "clean"))
    seg = F.col("c_mktsegment")
    back = t.customer.select("c_custkey", F.when(seg == "BUILDING", "wood-texture")
                             .when(seg != "MACHINERY", "plain").alias("board_appearance"))
    return B.assign_pool(df, ["board_id"], "ds", "kinds", "conditions", "c_custkey",
                         F.col("board_id") % 4 == 0, back, ["photo"], ["heads"])


@query("b14_format_violations", sql(
    "SELECT p_partkey, unnest(list_filter([CASE WHEN NOT regexp_full_match(p_name, "
    "'[a-z0-9][a-z0-9_-]{0,63}') THEN 'identifier' END, CASE WHEN p_size % 3 = 0 THEN 'moves' END, "
    "CASE WHEN p_size > 25 THEN 'ply' END, CASE WHEN p_size % 2 = 0 THEN 'placement' END], "
    "lambda x: x IS NOT NULL)) AS problem FROM part"))
def b14(t):
    n = F.col("p_size")
    moves = F.array_repeat(F.when(n % 3 == 0, "e2e9").otherwise("e7e8q"), 25)
    placement = F.when(n % 2 == 0, "8/8/8/8/8/8/8/44").otherwise("8/8/8/8/8/8/8/4K3")
    df = t.part.select("p_partkey", "p_name", n, moves.alias("moves"), placement.alias("placement"))
    return B.format_violations(df, ["p_partkey"], "p_name", "moves", "p_size", "placement")


@query("b15_error_text", sql(
    f"SELECT board_id, CASE WHEN min(pred_id) < 0 THEN 'NOT_DETECTED' ELSE coalesce(string_agg({SQUARE} || ':' "
    f"|| {label('class_id')} || '->' || {label('pred_id')}, '; ' ORDER BY idx) "
    "FILTER (pred_id <> class_id), 'OK') END AS errors FROM cells GROUP BY 1"))
def b15(t):
    return t.placed("grid", "pred_grid").select("board_id", B.error_text("grid", "pred_grid").alias("errors"))


@query("b16_source_key", sql(
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'video:' || CAST(user_id AS VARCHAR) "
    "WHEN event_type IN ('click', 'error') AND user_id % 2 = 0 THEN event_type || ':' || "
    "CAST(user_id AS VARCHAR) END AS source FROM events"))
def b16(t):
    u = F.col("user_id").cast("string")
    df = t.events.select("event_id", "event_type", F.when(F.col("event_type") == "view", u).alias("video"),
                         F.when(F.col("user_id") % 2 == 0, u).otherwise("").alias("game"))
    return df.select("event_id", B.source_key("video", "event_type", "game", ["click", "error"])
                     .alias("source"))


_CODES = list(ERROR_STATUS) + ["SOMETHING_ELSE"]


@query("b17_audit_payloads", sql(
    "SELECT board_id, CAST(CASE WHEN board_id % 7 = 0 THEN NULL WHEN board_id % 7 = 1 THEN NULL "
    "WHEN board_id % 7 = 2 THEN [" + ",".join(str(ERROR_STATUS.get(c, "NULL")) for c in _CODES) +
    "][group_id % 8 + 1] WHEN board_id % 7 = 3 THEN NULL WHEN board_id % 7 = 4 THEN NULL ELSE 200 END AS BIGINT) "
    "AS status, CASE WHEN board_id % 7 = 0 THEN 'fields' WHEN board_id % 7 = 1 THEN 'duplicate-key' "
    "WHEN board_id % 7 = 2 AND group_id % 8 = 7 THEN 'error-fields' WHEN board_id % 7 = 3 THEN 'placement' "
    "WHEN board_id % 7 = 4 THEN 'not-an-object' END AS problem FROM boards"))
def b17(t):
    k = F.col("board_id") % 7
    code = F.get(P.literal_array(_CODES), (F.col("group_id") % 8).cast("int"))
    good = F.concat(F.lit('{"piecePlacement": "'), "placement", F.lit('"}'))
    body = (F.when(k == 0, '{"piecePlacement": "8", "extra": 1}')
            .when(k == 1, F.concat(F.lit('{"piecePlacement": "8", "piecePlacement": "'), "placement",
                                   F.lit('"}')))
            .when(k == 2, F.concat(F.lit('{"error": {"code": "'), code, F.lit('", "message": "m"}}')))
            .when(k == 3, '{"piecePlacement": "8/8/8/8/8/8/8/44"}')
            .when(k == 4, "[1, 2]").otherwise(good))
    return B.audit_payloads(t.placed("placement").withColumn("body", body), ["board_id"], "body")


@query("b18_coverage_label", sql(
    "SELECT board_id, CASE WHEN regexp_replace(config_id, '-[^-]*$', '') IN ('alpha-brown-plain', "
    "'beta-blue-carved') THEN 'shared' ELSE 'new' END AS coverage FROM boards"))
def b18(t):
    return t.boards.select("board_id", B.coverage_label(
        "config_id", ["alpha-brown-plain", "beta-blue-carved"]).alias("coverage"))


@query("b19_control_mask", sql(
    "SELECT board_id, status = 'F' AS previous_control, NOT list_contains(conditions, 'arrow') AS arrow_free "
    "FROM boards"))
def b19(t):
    df = t.boards.withColumn("cohort", F.when(F.col("status") == "F", "previous").otherwise("new"))
    return df.select("board_id", B.control_mask("cohort", "conditions", "previous").alias("previous_control"),
                     B.control_mask("cohort", "conditions", "arrow-free").alias("arrow_free"))


@query("b19_baseline_exact", sql("SELECT board_id FROM cells GROUP BY 1 HAVING bool_and(class_id = pred_id)"))
def b19b(t):
    return B.baseline_exact(t.cells, "class_id", "pred_id", "board_id")


@query("o1_ordered", sql("SELECT config_id, board_id, split FROM boards ORDER BY 1, 2"))
def o1(t):
    return S.ordered(t.boards.select("config_id", "board_id", "split"), ["config_id", "board_id"])


@query("o2_top_k", sql(
    "SELECT box_id, abs(x - dx) + abs(w - dw) AS score FROM rects ORDER BY score DESC, box_id LIMIT 25"))
def o2(t):
    score = F.abs(F.col("x") - F.col("dx")) + F.abs(F.col("w") - F.col("dw"))
    return S.top_k(t.rects.select("box_id", score.alias("score")), [F.desc("score"), F.asc("box_id")], 25)


@query("o3_select_best", sql(
    "SELECT group_id, board_id, price FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY "
    "CAST(price AS BIGINT) // 50000 DESC, board_id) AS r FROM boards) WHERE r = 1"))
def o3(t):
    best = S.select_best(t.boards, [F.desc(F.floor(F.bround("price", 0) / 50000)), F.asc("board_id")],
                         ["group_id"])
    return best.select("group_id", "board_id", "price")


_TR = "SELECT group_id, seed_key FROM boards WHERE leak_split = 'training'"
_EV = "SELECT group_id, seed_key FROM boards WHERE leak_split <> 'training'"


def _parts(t):
    train = F.col("leak_split") == "training"
    return t.boards.where(train), t.boards.where(~train)


@query("u1_union_all", sql(f"SELECT * FROM ({_TR}) UNION ALL SELECT * FROM ({_EV})"))
def u1(t):
    a, b = _parts(t)
    return S.union_all(a.select("group_id", "seed_key"), b.select("group_id", "seed_key"))


@query("u2_intersection", sql(f"SELECT group_id FROM ({_TR}) INTERSECT SELECT group_id FROM ({_EV})"))
def u2(t):
    return S.intersection(*_parts(t), ["group_id"])


@query("u3_difference", sql(f"SELECT group_id FROM ({_TR}) EXCEPT SELECT group_id FROM ({_EV})"))
def u3(t):
    return S.difference(*_parts(t), ["group_id"])


@query("u4_is_subset", sql(
    "SELECT x AS only_a, y AS only_b, x = 0 AS is_subset, x = 0 AND y > 0 AS is_proper_subset, "
    "x = 0 AND y = 0 AS is_equal FROM (SELECT (SELECT count(*) FROM (SELECT group_id FROM a EXCEPT "
    "SELECT group_id FROM b)) AS x, (SELECT count(*) FROM (SELECT group_id FROM b EXCEPT "
    "SELECT group_id FROM a)) AS y)", a=_TR, b="SELECT c_custkey AS group_id FROM customer"))
def u4(t):
    return S.subset_check(_parts(t)[0], t.customer.select(F.col("c_custkey").alias("group_id")), ["group_id"])
