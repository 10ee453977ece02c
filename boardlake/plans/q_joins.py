"""Join queries (family J)."""

from pyspark.sql import functions as F

from boardlake.operators import joins as J
from boardlake.plans.registry import problems_sql, query, sql


@query("j1_join_evidence", sql(
    "SELECT b.board_id, b.group_id, category, CASE WHEN b.board_id % 17 <> 0 THEN grid = pred_grid END AS exact, boxes, found, "
    "c_mktsegment AS style, nullif(concat_ws(',', CASE WHEN b.board_id % 23 = 0 THEN 'repeated-manifest' END, CASE WHEN "
    "b.board_id % 17 = 0 THEN 'missing-predictions' END, CASE WHEN boxes IS NULL THEN 'missing-geometry' END, CASE WHEN "
    "c_custkey IS NULL THEN 'missing-appearance' END), '') AS problem "
    "FROM placements b LEFT JOIN (SELECT board_id, count(*) AS boxes, bool_and(found) AS found FROM rects GROUP BY 1) "
    "g ON b.board_id = g.board_id LEFT JOIN customer ON c_custkey = group_id"))
def j1(t):
    p = t.placed("grid", "pred_grid").where("board_id % 17 <> 0")
    preds = p.select("board_id", (F.col("grid") == F.col("pred_grid")).alias("exact"))
    geo = t.rects.groupBy("board_id").agg(F.count(F.lit(1)).alias("boxes"), F.bool_and("found").alias("found"))
    style = t.customer.select(F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("style"))
    manifest = t.boards.select("board_id", "group_id", "category")
    manifest = manifest.unionAll(manifest.where("board_id % 23 = 0"))
    return J.join_evidence(preds, geo, manifest, style, "board_id", "group_id")


@query("j2_membership_diff", sql(
    "SELECT coalesce(a.board_id, b.board_id) AS board_id, CASE WHEN b.board_id IS NULL THEN 'only-left' ELSE "
    "'only-right' END AS side FROM (SELECT board_id FROM boards) a FULL JOIN (SELECT DISTINCT board_id FROM rects "
    "WHERE found) b ON a.board_id = b.board_id WHERE a.board_id IS NULL OR b.board_id IS NULL"))
def j2(t):
    return J.membership_diff(t.boards, t.rects.where("found"), ["board_id"])


_RUN = ("SELECT board_id, grid, coalesce(pred_grid = grid, false) AS base, coalesce(cand_grid = grid, false) "
        "AS cand FROM grids")


@query("j3_pair_runs", sql(
    "SELECT board_id, CASE WHEN board_id % 19 <> 0 THEN base END AS baseline, CASE WHEN board_id % 13 <> 0 THEN cand END AS candidate, "
    "board_id % 19 <> 0 AND board_id % 13 <> 0 AS same_label, CASE WHEN board_id % 19 = 0 THEN 'only-candidate' WHEN board_id % 13 = 0 "
    "THEN 'only-baseline' END AS problem FROM r WHERE board_id % 19 <> 0 OR board_id % 13 <> 0", r=_RUN))
def j3(t):
    p = t.placed("grid", "pred_grid", "cand_grid")
    old = p.select("board_id", "grid", F.coalesce(F.col("pred_grid") == F.col("grid"), F.lit(False)).alias("ok"))
    new = p.select("board_id", "grid", F.coalesce(F.col("cand_grid") == F.col("grid"), F.lit(False)).alias("ok"))
    return J.pair_runs(old.where("board_id % 19 <> 0"), new.where("board_id % 13 <> 0"), ["board_id"], "grid", "ok").drop("grid")


@query("j4_pair_clean", sql(
    "SELECT b.pair_id, b.board_id, b.category, c.board_id AS clean_board_id, c.category AS clean_category "
    "FROM boards b LEFT JOIN (SELECT * FROM boards WHERE conditions = ['clean'] QUALIFY row_number() OVER "
    "(PARTITION BY pair_id ORDER BY board_id) = 1) c ON b.pair_id = c.pair_id WHERE b.conditions <> ['clean']"))
def j4(t):
    return J.pair_clean(t.boards, "pair_id", F.col("conditions") == F.array(F.lit("clean")), "board_id",
                        ["category"])


_FAILED = "SELECT board_id FROM grids WHERE pred_grid IS NULL OR pred_grid <> grid"


@query("j5_previous_failures", sql(
    f"SELECT box_id, board_id FROM rects WHERE board_id IN ({_FAILED})"))
def j5(t):
    p = t.placed("grid", "pred_grid")
    failed = p.where(F.col("pred_grid").isNull() | (F.col("pred_grid") != F.col("grid")))
    return J.previous_failures(t.rects.select("box_id", "board_id"), failed, "board_id")


@query("j6_unobserved", sql(
    "SELECT board_id, group_id FROM boards WHERE split <> 'training' AND group_id NOT IN "
    "(SELECT group_id FROM boards WHERE category = '1-URGENT')"))
def j6(t):
    b = t.boards
    return J.unobserved(b.where("split <> 'training'").select("board_id", "group_id"),
                        b.where("category = '1-URGENT'"), "group_id").select("board_id", "group_id")


@query("j7_plan_jobs", sql(
    "SELECT c_nationkey, c_custkey, size, config, 'clean-' || config || '-' || size || '-' || "
    "CAST(c_nationkey AS VARCHAR) AS batch_id FROM (SELECT c_nationkey, c_custkey, unnest(CASE WHEN r - 1 = "
    "(g - 1) % n THEN ['standard', 'compact'] ELSE ['standard'] END) AS size FROM (SELECT c_nationkey, c_custkey, "
    "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY "
    "c_nationkey) AS n, dense_rank() OVER (ORDER BY c_nationkey) AS g FROM customer)) "
    "CROSS JOIN (SELECT unnest(['alpha-brown', 'beta-blue', 'gamma-green']) AS config)"))
def j7(t):
    return J.plan_jobs(t.customer, "c_nationkey", "c_custkey", ["alpha-brown", "beta-blue", "gamma-green"])


@query("j8_arrow_routes", sql(
    "SELECT board_id, geometry, count(*) AS routes FROM (SELECT board_id, CASE WHEN dx > 0 AND dy = 0 THEN "
    "'horizontal' WHEN dx = 0 AND dy > 0 THEN 'vertical' WHEN dx = dy AND dx > 0 THEN 'diagonal' WHEN dx * dy = 2 "
    "THEN 'knight' END AS geometry FROM (SELECT board_id, abs(i % 8 - idx % 8) AS dx, abs(i // 8 - idx // 8) AS dy "
    "FROM cells, idx WHERE class_id = 6)) WHERE geometry IS NOT NULL GROUP BY 1, 2"))
def j8(t):
    kings = t.cells.where("class_id = 6").select("board_id", "idx")
    return J.arrow_routes(kings, "idx").groupBy("board_id", "geometry").agg(F.count(F.lit(1)).alias("routes"))


@query("j8_all_routes", sql(
    "SELECT class_id, geometry, count(*) AS routes FROM (SELECT class_id, CASE WHEN dx > 0 AND dy = 0 THEN "
    "'horizontal' WHEN dx = 0 AND dy > 0 THEN 'vertical' WHEN dx = dy AND dx > 0 THEN 'diagonal' WHEN dx * dy = 2 "
    "THEN 'knight' END AS geometry FROM (SELECT class_id, abs(i % 8 - idx % 8) AS dx, abs(i // 8 - idx // 8) AS dy "
    "FROM cells, idx)) WHERE geometry IS NOT NULL GROUP BY 1, 2"))
def j8_all(t):
    ends = t.cells.groupBy("class_id", "idx").agg(F.count(F.lit(1)).alias("n"))  # before routes multiply rows
    return J.arrow_routes(ends, "idx").groupBy("class_id", "geometry").agg(F.sum("n").alias("routes"))


_KEYS = "SELECT doc_id, split, unnest(['text_sha', 'norm_sha', 'head_sha']) AS kind, " \
        "unnest([text_sha, norm_sha, head_sha]) AS v FROM hashes"


@query("j9_duplicate_matches", sql(
    "SELECT a.doc_id, string_agg(a.kind, ',' ORDER BY a.kind) AS matched_by, CAST(sum(n) AS BIGINT) AS matches, "
    "min(f) AS first_match FROM k a JOIN (SELECT kind, v, count(*) AS n, min(doc_id) AS f FROM k WHERE split <> "
    "'training' GROUP BY 1, 2) b ON a.kind = b.kind AND a.v = b.v WHERE split = 'training' GROUP BY 1", k=_KEYS))
def j9(t):
    h = t.hashes
    return J.duplicate_matches(h.where("split = 'training'"), h.where("split <> 'training'"), "doc_id", "doc_id",
                               ["text_sha", "norm_sha", "head_sha"])


@query("j10_nearest_position", sql(
    "SELECT session_id, distance, CAST(sum(n) AS BIGINT) AS nearest_samples, min(f) AS first_nearest FROM "
    "(SELECT session_id, distance, n, f, rank() OVER (PARTITION BY session_id ORDER BY distance) AS r FROM "
    "(SELECT a.board_id AS session_id, CAST(hamming(a.grid, b.grid) AS BIGINT) AS distance, n, f FROM "
    "(SELECT board_id, grid FROM placements WHERE split = 'evaluation') a, (SELECT grid, count(*) AS n, "
    "min(board_id) AS f FROM placements WHERE split = 'training' GROUP BY 1) b)) WHERE r = 1 GROUP BY 1, 2"))
def j10(t):
    p = t.placed("grid")
    return J.nearest_position(p.where("split = 'evaluation'").withColumnRenamed("board_id", "session_id"),
                              p.where("split = 'training'"), "session_id", "board_id", "grid")


_FIELDS = ["group_id", "leak_split", "category", "orientation", "grid"]


@query("j11_inheritance_violations", sql(
    "SELECT c.board_id, " + problems_sql({
        "parent": "p.board_id IS NULL OR c.seed_key = c.board_id",
        **{f: f"p.board_id IS NOT NULL AND c.{f} IS DISTINCT FROM p.{f}" for f in _FIELDS}}) +
    " FROM placements c LEFT JOIN placements p ON c.seed_key = p.board_id WHERE c.m >= 37"))
def j11(t):
    p = t.placed("grid").select("board_id", "seed_key", "m", *_FIELDS)
    return J.inheritance_violations(p.where("m >= 37"), p, "board_id", "seed_key", "board_id", _FIELDS)


_BOX = ["left", "top", "right", "bottom"]
_CROPPED = (
    "SELECT *, CASE WHEN cut THEN x1 - x0 ELSE 512 END + CASE WHEN board_id % 7 = 0 THEN 1 ELSE 0 END AS width, CASE WHEN cut THEN y1 - y0 ELSE 512 "
    "END AS height, 64 - coalesce(x0, 0) + CASE WHEN board_id % 11 = 0 THEN 2 ELSE 0 END AS g_left, 64 - coalesce(y0, 0) AS g_top, "
    "448 - coalesce(x0, 0) AS g_right, 448 - coalesce(y0, 0) AS g_bottom FROM (SELECT board_id, seed_key, board_id % 4 > 0 AS cut, CASE WHEN board_id % 4 "
    "> 0 THEN 10 * (board_id % 3) END AS x0, CASE WHEN board_id % 4 > 0 THEN 20 END AS y0, CASE WHEN board_id % 4 > 0 THEN CASE WHEN board_id % 5 = 0 "
    "THEN 600 ELSE 500 END END AS x1, CASE WHEN board_id % 4 > 0 THEN 480 END AS y1 FROM boards WHERE m >= 37)")


@query("j11_cropped_variants", sql(
    "SELECT c.board_id, " + problems_sql({
        "parent": "p.board_id IS NULL OR c.seed_key = c.board_id",
        "crop": "p.board_id IS NOT NULL AND cut AND NOT (x0 >= 0 AND y0 >= 0 AND x0 < x1 AND y0 < y1 AND x1 <= 512 AND y1 <= 512)",
        "size": "p.board_id IS NOT NULL AND cut AND (width <> x1 - x0 OR height <> y1 - y0)",
        "grid": "p.board_id IS NOT NULL AND cut AND (g_left <> 64 - x0 OR g_top <> 64 - y0 OR g_right <> 448 - x0 OR g_bottom <> 448 - y0)"})
    + " FROM c LEFT JOIN boards p ON c.seed_key = p.board_id", c=_CROPPED))
def j11_cropped(t):
    k = F.col("board_id")
    cut = k % 4 > 0
    x0, y0 = F.when(cut, 10 * (k % 3)), F.when(cut, F.lit(20))
    x1, y1 = F.when(cut, F.when(k % 5 == 0, 600).otherwise(500)), F.when(cut, F.lit(480))
    near = {"g_left": 64 - F.coalesce(x0, F.lit(0)) + F.when(k % 11 == 0, 2).otherwise(0), "g_top": 64 - F.coalesce(y0, F.lit(0)),
            "g_right": 448 - F.coalesce(x0, F.lit(0)), "g_bottom": 448 - F.coalesce(y0, F.lit(0))}
    size = {"width": F.when(cut, x1 - x0).otherwise(512) + F.when(k % 7 == 0, 1).otherwise(0), "height": F.when(cut, y1 - y0).otherwise(512)}
    child = t.boards.where("m >= 37").select(k, "seed_key", x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom"),
                                             *[v.alias(n) for n, v in {**size, **near}.items()])
    whole = t.boards.select(k, *[F.lit(v).alias(n) for n, v in (("width", 512), ("height", 512), ("g_left", 64), ("g_top", 64),
                                                                ("g_right", 448), ("g_bottom", 448))])
    return J.inheritance_violations(child, whole, "board_id", "seed_key", "board_id", [], _BOX, ["width", "height"],
                                    [f"g_{b}" for b in _BOX])


_MAP = ("SELECT pair_id, unnest(['split', 'category', 'status', 'orientation']) AS name, "
        "unnest([split, category, status, orientation]) AS v FROM boards WHERE board_id % 2 = {r}")


@query("j12_map_diff", sql(
    "SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.name, b.name) AS name, a.v AS left_value, "
    "b.v AS right_value FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.name = b.name WHERE a.v IS DISTINCT FROM b.v "
    "AND coalesce(a.name, b.name) <> 'orientation'", a=_MAP.format(r=0), b=_MAP.format(r=1)))
def j12(t):
    names = ["split", "category", "status", "orientation"]
    entries = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    b = t.boards.select("board_id", "pair_id", entries.alias("plan"))
    even = F.col("board_id") % 2 == 0
    return J.map_diff(b.where(even), b.where(~even), "pair_id", "plan", ["orientation"])


_CODE = "CASE WHEN {g} IS NULL THEN CASE WHEN board_id % {m} = 0 THEN 'BOARD_NOT_FOUND' ELSE 'INVALID_IMAGE' END END"


@query("j13_result_parity", sql(
    "SELECT board_id, problem FROM (SELECT board_id, CASE WHEN pred_grid <> cand_grid THEN 'placement' "
    "WHEN (pred_grid IS NULL) <> (cand_grid IS NULL) THEN 'status' WHEN pred_grid IS NULL AND a IS DISTINCT FROM b "
    "THEN 'code' END AS problem FROM (SELECT *, " + _CODE.format(g="pred_grid", m=2) + " AS a, " +
    _CODE.format(g="cand_grid", m=3) + " AS b FROM grids)) WHERE problem IS NOT NULL"))
def j13(t):
    def side(grid, mod):
        code = F.when(F.col(grid).isNull(), F.when(F.col("board_id") % mod == 0, "BOARD_NOT_FOUND")
                      .otherwise("INVALID_IMAGE"))
        return t.placed(grid).select("board_id", F.col(grid).alias("p"), code.alias("c"))
    return J.result_parity(side("pred_grid", 2), side("cand_grid", 3), "board_id", "p", "c")
