"""Constraint and leakage queries (family C)."""

from pyspark.sql import functions as F

from boardlake.functions.placement import family_key, literal_array, square_name
from boardlake.operators import audits as C
from boardlake.plans.q_labels import FAMILY_SQL
from boardlake.plans.q_metrics import BACKGROUND
from boardlake.plans.registry import problems_sql, query, sql

_FAM = f"SELECT p.*, {FAMILY_SQL} AS family, sha256(grid) AS sha FROM placements p"


def families(t):
    return t.placed("grid").withColumn("family", family_key("grid")).withColumn("sha", F.sha2("grid", 256))


@query("c1_split_leaks", sql(
    "SELECT kind, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS rows FROM "
    "(SELECT leak_split AS split, unnest(['group', 'position', 'family']) AS kind, unnest([CAST(group_id AS "
    "VARCHAR), CAST(position_id AS VARCHAR), family]) AS value FROM f) GROUP BY 1, 2 "
    "HAVING count(DISTINCT split) > 1", f=_FAM))
def c1(t):
    return C.split_leaks(families(t), "leak_split",
                         {"group": "group_id", "position": "position_id", "family": "family"})


@query("c2_fd_violations", sql(
    "SELECT sha, count(*) AS variants, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT sha, group_id, leak_split, "
    "count(*) AS n FROM f GROUP BY 1, 2, 3) GROUP BY 1 HAVING count(*) > 1", f=_FAM))
def c2(t):
    return C.fd_violations(families(t).drop("family"), ["sha"], ["group_id", "leak_split"])


@query("c3_duplicate_keys", sql(
    "SELECT group_id, category, orientation, count(*) AS n, min(board_id) AS first_example FROM boards "
    "GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def c3(t):
    from boardlake.operators.joins import duplicate_keys
    return duplicate_keys(t.boards, ["group_id", "category", "orientation"], "board_id")


# File hashes of a board: its image is another board's source, or original, now and then.
_FILES = {"image_sha": "board_id", "source_sha": "board_id // 3 * 3", "original_sha": "board_id // 7 * 7 + 1"}
_OVK = ("SELECT DISTINCT board_id, leak_split, kind, value FROM (SELECT board_id, leak_split, unnest(['group', 'position-id', "
        "'placement-family', 'archive', 'image-file', 'image-file', 'image-file', 'pixels', 'known-source']) AS kind, "
        "unnest([CAST(group_id AS VARCHAR), CAST(position_id AS VARCHAR), family, sha, "
        + ", ".join(f"sha256(CAST({e} AS VARCHAR))" for e in _FILES.values()) +
        ", sha256(grid || orientation), CASE WHEN status = 'P' THEN 'game:' || CAST(pair_id AS VARCHAR) END]) AS value FROM f) "
        "WHERE value IS NOT NULL")


@query("c4_overlap_audit", sql(
    "SELECT k.board_id, k.kind, examples FROM k JOIN (SELECT kind, value, array_to_string(list_slice(list("
    "board_id ORDER BY board_id), 1, 3), ',') AS examples FROM k WHERE leak_split = 'validation' GROUP BY 1, 2) r "
    "ON k.kind = r.kind AND k.value = r.value WHERE leak_split = 'training'", f=_FAM, k=_OVK))
def c4(t):
    k = F.col("board_id")
    files = {"image_sha": k, "source_sha": F.floor(k / 3) * 3, "original_sha": F.floor(k / 7) * 7 + 1}
    f = families(t).withColumns({n: F.sha2(e.cast("string"), 256) for n, e in files.items()}).withColumns({
        "pixels": F.sha2(F.concat("grid", "orientation"), 256),
        "known": F.when(F.col("status") == "P", F.concat(F.lit("game:"), F.col("pair_id").cast("string")))})
    kinds = {"group": "group_id", "position-id": "position_id", "placement-family": "family", "archive": "sha",
             "image-file": list(files), "pixels": "pixels", "known-source": "known"}
    return C.overlap_audit(f.where("leak_split = 'training'"), f.where("leak_split = 'validation'"),
                           "board_id", kinds)


_ID = ["group_id", "category", "orientation", "grid"]


@query("c5_augmentation_violations", sql(
    "SELECT e.board_id, " + problems_sql({
        "source": "b.board_id IS NULL",
        "split": "b.board_id IS NOT NULL AND (b.split <> 'training' OR e.split <> 'training')",
        "pixels": "b.board_id IS NOT NULL AND e.ref_sha IS DISTINCT FROM b.sha",
        **{c: f"b.board_id IS NOT NULL AND e.{c} IS DISTINCT FROM b.{c}" for c in _ID}}) +
    " FROM (SELECT *, CASE WHEN board_id % 7 = 0 THEN -1 ELSE seed_key END AS ref, CASE WHEN board_id % 3 = 0 "
    "THEN 'old' ELSE sha END AS ref_sha FROM f WHERE m >= 37) e LEFT JOIN f b ON e.ref = b.board_id",
    f="SELECT placements.*, sha256(grid) AS sha FROM placements"))
def c5(t):
    p = t.placed("grid").withColumn("sha", F.sha2("grid", 256))
    k = F.col("board_id")
    extra = p.where("m >= 37").withColumn("ref", F.when(k % 7 == 0, -1).otherwise(F.col("seed_key"))) \
        .withColumn("ref_sha", F.when(k % 3 == 0, "old").otherwise(F.col("sha")))
    return C.augmentation_violations(p, extra, "board_id", "ref", "board_id", "split", "sha", "ref_sha", _ID)


_COMBO = "regexp_replace(config_id, '-[^-]*$', '')"
_HELD = ["alpha-blue-carved", "beta-green-plain", "gamma-brown-carved"]


@query("c6_reservation_violations", sql(
    f"SELECT board_id, {_COMBO} AS combination, split FROM boards WHERE split <> 'evaluation' AND {_COMBO} IN ("
    + ", ".join(f"'{h}'" for h in _HELD) + ")"))
def c6(t):
    df = t.boards.withColumn("combination", F.regexp_replace("config_id", "-[^-]*$", ""))
    return C.reservation_violations(df, t.literal("combination string", [(h,) for h in _HELD]),
                                    ["board_id"], "combination", "split")


@query("c7_addition_violations", sql(
    "SELECT board_id, 'group' AS problem FROM n WHERE group_id IN (SELECT group_id FROM r) UNION ALL "
    "SELECT board_id, 'family' FROM n WHERE family IN (SELECT family FROM r) UNION ALL "
    "SELECT board_id, 'hash' FROM n WHERE sha IN (SELECT sha FROM r) UNION ALL "
    "SELECT board_id, 'identity' FROM n WHERE (position_id, config_id, orientation) IN (SELECT position_id, "
    "config_id, orientation FROM f GROUP BY 1, 2, 3 HAVING count(*) > 1)", f=_FAM,
    n="SELECT * FROM f WHERE category = '1-URGENT'",
    r="SELECT * FROM f WHERE category <> '1-URGENT' AND leak_split <> 'training'"))
def c7(t):
    f = families(t)
    new = F.col("category") == "1-URGENT"
    return C.addition_violations(f.where(~new), f.where(new), "board_id", "leak_split", "group_id", "family",
                                 "sha", ["position_id", "config_id", "orientation"])


@query("c8_detection_reservation", sql(
    "SELECT e.board_id, " + problems_sql({
        "source": "EXISTS (SELECT 1 FROM r WHERE r.sha = e.sha AND (r.platform <> e.platform OR r.group_id <> e.group_id))",
        "held-out": "leak_split <> 'evaluation' AND (EXISTS (SELECT 1 FROM r WHERE r.sha = e.sha AND r.leak_split = "
                    "'evaluation') OR EXISTS (SELECT 1 FROM r WHERE r.platform = e.platform AND r.group_id = e.group_id "
                    "AND r.leak_split = 'evaluation'))",
        "bounds": "EXISTS (SELECT 1 FROM r WHERE r.sha = e.sha AND r.box <> e.box)"}) +
    " FROM s e WHERE category <> '5-LOW'",
    s="SELECT board_id, group_id, leak_split, category, sha256(grid) AS sha, split_part(config_id, '-', 1) AS platform, "
      "board_id % 4 AS box FROM placements",
    r="SELECT * FROM s WHERE category = '5-LOW'"))
def c8(t):
    s = t.placed("grid").select("board_id", "group_id", "leak_split", "category", F.sha2("grid", 256).alias("sha"),
                            F.split("config_id", "-")[0].alias("platform"),
                            (F.col("board_id") % 4).alias("box"))
    low = F.col("category") == "5-LOW"
    return C.detection_reservation(s.where(~low), s.where(low), "board_id", "sha", "platform", "group_id",
                                   "leak_split", "box")


@query("c9_external_violations", sql(
    "SELECT board_id, " + problems_sql({
        "namespace": "NOT regexp_full_match(pid, 'real-[a-z0-9][a-z0-9_-]{0,58}') OR NOT regexp_full_match(gid, "
                     "'real-[a-z0-9][a-z0-9_-]{0,58}')",
        "split": "sp NOT IN ('training', 'validation', 'evaluation')",
        "family": "family IN (SELECT family FROM f WHERE category <> '5-LOW')"}) +
    " FROM (SELECT *, CASE WHEN board_id % 9 = 0 THEN 'pos-' ELSE 'real-' END || CAST(board_id AS VARCHAR) AS pid, "
    "'real-' || CASE WHEN board_id % 11 = 0 THEN '_' ELSE '' END || CAST(group_id AS VARCHAR) AS gid, "
    "CASE WHEN board_id % 13 = 0 THEN 'test' ELSE split END AS sp FROM f WHERE category = '5-LOW')", f=_FAM))
def c9(t):
    f, k = families(t), F.col("board_id")
    low = F.col("category") == "5-LOW"
    ext = f.where(low).withColumn("pid", F.concat(F.when(k % 9 == 0, "pos-").otherwise("real-"), k.cast("string"))) \
        .withColumn("gid", F.concat(F.lit("real-"), F.when(k % 11 == 0, "_").otherwise(""),
                                    F.col("group_id").cast("string"))) \
        .withColumn("sp", F.when(k % 13 == 0, "test").otherwise(F.col("split")))
    return C.external_violations(ext, f.where(~low), "board_id", ["pid", "gid"], "real-", "sp",
                                 ["training", "validation", "evaluation"], "family")


_GAME = ("sha256('{\"initialPosition\":\"standard\",\"moves\":[\"' || config_id || '\",\"' || category || '\",\"' || "
         "CAST(group_id % 40 AS VARCHAR) || '\"]}')")


@query("c10_consume", sql(
    "SELECT game, count(*) AS rows, CASE WHEN game IN (SELECT game FROM g WHERE split = 'validation') THEN "
    "'consulted' ELSE 'new' END AS status FROM g WHERE split = 'evaluation' GROUP BY 1",
    g=f"SELECT split, {_GAME} AS game FROM boards"))
def c10(t):
    moves = F.array("config_id", "category", (F.col("group_id") % 40).cast("string"))
    g = t.boards.select("split", C.game_identity(F.lit("standard"), moves).alias("game"))
    return C.consume(g.where("split = 'evaluation'"), g.where("split = 'validation'"), "game")


@query("c11_coverage_gaps", sql(
    "SELECT * FROM (SELECT category, class_id, background, coalesce(squares, 0) AS squares, coalesce(groups, 0) AS "
    "groups, CASE WHEN coalesce(squares, 0) < 2600 THEN 'insufficient' WHEN coalesce(squares, 0) < 2700 OR "
    "coalesce(groups, 0) < 1300 THEN 'warning' END AS level FROM g LEFT JOIN c USING (category, class_id, background)) "
    "WHERE level IS NOT NULL",
    g="SELECT category, class_id, background FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', "
      "'5-LOW', '6-ABSENT']) AS category), (SELECT CAST(range AS BIGINT) "
      "AS class_id FROM range(13)), (SELECT unnest(['light', 'dark']) AS background)",
    c=f"SELECT category, class_id, {BACKGROUND} AS background, count(*) AS squares, count(DISTINCT group_id) AS groups "
      "FROM cells GROUP BY 1, 2, 3"))
def c11(t):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-ABSENT"]
    return C.coverage_gaps(t.cells, "category", "class_id", "idx", "group_id", 2600, 2700, 1300, names)


@query("c12_group_composition", sql(
    "SELECT group_id, " + problems_sql({
        "unused": "samples IS NULL", "size": "samples IS NOT NULL AND samples <> 4",
        "categories": "samples IS NOT NULL AND (n0 <> 1 OR n1 <> 1 OR n2 <> 1 OR n3 <> 1)"}) +
    " FROM (SELECT c_custkey AS group_id FROM customer) LEFT JOIN (SELECT group_id, count(*) AS samples, "
    "count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER "
    "(k = 3) AS n3 FROM (SELECT group_id, board_id % 4 AS k FROM boards) GROUP BY 1) USING (group_id)"))
def c12(t):
    names = ["opening", "middlegame", "endgame", "promotion"]
    df = t.boards.withColumn(
        "phase", F.get(literal_array(names), (F.col("board_id") % 4).cast("int")))
    groups = t.customer.select(F.col("c_custkey").alias("group_id"))
    return C.group_composition(df, groups, "group_id", "phase", names, 4)


@query("c12_missing_colours", sql(
    "SELECT split, colour FROM (SELECT unnest(['training', 'validation', 'evaluation', 'reserve']) AS split), (SELECT unnest(['white', "
    "'black']) AS colour) WHERE (split, colour) NOT IN (SELECT split, CASE WHEN group_id % 2 = 0 THEN 'white' ELSE 'black' END FROM boards "
    "WHERE board_id % 4 = 3 AND (split <> 'evaluation' OR group_id % 2 = 0))"))
def c12b(t):
    colour = F.when((F.col("board_id") % 4 == 3) & ((F.col("split") != "evaluation") | (F.col("group_id") % 2 == 0)),
                    F.when(F.col("group_id") % 2 == 0, "white").otherwise("black"))
    return C.missing_colours(t.boards, "split", colour, ["training", "validation", "evaluation", "reserve"])


@query("c13_box_violations", sql(
    "SELECT box_id, " + problems_sql({
        "outside": "dx < 0 OR dy < 0 OR dx + dw > 300 OR dy + dh > 280", "small": "least(dw, dh) < 202",
        "not-square": "abs(dw - dh) > 1"}) + " FROM (SELECT * REPLACE (CASE WHEN box_id % 71 = 0 THEN NULL ELSE dw END AS dw) FROM rects)"))
def c13(t):
    holes = t.rects.withColumn("dw", F.when(F.col("box_id") % 71 != 0, F.col("dw")))
    return C.box_violations(holes, ["box_id"], "dx", "dy", "dw", "dh", F.lit(300), F.lit(280), 202)


_P = [("ex0", "ey0"), ("ex1", "ey1"), ("ex2", "ey2"), ("ex3", "ey3")]


def _turn(i):
    (ax, ay), (bx, by), (cx, cy) = _P[i], _P[(i + 1) % 4], _P[(i + 2) % 4]
    return f"({bx} - {ax}) * ({cy} - {by}) - ({by} - {ay}) * ({cx} - {bx}) <= 0"


@query("c13_corner_violations", sql(
    "SELECT board_id, " + problems_sql({
        "outside": " OR ".join(f"{x} < 0 OR {y} < 0 OR {x} > 600 OR {y} > 600" for x, y in _P),
        "not-convex": " OR ".join(_turn(i) for i in range(4)),
        "order": "NOT (ex0 < ex1 AND ex3 < ex2 AND ey0 < ey3 AND ey1 < ey2)"}) + " FROM quads"))
def c13b(t):
    return C.corner_violations(t.quads, ["board_id"], _P, F.col("image_w"), F.col("image_h"))


@query("c13_grid_lines", sql(
    "SELECT box_id, " + problems_sql({
        "count": "category = 'A'", "alignment": "mis"}) +
    " FROM (SELECT *, list_bool_or([abs((x + i * (w // 8) + CASE WHEN box_id % 5 = 0 AND i = 3 THEN 2 "
    "ELSE 0 END) - (x + i * w / 8.0)) > 1 FOR i IN range(1, CASE WHEN category = 'A' THEN 7 ELSE 8 END)]) AS mis FROM rects)"))
def c13c(t):
    step = F.floor(F.col("w") / 8)
    shift = F.col("box_id") % 5 == 0
    count = F.when(F.col("category") == "A", 6).otherwise(7)
    lines = F.transform(F.sequence(F.lit(1), count), lambda i: F.col("x") + i * step
                        + F.when(shift & (i == 3), 2).otherwise(0))
    return C.grid_line_violations(t.rects.withColumn("lines", lines), ["box_id"], "lines", F.col("x"),
                                  F.col("x") + F.col("w"))


@query("c13_clip", sql(
    "SELECT box_id, " + problems_sql({
        "clip": "l <> greatest(0, gx) OR tp <> greatest(0, gy) OR r <> least(250, gx + w) OR b <> least(230, gy + h)",
        "empty": "l >= r OR tp >= b"}) +
    " FROM (SELECT box_id, w, h, x - 30 AS gx, y - 20 AS gy, greatest(0, x - 30) AS l, CASE WHEN box_id % 6 = 0 THEN y - 20 "
    "ELSE greatest(0, y - 20) END AS tp, least(250, x - 30 + w) AS r, least(230, y - 20 + h) AS b FROM rects)"))
def c13d(t):
    def z(n):
        return F.lit(n).cast("long")
    df = t.rects.select("box_id", (F.col("x") - 30).alias("gx"), (F.col("y") - 20).alias("gy"), "w", "h") \
        .withColumn("gr", F.col("gx") + F.col("w")).withColumn("gb", F.col("gy") + F.col("h")) \
        .withColumn("l", F.greatest(z(0), "gx")) \
        .withColumn("tp", F.when(F.col("box_id") % 6 == 0, F.col("gy")).otherwise(F.greatest(z(0), "gy"))) \
        .withColumn("r", F.least(z(250), "gr")).withColumn("b", F.least(z(230), "gb"))
    return C.clip_violations(df, ["box_id"], ["l", "tp", "r", "b"], ["gx", "gy", "gr", "gb"], z(250), z(230))


@query("c14_stale_inputs", sql(
    "SELECT path, CASE WHEN now IS NULL THEN 'missing' WHEN was IS NULL THEN 'unexpected' ELSE 'changed' END AS problem "
    "FROM (SELECT coalesce(a.path, f.path) AS path, a.text_sha AS now, f.text_sha AS was FROM a FULL JOIN f ON "
    "a.path = f.path) WHERE now IS NULL OR was IS NULL OR now <> was",
    a="SELECT CAST(doc_id AS VARCHAR) AS path, text_sha FROM hashes WHERE doc_id % 17 <> 0",
    f="SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 23 = 0 THEN norm_sha || 'x' ELSE text_sha END AS text_sha "
      "FROM hashes WHERE doc_id % 19 <> 0"))
def c14(t):
    h, d = t.hashes, F.col("doc_id")
    now = h.where(d % 17 != 0).select(d.cast("string").alias("path"), "text_sha")
    was = h.where(d % 19 != 0).select(d.cast("string").alias("path"), F.when(
        d % 23 == 0, F.concat("norm_sha", F.lit("x"))).otherwise(F.col("text_sha")).alias("text_sha"))
    return C.stale_inputs(now, was, "path", "text_sha")


@query("c15_stale_reviews", sql(
    "SELECT board_id FROM boards WHERE board_id % 21 = 0"))
def c15(t):
    fields = ["board_id", "group_id", "split", "orientation", "category"]
    old = t.boards.withColumn("recorded", C.review_fingerprint(fields)) \
        .withColumn("category", F.when(F.col("board_id") % 21 == 0, "changed").otherwise(F.col("category")))
    return C.stale_reviews(old, ["board_id"], fields, "recorded")


_INTAKE = ("SELECT h.doc_id, h.lang, h.source, CASE WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'ambiguous' "
           "WHEN h.doc_id % 31 = 0 THEN 'guessed' ELSE 'visual-transcription' END AS status, CASE WHEN quality = 1 THEN 'p' END "
           "AS placement, CASE WHEN h.doc_id % 5 = 0 THEN '' ELSE 'r' END AS reviewer, 'visual-board-review' AS method, "
           "CASE WHEN h.doc_id % 7 = 0 THEN norm_sha || 'x' ELSE text_sha END AS source_sha, text_sha FROM hashes h LEFT JOIN labels "
           "USING (doc_id)")


def intake(t):
    h, d = t.hashes, F.col("doc_id")
    j = h.join(t.labels, "doc_id", "left")
    return j.select(
        "doc_id", "lang", "source",
        F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "ambiguous")
        .when(d % 31 == 0, "guessed").otherwise("visual-transcription").alias("status"),
        F.when(F.col("quality") == 1, "p").alias("placement"),
        F.when(d % 5 == 0, "").otherwise("r").alias("reviewer"), F.lit("visual-board-review").alias("method"),
        F.when(d % 7 == 0, F.concat("norm_sha", F.lit("x"))).otherwise(F.col("text_sha")).alias("source_sha"),
        "text_sha")


@query("c16_intake_violations", sql(
    "SELECT doc_id, " + problems_sql({
        "status": "status NOT IN ('visual-transcription', 'pending', 'ambiguous')",
        "label-without-review": "status IN ('pending', 'ambiguous') AND placement IS NOT NULL",
        "missing-label": "status = 'visual-transcription' AND placement IS NULL",
        "reviewer": "status = 'visual-transcription' AND reviewer = ''",
        "stale-source": "status = 'visual-transcription' AND source_sha <> text_sha"}) + " FROM x", x=_INTAKE))
def c16(t):
    return C.intake_violations(intake(t), ["doc_id"], "status", "placement", "reviewer", "method", "source_sha",
                               "text_sha")


@query("c16_intake_counts", sql(
    "SELECT 'all' AS dimension, 'all' AS value, count(*) AS n FROM x UNION ALL " + " UNION ALL ".join(
        f"SELECT '{d}', {d}, count(*) FROM x GROUP BY {d}" for d in ("status", "lang", "source")), x=_INTAKE))
def c16b(t):
    return C.intake_counts(intake(t), ["status", "lang", "source"])


@query("c16_repeated_values", sql(
    "SELECT text_sha, count(*) AS n, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 3), ',') AS examples "
    "FROM hashes GROUP BY 1 HAVING count(*) > 1"))
def c16c(t):
    return C.repeated_values(t.hashes, "text_sha", "doc_id")


# Marks of every kind, with square names and colours; some are broken in each way the rules name.
MARKS_SQL = """
    SELECT board_id, mark_no, kind, sq1, sq2, path, bend, width, [255, 200 + board_id % 60, 0, alpha] AS rgba,
      CASE WHEN kind = 'arrow' THEN NULL
           WHEN kind = 'selection' AND board_id % 13 <> 0 OR kind = 'check' THEN [n1]
           WHEN kind = 'move-dot' AND board_id % 11 = 0 THEN [n1, n2, n1]
           WHEN kind = 'last-move' AND board_id % 11 = 0 THEN [n1]
           WHEN board_id % 53 = 0 THEN [n1, 'j9'] ELSE [n1, n2] END AS squares
    FROM (SELECT * REPLACE (CASE WHEN board_id % 61 = 0 THEN NULL WHEN kind <> 'circle' THEN kind
              ELSE ['circle', 'last-move', 'selection', 'move-dot'][board_id % 4 + 1] END AS kind,
              CASE WHEN board_id % 43 = 0 THEN (sq2 + 11) % 64 ELSE sq2 END AS sq2),
            'abcdefgh'[sq1 % 8 + 1] || CAST(8 - sq1 // 8 AS VARCHAR) AS n1,
            'abcdefgh'[sq2 % 8 + 1] || CAST(8 - sq2 // 8 AS VARCHAR) AS n2
          FROM marks)"""


def all_marks(t):
    k, n1, n2 = F.col("board_id"), square_name("sq1"), square_name("sq2")
    kind = F.when(k % 61 == 0, None).when(F.col("kind") != "circle", F.col("kind")).otherwise(
        F.get(literal_array(["circle", "last-move", "selection", "move-dot"]), (k % 4).cast("int")))
    named = t.marks.withColumns({"n1": n1, "n2": n2, "kind": kind})
    is_kind = lambda x: F.col("kind") == x
    squares = (F.when(is_kind("arrow"), None)
               .when((is_kind("selection") & (k % 13 != 0)) | is_kind("check"), F.array("n1"))
               .when(is_kind("move-dot") & (k % 11 == 0), F.array("n1", "n2", "n1"))
               .when(is_kind("last-move") & (k % 11 == 0), F.array("n1"))
               .when(k % 53 == 0, F.array(F.col("n1"), F.lit("j9"))).otherwise(F.array("n1", "n2")))
    return named.withColumns({
        "squares": squares, "rgba": F.array(F.lit(255).cast("long"), 200 + k % 60, F.lit(0).cast("long"), F.col("alpha")),
        "sq2": F.when(k % 43 == 0, (F.col("sq2") + 11) % 64).otherwise(F.col("sq2"))})


_DXY = "abs(sq2 % 8 - sq1 % 8) AS dx, abs(sq2 // 8 - sq1 // 8) AS dy"


@query("c17_mark_violations", sql(
    "SELECT board_id, mark_no, " + problems_sql({
        "kind": "kind NOT IN ('arrow', 'last-move', 'selection', 'check', 'circle', 'move-dot')",
        "squares": "kind IS DISTINCT FROM 'arrow' AND (len(squares) <> len(list_distinct(squares)) OR list_contains(squares, 'j9') "
                   "OR coalesce(kind = 'last-move', false) AND len(squares) <> 2 OR coalesce(kind = 'selection', false) "
                   "AND len(squares) <> 1)",
        "check": "coalesce(kind = 'check', false) AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.board_id = x.board_id AND "
                 "c.idx = x.sq1 AND class_id IN (6, 12))",
        "path": "coalesce(kind = 'arrow', false) AND CASE path WHEN 'straight' THEN NOT ((dx > 0 OR dy > 0) AND (dx = 0 OR dy = 0 "
                "OR dx = dy)) OR bend IS NOT NULL ELSE dx * dy <> 2 OR bend IS NULL END",
        "width": "coalesce(kind = 'arrow', false) AND NOT width BETWEEN 0.04 AND 0.3",
        "colour": "rgba[2] > 255 OR rgba[4] = 0"}) +
    f" FROM (SELECT *, {_DXY} FROM am) x", am=MARKS_SQL))
def c17(t):
    return C.mark_violations(all_marks(t), t.cells, "board_id", "mark_no", "kind", "squares", "rgba", "path", "bend",
                             "width", "sq1", "sq2")


@query("c17_doubled_kinds", sql(
    "SELECT board_id, kind, count(*) AS n FROM (SELECT board_id, kind FROM am UNION ALL SELECT board_id, kind FROM am WHERE "
    "board_id % 5 = 0) WHERE kind <> 'arrow' GROUP BY 1, 2 HAVING count(*) > 1", am=MARKS_SQL))
def c17b(t):
    m = all_marks(t).select("board_id", "kind")
    return C.doubled_kinds(m.unionAll(m.where("board_id % 5 = 0")), "board_id", "kind")


_BATCH = ("SELECT pair_id, orientation, board_id, 2 * (board_id % 50) + CASE WHEN board_id % 19 = 0 THEN 1 ELSE 0 END AS px, "
          "board_id % 50 AS css, CASE WHEN board_id % 29 = 0 THEN 'x.png' ELSE CAST(pair_id AS VARCHAR) || '-' || orientation "
          "|| '.png' END AS image FROM boards WHERE board_id % 23 <> 0")


@query("c19_capture_audit", sql(
    "SELECT pair_id, orientation, 'missing' AS problem FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.pair_id = e.pair_id "
    "AND b.orientation = e.orientation) UNION ALL SELECT pair_id, orientation, 'unexpected' FROM b WHERE NOT EXISTS (SELECT 1 "
    "FROM e WHERE b.pair_id = e.pair_id AND b.orientation = e.orientation) UNION ALL SELECT pair_id, orientation, 'bounds' FROM b "
    "WHERE px <> 2 * css UNION ALL SELECT pair_id, orientation, 'image' FROM b WHERE image = 'x.png'",
    e="SELECT DISTINCT pair_id, o AS orientation FROM boards, (SELECT unnest(['white-bottom', 'black-bottom']) AS o) "
      "WHERE pair_id % 27 <> 0", b=_BATCH))
def c19(t):
    k = F.col("board_id")
    name = F.concat_ws("", F.col("pair_id").cast("string"), F.lit("-"), F.col("orientation"), F.lit(".png"))
    batch = t.boards.where(k % 23 != 0).select(
        "pair_id", "orientation", (2 * (k % 50) + F.when(k % 19 == 0, 1).otherwise(0)).alias("px"),
        (k % 50).alias("css"), F.when(k % 29 == 0, "x.png").otherwise(name).alias("image"), name.alias("want"))
    grid = t.boards.where(F.col("pair_id") % 27 != 0).select("pair_id").distinct().select(
        "pair_id", F.explode(literal_array(["white-bottom", "black-bottom"])).alias("orientation"))
    return C.capture_audit(batch, grid, ["pair_id", "orientation"], {
        "bounds": F.col("px") != 2 * F.col("css"), "image": F.col("image") != F.col("want")})


@query("c20_duplicate_archives", sql(
    "SELECT head_sha, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_row FROM hashes GROUP BY 1 "
    "HAVING count(*) > 1"))
def c20(t):
    return C.duplicate_archives(t.hashes, "head_sha", "source", "doc_id")


@query("c20_later_duplicates", sql(
    "SELECT board_id, first_row FROM (SELECT board_id, min(board_id) OVER (PARTITION BY grid) AS first_row FROM grids) "
    "WHERE board_id <> first_row"))
def c20b(t):
    return C.later_duplicates(t.placed("grid").select("board_id", "grid"), "grid", "board_id")


_LIST = ("SELECT box_id + CASE WHEN box_id % 101 = 0 THEN 1000000000 ELSE 0 END AS box_id, board_id + CASE WHEN box_id % 37 = 0 "
         "THEN 1 ELSE 0 END AS board_id, CASE WHEN box_id % 41 = 0 THEN 'Z' ELSE category END AS category FROM x "
         "UNION ALL SELECT box_id, board_id, category FROM x WHERE box_id % 53 = 0")


@query("c21_session_membership", sql(
    "SELECT coalesce(x.box_id, l.box_id) AS box_id, " + problems_sql({
        "unknown-image": "x.box_id IS NULL", "unassigned": "n IS NULL", "several-sessions": "coalesce(n, 0) > 1",
        "wrong-session": "x.box_id IS NOT NULL AND n IS NOT NULL AND (board_id <> s1 OR board_id <> s2)",
        "wrong-kind": "x.box_id IS NOT NULL AND n IS NOT NULL AND (category <> k1 OR category <> k2)"}) +
    " FROM x FULL JOIN (SELECT box_id, count(*) AS n, min(board_id) AS s1, max(board_id) AS s2, min(category) AS k1, "
    "max(category) AS k2 FROM l GROUP BY 1) l ON x.box_id = l.box_id",
    x="SELECT box_id, min(board_id) AS board_id, min(category) AS category FROM rects GROUP BY 1", l=_LIST))
def c21(t):
    x = t.rects.groupBy("box_id").agg(F.min("board_id").alias("board_id"), F.min("category").alias("category"))
    b = F.col("box_id")
    moved = x.select((b + F.when(b % 101 == 0, 1000000000).otherwise(0)).alias("box_id"),
                     (F.col("board_id") + F.when(b % 37 == 0, 1).otherwise(0)).alias("board_id"),
                     F.when(b % 41 == 0, "Z").otherwise(F.col("category")).alias("category"))
    listing = moved.unionByName(x.where(b % 53 == 0))
    return C.session_membership(x, listing, "box_id", "board_id", "category")


@query("c22_session_overlap", sql(
    "SELECT board_id, coalesce(dn, 0) AS duplicate_matches, coalesce(fn, 0) AS family_matches, coalesce(sn, 0) AS source_matches, "
    "CASE WHEN coalesce(dn, fn, sn) IS NOT NULL THEN 'overlap-found' ELSE 'no-observed-overlap' END AS status, "
    "CASE WHEN src IS NOT NULL THEN 'known-source' ELSE 'unresolved-source' END AS provenance FROM "
    "(SELECT * FROM s WHERE leak_split = 'evaluation') "
    "LEFT JOIN (SELECT sha, count(*) AS dn FROM s WHERE leak_split = 'validation' GROUP BY 1) USING (sha) "
    "LEFT JOIN (SELECT family, count(*) AS fn FROM s WHERE leak_split = 'validation' GROUP BY 1) USING (family) "
    "LEFT JOIN (SELECT src, count(*) AS sn FROM s WHERE leak_split = 'validation' AND src IS NOT NULL GROUP BY 1) USING (src)",
    f=_FAM, s="SELECT board_id, leak_split, family, sha, CASE WHEN status = 'P' THEN 'game:' || CAST(group_id AS VARCHAR) END "
              "AS src FROM f"))
def c22(t):
    src = F.when(F.col("status") == "P", F.concat(F.lit("game:"), F.col("group_id").cast("string")))
    s = families(t).select("board_id", "leak_split", "family", "sha", src.alias("src"))
    return C.session_overlap(s.where("leak_split = 'evaluation'"), s.where("leak_split = 'validation'"), "board_id",
                             "family", "src", "sha")


_OVERLAP = ("SELECT board_id, leak_split, grid, family, sha, sha256(grid || orientation) AS pixels, CASE WHEN status = 'P' THEN 'game:' || "
            "CAST(group_id AS VARCHAR) END AS src, CASE WHEN leak_split = 'validation' THEN 'validation' WHEN leak_split = 'training' "
            "AND status = 'O' THEN 'development' WHEN leak_split = 'training' THEN 'digital' END AS cohort FROM f")


def _overlap_rows(t):
    src = F.when(F.col("status") == "P", F.concat(F.lit("game:"), F.col("group_id").cast("string")))
    training, open_ = F.col("leak_split") == "training", F.col("status") == "O"
    return families(t).select(
        "board_id", "leak_split", "grid", "family", "sha", F.sha2(F.concat("grid", "orientation"), 256).alias("pixels"), src.alias("src"),
        F.when(F.col("leak_split") == "validation", "validation").when(training & open_, "development").when(
            training, "digital").alias("cohort"))


@query("c22_overlap_report", sql(
    "SELECT a.board_id, c.cohort, coalesce(en.n, 0) AS exact_matches, coalesce(fn.n, 0) AS family_matches, coalesce(sn.n, 0) AS "
    "source_matches, coalesce(hn.n, 0) AS sha_matches, coalesce(pn.n, 0) AS pixels_matches, d.distance, d.n AS nearest_samples, "
    "d.f AS first_nearest, CASE WHEN bool_or(c.cohort <> 'development' AND (fn.n IS NOT NULL OR sn.n IS NOT NULL) OR c.cohort = 'validation' "
    "AND (hn.n IS NOT NULL OR pn.n IS NOT NULL)) OVER (PARTITION BY a.board_id) THEN 'overlap-found' ELSE 'no-observed-overlap' END AS "
    "status, CASE WHEN a.src IS NOT NULL THEN 'known-source' ELSE 'unresolved-source' END AS provenance FROM a JOIN c ON true "
    + " ".join(f"LEFT JOIN (SELECT cohort, {col}, count(*) AS n FROM s WHERE cohort IS NOT NULL AND {col} IS NOT NULL GROUP BY 1, 2) {k} "
               f"ON {k}.cohort = c.cohort AND {k}.{col} = a.{col}"
               for k, col in (("en", "grid"), ("fn", "family"), ("sn", "src"), ("hn", "sha"), ("pn", "pixels")))
    + " LEFT JOIN (SELECT board_id, cohort, distance, CAST(sum(n) AS BIGINT) AS n, min(f) AS f FROM (SELECT *, rank() OVER (PARTITION BY "
      "board_id, cohort ORDER BY distance) AS r FROM (SELECT a.board_id, g.cohort, CAST(hamming(a.grid, g.grid) AS BIGINT) AS distance, "
      "g.n, g.f FROM a, (SELECT cohort, grid, count(*) AS n, min(board_id) AS f FROM s WHERE cohort IS NOT NULL GROUP BY 1, 2) g)) "
      "WHERE r = 1 GROUP BY 1, 2, 3) d ON d.board_id = a.board_id AND d.cohort = c.cohort",
    f=_FAM, s=_OVERLAP, a="SELECT * FROM s WHERE leak_split = 'evaluation'",
    c="SELECT unnest(['validation', 'development', 'digital']) AS cohort"))
def c22_report(t):
    s = _overlap_rows(t)
    cohorts = {c: s.where(F.col("cohort") == c) for c in ("validation", "development", "digital")}
    return C.overlap_report(s.where("leak_split = 'evaluation'"), cohorts, ["validation", "digital"], "board_id", "board_id", "grid",
                            "family", "src", ["sha", "pixels"])


@query("c22_matching_files", sql(
    "SELECT kind, value, side, id FROM (SELECT board_id AS id, CASE WHEN leak_split = 'training' THEN 'target' ELSE 'cohort' END AS side, "
    "unnest(['sha', 'pixels']) AS kind, unnest([sha, pixels]) AS value FROM s WHERE leak_split IN ('training', 'validation')) "
    "WINDOW w AS (PARTITION BY kind, value) QUALIFY count(*) FILTER (side = 'target') OVER w > 0 AND count(*) FILTER (side = 'cohort') "
    "OVER w > 0", f=_FAM, s=_OVERLAP))
def c22_files(t):
    s = _overlap_rows(t)
    return C.matching_files(s.where("leak_split = 'training'"), s.where("leak_split = 'validation'"), "board_id", "board_id",
                            ["sha", "pixels"])


_CF = ["group_id", "split", "orientation", "config_id"]


@query("c23_cached_mismatch", sql(
    "SELECT c.board_id, " + problems_sql({
        "unknown": "b.board_id IS NULL",
        **{f: f"b.board_id IS NOT NULL AND c.{f} IS DISTINCT FROM b.{f}" for f in _CF}}) +
    " FROM (SELECT board_id, group_id + CASE WHEN board_id % 31 = 0 THEN 1 ELSE 0 END AS group_id, CASE WHEN board_id % 33 = 0 "
    "THEN NULL ELSE split END AS split, orientation, config_id FROM boards) c LEFT JOIN (SELECT * FROM boards WHERE "
    "board_id % 35 <> 0) b ON c.board_id = b.board_id"))
def c23(t):
    k = F.col("board_id")
    cache = t.boards.select(k, (F.col("group_id") + F.when(k % 31 == 0, 1).otherwise(0)).alias("group_id"),
                            F.when(k % 33 != 0, F.col("split")).alias("split"), "orientation", "config_id")
    return C.cached_mismatch(cache, t.boards.where(k % 35 != 0), "board_id", _CF)


@query("c24_assignment_check", sql(
    "SELECT split, CAST(NULL AS BIGINT) AS board_id, 'several-groups' AS problem FROM r GROUP BY 1 HAVING count(DISTINCT group_id) > 1 "
    "UNION ALL (SELECT split, board_id, 'not-reviewed' FROM p WHERE board_id NOT IN (SELECT board_id FROM r)) "
    "UNION ALL (SELECT split, board_id, 'not-planned' FROM r WHERE board_id NOT IN (SELECT board_id FROM p))",
    p="SELECT split, board_id FROM boards WHERE board_id % 37 <> 0",
    r="SELECT split, board_id, CASE WHEN split = 'evaluation' THEN 0 ELSE group_id END AS group_id FROM boards "
      "WHERE board_id % 39 <> 0"))
def c24(t):
    k = F.col("board_id")
    rows = t.boards.where(k % 39 != 0).withColumn(
        "group_id", F.when(F.col("split") == "evaluation", 0).otherwise(F.col("group_id")))
    return C.assignment_check(t.boards.where(k % 37 != 0), rows, "split", "board_id", "group_id")
