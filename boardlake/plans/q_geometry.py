"""Geometry queries (family G, A18, A19, C18, W12)."""

from pyspark.sql import functions as F

from boardlake.operators import geometry as G
from boardlake.operators import metrics as M
from boardlake.operators import sampling as W
from boardlake.functions.placement import literal_array
from boardlake.plans.q_audits import MARKS_SQL, all_marks
from boardlake.plans.registry import query, sql

_RM = ("SELECT *, greatest(abs(x - dx), abs(y - dy), abs(x + w - dx - dw), abs(y + h - dy - dh)) AS max_edge_error, "
       "i / CAST(w * h + dw * dh - i AS DOUBLE) AS iou FROM (SELECT *, greatest(0, least(x + w, dx + dw) - greatest(x, dx)) * "
       "greatest(0, least(y + h, dy + dh) - greatest(y, dy)) AS i FROM rects)")
_EXP, _ACT = ["x", "y", "w", "h"], ["dx", "dy", "dw", "dh"]


@query("g1_rectangle_metrics", sql("SELECT box_id, max_edge_error, iou FROM r", r=_RM))
def g1(t):
    return G.rectangle_metrics(t.rects, ["box_id"], _EXP, _ACT)


def _metrics(t):
    return G.rectangle_metrics(t.rects, ["box_id", "category", "found"], _EXP, _ACT)


@query("a18_detection_summary", sql(
    "SELECT category, count(*) AS images, count(*) FILTER (found) AS detected, count(*) FILTER (found AND max_edge_error <= 2) AS "
    "within_tolerance, count(*) FILTER (NOT found) AS failed, count(*) FILTER (found AND max_edge_error > 2) AS out_of_tolerance, "
    "round(avg(iou) FILTER (found), 6) AS mean_iou, max(max_edge_error) FILTER (found) AS max_edge_error FROM r GROUP BY 1", r=_RM))
def a18(t):
    return M.detection_summary(_metrics(t), ["category"], F.col("found"), F.col("max_edge_error") <= 2, "iou",
                               "max_edge_error")


@query("a18_detection_failures", sql(
    "SELECT box_id, CASE WHEN NOT found THEN 'not-detected' ELSE 'out-of-tolerance' END AS reason FROM r WHERE NOT found OR "
    "max_edge_error > 2", r=_RM))
def a18b(t):
    return M.detection_failures(_metrics(t), F.col("found"), F.col("max_edge_error") <= 2).select("box_id", "reason")


@query("a19_negative_summary", sql(
    "SELECT category, count(*) AS images, count(*) FILTER (dx % 7 = 0) AS false_detections, count(*) FILTER (dx % 7 = 0) / "
    "CAST(count(*) AS DOUBLE) AS false_detection_rate FROM rects GROUP BY 1"))
def a19(t):
    return M.negative_summary(t.rects, ["category"], F.col("dx") % 7 == 0)


_C = [(f"ex{i}", f"ey{i}") for i in range(4)]


def _found():
    return [(F.col(x) + F.col(f"j{i}"), F.col(y) + F.col(f"j{(i + 1) % 4}")) for i, (x, y) in enumerate(_C)]


@query("g2_quad_metrics")
def g2(t):
    return G.quad_metrics(t.quads.where("found"), ["board_id"], _C, _found())


def _hom(x, y):
    dx1, dx2, sx = f"({x}1-{x}2)", f"({x}3-{x}2)", f"({x}0-{x}1+{x}2-{x}3)"
    dy1, dy2, sy = f"({y}1-{y}2)", f"({y}3-{y}2)", f"({y}0-{y}1+{y}2-{y}3)"
    det = f"nullif(CAST({dx1}*{dy2}-{dx2}*{dy1} AS DOUBLE), 0)"
    return f"({sx}*{dy2}-{dx2}*{sy})/{det}", f"({dx1}*{sy}-{sx}*{dy1})/{det}"


def _proj(p, x, y):
    w = f"nullif({p}g*u+{p}h*v+1, 0)"
    return (f"(({x}1-{x}0+{p}g*{x}1)*u+({x}3-{x}0+{p}h*{x}3)*v+{x}0)/{w}",
            f"(({y}1-{y}0+{p}g*{y}1)*u+({y}3-{y}0+{p}h*{y}3)*v+{y}0)/{w}")


_EG, _EH = _hom("ex", "ey")
_AG, _AH = _hom("ax", "ay")
_PE, _PA = _proj("e", "ex", "ey"), _proj("a", "ax", "ay")
_DET = ", ".join(f"ex{i} + j{i} AS ax{i}, ey{i} + j{(i + 1) % 4} AS ay{i}" for i in range(4))
_SIDE = "(" + " + ".join(f"sqrt((ex{i}-ex{(i + 1) % 4})**2 + (ey{i}-ey{(i + 1) % 4})**2)" for i in range(4)) + ") / 4"
_CORNER = "greatest(" + ", ".join(f"sqrt((ex{i}-ax{i})**2 + (ey{i}-ay{i})**2)" for i in range(4)) + ")"


@query("g2_quad_errors", sql(
    f"SELECT board_id, round(max(corner), 4) AS max_corner_error, round(max(corner) / max(side), 5) AS corner_board_fraction, round(max(sqrt(({_PE[0]} - "
    f"{_PA[0]})**2 + ({_PE[1]} - {_PA[1]})**2)) / (max(side) / 8), 5) AS grid_cell_fraction FROM h, (SELECT (range % 9) / 8.0::DOUBLE AS u, "
    "(range // 9) / 8.0::DOUBLE AS v FROM range(81)) GROUP BY 1",
    d=f"SELECT *, {_DET} FROM quads WHERE found",
    h=f"SELECT *, {_EG} AS eg, {_EH} AS eh, {_AG} AS ag, {_AH} AS ah, {_CORNER} AS corner, {_SIDE} AS side FROM d"))
def g2b(t):
    m = G.quad_errors(t.quads.where("found"), ["board_id"], _C, _found())
    return m.select("board_id", F.round("corner", 4).alias("max_corner_error"),
                    F.round(F.col("corner") / F.col("side"), 5).alias("corner_board_fraction"),
                    F.round(F.col("grid") / (F.col("side") / 8), 5).alias("grid_cell_fraction"))


_ED = [f"sqrt(CAST((ex{i}-ex{(i + 1) % 4})**2 + (ey{i}-ey{(i + 1) % 4})**2 AS DOUBLE))" for i in range(4)]


@query("g3_quad_shape", sql(
    "SELECT board_id, round(least(e0, e1, e2, e3), 6) AS shortest_edge, round(least(e0, e1, e2, e3) / 8, 6) AS shortest_edge_per_cell, "
    "round(greatest(e0 / e2, e2 / e0, e1 / e3, e3 / e1), 9) AS opposite_edge_ratio, CASE WHEN greatest(e0 / e2, e2 / e0, e1 / e3, "
    "e3 / e1) < 1.2 THEN 'opposite-edge-ratio-under-1.2' ELSE 'opposite-edge-ratio-at-least-1.2' END AS geometry_band FROM (SELECT "
    "board_id, " + ", ".join(f"{e} AS e{i}" for i, e in enumerate(_ED)) + " FROM quads)"))
def g3(t):
    return G.quad_shape(t.quads, ["board_id"], _C)


_SC = [("reference", (0, 0, 0, 0)), ("shift-x-1", (-1, 0, -1, 0)), ("shift-y+2", (0, 2, 0, 2)), ("inset-2", (2, 2, -2, -2)),
       ("outset-2", (-2, -2, 2, 2)), ("asymmetric-2", (1, -2, 2, -1))]


@query("g4_perturb_bounds", sql(
    "SELECT box_id, scenario, l AS \"left\", tp AS top, r AS \"right\", b AS bottom, l >= 0 AND l < r AND r <= 300 AND tp >= 0 AND tp < b AND "
    "b <= 280 AS valid FROM (SELECT box_id, scenario, x + a AS l, y + bb AS tp, x + w + c AS r, y + h + d AS b FROM rects, (VALUES "
    + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in _SC) + ") s(scenario, a, bb, c, d))"))
def g4(t):
    return G.perturb_bounds(t.rects, ["box_id"], _EXP, F.lit(300), F.lit(280), _SC)


def _arrows(t):
    return t.marks.where("kind = 'arrow'")


_SHAFTS = (("x0", "y0", "x1", "y1"), ("x1", "y1", "tx", "ty"))


def _point_sql(seg, px, py):
    """Distance of a point to a segment."""
    ax, ay, bx, by = seg
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    t = (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / "
         f"({dx} * {dx} + {dy} * {dy}) ELSE 0 END))")
    ox, oy = f"({px} - {ax} - {t} * {dx})", f"({py} - {ay} - {t} * {dy})"
    return f"sqrt({ox} * {ox} + {oy} * {oy})"


def _near_sql(seg):
    ax, ay, bx, by = seg
    cross = [f"({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax})" for x in ("lf", "rt") for y in ("tp", "bt")]
    hits = (f"(greatest({ax}, {bx}) >= lf AND least({ax}, {bx}) <= rt AND greatest({ay}, {by}) >= tp AND least({ay}, {by}) <= bt AND "
            f"greatest({', '.join(cross)}) >= 0 AND least({', '.join(cross)}) <= 0)")
    def outside(x, y):
        ox, oy = f"greatest(lf - {x}, 0.0::DOUBLE, {x} - rt)", f"greatest(tp - {y}, 0.0::DOUBLE, {y} - bt)"
        return f"sqrt({ox} * {ox} + {oy} * {oy})"
    near = ", ".join([outside(ax, ay), outside(bx, by)] + [_point_sql(seg, x, y) for x in ("lf", "rt") for y in ("tp", "bt")])
    return f"({hits} OR least({near}) < width / 2)"


def _head_sql():
    pts = [("x2", "y2"), ("lx", "ly"), ("rx", "ry")]
    xs, ys = ", ".join(p[0] for p in pts), ", ".join(p[1] for p in pts)
    parts = [f"greatest({xs}) >= lf AND least({xs}) <= rt AND greatest({ys}) >= tp AND least({ys}) <= bt"]
    for i in range(3):
        (ax, ay), (bx, by), (cx, cy) = pts[i], pts[(i + 1) % 3], pts[(i + 2) % 3]
        def side(x, y):
            return f"(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}))"
        parts.append("greatest(" + ", ".join(f"{side(x, y)} * sign({side(cx, cy)})" for x in ("lf", "rt") for y in ("tp", "bt")) + ") >= 0")
    return "(" + " AND ".join(parts) + ")"


def _parts_sql(source, keep):
    return (f"SELECT *, bx + vx * width * 0.4::DOUBLE AS tx, by_ + vy * width * 0.4::DOUBLE AS ty, bx - vy * half AS lx, by_ + vx * half AS ly, bx + vy * half AS rx, "
            "by_ - vx * half AS ry FROM (SELECT *, x2 - vx * len AS bx, y2 - vy * len AS by_ FROM (SELECT *, (x2 - x1) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * "
            "(y2 - y1)) AS vx, (y2 - y1) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS vy, greatest(0.3::DOUBLE, width * 2.1::DOUBLE) AS len, width * "
            "1.5::DOUBLE AS half FROM (SELECT *, CASE WHEN bend = 'horizontal-first' THEN x2 ELSE x0 END AS x1, CASE WHEN bend = 'vertical-first' THEN y2 ELSE y0 END AS y1 "
            f"FROM (SELECT {keep}, sq1 % 8 + 0.5::DOUBLE AS x0, sq1 // 8 + 0.5::DOUBLE AS y0, sq2 % 8 + 0.5::DOUBLE AS x2, sq2 // 8 + 0.5::DOUBLE AS y2, bend, "
            f"CAST(width AS DOUBLE) AS width FROM {source}))))")


def _touch_sql(parts, keep, halo):
    return (f"SELECT {keep}, idx FROM (SELECT *, i % 8 - {halo}::DOUBLE AS lf, i // 8 - {halo}::DOUBLE AS tp, i % 8 - {halo}::DOUBLE + 1 + 2 * {halo}::DOUBLE AS rt, "
            f"i // 8 - {halo}::DOUBLE + 1 + 2 * {halo}::DOUBLE AS bt, i AS idx FROM {parts}, idx) WHERE " + " OR ".join([*map(_near_sql, _SHAFTS), _head_sql()]))


_AR = "SELECT * FROM marks WHERE kind = 'arrow'"
_AP = _parts_sql("ar", "board_id, mark_no")


@query("g5_touched_cells", sql("SELECT * FROM tc", ar=_AR, ap=_AP, tc=_touch_sql("ap", "board_id, mark_no", "0.0625")))
def g5(t):
    return G.with_touched(_arrows(t), ["board_id", "mark_no"], "sq1", "sq2", "bend", "width")


_POINT = "idx % 8 + (p % 16 + 0.5::DOUBLE) / 16 AS px, idx // 8 + (p // 16 + 0.5::DOUBLE) / 16 AS py"
_ALONG, _OFF = "((x2 - px) * vx + (y2 - py) * vy)", "abs((px - x2) * vy - (py - y2) * vx)"


@query("g5_crossing_cells", sql(
    "SELECT DISTINCT position_id, idx FROM (SELECT position_id, idx, p FROM (SELECT *, " + _POINT + " FROM ap JOIN busy USING (position_id), (SELECT range AS p FROM range(256))) "
    f"WHERE least({_point_sql(_SHAFTS[0], 'px', 'py')}, {_point_sql(_SHAFTS[1], 'px', 'py')}) <= width / 2 OR ({_ALONG} >= 0 AND {_ALONG} <= len AND {_OFF} <= {_ALONG} / len * half) "
    "GROUP BY 1, 2, 3 HAVING count(DISTINCT mark_no) > 1)",
    ar="SELECT board_id // 4 AS position_id, board_id AS mark_no, sq1, sq2, bend, width FROM marks WHERE kind = 'arrow'",
    ap=_parts_sql("ar", "position_id, mark_no"), tc=_touch_sql("ap", "position_id, mark_no", "0.0"),
    busy="SELECT position_id, idx FROM tc GROUP BY 1, 2 HAVING count(DISTINCT mark_no) > 1"))
def g5b(t):
    arrows = _arrows(t).select(
        F.floor(F.col("board_id") / 4).alias("position_id"), F.col("board_id").alias("mark_no"), "sq1", "sq2", "bend", "width")
    return G.crossing_cells(arrows, "position_id", "mark_no", "sq1", "sq2", "bend", "width")


@query("g5_exact_crossings")
def g5_exact(t):
    arrows = _arrows(t).select(
        F.floor(F.col("board_id") / 4).alias("position_id"), F.col("board_id").alias("mark_no"), "sq1", "sq2", "bend", "width")
    return G.exact_crossings(arrows, "position_id", "mark_no", "sq1", "sq2", "bend", "width")


_TAGS = ("SELECT board_id, i AS idx, 'clean-control' AS tag FROM boards, idx WHERE conditions = ['clean'] UNION SELECT board_id, sq1, "
         "'arrow-start' FROM marks WHERE kind = 'arrow' UNION SELECT board_id, sq2, 'arrow-tip' FROM marks WHERE kind = 'arrow' UNION "
         "SELECT board_id, unnest([sq1, sq2]), kind FROM marks WHERE kind <> 'arrow'")


@query("g6_cell_tags", sql(
    _TAGS + " UNION SELECT board_id, idx, 'arrow-touch' FROM tc UNION SELECT board_id, idx, 'arrow-with-other-mark' FROM tc SEMI JOIN (SELECT board_id, unnest([sq1, sq2]) AS "
    "idx FROM marks WHERE kind <> 'arrow') USING (board_id, idx)", ar=_AR, ap=_AP, tc=_touch_sql("ap", "board_id, mark_no", "0.0")))
def g6(t):
    return G.cell_tags(t.boards, t.marks, "board_id", F.col("conditions") == F.array(F.lit("clean")), "mark_no", "kind",
                       "sq1", "sq2", "bend", "width")


@query("g6_mark_tags", sql(_TAGS))
def g6b(t):
    return g6(t).where(~F.col("tag").isin("arrow-touch", "arrow-crossing", "arrow-with-other-mark"))


_LAY = [("board-crop-384", 384, 0), ("synthetic-margins-256", 256, 64)]


@query("g7_layout_variants", sql(
    "SELECT board_id, config_id, layout, CAST(s + 2 * mg AS BIGINT) AS image_side, CAST(mg AS BIGINT) AS x, CAST(mg AS BIGINT) AS y, "
    "CAST(s AS BIGINT) AS width, CAST(s AS BIGINT) AS height FROM boards, (VALUES ('board-crop-384', 384, 0), "
    "('synthetic-margins-256', 256, 64)) v(layout, s, mg)"))
def g7(t):
    return G.layout_variants(t.boards, ["board_id"], ["config_id"], _LAY)


_WIDTHS = [0.08, 0.14, 0.22]


_CASES = ["arrow-empty", "arrow-piece", "arrow-crossed", "arrow-combined"]
_NUM = f"CAST(('0x' || substr(sha256('17|' || CAST(board_id AS VARCHAR)), 1, 15)) AS BIGINT)"
_ROUTES = {
    "ro": "SELECT *, abs(sq2 % 8 - sq1 % 8) AS dx, abs(sq2 // 8 - sq1 // 8) AS dy FROM (SELECT a.i AS sq1, b.i AS sq2 FROM idx a, idx b)",
    "rs": "SELECT *, CASE WHEN bend IS NOT NULL THEN 'knight' WHEN dy = 0 THEN 'horizontal' WHEN dx = 0 THEN 'vertical' ELSE 'diagonal' END "
          "AS geometry FROM (SELECT sq1, sq2, dx, dy, unnest(CASE WHEN dx * dy = 2 THEN ['horizontal-first', 'vertical-first'] ELSE [NULL] END) "
          "AS bend, width FROM ro, (SELECT unnest([0.08, 0.14, 0.22]) AS width) WHERE (dx > 0 OR dy > 0) AND (dx = 0 OR dy = 0 OR dx = dy "
          "OR dx * dy = 2))",
    "rp": _parts_sql("rs", "sq1, sq2, geometry"),
    "rt": _touch_sql("rp", "sq1, sq2, geometry, bend, width", "0.0625"),
    "rm": "SELECT *, row_number() OVER (PARTITION BY geometry ORDER BY sq1, sq2, coalesce(bend, ''), width) AS no FROM (SELECT sq1, sq2, "
          "geometry, bend, width, bit_or(1::UBIGINT << CAST(idx AS UBIGINT)) AS touched FROM rt GROUP BY 1, 2, 3, 4, 5)",
    "bo": f"SELECT board_id, ['arrow-empty', 'arrow-piece', 'arrow-crossed', 'arrow-combined'][board_id % 4 + 1] AS \"case\", {_NUM} AS n, m "
          "FROM (SELECT board_id, bit_or(CASE WHEN class_id <> 0 THEN 1::UBIGINT << CAST(idx AS UBIGINT) ELSE 0::UBIGINT END) AS m "
          "FROM cells GROUP BY 1)",
    "bg": "SELECT *, ['horizontal', 'vertical', 'diagonal', 'knight'][n % 4 + 1] AS geometry FROM bo WHERE \"case\" <> 'arrow-crossed'",
    "fit": "SELECT board_id, no, row_number() OVER (PARTITION BY board_id ORDER BY no) AS k, count(*) OVER (PARTITION BY board_id) AS c, n FROM bg "
           "JOIN rm USING (geometry) WHERE ((touched & m) = 0) = (\"case\" = 'arrow-empty')",
    "two": "SELECT board_id, \"case\", a, [0.08, 0.14, 0.22][n // 128 % 3 + 1] AS width, CASE WHEN n // 64 % 2 = 1 THEN CASE a WHEN 1 THEN "
           "y * 8 + x - 2 ELSE (y - 2) * 8 + x END ELSE CASE a WHEN 1 THEN (y - 2) * 8 + x - 2 ELSE (y + 2) * 8 + x - 2 END END AS s1, CASE WHEN "
           "n // 64 % 2 = 1 THEN CASE a WHEN 1 THEN y * 8 + x + 2 ELSE (y + 2) * 8 + x END ELSE CASE a WHEN 1 THEN (y + 2) * 8 + x + 2 ELSE "
           "(y - 2) * 8 + x + 2 END END AS s2 FROM (SELECT *, 2 + n // 4 % 4 AS x, 2 + n // 16 % 4 AS y FROM bo WHERE \"case\" = 'arrow-crossed'), "
           "(SELECT unnest([1, 2]) AS a)",
}
_SIGNED = "CAST(CASE WHEN touched >= 9223372036854775808 THEN CAST(touched AS HUGEINT) - 18446744073709551616 ELSE touched END AS BIGINT)"
_PLAN = (f"SELECT bg.board_id, \"case\", CAST(1 AS INTEGER) AS arrow_no, bg.geometry, sq1 AS start, sq2 AS \"end\", bend, width, {_SIGNED} AS "
         "touched, CASE WHEN f.no IS NULL THEN 'no-route' END AS reason FROM bg LEFT JOIN (SELECT * FROM fit WHERE k = n // 128 % c + 1) f ON "
         "bg.board_id = f.board_id LEFT JOIN rm ON rm.geometry = bg.geometry AND rm.no = f.no UNION ALL SELECT board_id, \"case\", CAST(a AS "
         f"INTEGER), geometry, sq1, sq2, bend, rm.width, {_SIGNED}, CAST(NULL AS VARCHAR) FROM two JOIN rm ON s1 = sq1 AND s2 = sq2 AND rm.width = two.width")


def arrow_plans(t):
    case = F.get(literal_array(_CASES), (F.col("board_id") % 4).cast("int"))
    boards = t.placed("grid").select("board_id", case.alias("case"), G.occupied_mask("grid").alias("mask"))
    return W.arrow_plan(boards, G.route_table(t.spark, _WIDTHS), "board_id", "mask", "case", 17)


@query("w12_arrow_plan", sql(_PLAN, **_ROUTES))
def w12(t):
    return arrow_plans(t)


@query("w12_combined_marks", sql(
    "SELECT board_id, 'last-move' AS kind, start || ',' || \"end\" AS squares FROM pl WHERE \"case\" = 'arrow-combined' AND start IS NOT NULL UNION ALL "
    "SELECT board_id, 'circle', CAST(\"end\" AS VARCHAR) FROM pl WHERE \"case\" = 'arrow-combined' AND start IS NOT NULL", **_ROUTES, pl=_PLAN))
def w12b(t):
    return W.combined_marks(arrow_plans(t), "board_id").withColumn("squares", F.array_join("squares", ","))


@query("w16_training_cells", sql(
    "SELECT board_id, i AS idx FROM boards, idx WHERE conditions = ['clean'] UNION ALL (SELECT board_id, r * 8 + c AS idx FROM (SELECT board_id, "
    "s // 8 + dr AS r, s % 8 + dc AS c FROM (SELECT board_id, kind, unnest([sq1, sq2]) AS s FROM am WHERE kind IS DISTINCT FROM 'arrow'), "
    "(SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) WHERE dr = 0 AND dc = 0 OR coalesce(kind IN ('last-move', 'selection'), "
    "false)) WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 UNION SELECT board_id, idx FROM tc)", am=MARKS_SQL, ar=_AR, ap=_AP,
    tc=_touch_sql("ap", "board_id, mark_no", "0.0625")))
def w16(t):
    boxes = all_marks(t).withColumn("cells", F.array("sq1", "sq2"))
    touched = G.with_touched(_arrows(t), ["board_id"], "sq1", "sq2", "bend", "width")
    return W.training_cells(t.boards, boxes, "board_id", F.col("conditions") == F.array(F.lit("clean")), "kind", "cells", touched)


@query("c18_arrow_coverage", sql(
    "SELECT * FROM (SELECT board_id, count(*) AS touched, count(*) FILTER (o) AS occupied, count(*) FILTER (NOT o) AS empty, CASE WHEN board_id % 2 = 0 THEN 'arrow-piece' ELSE "
    "'arrow-empty' END AS \"case\" FROM (SELECT tc.board_id, class_id <> 0 AS o FROM tc JOIN cells c ON c.board_id = tc.board_id AND c.idx = tc.idx) GROUP BY 1) WHERE CASE WHEN "
    "\"case\" = 'arrow-empty' THEN occupied > 0 ELSE occupied = 0 END", ar=_AR, ap=_AP, tc=_touch_sql("ap", "board_id, mark_no", "0.0625")))
def c18(t):
    """Recorded coverage against recomputed cells: boards whose annotation disagrees."""
    arrows = _arrows(t)
    occupied = t.placed("grid").select("board_id", "grid")
    cells = G.with_touched(arrows, ["board_id"], "sq1", "sq2", "bend", "width").join(occupied, "board_id")
    filled = F.substring("grid", (F.col("idx") + 1).cast("int"), F.lit(1)) != "."
    found = cells.groupBy("board_id").agg(
        F.count("*").alias("touched"), F.count_if(filled).alias("occupied"), F.count_if(~filled).alias("empty"))
    case = F.when(F.col("board_id") % 2 == 0, "arrow-piece").otherwise("arrow-empty")
    wrong = F.when(F.col("case") == "arrow-empty", F.col("occupied") > 0).otherwise(F.col("occupied") == 0)
    return found.withColumn("case", case).where(wrong)


@query("c18_annotation_mismatch", sql(
    "SELECT DISTINCT board_id, 'covered' AS problem FROM tc WHERE board_id % 9 = 0 UNION ALL SELECT DISTINCT board_id, unnest(['occupied', 'empty']) FROM tc WHERE "
    "board_id % 12 = 0 UNION ALL SELECT DISTINCT board_id, unnest(['covered', 'occupied', 'empty']) FROM tc WHERE board_id % 77 = 1 AND board_id % 9 <> 0 AND board_id % 12 <> 0",
    ar=_AR, ap=_AP, tc=_touch_sql("ap", "board_id, mark_no", "0.0625")))
def c18b(t):
    """Lists as recomputed, but for a missing last cell, exchanged halves, and boards without annotation."""
    touched = G.with_touched(_arrows(t), ["board_id"], "sq1", "sq2", "bend", "width").distinct()
    boards = t.placed("grid").select("board_id", "grid")
    filled = F.substring("grid", (F.col("idx") + 1).cast("int"), F.lit(1)) != "."
    made = touched.join(boards, "board_id").groupBy("board_id").agg(*[F.array_sort(F.collect_list(F.when(k, F.col("idx")))).alias(n) for n, k in (
        ("c", F.lit(True)), ("o", filled), ("e", ~filled))])
    b = F.col("board_id")
    swap = b % 12 == 0
    stored = made.select("board_id", F.when(b % 9 == 0, F.slice("c", F.lit(1), F.size("c") - 1)).otherwise(F.col("c")).alias("covered"),
                         F.when(swap, F.col("e")).otherwise(F.col("o")).alias("occupied"), F.when(swap, F.col("o")).otherwise(F.col("e")).alias("empty"))
    stored = stored.where(~((b % 77 == 1) & (b % 9 != 0) & ~swap))
    return G.annotation_mismatch(touched, boards, stored, "board_id", "grid")
