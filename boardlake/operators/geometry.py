"""Rectangles, quadrilaterals, crop requests and arrow footprints (family G).

Everything is row-level arithmetic, but for exact crossings, where each pair of arrow shapes is examined in numpy. Arrow footprints are analytic (distance of the
shaft and head to cell rectangles) and may differ from a rasterised mask by boundary
pixels.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.functions.rules import differs, violations
from boardlake.functions.placement import let, literal_array

ONE = "*"


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def norm(x: Column, y: Column) -> Column:
    """Euclidean length; plain arithmetic is much cheaper than ``hypot`` at board scale."""
    return F.sqrt(x * x + y * y)


def safe_div(a: Column, b: Column) -> Column:
    """Quotient, null for a zero divisor (degenerate shapes have no metric)."""
    return F.try_divide(a, b)


def rectangle_metrics(df: DataFrame, keys: Sequence[str], expected: Sequence[str],
                      actual: Sequence[str]) -> DataFrame:
    """Largest edge error and intersection over union of two (x, y, w, h) boxes."""
    ex, ey, ew, eh = (F.col(c) for c in expected)
    ax, ay, aw, ah = (F.col(c) for c in actual)
    zero = F.lit(0).cast("long")
    iw = F.greatest(zero, F.least(ex + ew, ax + aw) - F.greatest(ex, ax))
    ih = F.greatest(zero, F.least(ey + eh, ay + ah) - F.greatest(ey, ay))
    edge = F.greatest(F.abs(ex - ax), F.abs(ey - ay), F.abs(ex + ew - ax - aw), F.abs(ey + eh - ay - ah))
    inter = iw * ih
    return df.select(*keys, edge.alias("max_edge_error"),
                     (inter / (ew * eh + aw * ah - inter)).alias("iou"))


def corner_array(corners: Sequence[tuple[Column | str, Column | str]]) -> Column:
    return F.array(*[F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))
                     for x, y in corners])


def polygon_area(points: Column) -> Column:
    def shoelace(ps: Column) -> Column:
        n = F.size(ps)
        cross = F.transform(ps, lambda p, i: let(F.get(ps, (i + 1) % n), lambda q: p["x"] * q["y"] - q["x"] * p["y"]))
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2
    return let(points, shoelace)


def clip_convex(subject: Column, clip: Column) -> Column:
    """Vertices of the intersection of two clockwise (image axes) convex polygons."""
    edges = let(clip, lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(
        F.get(c, i).alias("a"), F.get(c, (i + 1) % 4).alias("b"))))

    def side(edge: Column, p: Column) -> Column:
        a, b = edge["a"], edge["b"]
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

    def cut(points: Column, edge: Column) -> Column:
        ahead = F.transform(points, lambda p, i: F.struct(
            p.alias("p"), F.get(points, (i + 1) % F.size(points)).alias("q")))
        signed = F.transform(ahead, lambda v: F.struct(
            v["p"].alias("p"), v["q"].alias("q"), side(edge, v["p"]).alias("sp"), side(edge, v["q"]).alias("sq"),
            safe_div(side(edge, v["p"]), side(edge, v["p"]) - side(edge, v["q"])).alias("t")))
        kept = F.transform(signed, lambda v: F.array_compact(F.array(
            F.when(v["sp"] >= 0, v["p"]),
            F.when((v["sp"] >= 0) != (v["sq"] >= 0), F.struct(
                (v["p"]["x"] + v["t"] * (v["q"]["x"] - v["p"]["x"])).alias("x"),
                (v["p"]["y"] + v["t"] * (v["q"]["y"] - v["p"]["y"])).alias("y"))))))
        return F.flatten(kept)

    return F.aggregate(edges, subject, cut)


def _coefficients(q: Sequence[tuple[Column, Column]]) -> dict[str, Column]:
    """Closed form of the map from the unit square to TL, TR, BR, BL."""
    x, y = [p[0] for p in q], [p[1] for p in q]
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    det = dx1 * dy2 - dx2 * dy1
    g, h = safe_div(sx * dy2 - dx2 * sy, det), safe_div(dx1 * sy - sx * dy1, det)
    return {"a": x[1] - x[0] + g * x[1], "b": x[3] - x[0] + h * x[3], "c": x[0],
            "d": y[1] - y[0] + g * y[1], "e": y[3] - y[0] + h * y[3], "f": y[0], "g": g, "h": h}


def homography(corners: Sequence[tuple[str, str]]) -> Column:
    """Struct of the 8 coefficients for corner columns in TL, TR, BR, BL order."""
    q = [(_c(x).cast("double"), _c(y).cast("double")) for x, y in corners]
    return F.struct(*[v.alias(k) for k, v in _coefficients(q).items()])


def project(m, u: Column, v: Column) -> tuple[Column, Column]:
    w = m["g"] * u + m["h"] * v + 1
    return safe_div(m["a"] * u + m["b"] * v + m["c"], w), safe_div(m["d"] * u + m["e"] * v + m["f"], w)


def quad_errors(df: DataFrame, keys: Sequence[str], expected: Sequence, actual: Sequence,
                carry: dict[str, Column] | None = None) -> DataFrame:
    """Max corner error, mean side and max error over the 9 x 9 grid per quadrilateral.

    ``keys`` identify a row. The grid points are exploded and reduced again with primitive
    maxima, which stays in generated code; one row per quadrilateral is exchanged.
    """
    e, a = ([(_c(x).cast("double"), _c(y).cast("double")) for x, y in q] for q in (expected, actual))
    corner = F.greatest(*[norm(p[0] - q[0], p[1] - q[1]) for p, q in zip(e, a)])
    side = sum((norm(e[i][0] - e[(i + 1) % 4][0], e[i][1] - e[(i + 1) % 4][1]) for i in range(1, 4)),
               norm(e[0][0] - e[1][0], e[0][1] - e[1][1])) / 4
    maps = {f"_{n}{k}": v for n, q in (("e", e), ("a", a)) for k, v in _coefficients(q).items()}
    carry = carry or {}
    rows = df.select(*keys, corner.alias("corner"), side.alias("side"), *[v.alias(k) for k, v in carry.items()],
                     *[v.alias(k) for k, v in maps.items()])
    grid = rows.select("*", F.explode(literal_array(range(81)).cast("array<bigint>")).alias("_k"))
    u, v = (F.col("_k") % 9) / 8, F.floor(F.col("_k") / 9) / 8
    (ex, ey), (ax, ay) = (project({k: F.col(f"_{n}{k}") for k in "abcdefgh"}, u, v) for n in "ea")
    return grid.groupBy(*keys).agg(
        F.max("corner").alias("corner"), F.max("side").alias("side"), F.max(norm(ex - ax, ey - ay)).alias("grid"),
        *[F.max(k).alias(k) for k in carry])


def quad_metrics(df: DataFrame, keys: Sequence[str], expected: Sequence, actual: Sequence,
                 min_iou: float = 0.95, max_corner: float = 0.01, max_grid: float = 0.08) -> DataFrame:
    """IoU, corner and grid errors of a detected quadrilateral, and the policy flag."""
    e, a = corner_array(expected), corner_array(actual)
    iou = let(F.struct(e.alias("e"), a.alias("a")), lambda q: let(
        F.struct(polygon_area(clip_convex(q["a"], q["e"])).alias("i"), polygon_area(q["e"]).alias("e"),
                 polygon_area(q["a"]).alias("a")),
        lambda s: safe_div(s["i"], s["e"] + s["a"] - s["i"])))
    m = quad_errors(df, keys, expected, actual, {"iou": iou})
    out = m.select(
        *keys, F.round("iou", 9).alias("iou"), F.round("corner", 6).alias("max_corner_error"),
        F.round(safe_div(F.col("corner"), F.col("side")), 9).alias("corner_board_fraction"),
        F.round(safe_div(F.col("grid"), F.col("side") / 8), 9).alias("grid_cell_fraction"))
    return out.withColumn("within_policy", F.coalesce(
        (F.col("iou") >= min_iou) & (F.col("corner_board_fraction") <= max_corner)
        & (F.col("grid_cell_fraction") <= max_grid), F.lit(False)))


def quad_shape(df: DataFrame, keys: Sequence[str], corners: Sequence[tuple[str, str]],
               limit: float = 1.2) -> DataFrame:
    """Shortest edge, opposite-edge ratio and geometry band."""
    pts = [(F.col(a), F.col(b)) for a, b in corners]
    edges = [norm(pts[i][0] - pts[(i + 1) % 4][0], pts[i][1] - pts[(i + 1) % 4][1]) for i in range(4)]
    ratio = F.greatest(*[safe_div(edges[a], edges[b]) for a, b in ((0, 2), (2, 0), (1, 3), (3, 1))])
    return df.select(*keys, F.round(F.least(*edges), 6).alias("shortest_edge"),
                     F.round(F.least(*edges) / 8, 6).alias("shortest_edge_per_cell"),
                     F.round(ratio, 9).alias("opposite_edge_ratio"),
                     F.when(ratio < limit, f"opposite-edge-ratio-under-{limit}")
                     .otherwise(f"opposite-edge-ratio-at-least-{limit}").alias("geometry_band"))


def perturb_bounds(df: DataFrame, keys: Sequence[str], box: Sequence[str], image_w: Column,
                   image_h: Column, scenarios: Sequence[tuple[str, Sequence[int]]]) -> DataFrame:
    """Edge-shifted crop requests; those leaving the image are flagged, never clipped."""
    x, y, w, h = (F.col(c) for c in box)
    edges = (x, y, x + w, y + h)
    names = ("left", "top", "right", "bottom")
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), *[
        (e + int(d)).alias(n) for e, d, n in zip(edges, offsets, names)]) for s, offsets in scenarios])
    valid = ((F.col("left") >= 0) & (F.col("left") < F.col("right")) & (F.col("right") <= image_w)
             & (F.col("top") >= 0) & (F.col("top") < F.col("bottom")) & (F.col("bottom") <= image_h))
    return df.select("*", F.inline(rows)).select(*keys, "scenario", *names, valid.alias("valid"))


def layout_variants(df: DataFrame, keys: Sequence[str], carry: Sequence[str],
                    layouts: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Rescaled and margin layouts as geometry rows: (name, board side, margin)."""
    rows = F.array(*[F.struct(
        F.lit(n).alias("layout"), F.lit(s + 2 * m).cast("long").alias("image_side"),
        F.lit(m).cast("long").alias("x"), F.lit(m).cast("long").alias("y"),
        F.lit(s).cast("long").alias("width"), F.lit(s).cast("long").alias("height"))
        for n, s, m in layouts])
    return df.select(*keys, *carry, F.inline(rows))


def _segment_point(seg, px, py) -> Column:
    """Distance of a point to a segment (start, direction, squared length)."""
    ax, ay, dx, dy, length = seg
    t = F.when(length > 0, safe_div((px - ax) * dx + (py - ay) * dy, length)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return norm(px - ax - t * dx, py - ay - t * dy)


def _near_segment(seg, end, left, top, right, bottom, reach) -> Column:
    """Segment meets the rectangle (separating axes), or passes within ``reach`` of it."""
    ax, ay, dx, dy, _ = seg
    bx, by = end
    boxes = (F.greatest(ax, bx) >= left) & (F.least(ax, bx) <= right) \
        & (F.greatest(ay, by) >= top) & (F.least(ay, by) <= bottom)
    sides = [dx * (y - ay) - dy * (x - ax) for x in (left, right) for y in (top, bottom)]
    hits = boxes & (F.greatest(*sides) >= 0) & (F.least(*sides) <= 0)

    def outside(px, py):
        zero = F.lit(0.0)
        return norm(F.greatest(left - px, zero, px - right), F.greatest(top - py, zero, py - bottom))

    near = F.least(outside(ax, ay), outside(bx, by), *[
        _segment_point(seg, x, y) for x in (left, right) for y in (top, bottom)])
    return hits | (near < reach)


def _triangle_hits(pts, left, top, right, bottom) -> Column:
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    hit = ((F.greatest(*xs) >= left) & (F.least(*xs) <= right)
           & (F.greatest(*ys) >= top) & (F.least(*ys) <= bottom))
    for i in range(3):
        (ax, ay), (bx, by), (cx, cy) = pts[i], pts[(i + 1) % 3], pts[(i + 2) % 3]
        def side(x, y):
            return (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        own = side(cx, cy)
        corners = [side(x, y) * F.signum(own) for x in (left, right) for y in (top, bottom)]
        hit = hit & (F.greatest(*corners) >= 0)
    return hit


def _arrow_parts(df: DataFrame, start: str, end: str, bend: str, width: str) -> DataFrame:
    """Adds the shaft vertices, head triangle and stroke width in cell units."""
    def xy(c):
        return (F.col(c) % 8 + 0.5), (F.floor(F.col(c) / 8) + 0.5)
    (x0, y0), (x2, y2) = xy(start), xy(end)
    out = df.withColumns({"_x0": x0, "_y0": y0, "_x2": x2, "_y2": y2, "_w": F.col(width)})
    out = out.withColumns({
        "_x1": F.when(F.col(bend) == "horizontal-first", F.col("_x2")).otherwise(F.col("_x0")),
        "_y1": F.when(F.col(bend) == "horizontal-first", F.col("_y0"))
        .when(F.col(bend) == "vertical-first", F.col("_y2")).otherwise(F.col("_y0"))})
    vx, vy = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    size = norm(vx, vy)
    out = out.withColumns({"_vx": vx / size, "_vy": vy / size,
                           "_len": F.greatest(F.lit(0.30), F.col("_w") * 2.1), "_half": F.col("_w") * 1.5})
    bx, by = F.col("_x2") - F.col("_vx") * F.col("_len"), F.col("_y2") - F.col("_vy") * F.col("_len")
    out = out.withColumns({
        "_tx": bx + F.col("_vx") * F.col("_w") * 0.4, "_ty": by + F.col("_vy") * F.col("_w") * 0.4,
        "_lx": bx - F.col("_vy") * F.col("_half"), "_ly": by + F.col("_vx") * F.col("_half"),
        "_rx": bx + F.col("_vy") * F.col("_half"), "_ry": by - F.col("_vx") * F.col("_half")})
    out = out.withColumns({"_ax": F.col("_x1") - F.col("_x0"), "_ay": F.col("_y1") - F.col("_y0"),
                           "_bx": F.col("_tx") - F.col("_x1"), "_by": F.col("_ty") - F.col("_y1")})
    return out.withColumns({n: F.col(f"_{k}x") * F.col(f"_{k}x") + F.col(f"_{k}y") * F.col(f"_{k}y")
                            for n, k in (("_aq", "a"), ("_bq", "b"))})


_SHAFT = ("_x0", "_y0", "_ax", "_ay", "_aq")
_BEND = ("_x1", "_y1", "_bx", "_by", "_bq")


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def touched_masks(marks: DataFrame, start: str, end: str, bend: str, width: str,
                  halo: float = 4 / 64) -> DataFrame:
    """Distinct arrow shapes with the 64-bit mask of cells met by shaft, bend, head and halo.

    Each shape is tested once against 64 cells; the bits are or-ed as primitives, so only
    one long per shape is exchanged.
    """
    shape = [start, end, bend, width]
    p = _arrow_parts(marks.select(*shape).distinct(), *shape).select(
        "*", F.explode(literal_array(range(64)).cast("array<bigint>")).alias("_i"))
    left, top = F.col("_i") % 8 - halo, F.floor(F.col("_i") / 8) - halo
    rect = (left, top, left + 1 + 2 * halo, top + 1 + 2 * halo)
    reach = F.col("_w") / 2
    hit = (_near_segment(_cols(_SHAFT), _cols(("_x1", "_y1")), *rect, reach)
           | _near_segment(_cols(_BEND), _cols(("_tx", "_ty")), *rect, reach)
           | _triangle_hits([_cols(c) for c in (("_x2", "_y2"), ("_lx", "_ly"), ("_rx", "_ry"))], *rect))
    bit = F.when(hit, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i").cast("int")))
    return p.groupBy(*shape).agg(F.bit_or(bit).alias("touched"))


def touched_cells(marks: DataFrame, start: str, end: str, bend: str, width: str,
                  halo: float = 4 / 64) -> DataFrame:
    """(start, end, bend, width, idx) rows of :func:`touched_masks`."""
    m = touched_masks(marks, start, end, bend, width, halo)
    return m.select(start, end, bend, width, F.explode(mask_cells("touched")).alias("idx"))


def with_touched(marks: DataFrame, keys: Sequence[str], start: str, end: str, bend: str, width: str,
                 halo: float = 4 / 64) -> DataFrame:
    """Touched cells per mark row."""
    t = touched_cells(marks, start, end, bend, width, halo).select(
        F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(bend).alias("_bd"),
        F.col(width).alias("_wd"), "idx")
    on = ((F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e"))
          & F.col(bend).eqNullSafe(F.col("_bd")) & (F.col(width) == F.col("_wd")))
    return marks.join(t, on).select(*keys, "idx")


def route_table(spark: SparkSession, widths: Sequence[float], halo: float = 4 / 64) -> DataFrame:
    """Every legal arrow with the 64-bit mask of its touched cells (fixed size)."""
    from boardlake.operators.joins import arrow_routes
    ends = spark.range(64).withColumnRenamed("id", "end")
    routes = arrow_routes(ends, "end").select(
        "geometry", "start", "end", F.explode(F.when(
            F.col("geometry") == "knight", literal_array(["horizontal-first", "vertical-first"]))
            .otherwise(F.array(F.lit(None).cast("string")))).alias("bend"))
    routes = routes.select("*", F.explode(literal_array(widths)).alias("width"))
    masks = touched_masks(routes, "start", "end", "bend", "width", halo)
    dx = F.abs(F.col("end") % 8 - F.col("start") % 8)
    dy = F.abs(F.floor(F.col("end") / 8) - F.floor(F.col("start") / 8))
    geometry = (F.when(F.col("bend").isNotNull(), "knight").when(dy == 0, "horizontal")
                .when(dx == 0, "vertical").otherwise("diagonal"))
    return masks.withColumn("geometry", geometry)


def occupied_mask(grid: Column | str) -> Column:
    """64-bit mask of occupied cells of a grid."""
    return let(_c(grid), lambda g: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(
            F.when(F.substring(g, i + 1, F.lit(1)) == ".", F.lit(0).cast("long"))
            .otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))


def mask_cells(mask: Column | str) -> Column:
    """Indexes of the set bits, ascending."""
    return F.filter(literal_array(range(64)).cast("array<bigint>"), lambda i: F.call_function(
        "shiftright", _c(mask), i.cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0)


def point_words(marks: DataFrame, start: str, end: str, bend: str, width: str, points: int = 16) -> DataFrame:
    """Distinct arrow shapes and touched cells with the ``points`` x ``points`` bits their stroke covers, and their number.

    Shapes depend on the arrow alone, so their number is bounded by squares, bends and widths, whatever the
    number of boards.
    """
    shape = [start, end, bend, width]
    parts = _arrow_parts(touched_cells(marks, *shape, 0.0), *shape)
    at = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(points * points - 1))).alias("_p"))
    px = F.col("idx") % 8 + (F.col("_p") % points + 0.5) / points
    py = F.floor(F.col("idx") / 8) + (F.floor(F.col("_p") / points) + 0.5) / points
    shaft = F.least(_segment_point(_cols(_SHAFT), px, py), _segment_point(_cols(_BEND), px, py)) <= F.col("_w") / 2
    along = (F.col("_x2") - px) * F.col("_vx") + (F.col("_y2") - py) * F.col("_vy")
    off = F.abs((px - F.col("_x2")) * F.col("_vy") - (py - F.col("_y2")) * F.col("_vx"))
    head = (along >= 0) & (along <= F.col("_len")) & (off <= along / F.col("_len") * F.col("_half"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_p") % 64).cast("int"))
    # A projected column, not a filter: shared terms of the distances are evaluated once.
    inside = at.select(*shape, "idx", F.floor(F.col("_p") / 64).alias("_word"), F.when(shaft | head, bit).alias("_bit"))
    return inside.groupBy(*shape, "idx").agg(F.count("_bit").alias("_n"), *[
        F.bit_or(F.when(F.col("_word") == w, F.col("_bit"))).alias(f"_w{w}") for w in range((points * points + 63) // 64)])


def crossing_cells(marks: DataFrame, board: str, mark: str, start: str, end: str, bend: str,
                   width: str, points: int = 16) -> DataFrame:
    """Cells where the strokes of two arrows of a board overlap.

    The points that a stroke covers in a cell are looked up by its shape as a few words. A point is
    covered once per arrow, so two strokes overlap where more points were covered than differ: one
    count and a few or-ed words per cell, combined before the exchange. ``mark`` is unique within its board.
    """
    words = [f"_w{w}" for w in range((points * points + 63) // 64)]
    t = point_words(marks, start, end, bend, width, points).select(
        F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(bend).alias("_bd"), F.col(width).alias("_wd"), "idx", "_n", *words)
    on = ((F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e"))
          & F.col(bend).eqNullSafe(F.col("_bd")) & (F.col(width) == F.col("_wd")))
    covered = marks.join(t, on).groupBy(board, "idx").agg(
        F.sum("_n").alias("_n"), *[F.bit_or(w).alias(w) for w in words])
    distinct = sum((F.coalesce(F.bit_count(w), F.lit(0)) for w in words), F.lit(0))
    return covered.where(F.col("_n") > distinct).select(board, "idx")


FINEST = 12  # halvings of a square; strokes whose common part holds a disc of two such steps are found


def _stroke(start: int, end: int, bend: str | None, width: float) -> list[tuple]:
    """Convex parts of an arrow as :func:`_arrow_parts` has them: two shafts with round ends (a, b, radius) and the head."""
    p, q = (np.array([k % 8 + 0.5, k // 8 + 0.5]) for k in (start, end))
    corner = np.array([q[0], p[1]]) if bend == "horizontal-first" else np.array([p[0], q[1]]) if bend == "vertical-first" else p
    v = (q - corner) / np.linalg.norm(q - corner)
    length, half, side = max(0.30, width * 2.1), width * 1.5, np.array([-v[1], v[0]])
    base = q - v * length
    return [("shaft", p, corner, width / 2), ("shaft", corner, base + v * width * 0.4, width / 2),
            ("head", q, base + side * half, base - side * half)]


def _outside(part: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance to a part, negative inside; it never changes faster than the place."""
    if part[0] == "shaft":
        _, a, b, radius = part
        d = b - a
        t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(d @ d, 1e-300), 0, 1)
        return np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]) - radius
    corners = part[1:]
    turn = np.sign(np.cross(np.append(corners[1] - corners[0], 0), np.append(corners[2] - corners[0], 0))[2])
    out = None
    for k in range(3):
        a, b = corners[k], corners[(k + 1) % 3]
        d = (b - a) / np.linalg.norm(b - a)
        s = turn * (d[1] * (x - a[0]) - d[0] * (y - a[1]))
        out = s if out is None else np.maximum(out, s)
    return out


def overlap_mask(first: tuple, second: tuple) -> int:
    """64-bit mask of the squares in which two arrows (start, end, bend, width) overlap.

    Two parts overlap in a square where the larger of their distances is negative somewhere. Distances change no faster than
    the place, so a square whose centre is farther out than its half diagonal is settled; the others are quartered.
    """
    mask = 0
    for a in _stroke(*first):
        for b in _stroke(*second):
            cell = np.array([k for k in range(64) if not mask >> k & 1])
            x, y, half = cell % 8 + 0.5, cell // 8 + 0.5, 0.5
            for _ in range(FINEST):
                far = np.maximum(_outside(a, x, y), _outside(b, x, y))
                hit = np.unique(cell[far < 0])
                for k in hit.tolist():
                    mask |= 1 << k
                keep = (far < half * 1.4142135623730951) & ~np.isin(cell, hit)
                if not keep.any():
                    break
                cell, x, y, half = np.repeat(cell[keep], 4), np.repeat(x[keep], 4), np.repeat(y[keep], 4), half / 2
                x, y = x + np.tile([-half, half, -half, half], len(x) // 4), y + np.tile([-half, -half, half, half], len(y) // 4)
    return mask - (1 << 64) if mask >> 63 else mask


def exact_crossings(marks: DataFrame, board: str, mark: str, start: str, end: str, bend: str, width: str) -> DataFrame:
    """Squares where the strokes of two arrows of a board overlap, however thin: no points are sampled.

    Each pair of different shapes is examined once, whatever the number of boards that have it; a shape that a board has twice
    overlaps itself where it lies. A board holds a few arrows, so its pairs of shapes are few. ``mark`` is unique within
    its board.
    """
    shape = [start, end, bend, width]
    own = marks.groupBy(board, *shape).agg(F.count(mark).alias("_n"))
    name = F.to_json(F.struct(*[F.col(c) for c in shape]), {"ignoreNullFields": "false"})
    named = own.select(board, "_n", name.alias("_a"))
    lists = named.groupBy(board).agg(F.array_sort(F.collect_list("_a")).alias("_all"), F.collect_list(
        F.when(F.col("_n") > 1, F.col("_a"))).alias("_twice"))
    pairs = lists.select(board, F.explode(F.concat(
        F.flatten(F.transform("_all", lambda a: F.transform(F.filter("_all", lambda b: b > a), lambda b: F.struct(
            a.alias("_a"), b.alias("_b"))))), F.transform("_twice", lambda a: F.struct(a.alias("_a"), a.alias("_b"))))).alias("_p")).select(
        board, "_p._a", "_p._b")

    def examine(batches):
        for pdf in batches:
            shapes = [[tuple(json.loads(v)[c] for c in shape) for v in pdf[side]] for side in ("_a", "_b")]
            yield pdf.assign(_mask=[overlap_mask(x, y) for x, y in zip(*shapes)])

    masks = pairs.select("_a", "_b").distinct().mapInPandas(examine, "_a string, _b string, _mask long")
    found = pairs.join(masks, ["_a", "_b"]).groupBy(board).agg(F.bit_or("_mask").alias("_m"))
    return found.select(board, F.explode(mask_cells("_m")).alias("idx"))


def annotation_mismatch(touched: DataFrame, boards: DataFrame, annotated: DataFrame, board: str, grid: str) -> DataFrame:
    """(board, problem): stored index lists of arrow coverage that the recomputed cells do not bear out.

    ``touched`` has (board, idx) rows of all arrows of a board, ``annotated`` the lists ``covered``, ``occupied`` and ``empty``. A
    list holds at most a board's 64 cells; a board without annotation, or without arrows, breaks all three.
    """
    cells = touched.select(board, "idx").distinct().join(boards.select(board, grid), board)
    filled = F.substring(grid, (F.col("idx") + 1).cast("int"), F.lit(1)) != "."
    lists = cells.groupBy(board).agg(*[F.array_sort(F.collect_list(F.when(keep, F.col("idx")))).alias(f"_{name}") for name, keep in (
        ("covered", F.lit(True)), ("occupied", filled), ("empty", ~filled))])
    j = annotated.join(lists, board, "full")
    return violations(j, [board], {n: differs(n, f"_{n}") for n in ("covered", "occupied", "empty")})


def cell_tags(boards: DataFrame, marks: DataFrame, board: str, is_clean: Column, mark: str, kind: str,
              a: str, b: str, bend: str, width: str) -> DataFrame:
    """(board, idx, tag) rows: clean control, marks, arrow touch/start/tip/crossing, combinations."""
    clean = boards.where(is_clean).select(
        board, F.explode(literal_array(range(64)).cast("array<bigint>")).alias("idx"),
        F.lit("clean-control").alias("tag"))
    arrows = marks.where(F.col(kind) == "arrow")
    touch = with_touched(arrows, [board], a, b, bend, width, 0.0).withColumn("tag", F.lit("arrow-touch"))
    ends = arrows.select(board, F.inline(F.array(
        F.struct(F.col(a).alias("idx"), F.lit("arrow-start").alias("tag")),
        F.struct(F.col(b).alias("idx"), F.lit("arrow-tip").alias("tag")))))
    others = marks.where(F.col(kind) != "arrow").select(
        board, F.explode(F.array(a, b)).alias("idx"), F.col(kind).alias("tag"))
    cross = exact_crossings(arrows, board, mark, a, b, bend, width).withColumn("tag", F.lit("arrow-crossing"))
    both = (touch.select(board, "idx").join(others.select(board, "idx").distinct(), [board, "idx"], "left_semi")
            .withColumn("tag", F.lit("arrow-with-other-mark")))
    rows = clean
    for part in (touch, ends, others, cross, both):
        rows = rows.unionByName(part.select(board, "idx", "tag"))
    return rows.distinct()
