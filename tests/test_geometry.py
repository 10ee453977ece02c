import numpy as np
from pyspark.sql import functions as F

from boardlake.operators import features as X
from boardlake.operators import geometry as G


def raster(start, end, bend, width, grow):
    """Cells whose pixel centres (512 px board) lie in the arrow, dilated by a square of ``grow`` px."""
    def c(s):
        return np.array([s % 8 + 0.5, s // 8 + 0.5]) * 64
    a, z = c(start), c(end)
    mid = None if bend is None else np.array([z[0], a[1]]) if bend == "horizontal-first" else np.array([a[0], z[1]])
    v = [a, z] if mid is None else [a, mid, z]
    yy, xx = np.mgrid[0:512, 0:512] + 0.5
    w = width * 64
    d = (v[-1] - v[-2]) / np.linalg.norm(v[-1] - v[-2])
    length, half = max(0.30, width * 2.1) * 64, width * 1.5 * 64
    tail = v[-1] - d * length + d * w * 0.4
    def seg(p, q):
        t = np.clip(((xx - p[0]) * (q - p)[0] + (yy - p[1]) * (q - p)[1]) / max(((q - p) ** 2).sum(), 1e-12), 0, 1)
        return np.hypot(xx - p[0] - t * (q - p)[0], yy - p[1] - t * (q - p)[1])
    inside = np.zeros((512, 512), bool)
    pts = [*v[:-1], tail]
    for p, q in zip(pts, pts[1:]):
        inside |= seg(p, q) <= w / 2
    along = (v[-1][0] - xx) * d[0] + (v[-1][1] - yy) * d[1]
    off = np.abs((xx - v[-1][0]) * d[1] - (yy - v[-1][1]) * d[0])
    inside |= (along >= 0) & (along <= length) & (off <= along / length * half)
    if grow:
        ys, xs = np.nonzero(inside)
        out = np.zeros_like(inside)
        for dy in range(-grow, grow + 1):
            for dx in range(-grow, grow + 1):
                out[np.clip(ys + dy, 0, 511), np.clip(xs + dx, 0, 511)] = True
        inside = out
    return set(np.flatnonzero(inside.reshape(8, 64, 8, 64).any(axis=(1, 3))).tolist())


def test_touched_cells_bracket_the_raster(spark):
    shapes = [(0, 7, None, 0.08), (56, 0, None, 0.22), (0, 63, None, 0.14), (63, 9, None, 0.22), (27, 44, "horizontal-first", 0.14),
              (27, 44, "vertical-first", 0.08), (10, 4, "horizontal-first", 0.22), (35, 36, None, 0.22), (7, 56, None, 0.08)]
    df = spark.createDataFrame(shapes, "s long, e long, b string, w double")
    got = {}
    for r in G.touched_cells(df, "s", "e", "b", "w").collect():
        got.setdefault((r.s, r.e, r.b, r.w), set()).add(r.idx)
    for shape in shapes:
        assert raster(*shape, 3) <= got[shape] <= raster(*shape, 6), shape


def test_crossing_cells(spark):
    rows = [(1, 1, 32, 39, None, 0.14), (1, 2, 4, 60, None, 0.14), (2, 1, 0, 7, None, 0.08), (2, 2, 56, 63, None, 0.08)]
    df = spark.createDataFrame(rows, "b long, m long, s long, e long, bend string, w double")
    assert {(r.b, r.idx) for r in G.crossing_cells(df, "b", "m", "s", "e", "bend", "w").collect()} == {(1, 36)}


def cells_of(mask):
    return {k for k in range(64) if mask >> k & 1}


def sampled(first, second, n):
    """Squares with a common point on an n x n grid of each square, by the definition of a stroke."""
    at = (np.arange(8 * n) + 0.5) / n
    x, y = np.meshgrid(at, at)

    def covered(s, e, bend, w):
        p, q = (np.array([k % 8 + 0.5, k // 8 + 0.5]) for k in (s, e))
        c = np.array([q[0], p[1]]) if bend == "horizontal-first" else np.array([p[0], q[1]]) if bend == "vertical-first" else p
        v = (q - c) / np.hypot(*(q - c))
        length = max(0.3, 2.1 * w)
        tail = q - v * length + v * w * 0.4

        def near(a, b):
            d = b - a
            t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(d @ d, 1e-30), 0, 1)
            return np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]) < w / 2

        along = (q[0] - x) * v[0] + (q[1] - y) * v[1]
        off = np.abs((x - q[0]) * v[1] - (y - q[1]) * v[0])
        return near(p, c) | near(c, tail) | ((along > 0) & (along < length) & (off < along / length * 1.5 * w))

    both = covered(*first) & covered(*second)
    return {r * 8 + f for r in range(8) for f in range(8) if both[r * n:(r + 1) * n, f * n:(f + 1) * n].any()}


def test_exact_crossings_find_what_points_miss():
    """Nothing that any grid finds is missing, everything found is confirmed by a finer grid, and thin overlaps are found."""
    rng, thin, shapes = np.random.default_rng(7), 0, []
    while len(shapes) < 60:
        s, e = (int(k) for k in rng.integers(0, 64, 2))
        dx, dy = abs(s % 8 - e % 8), abs(s // 8 - e // 8)
        w = float(rng.choice([0.08, 0.14, 0.22]))
        if dx * dy == 2:
            shapes.append((s, e, str(rng.choice(["horizontal-first", "vertical-first"])), w))
        elif s != e and (dx == 0 or dy == 0 or dx == dy):
            shapes.append((s, e, None, w))
    for a, b in zip(shapes[::2], shapes[1::2]):
        exact = cells_of(G.overlap_mask(a, b))
        assert exact == cells_of(G.overlap_mask(b, a)) and sampled(a, b, 16) <= exact and sampled(a, b, 40) <= exact
        missed = exact - sampled(a, b, 16)
        thin += len(missed)
        assert not missed or missed <= sampled(a, b, 300), (a, b)
    corner = (0, 2, None, 0.08), (2, 18, None, 0.08)  # both reach the middle of square 2
    assert 2 in cells_of(G.overlap_mask(*corner))
    lanes = (0, 7, None, 0.22), (8, 15, None, 0.22)
    assert G.overlap_mask(*lanes) == 0
    # The heads of both arrows end on a common border of squares, a sixtieth of a square deep.
    a, b = (8, 10, None, 0.22), (3, 24, None, 0.22)
    assert thin > 0 and cells_of(G.overlap_mask(a, b)) == sampled(a, b, 300)


def test_exact_crossings_of_boards(spark):
    rows = [(1, 1, 32, 39, None, 0.14), (1, 2, 4, 60, None, 0.14), (2, 1, 0, 7, None, 0.08), (2, 2, 56, 63, None, 0.08), (3, 1, 0, 2, None, 0.08),
            (3, 2, 0, 2, None, 0.08), (4, 1, 32, 39, None, 0.14), (5, 1, 32, 39, None, 0.14), (5, 2, 4, 60, None, 0.14), (5, 3, 56, 7, None, 0.08)]
    df = spark.createDataFrame(rows, "b long, m long, s long, e long, bend string, w double")
    got = {}
    for r in G.exact_crossings(df, "b", "m", "s", "e", "bend", "w").collect():
        got.setdefault(r.b, []).append(r.idx)
    got = {b: sorted(v) for b, v in got.items()}
    assert got[1] == [36] and 2 not in got and 4 not in got and {0, 1, 2} <= set(got[3]) and got[5] == [28, 35, 36]


def test_route_table_counts(spark):
    t = G.route_table(spark, [0.08])
    n = {r.geometry: r["count"] for r in t.groupBy("geometry").count().collect()}
    assert n == {"horizontal": 448, "vertical": 448, "diagonal": 560, "knight": 672}


def quad(*p):
    return [(F.lit(float(x)), F.lit(float(y))) for x, y in p]


def test_quad_metrics(spark):
    square = [(0, 0), (100, 0), (100, 100), (0, 100)]
    df = spark.range(1)
    same = G.quad_metrics(df, ["id"], quad(*square), quad(*square)).first()
    assert same.iou == 1.0 and same.max_corner_error == 0 and same.within_policy is True
    moved = G.quad_metrics(df, ["id"], quad(*square), quad(*[(x + 10, y) for x, y in square])).first()
    assert abs(moved.iou - 0.9 / 1.1) < 1e-8 and moved.corner_board_fraction == 0.1
    assert abs(moved.grid_cell_fraction - 0.8) < 1e-8 and moved.within_policy is False
    a, b = [(3, 5), (95, 0), (104, 99), (-4, 92)], [(0, 0), (99, 3), (96, 103), (2, 96)]
    got = G.quad_metrics(df, ["id"], quad(*a), quad(*b)).first()
    yy, xx = np.mgrid[-10:110:0.25, -10:110:0.25]
    def inside(q):
        ok = np.ones_like(xx, bool)
        for (x1, y1), (x2, y2) in zip(q, q[1:] + q[:1]):
            ok &= (x2 - x1) * (yy - y1) - (y2 - y1) * (xx - x1) >= 0
        return ok
    ia, ib = inside(a), inside(b)
    assert abs(got.iou - (ia & ib).sum() / (ia | ib).sum()) < 2e-3
    hs = [solve(q) for q in (a, b)]
    errors = []
    for v in np.linspace(0, 1, 9):
        for u in np.linspace(0, 1, 9):
            p, q = (h @ [u, v, 1] for h in hs)
            errors.append(np.hypot(*(p[:2] / p[2] - q[:2] / q[2])))
    side = np.mean([np.hypot(*np.subtract(a[i], a[(i + 1) % 4])) for i in range(4)])
    assert abs(got.grid_cell_fraction - max(errors) / (side / 8)) < 1e-6


def solve(q):
    rows, rhs = [], []
    for (u, v), (x, y) in zip([(0, 0), (1, 0), (1, 1), (0, 1)], q):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        rhs += [x, y]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1).reshape(3, 3)


def test_rectified_pixels_are_bilinear(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (20, 24))
    q = [(3.0, 2.0), (21.0, 3.5), (20.0, 17.0), (2.5, 18.0)]
    cols = [(f"x{i}", f"y{i}") for i in range(4)]
    flat = [int(v) for v in img.ravel()]
    corners = [c for p in q for c in p]
    boards = spark.createDataFrame([(1, flat, 24, *corners), (2, None, 24, *corners), (3, flat, 24, None, *corners[1:]), (4, flat, 24, *[5.0] * 8)],
                                   "b long, px array<long>, w int, " + ", ".join(f"{a} double, {b} double" for a, b in cols))
    out = {r.b: r.rectified for r in X.rectify_pixels(boards, "b", "px", "w", cols, 6).collect()}
    assert out[2] == out[3] == out[4] == [None] * 36
    got = {(t % 6, t // 6): v for t, v in enumerate(out[1])}
    h = solve(q)
    assert len(got) == 36
    for ty in range(6):
        for tx in range(6):
            p = h @ [(tx + 0.5) / 6, (ty + 0.5) / 6, 1]
            x, y = p[0] / p[2] - 0.5, p[1] / p[2] - 0.5
            x0, y0 = int(np.floor(x)), int(np.floor(y))
            fx, fy = x - x0, y - y0
            want = sum(w * img[y0 + dy, x0 + dx] for dx, dy, w in (
                (0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)))
            assert abs(got[tx, ty] - want) < 1e-4


def test_shifted_templates(spark):
    rng = np.random.default_rng(3)
    bank = rng.random((3, 8, 8))
    cells = [np.roll(bank[i % 3], (i % 2, -(i % 2)), axis=(0, 1)) + rng.random((8, 8)) * 0.01 for i in range(9)]
    t = spark.createDataFrame([(i, f"L{i}", b.ravel().tolist()) for i, b in enumerate(bank)], "no long, lab string, f array<double>")
    c = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(cells)], "id long, f array<double>")
    shifts = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = {r.id: r.label for r in X.nearest_template(c, t, "id", "f", "no", "lab", block=2, shape=(8, 8), shifts=shifts, margin=2).collect()}
    assert got == {i: f"L{i % 3}" for i in range(9)}


def test_template_ties_take_the_first(spark):
    t = spark.createDataFrame([(5, "b", [0.0, 0.0]), (2, "a", [0.0, 0.0]), (9, "c", [1.0, 1.0])], "no long, lab string, f array<double>")
    c = spark.createDataFrame([(1, [0.0, 0.1])], "id long, f array<double>")
    for block in (1, 10):
        assert X.nearest_template(c, t, "id", "f", "no", "lab", block=block).first().template_no == 2


def test_orientation_votes(spark):
    rows = [(1, "a", "black-bottom")] * 4 + [(2, "a", "black-bottom")] * 3 + [(3, "a", "black-bottom")] * 5 + [(3, "a", "white-bottom")] \
        + [(4, "a", "black-bottom")] * 5 + [(4, "a", "contradiction")] + [(5, "a", None)] * 6
    df = spark.createDataFrame(rows, "b int, l string, d string")
    got = {r.b: r.orientation for r in X.orientation_vote(df, "b", "d").collect()}
    assert got == {1: "black-bottom", 2: "white-bottom", 3: "white-bottom", 4: "white-bottom", 5: "white-bottom"}
    two = {r.b: r.orientation for r in X.orientation_vote_layouts(df, "b", "l", "d").collect()}
    assert two == got
