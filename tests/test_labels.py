from conftest import values
from pyspark.sql import functions as F

from boardlake.functions import placement as P
from boardlake.operators import labels as B

# Fixed value: the start position.
START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"
EMPTY = "8/8/8/8/8/8/8/8"
ODD = "8/8/8/8/8/8/8/R6k"


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()[0]


def test_known_placements_round_trip(spark):
    for text in (START, EMPTY, ODD, "p7/1p6/2p5/3p4/4p3/5p2/6p1/7p"):
        grid = one(spark, P.placement_grid(F.lit(text)))
        assert len(grid) == 64
        assert one(spark, P.encode_grid(F.lit(grid))) == text


def test_invalid_placements(spark):
    for text in ("k7/8", "1k6/8/8/8/8/8/8/8/R7", "k34/8/8/8/8/8/8/8", "k8/8/8/8/8/8/8/8", "k5/8/8/8/8/8/8/8",
                 "k6c/8/8/8/8/8/8/8", " k7/8/8/8/8/8/8/8", "", "k......./8/8/8/8/8/8/8", "k7/8/8/8/8/8/8/0"):
        assert one(spark, P.is_canonical(F.lit(text))) is False, text
    assert one(spark, P.is_canonical(F.lit(None).cast("string"))) is False
    assert one(spark, P.encode_grid(F.lit("." * 63))) is None
    assert one(spark, P.encode_grid(F.lit("z" + "." * 63))) is None


def test_encode_cells_needs_every_cell(spark):
    rows = [(1, i, 0) for i in range(64)] + [(2, i, 0) for i in range(63)] + [(3, i if i else 1, 0) for i in range(64)] \
        + [(4, i, 13 if i == 5 else 0) for i in range(64)]
    df = spark.createDataFrame(rows, "b long, idx long, class_id long")
    assert dict(values(B.encode_cells(df, "b"))) == {1: EMPTY, 2: None, 3: None, 4: None}


def test_square_names_and_labels(spark):
    df = spark.createDataFrame([(1, START, "white-bottom"), (2, START, "black-bottom")], "b long, p string, o string")
    rows = {(r.b, r.square): r for r in B.square_labels(df, ["b"], "p", "o").collect()}
    assert len(rows) == 128
    assert (rows[1, "a8"].label, rows[1, "a8"].background, rows[1, "a8"].image_row) == ("r", "light", 0)
    assert (rows[2, "a8"].image_row, rows[2, "a8"].image_column) == (7, 7)
    assert (rows[1, "e1"].label, rows[1, "e1"].class_id, rows[1, "e1"].idx) == ("K", 6, 60)


def test_family_is_shared_by_all_sixteen_forms(spark):
    # Hand-written: one piece of each kind, seen from the eight sides of the board.
    sides = ["nK6/8/8/8/8/8/8/8", "6Kn/8/8/8/8/8/8/8", "8/8/8/8/8/8/8/nK6", "8/8/8/8/8/8/8/6Kn",
             "n7/K7/8/8/8/8/8/8", "7n/7K/8/8/8/8/8/8", "8/8/8/8/8/8/K7/n7", "8/8/8/8/8/8/7K/7n"]
    swap = {"n": "N", "K": "k"}
    sides += ["".join(swap.get(c, c) for c in s) for s in sides]
    grid = one(spark, P.placement_grid(F.lit(sides[0])))
    forms = {one(spark, P.placement_grid(F.lit(s))) for s in sides}
    assert len(forms) == 16
    df = spark.createDataFrame([(f,) for f in forms], "g string").select(P.family_key("g").alias("k"))
    assert {r.k for r in df.collect()} == {min(forms)}
    other = "." + grid[0] + "." + grid[1] + grid[4:]
    assert one(spark, P.family_key(F.lit(other))) != min(forms)


def test_half_even_bounds(spark):
    df = spark.createDataFrame([(1, 94.5, 147.875, 520.0, 520.0)], "i long, x double, y double, w double, h double")
    r = B.raster_bounds(df, ["i"], "x", "y", "w", "h").first()
    assert (r.left, r.top, r.right, r.bottom) == (94, 148, 614, 668)


def test_error_text(spark):
    g = one(spark, P.placement_grid(F.lit(START)))
    bad = "." + g[1:]
    assert one(spark, B.error_text(F.lit(g), F.lit(bad))) == "a8:r->empty"
    assert one(spark, B.error_text(F.lit(g), F.lit(g))) == "OK"
    assert one(spark, B.error_text(F.lit(g), F.lit(None).cast("string"))) == "NOT_DETECTED"


def test_payload_audit(spark):
    bodies = ['{"piecePlacement":"%s"}' % START, '{"piecePlacement":"8"}', '{"error":{"code":"INVALID_IMAGE","message":"x"}}',
              '{"error":{"code":"INVALID_IMAGE","message":""}}', '{"error":{"code":"NOPE","message":"x"}}',
              '{"piecePlacement":"%s","error":null}' % START, '{"piecePlacement":5}', "[]", "null", "x"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {r.i: r.status for r in B.audit_payloads(df, ["i"], "body").collect()}
    assert got == {0: 200, 1: None, 2: 422, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None, 9: None}


def test_unknown_sources_never_match(spark):
    df = spark.createDataFrame([(1, None, "site", None), (2, None, "other", "7"), (3, "v", "x", None), (4, "", "site", "9")],
                               "i int, v string, p string, g string")
    keys = dict(values(df.select("i", B.source_key("v", "p", "g", ["site"]))))
    assert keys == {1: None, 2: None, 3: "video:v", 4: "site:9"}
