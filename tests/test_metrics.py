import numpy as np
from conftest import values
from pyspark.sql import functions as F

from boardlake.plans import QUERIES
from boardlake.operators import compare as P
from boardlake.operators import gates as Q
from boardlake.operators import metrics as M


def test_class_metrics_with_failures_and_absent_classes(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, -1), (2, 2), (0, 0)], "e long, p long")
    m = {r.class_id: r for r in M.class_metrics(df, "e", "p").collect()}
    assert len(m) == 13
    assert (m[1].total, m[1].correct, m[1].predicted, m[1].precision) == (3, 1, 1, 1.0)
    assert (m[2].precision, m[2].recall) == (0.5, 1.0)
    assert (m[5].recall, m[5].precision, m[5].f1) == (None, None, None)
    assert abs(M.macro_recall(df, "e", "p").first()[0] - (1 / 3 + 1 + 1) / 3) < 1e-9
    c = {r.expected: r for r in M.confusion(df, "e", "p").collect()}
    assert (c[1].p_1, c[1].p_2, c[1].p_error) == (1, 1, 1)


def test_exact_positions_need_all_variants(spark):
    rows = [(b, b // 2, 1, 1 if b != 3 else 2) for b in range(4) for _ in range(2)]
    df = spark.createDataFrame(rows, "b long, pos long, e long, p long")
    r = M.exact_rates(df, "e", "p", "b", "pos").first()
    assert (r.images, r.positions, r.exact_boards, r.exact_positions) == (4, 2, 3, 1)


def test_quantiles_match_numpy_with_one_hot_value(spark):
    rng = np.random.default_rng(2)
    data = [("a", float(v)) for v in rng.gamma(2, 3, 501)] + [("b", 7.0)] * 400 + [("b", 9.0)] * 3 + [("c", 1.5)]
    df = spark.createDataFrame(data, "k string, v double")
    for rows in (1, 50, 20_000):
        for r in M.latency_by_rank(df, "v", ["k"], rows).collect():
            x = [v for k, v in data if k == r.k]
            assert r.samples == len(x)
            assert abs(r.median_ms - np.percentile(x, 50) * 1000) < 1e-5
            assert abs(r.p95_ms - np.percentile(x, 95) * 1000) < 1e-5


def test_quantile_bands_are_even_for_a_heavy_tail(spark):
    """Values over fifteen orders of magnitude, a hot group, nulls: no band holds many rows and results are exact."""
    from boardlake.functions.hashing import value_bucket
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(0, 12, 20_000))
    data = [("hot" if k % 3 else f"g{k % 7}", float(v)) for k, v in enumerate(x)] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    sizes = [r["count"] for r in df.where("v IS NOT NULL").groupBy(value_bucket(df, "v", 200)).count().collect()]
    assert len(sizes) > 80 and max(sizes) < 600
    got = {r.k: r for r in M.quantiles_by_rank(df, "v", ["k"], 200).collect()}
    for k in {k for k, v in data if v is not None}:
        own = [v for g, v in data if g == k and v is not None]
        assert got[k].samples == len(own)
        assert np.allclose([got[k].q50, got[k].q95], [np.percentile(own, 50), np.percentile(own, 95)], rtol=1e-12)
    assert "none" not in got


def test_zero_count_weight_is_null(spark):
    df = spark.createDataFrame([(0, 30), (1, 10), (2, 0)], "c long, squares long")
    w = dict(values(M.class_weights(df, ["c"]), "c", "weight"))
    assert abs(w[0] - 40 / 90) < 1e-9 and w[2] is None


def test_a_lost_control_is_not_hidden_by_gains(spark):
    rows = []
    for b in range(6):
        for i in range(4):
            base = 1 if b < 2 else 2
            cand = 2 if b == 0 and i == 0 else 1
            rows.append((b, i, "d", "x" if b else "control", 1, base, cand))
    df = spark.createDataFrame(rows, "b long, idx long, dom string, cat string, e long, p long, c long")
    boards = P.paired_boards(df, "e", "p", "c", ["b", "dom", "cat"])
    rows = {r.dom: r for r in Q.safety_gate(df, boards, "dom", ["cat"], "e", "p", "c", ["d", "absent"]).collect()}
    assert rows["absent"].safe is False and rows["absent"].reasons == "missing domain"
    g = rows["d"]
    assert g.gained_boards == 4 and g.lost_boards == 1 and g.safe is False and g.worse_strata == 1
    assert "lost baseline-correct boards" in g.reasons and "worsened strata" in g.reasons
    assert P.paired_changes(boards, "b").where("outcome = 'lost'").first().b == 0


def test_gates_fail_closed(spark):
    gates = spark.createDataFrame([("a", 0.5, ">="), ("nan", 0.5, ">="), ("none", 0.5, "<="), ("absent", 0.5, "<="), ("inf", 1.0, ">=")],
                                  "name string, threshold double, comparison string")
    m = spark.createDataFrame([("a", 0.7), ("nan", float("nan")), ("none", None), ("inf", float("inf"))], "name string, actual double")
    got = dict(values(Q.apply_gates(m, gates), "name", "passed"))
    assert got == {"a": True, "nan": False, "none": False, "absent": False, "inf": False}
    assert Q.verdict(Q.apply_gates(m, gates)).first().ready is False


def test_failure_stages(spark):
    g, bad = "." * 64, "P" + "." * 63
    df = spark.createDataFrame([(1, g, g, None), (2, g, g, bad), (3, g, bad, bad), (4, g, bad, g), (5, g, g, g)],
                               "i int, e string, m string, a string")
    got = {r.i: (r.stage, r.automatic_errors, r.recovered_squares, r.introduced_squares, r.persistent_squares)
           for r in P.stage_failures(df, ["i"], "e", "m", "a").collect()}
    assert got == {1: ("detection-failed", None, "", "", ""), 2: ("crop-sensitive-failure", 1, "", "a8", ""),
                   3: ("classification-fails-with-both-geometries", 1, "", "", "a8"),
                   4: ("automatic-crop-recovers-position", 0, "a8", "", ""), 5: ("both-correct", 0, "", "", "")}
    assert P.stage_summary(P.stage_failures(df, ["i"], "e", "m", "a")).where("stage = 'detection-failed'").first().automatic_errors is None


def test_cell_changes(spark):
    df = spark.createDataFrame([(0, 1, 1, 2), (1, 1, 2, 1), (2, 1, 2, 3), (3, 1, 1, 1)], "idx long, e long, a long, b long")
    assert [r.change for r in P.cell_changes(df, "e", "a", "b", []).orderBy("idx").collect()] == [
        "regression", "recovery", "changed-error"]
    assert df.where(F.col("a") != F.col("b")).count() == 3


def test_marked_cells_are_never_broadcast(spark):
    cells = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(4)], "board_id long, idx long")
    marks = spark.createDataFrame([(1, "arrow", [0, 0]), (1, "circle", [0, 3]), (2, "check", [1, None]), (3, "arrow", [1, 2])],
                                  "board_id long, kind string, squares array<long>")
    out = M.marked_cells(cells, marks, "board_id", "idx", "squares")
    assert values(out, "board_id", "idx", "kind") == sorted(
        [(1, 0, "arrow"), (1, 0, "circle"), (1, 3, "circle"), (2, 1, "check")], key=repr)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverage_of_any_class_by_definition(spark, sf):
    rows = [(s, c, b, None if b == 7 else b // 2, b // 3, i) for b in range(12) for i in range(64)
            for s in ("training",) for c in [None if (b + i) % 9 == 0 else -1 if (b + i) % 7 == 0 else (b * i) % 40]]
    cells = spark.createDataFrame(rows, "split string, class_id long, board_id long, position_id long, group_id long, idx long")
    want = {}
    for s, c, b, p, g, i in rows:
        cell = want.setdefault((s, c, "dark" if (i // 8 + i % 8) % 2 else "light"), ([], set(), set(), set()))
        cell[0].append(i)
        for held, value in zip(cell[1:], (b, p, g)):
            held.add(value)
    got = {(r.split, r.class_id, r.background): (r.squares, r.boards, r.positions, r.groups) for r in M.coverage(
        cells, "class_id", "idx", "board_id", "position_id", "group_id", "split").collect() if r.squares}
    assert got == {k: (len(n), len(b), len(p - {None}), len(g)) for k, (n, b, p, g) in want.items()}


def test_coverage_counts_boards_and_not_cells(spark, sf):
    df = QUERIES["a11_coverage"](spark, sf)
    assert "Expand" not in plan_of(df)  # distinct counting over one row for each board and class


def test_teacher_audit_sorts_no_cells(spark, sf):
    plan = plan_of(QUERIES["a20_teacher_audit"](spark, sf))
    assert "SortAggregate" not in plan


def test_teacher_audit_of_unknown_digests(spark):
    draws = spark.createDataFrame([("a", 1, 0, 3, "x"), ("a", 1, 0, None, None), ("a", 2, 0, None, None), ("b", 1, 5, 5, "x"),
                                   ("b", 1, 5, 4, "y")], "pool string, cell int, label int, tc int, dg string")
    got = {r.pool: (r.exposures, r.distinct_cells, r.inconsistent_cells) for r in M.teacher_audit(
        draws, ["cell"], "pool", "label", "tc", "dg").collect()}
    assert got == {"a": (3, 2, 0), "b": (2, 1, 1)}
