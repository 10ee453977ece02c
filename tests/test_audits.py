"""Mutation tests: a clean table has no violations, one broken field exactly one."""

from conftest import values
from pyspark.sql import functions as F

from boardlake.operators import audits as C
from boardlake.operators import joins as J


def boards(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("board"), F.floor(F.col("id") / 4).alias("grp"),
        F.when(F.floor(F.col("id") / 4) % 2 == 0, "training").otherwise("validation").alias("split"),
        F.sha2(F.col("id").cast("string"), 256).alias("sha"), F.lit("white-bottom").alias("orientation"))


def test_split_leak_mutation(spark):
    df = boards(spark)
    assert C.split_leaks(df, "split", {"group": "grp", "hash": "sha"}).count() == 0
    broken = df.withColumn("split", F.when(F.col("board") == 5, "evaluation").otherwise(F.col("split")))
    assert values(C.split_leaks(broken, "split", {"group": "grp", "hash": "sha"})) == [
        ("group", "1", "evaluation,validation", 4)]


def test_null_keys_do_not_leak(spark):
    df = boards(spark).withColumn("sha", F.lit(None).cast("string"))
    assert C.split_leaks(df, "split", {"hash": "sha"}).count() == 0


def test_functional_dependency_mutation(spark):
    df = boards(spark)
    assert C.fd_violations(df, ["grp"], ["split"]).count() == 0
    broken = df.withColumn("split", F.when(F.col("board") == 9, "x").otherwise(F.col("split")))
    assert [r.grp for r in C.fd_violations(broken, ["grp"], ["split"]).collect()] == [2]


def test_augmentation_mutation(spark):
    base = boards(spark)
    extra = base.where("split = 'training'").select(
        (F.col("board") + 1000).alias("board"), "grp", "split", "sha", "orientation", F.col("board").alias("ref"),
        F.col("sha").alias("ref_sha"))
    args = ("board", "ref", "board", "split", "sha", "ref_sha", ["grp", "orientation"])
    assert C.augmentation_violations(base, extra, *args).count() == 0
    for col, value, name in (("ref", F.lit(99999), "source"), ("ref_sha", F.lit("x"), "pixels"),
                             ("orientation", F.lit("black-bottom"), "orientation"), ("split", F.lit("validation"), "split")):
        broken = extra.withColumn(col, F.when(F.col("board") == 1001, value).otherwise(F.col(col)))
        assert values(C.augmentation_violations(base, broken, *args)) == [(1001, name)]


def test_overlap_examples_are_the_first_three(spark):
    df = boards(spark).withColumn("same", F.lit("k"))
    hit = C.overlap_audit(df.where("split = 'training'"), df.where("split = 'validation'"), "board", {"key": "same"})
    assert hit.select("examples").distinct().collect()[0][0] == "4,5,6"
    assert hit.count() == 20


def test_corner_rules(spark):
    cols = "i int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"
    ok = (1, 10., 10., 90., 10., 90., 90., 10., 90.)
    cases = [ok, (2, 90., 10., 10., 10., 90., 90., 10., 90.), (3, 10., 10., 90., 10., 190., 90., 10., 90.),
             (4, 10., 90., 10., 10., 90., 10., 90., 90.)]
    df = spark.createDataFrame(cases, cols)
    names = [(f"x{i}", f"y{i}") for i in range(4)]
    got = values(C.corner_violations(df, ["i"], names, F.lit(100), F.lit(100)))
    assert {i for i, _ in got} == {2, 3, 4}
    assert (3, "outside") in got and (4, "order") in got and (2, "not-convex") in got


def test_reviews_bind_to_their_fields(spark):
    df = boards(spark).withColumn("seen", C.review_fingerprint(["board", "split", "sha"]))
    assert C.stale_reviews(df, ["board"], ["sha", "split", "board"], "seen").count() == 0
    moved = df.withColumn("sha", F.when(F.col("board") == 3, "x").otherwise(F.col("sha")))
    assert values(C.stale_reviews(moved, ["board"], ["sha", "split", "board"], "seen")) == [(3,)]


def test_session_membership_mutation(spark):
    images = boards(spark).select("board", "grp", F.lit("photo").alias("kind"))
    assert C.session_membership(images, images, "board", "grp", "kind").count() == 0
    twice = images.unionByName(images.where("board = 3"))
    assert values(C.session_membership(images, twice, "board", "grp", "kind")) == [(3, "several-sessions")]
    assert values(C.session_membership(images, images.where("board <> 8"), "board", "grp", "kind")) == [(8, "unassigned")]


def test_duplicate_matches_stay_linear(spark):
    """All rows share a hash: one output row per left row, not one per pair."""
    a = spark.range(500).select("id", F.lit("h").alias("h1"), F.col("id").cast("string").alias("h2"))
    b = spark.range(500).select("id", F.lit("h").alias("h1"), (F.col("id") + 499).cast("string").alias("h2"))
    m = J.duplicate_matches(a, b, "id", "id", ["h1", "h2"])
    assert m.count() == 500
    assert values(m.where("matched_by = 'h1,h2'"), "id", "matches", "first_match") == [(499, 501, 0)]


def test_nearest_position_brute_force(spark):
    import random
    r = random.Random(4)
    def grid():
        return "".join(r.choice("..PpKk") for _ in range(64))
    samples = [(i, grid()) for i in range(60)]
    samples += [(100 + i, samples[i][1]) for i in range(10)]
    sessions = [(0, samples[3][1])] + [(1 + i, grid()) for i in range(7)]
    s = spark.createDataFrame(samples, "id long, g string")
    q = spark.createDataFrame(sessions, "sid long, g string")
    got = {x.sid: (x.distance, x.nearest_samples, x.first_nearest)
           for x in J.nearest_position(q, s, "sid", "id", "g", block=3, sample_block=7).collect()}
    for sid, g in sessions:
        d = [(sum(a != b for a, b in zip(g, h)), i) for i, h in samples]
        low = min(d)[0]
        ids = [i for x, i in d if x == low]
        assert got[sid] == (low, len(ids), min(ids))


def test_nearest_position_by_segments(spark):
    """Grids one to nine squares apart, ties among them, and hot segments."""
    import random
    r = random.Random(11)
    base = ["".join(r.choice("...PpKk") for _ in range(64)) for _ in range(8)] + ["." * 64]
    def changed(g, n):
        g = list(g)
        for k in r.sample(range(64), n):
            g[k] = r.choice([c for c in "PNBRQKpnbrqk." if c != g[k]])
        return "".join(g)
    samples = [(k, changed(base[k % 9], k % 6)) for k in range(200)] + [(900 + k, base[k]) for k in range(3)]
    sessions = [(k, changed(base[k % 9], k % 10)) for k in range(120)]
    s = spark.createDataFrame(samples, "id long, g string")
    got = {x.sid: (x.distance, x.nearest_samples, x.first_nearest)
           for x in J.nearest_position(spark.createDataFrame(sessions, "sid long, g string"), s, "sid", "id", "g").collect()}
    seen = set()
    for sid, g in sessions:
        d = [(sum(a != b for a, b in zip(g, h)), i) for i, h in samples]
        low = min(d)[0]
        ids = [i for x, i in d if x == low]
        assert got[sid] == (low, len(ids), min(ids))
        seen.add(low)
    assert {0, 1, 2, 3, 5, 7} <= seen and max(seen) > 7
    empty = J.nearest_position(spark.createDataFrame(sessions[:2], "sid long, g string"), s.limit(0), "sid", "id", "g")
    assert empty.count() == 0


def test_segments_alone_settle_near_grids(spark):
    from boardlake.operators import hamming
    a = "." * 20 + "K" + "." * 30 + "k" + "." * 12
    b = "." * 20 + "K" + "." * 29 + "k" + "." * 13
    known = spark.createDataFrame([(a, 2, 5), ("P" * 64, 1, 6)], "g string, _n long, _first long")
    asked = hamming.prepared(spark.createDataFrame([(b,)], "g string"), "g")
    for count, want in ((2, []), (4, [(b, 2, 2, 5)]), (8, [(b, 2, 2, 5)])):
        assert values(hamming.near_grids(asked, hamming.prepared(known, "g"), "g", count)) == want


def test_overlap_report_statuses(spark):
    g = lambda c: c * 64
    schema = "id long, g string, fam string, src string, sha string"
    sessions = spark.createDataFrame([(1, g("P"), "f1", None, "s1"), (2, g("p"), "f2", "game:2", "s2"), (3, g("K"), "f3", "game:3", "s3"),
                                      (4, g("k"), None, None, None)], schema)
    main = spark.createDataFrame([(10, g("N"), "f9", None, "s1"), (11, g("N"), "f9", None, "s1"), (12, None, None, None, None)], schema)
    clue = spark.createDataFrame([(20, g("p"), "f2", "game:2", "s2")], schema)
    plan = spark.createDataFrame([(30, g("B"), "f8", "game:3", "s9")], schema)
    got = {(r.id, r.cohort): r for r in C.overlap_report(
        sessions, {"main": main, "clue": clue, "plan": plan, "none": plan.limit(0)}, ["main", "plan"], "id", "id", "g", "fam", "src",
        ["sha"]).collect()}
    assert len(got) == 16 and {k[0] for k, r in got.items() if r.status == "overlap-found"} == {1, 3}
    assert got[1, "main"].sha_matches == 2 and got[1, "main"].distance == 64 and got[1, "main"].nearest_samples == 2
    assert got[2, "clue"].exact_matches == 1 and got[2, "clue"].distance == 0 and got[2, "clue"].provenance == "known-source"
    assert got[4, "none"].distance is None and got[4, "none"].provenance == "unresolved-source"
    files = values(C.matching_files(sessions, main, "id", "id", ["sha"]), "kind", "side", "id")
    assert files == [("sha", "cohort", 10), ("sha", "cohort", 11), ("sha", "target", 1)]


def test_membership_and_parity(spark):
    a, b = spark.range(5), spark.range(1, 6)
    assert values(J.membership_diff(a, b, ["id"])) == [(0, "only-left"), (5, "only-right")]


def test_crops_must_reproduce_their_parent(spark):
    cols = "id long, ref long, cl int, ct int, cr int, cb int, w int, h int, gl int, gt int, gr int, gb int"
    rows = [(1, 0, None, None, None, None, 100, 80, 10, 10, 60, 60), (2, 1, 5, 5, 65, 70, 60, 65, 5, 5, 55, 55),
            (3, 1, 5, 5, 65, 90, 60, 85, 5, 5, 55, 55), (4, 1, 5, 5, 65, 70, 61, 65, 5, 5, 55, 55),
            (5, 1, 5, 5, 65, 70, 60, 65, 5, 6, 55, 55), (6, 1, 5, None, 65, 70, 60, 65, 5, 5, 55, 55)]
    df = spark.createDataFrame(rows, cols)
    got = {}
    for r in J.inheritance_violations(df.where("id > 1"), df.where("id = 1"), "id", "ref", "id", [], ["cl", "ct", "cr", "cb"],
                                      ["w", "h"], ["gl", "gt", "gr", "gb"]).collect():
        got.setdefault(r.id, set()).add(r.problem)
    assert got == {3: {"crop"}, 4: {"size"}, 5: {"grid"}, 6: {"crop", "size", "grid"}}


def test_rules_fail_closed(spark):
    from boardlake.functions.rules import violations
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, bad boolean")
    assert values(violations(df, ["id"], {"rule": F.col("bad")})) == [(1, "rule"), (3, "rule")]


def test_a_leak_between_two_file_columns_is_found(spark):
    train = spark.createDataFrame([(1, "a", "b"), (2, "x", "x")], "id long, image string, source string")
    held = spark.createDataFrame([(9, "b", "z"), (8, "q", "x")], "id long, image string, source string")
    got = C.overlap_audit(train, held, "id", {"image-file": ["image", "source"]})
    assert values(got) == [(1, "image-file", "9"), (2, "image-file", "8")]


def test_marks_by_kind(spark):
    cells = spark.createDataFrame([(1, i, 6 if i == 60 else 0) for i in range(64)], "b long, idx long, class_id long")
    rows = [(1, "last-move", ["a1", "a2"]), (2, "last-move", ["a1"]), (3, "selection", ["a1"]), (4, "selection", ["a1", "a2"]),
            (5, "check", ["e1"]), (6, "check", ["e1", "e2"]), (7, "circle", ["a1", "b2", "c3"]), (8, "circle", []), (9, None, ["a1"]),
            (10, "move-dot", None), (11, "circle", ["a9"]), (12, "circle", ["a1", "a1"])]
    df = spark.createDataFrame([(1, n, k, s, [1, 2, 3, 4], None, None, None, None, None) for n, k, s in rows],
                               "b long, n long, k string, s array<string>, c array<int>, p string, bd string, w double, x long, y long")
    got = {}
    for r in C.mark_violations(df, cells, "b", "n", "k", "s", "c", "p", "bd", "w", "x", "y").collect():
        got.setdefault(r.n, set()).add(r.problem)
    assert got == {2: {"squares"}, 4: {"squares"}, 6: {"check"}, 8: {"squares"}, 9: {"kind"}, 10: {"squares"}, 11: {"squares"},
                   12: {"squares"}}


def test_overlap_report_makes_its_inputs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def grid(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, "ab"[i % 2] * 64, "f", None, str(i)) for i in range(8)],
                                 "id long, grid string, fam string, src string, sha string").mapInArrow(
        grid, "id long, grid string, fam string, src string, sha string")
    got = C.overlap_report(rows, {"one": rows, "two": rows}, ["one"], "id", "id", "grid", "fam", "src", ["sha"]).collect()
    assert len(got) == 16 and {r.distance for r in got} == {0} and made.value == 24
