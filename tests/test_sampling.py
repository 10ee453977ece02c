import pytest
from conftest import values
from pyspark.sql import functions as F

from boardlake.functions.hashing import bucket_rank, spread_rank, stable_hash, value_bucket
from boardlake.operators import sampling as W


def boards(spark):
    return spark.range(120).select(
        F.col("id").alias("board"), F.when(F.col("id") < 100, "p").otherwise("q").alias("pool"),
        F.when(F.col("id") < 80, 0).otherwise(F.col("id") % 5).alias("grp"), (F.col("id") % 7).alias("pos"),
        F.lit("s").alias("style"), F.transform(F.sequence(F.lit(0), F.col("id") % 6), lambda x: x.cast("long")).alias("cells"))


def test_exact_quotas_and_balance(spark):
    quotas = spark.createDataFrame([("p", 400), ("q", 24)], "pool string, quota long")
    d = W.sample_epoch(boards(spark), quotas, "pool", ["grp", "pos", "style", "board"], "cells", 1, 0).persist()
    assert dict(values(d.groupBy("pool").count())) == {"p": 400, "q": 24}
    for level in (["pool", "grp"], ["pool", "grp", "pos"], ["pool", "grp", "pos", "style", "board"]):
        n = d.groupBy(*level).count()
        spread = n.groupBy(*level[:-1]).agg((F.max("count") - F.min("count")).alias("s"))
        assert spread.agg(F.max("s")).first()[0] <= 1
    seen = d.groupBy("board", "idx").count().groupBy("board").agg((F.max("count") - F.min("count")).alias("s"))
    full = d.groupBy("board").agg(F.max("cycle").alias("c")).where("c > 0")
    assert seen.join(full, "board").agg(F.max("s")).first()[0] <= 1


def test_epochs_differ_and_repeat(spark):
    quotas = spark.createDataFrame([("p", 40), ("q", 24)], "pool string, quota long")
    def draw(seed, epoch):
        return values(W.sample_epoch(boards(spark), quotas, "pool", ["grp", "pos", "style", "board"], "cells", seed, epoch),
                      "board", "idx")
    assert draw(1, 0) == draw(1, 0)
    assert draw(1, 0) != draw(1, 1) != draw(2, 1)


def test_two_groups_share_evenly(spark):
    df = spark.createDataFrame([("a", 1, 40), ("a", 2, 40), ("b", 1, 24), ("b", 2, 24)], "pool string, grp long, quota long")
    assert values(W.allocate(df, ["pool"], "grp", "quota", (0,)), "pool", "grp", "quota") == [
        ("a", 1, 20), ("a", 2, 20), ("b", 1, 12), ("b", 2, 12)]


def test_bucket_ranks_with_a_hot_and_a_null_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot")
                                  .otherwise(F.col("id").cast("string")).alias("g")).withColumn("h", stable_hash("id"))
    r = spread_rank(df, ["g"], "h", ["id"], buckets=16, size="n")
    assert r.count() == 3000
    by = {}
    for x in r.collect():
        by.setdefault(x.g, []).append((x.rank, x.h, x.n))
    for rows in by.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1))
        assert [x[1] for x in rows] == sorted(x[1] for x in rows)
        assert rows[0][2] == len(rows)
    q = bucket_rank(df, [], F.floor(F.col("id") / 100), ["id"], out="r")
    assert q.where("r <> id + 1").count() == 0


@pytest.mark.parametrize("kind", ["outlier", "prefix", "negative", "date", "decimal"])
def test_value_buckets_are_even_and_ordered(spark, kind):
    """An outlier of 10^15, strings with a long common prefix, and other types: even buckets, exact ranks."""
    expr = {"outlier": "IF(id = 7, 1000000000000000L, id * 3)", "prefix": "concat(repeat('corpus/clean/', 5), IF(id % 2 = 0, 'a', 'é'), id * 7919L % 10007)",
            "negative": "CAST((id - 3000) AS DOUBLE) / 7", "date": "date_add(DATE'2020-01-01', CAST(id AS INT))",
            "decimal": "CAST(id * 1.25 AS DECIMAL(20, 2))"}[kind]
    df = spark.range(6000).selectExpr("id", f"{expr} AS v").unionByName(spark.range(1).selectExpr("-1 AS id", f"IF(false, {expr}, NULL) AS v"))
    bucket = value_bucket(df, "v", 100)
    rows = df.select("v", bucket.alias("b")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and rows[0].b == 0
    sizes = {}
    for r in rows:
        sizes[r.b] = sizes.get(r.b, 0) + 1
    assert len(sizes) >= 40 and max(sizes.values()) <= 500
    ranked = bucket_rank(df.where("v IS NOT NULL"), [], bucket, ["v"], out="r")
    want = spark.createDataFrame([(r.v,) for r in rows[1:]], df.select("v").schema).collect()
    assert [r.v for r in ranked.orderBy("r").collect()] == [r.v for r in want]


def test_value_buckets_with_few_or_equal_values(spark):
    for rows in ([], [(None,)], [("x",)] * 300, [(k,) for k in "abc"] * 200):
        df = spark.createDataFrame(rows, "v string")
        out = df.select("v", value_bucket(df, "v", 10).alias("b")).distinct().collect()
        assert [r.b for r in sorted(out, key=lambda r: r.v or "")] == sorted(r.b for r in out)
    many = spark.range(3000).select((F.col("id") % 2).alias("v"))
    assert many.select(value_bucket(many, "v", 10).alias("b")).distinct().count() == 2


def test_every_batch_is_full_but_the_last(spark):
    n = values(W.shuffle_batches(spark.range(1000), ["id"], 1, 0, 64).groupBy("batch").count())
    assert n == sorted([(b, 64) for b in range(15)] + [(15, 40)], key=repr)


def test_training_cells_clip_at_the_border(spark):
    b = spark.createDataFrame([(1, True), (2, False)], "b long, clean boolean")
    for kind, want in (("last-move", [0, 1, 8, 9, 54, 55, 62, 63]), ("selection", [0, 1, 8, 9, 54, 55, 62, 63]),
                       ("circle", [0, 63]), ("check", [0, 63]), ("move-dot", [0, 63]), (None, [0, 63]), ("arrow", [])):
        m = spark.createDataFrame([(2, kind, [0, 63])], "b long, k string, s array<long>")
        got = values(W.training_cells(b, m, "b", F.col("clean"), "k", "s").where("b = 2"), "idx")
        assert sorted(x[0] for x in got) == want, kind


def test_scenario_falls_forward_to_a_valid_one(spark):
    df = spark.range(50)
    got = W.assign_scenario(df, ["id"], 3, 8, lambda i: i == 5)
    assert {r.scenario for r in got.collect()} == {5}
    none = W.assign_scenario(df, ["id"], 3, 8, lambda i: i > 99)
    assert {r.scenario for r in none.collect()} == {None}


def test_first_passing_trial(spark):
    p = spark.createDataFrame([(g, 5 if g < 3 else 0, 5) for g in range(9)], "g long, c0 long, c1 long")
    sizes = [("a", 3), ("b", 3), ("c", 3)]
    for block in (1, 50):
        got = {r.g: (r.trial, r.split) for r in W.assign_splits(p, "g", sizes, 5, 1, 200, block).collect()}
        assert len({got[g][1] for g in range(3)}) == 3
        first = got[0][0]
        if block == 1:
            keep = first
    assert keep == first
    with pytest.raises(ValueError, match="none of 20"):
        W.assign_splits(p, "g", sizes, 99, 1, 20)


@pytest.mark.parametrize("digits,rows", [(3, 64), (1, 1), (2, 5)])
def test_ranks_of_all_trials_at_once(spark, monkeypatch, digits, rows):
    """The selected hashes are those of a full sort, whatever the number of rounds; ranks beyond the groups are null."""
    import hashlib
    monkeypatch.setattr(W, "SELECT_DIGITS", digits)
    monkeypatch.setattr(W, "SELECT_ROWS", rows)
    groups = spark.range(90).withColumnRenamed("id", "g")
    got = {r.trial: r for r in W.trial_thresholds(groups, "g", 5, 25, 3, [1, 40, 41, 90, 91], 90).collect()}
    assert len(got) == 20
    for t, r in got.items():
        order = sorted((hashlib.sha256(f"3|{t}|{g}".encode()).hexdigest(), g) for g in range(90))
        assert [tuple(r[f"t{k}"]) for k in range(4)] == [order[0], order[39], order[40], order[89]] and r.t4 is None


def test_required_counts_need_one_in_each_split(spark):
    p = spark.createDataFrame([(g, 9, int(g in (0, 1, 2)), int(g in (3, 4, 5))) for g in range(9)],
                              "g long, c0 long, white long, black long")
    got = {r.g: r.split for r in W.assign_splits(p, "g", [("a", 3), ("b", 3), ("c", 3)], 9, 2,
                                                 required=["white", "black"]).collect()}
    assert {got[g] for g in (0, 1, 2)} == {got[g] for g in (3, 4, 5)} == {"a", "b", "c"}


def test_missing_pools_and_empty_boards_are_named(spark):
    df = spark.createDataFrame([("p", 1, 1, "s", 1, [1, 2]), ("q", 2, 2, "s", 2, [])],
                               "pool string, grp long, pos long, style string, board long, cells array<long>")
    quota = lambda rows: spark.createDataFrame(rows, "pool string, quota long")
    args = ("pool", ["grp", "pos", "style", "board"], "cells", 1, 0)
    with pytest.raises(ValueError, match="missing"):
        W.sample_epoch(df, quota([("p", 2), ("missing", 5)]), *args)
    with pytest.raises(Exception, match="board without eligible cells: 2"):
        W.sample_epoch(df, quota([("q", 1)]), *args).collect()
    assert W.sample_epoch(df, quota([("p", 5), ("missing", 0)]), *args).count() == 5


def test_picks_take_string_ids(spark):
    df = spark.createDataFrame([(f"game-{g:03}", f"pos-{g}-{i}é") for g in range(30) for i in range(1 + g % 4)],
                               "g string, p string")
    got = values(W.compact_pick(df, "g", "p"))
    by = {}
    for g, p in sorted(map(tuple, df.collect())):
        by.setdefault(g, []).append(p)
    assert got == sorted(((g, ps[i % len(ps)]) for i, (g, ps) in enumerate(sorted(by.items()))), key=repr)


@pytest.mark.parametrize("widths", [[0.14], [0.06, 0.1, 0.14, 0.22]])
def test_arrow_plan_fits_its_case(spark, widths):
    from boardlake.operators.geometry import route_table
    routes = route_table(spark, widths).persist()
    by_kind = {}
    for r in routes.collect():
        by_kind.setdefault(r.geometry, {})[r.start, r.end, r.bend, r.width] = r.touched
    cases = ["arrow-empty", "arrow-piece", "arrow-crossed", "arrow-combined"]
    rows = [(i, m, cases[i % 4]) for i, m in enumerate([0, -1, 255, 0x00FF00000000FF00, 1 << 62, -(1 << 63)] * 20)]
    df = spark.createDataFrame(rows, "b long, mask long, c string").repartition(3)
    got = {}
    for r in W.arrow_plan(df, routes, "b", "mask", "c", 3).collect():
        got.setdefault(r.b, []).append(r)
    assert set(got) == {b for b, *_ in rows}
    for b, mask, case in rows:
        if case == "arrow-crossed":
            one, two = got[b]
            assert one.touched & two.touched and {one.arrow_no, two.arrow_no} == {1, 2}
            continue
        r, = got[b]
        known = by_kind[r.geometry]
        fits = [k for k, t in known.items() if ((t & mask) == 0) == (case == "arrow-empty")]
        if fits:
            assert (r.start, r.end, r.bend, r.width) in fits and r.reason is None
            assert r.touched == known[r.start, r.end, r.bend, r.width]
        else:
            assert r.touched is None and r.reason == "no-route"
    assert {r.geometry for rs in got.values() for r in rs} == set(by_kind)


def test_covering_orders_few_rows_and_loses_no_bucket(spark, monkeypatch):
    ordered, pick = [], W.hash_pick

    def counted(df, *args):
        ordered.append(df.count())
        return pick(df, *args)

    df = spark.range(60_000).select("id", F.when(F.col("id") < 3, "rare").otherwise("often").alias("kind"))
    grid = spark.createDataFrame([("rare",), ("often",), ("none",)], "kind string")
    want = values(grid.join(W.hash_pick(df, ["kind"], ["id"], "x"), "kind", "left"))
    monkeypatch.setattr(W, "hash_pick", counted)
    assert values(W.hash_pick_covering(df, ["kind"], ["id"], "x", grid)) == want
    found = dict(want)
    assert len(ordered) == 2 and sum(ordered) < 100 and found["none"] is None and found["rare"] is not None
