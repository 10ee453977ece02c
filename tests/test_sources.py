import random
import struct
import zlib

import pytest
from conftest import values
from pyspark.sql import functions as F

from boardlake.operators import models as L
from boardlake.sources import corpora as K
from boardlake.sources import datasets as D
from boardlake.sources.images import image_catalog
from boardlake.streaming.intake import _Versions, stream_dedupe, stream_intake, voted
from boardlake.streaming.monitor import monitor, stream_monitor


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(w, h, depth=8, kind=2, extra=b""):
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra
            + chunk(b"IDAT", zlib.compress(b"x")) + chunk(b"IEND", b""))


def jpeg(w, h, parts=3):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9
    sof = b"\xff\xc2" + struct.pack(">HBHHB", 8 + 3 * parts, 8, h, w, parts) + b"\1\x11\0" * parts
    return b"\xff\xd8" + app + b"\xff\xdb" + struct.pack(">H", 4) + b"\0\0" + sof + b"data" + b"\xff\xd9"


def test_catalogue(spark, tmp_path):
    files = {"a.png": png(640, 480), "b.txt": jpeg(320, 200), "grey.jpg": jpeg(9, 8, 1), "cmyk.jpg": jpeg(9, 8, 4), "empty.png": b"",
             "cut.png": png(5, 5)[:-6], "deep.png": png(5, 5, 16, 0), "one.png": png(5, 5, 1, 0), "anim.png": png(5, 5, extra=chunk(b"acTL", b"\0\0\0\2" + b"\0" * 4)), "still.png": png(5, 5, extra=chunk(b"acTL", b"\0\0\0\1" + b"\0" * 4)),
             "deep-rgb.png": png(5, 5, 16, 2), "deep-la.png": png(5, 5, 16, 4), "tail.png": png(5, 5) + b"more", "tail.jpg": jpeg(5, 5) + b"x",
             "stray.png": png(5, 5, extra=chunk(b"tEXt", b"acTL")), "crc.png": png(5, 5)[:-2] + b"xx", "big.png": png(20000, 20000),
             **{f"app{n}.jpg": jpeg(5, 5)[:2] + (b"\xff\xe2\0\4ab") * n + jpeg(5, 5)[2:] for n in (65, 300)},
             "x.gif": b"GIF89a....", "noise.png": b"hello", "cut.jpg": jpeg(5, 5)[:-2], "pal.png": png(7, 6, 8, 3)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    prefix = f"file:{tmp_path}/"
    wanted = spark.createDataFrame([(prefix + n, len(files.get(n, b"?"))) for n in [*files, "gone.png"]], "path string, length long")
    got = {r.path[len(prefix):]: r for r in image_catalog(spark, str(tmp_path), wanted=wanted).collect()}
    def row(n):
        return (got[n].format, got[n].width, got[n].height, got[n].mode, got[n].error_code)
    assert row("a.png") == ("PNG", 640, 480, "RGB", None)
    assert row("b.txt") == ("JPEG", 320, 200, "RGB", None)
    assert row("grey.jpg")[3] == "L" and row("cmyk.jpg")[3] == "CMYK" and row("one.png")[3] == "1" and row("pal.png")[3] == "P"
    codes = {n: got[n].error_code for n in got}
    assert codes["gone.png"] == "INPUT_READ_ERROR"
    assert {codes[n] for n in ("empty.png", "cut.png", "noise.png", "cut.jpg", "crc.png")} == {"INVALID_IMAGE"}
    assert {codes[n] for n in ("deep.png", "anim.png", "x.gif", "big.png")} == {"UNSUPPORTED_IMAGE"}
    assert {codes[n] for n in ("still.png", "deep-rgb.png", "deep-la.png", "tail.png", "tail.jpg", "stray.png", "app65.jpg",
                               "app300.jpg")} == {None}
    assert row("deep-rgb.png")[3] == "RGB" and row("deep-la.png")[3] == "LA"
    assert image_catalog(spark, str(tmp_path), "*.gif").count() == 1


def tiff(value, order="<", tag=0x0112, kind=3, n=1, count=None, before=0):
    """Directory of one orientation entry behind ``before`` others."""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    other = struct.pack(order + "HHIHH", 0x0100, 3, 1, 9, 0)
    short = struct.pack(order + "H", value) + b"\0\0" if kind == 3 else struct.pack(order + "I", value)
    entry = struct.pack(order + "HHI", tag, kind, n) + short
    return (mark + struct.pack(order + "I", 8) + struct.pack(order + "H", before + 1 if count is None else count)
            + other * before + entry + b"\0" * 4)


def exif_jpeg(w, h, data, lead=b""):
    body = b"Exif\0\0" + data
    app = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    plain = jpeg(w, h)
    return plain[:2] + lead + app + plain[2:]


def test_orientation_turns_the_size(spark, tmp_path):
    """All eight values in both byte orders and both formats; broken or foreign directories leave the stored size."""
    files, want = {}, {}
    for value in range(1, 9):
        for order in "<>":
            size = (20, 30) if value >= 5 else (30, 20)
            name = f"{value}{'le' if order == '<' else 'be'}"
            files[f"j{name}.jpg"] = exif_jpeg(30, 20, tiff(value, order, before=value % 3))
            files[f"p{name}.png"] = png(30, 20, extra=chunk(b"eXIf", tiff(value, order)))
            want[f"j{name}.jpg"] = want[f"p{name}.png"] = size
    late = png(30, 20)
    files["late.png"] = late[:-12] + chunk(b"eXIf", tiff(6)) + late[-12:]
    files["long.jpg"] = exif_jpeg(30, 20, tiff(8, ">", kind=4))
    files["second.jpg"] = exif_jpeg(30, 20, tiff(1), lead=exif_jpeg(1, 1, tiff(6))[2:][:4 + 6 + len(tiff(6))])
    want |= {"late.png": (20, 30), "long.jpg": (20, 30), "second.jpg": (20, 30)}
    odd = {"zero": tiff(0), "nine": tiff(9), "tag": tiff(6, tag=0x0111), "two": tiff(6, n=2), "text": tiff(6, kind=2), "cut": tiff(6)[:20],
           "far": b"II*\0\xff\xff\xff\xff", "magic": b"XX*\0" + tiff(6)[4:], "none": b"", "many": tiff(1, count=60_000)}
    for name, data in odd.items():
        files[f"{name}.jpg"] = exif_jpeg(30, 20, data)
        files[f"{name}.png"] = png(30, 20, extra=chunk(b"eXIf", data))
        want[f"{name}.jpg"] = want[f"{name}.png"] = (30, 20)
    files["crc.png"] = png(30, 20, extra=chunk(b"eXIf", tiff(6))[:-1] + b"?")
    xmp = b"http://ns.adobe.com/xap/1.0/\0" + tiff(6)
    files["xmp.jpg"] = jpeg(30, 20)[:2] + b"\xff\xe1" + struct.pack(">H", len(xmp) + 2) + xmp + jpeg(30, 20)[2:]
    want["xmp.jpg"] = (30, 20)
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in image_catalog(spark, str(tmp_path)).collect()}
    assert {n: (got[n].width, got[n].height) for n in want} == want
    assert {got[n].error_code for n in want} == {None} and got["crc.png"].error_code == "INVALID_IMAGE"


def test_publish_refuses_an_existing_destination(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "training").otherwise("validation"))
    path = str(tmp_path / "d")
    D.publish(df, path, ["split"])
    assert dict(values(D.published_counts(spark, path))) == {"training": 7, "validation": 3}
    with pytest.raises(Exception, match="(?i)exist"):
        D.publish(df, path, ["split"])
    plan = spark.read.parquet(path).where("split = 'training'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_index_rejects_bad_rows_and_unknown_splits(spark, tmp_path):
    (tmp_path / "split=training").mkdir()
    (tmp_path / "split=training" / "a.json").write_text('{"board_id": 1}\n{"board_id": "x"}\n')
    with pytest.raises(ValueError):
        D.read_index(spark, str(tmp_path), "board_id bigint, split string", "other")
    with pytest.raises(Exception):
        D.read_index(spark, str(tmp_path), "board_id bigint, split string", "training").collect()


def test_multi_line_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"dataset_id": "d",\n "group": {"group_id": 1, "split": "training"},\n "positions": '
                                     '[{"position_id": 7, "ply": 12, "piece_placement": "8", "categories": ["opening"]},\n {"position_id": 8}]}')
    m = D.read_manifest(spark, str(tmp_path / "m.json"), "positions", multi_line=True)
    assert values(m, "dataset_id", "group.group_id", "position_id", "ply") == [("d", 1, 7, 12), ("d", 1, 8, None)]


def test_inventory_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok", ["a"]), (2, "bad", ["a", "b"])], "id int, stage string, conditions array<string>")
    D.export_inventory(D.inventory(df, F.col("stage") != "ok", ["id", "stage"], ["conditions"]), str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert values(back) == [("2", "bad", "a; b")]


def test_resume_and_cache(spark):
    plan = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("c", "r1")], "b string, r string")
    done = spark.createDataFrame([("a", "r1"), ("b", "r2")], "b string, r string")
    assert dict(values(K.pending_batches(plan, done, "b", "r"))) == {"a": "published", "b": "recipe-conflict", "c": "pending"}
    req = spark.createDataFrame([(1, "x", "w"), (2, "x", "b"), (3, None, "w")], "id int, sha string, o string")
    old = req.where("id = 2").select(K.signature("o", "sha").alias("signature"))
    assert values(K.uncached(req, old, ["sha", "o"]), "id") == [(1,), (3,)]


def test_merge_keeps_an_existing_style(spark):
    p = spark.createDataFrame([(1, "a-b-c-512")], "id int, config string")
    m = K.merge_corpora(p, p.withColumn("id", F.lit(2)), "config", ["a/b/c"])
    assert values(m, "id", "cohort", "style.combination", "generalization") == [(1, "previous", "a/b/c", True), (2, "expansion", "a/b/c", True)]


def test_intake_stream_rejects_leaking_batches_and_replays(spark, tmp_path):
    schema = "id long, grp long, batch string, split string, sha string, size long"
    rows = [(2, 1, "a-leak", "training", "s2", 2), (3, 9, "a-leak", "training", "s3", 2), (4, 2, "b-good", "training", "s4", 1),
            (5, 5, "c-self", "training", "s5", 2), (6, 5, "c-self", "validation", "s6", 2),
            (7, 2, "d-late", "validation", "s7", 1), (8, 3, "e-more", "evaluation", "s8", 3), (9, 6, "e-more", "evaluation", "s9", 3),
            (10, 6, "e-more", "evaluation", "s10", 3), (11, 6, "f-after", "training", "s11", 1),
            (12, 7, "g-bytes", "training", "s4", 1), (13, 2, "h-same", "training", "s4", 1), (14, 8, "i-short", "training", "s14", 2)]
    rules = {"group": ("grp", ["split"]), "bytes": ("sha", ["grp", "split"])}
    for cut in ([rows], [rows[:7], rows[7:]], [[r] for r in rows]):
        base = tmp_path / str(len(cut))
        pub, pend, src, mark = (str(base / n) for n in ("pub", "pend", "src", "mark"))
        spark.createDataFrame([(1, 1, "old", "validation", "s1", 1)], schema).write.parquet(f"{pub}/intake=-1")
        def run():
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(src)
            stream_intake(stream, pub, pend, mark, "batch", "size", rules).awaitTermination()
            return sorted(r.id for r in spark.read.parquet(pub).collect())
        for part in cut:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            got = run()
        assert got == [1, 4, 8, 9, 10, 13], cut
        assert run() == got


def sequential(rows, rules, published=()):
    """Ids of rows whose batches are admitted one after the other."""
    known, kept = {}, []

    def says(r):
        return {(name, r[key], tuple(r[v] for v in values)) for name, (key, values) in rules.items() if r[key] is not None}

    for r in published:
        for name, key, value in says(r):
            known.setdefault((name, key), set()).add(value)
    for batch in sorted({r["batch"] for r in rows}):
        own = [r for r in rows if r["batch"] == batch]
        said = {}
        for r in own:
            for name, key, value in says(r):
                said.setdefault((name, key), set()).add(value)
        if len(own) >= own[0]["size"] and all(len(v) == 1 and known.get(k, v) == v for k, v in said.items()):
            known.update(said)
            kept += [r["id"] for r in own]
    return sorted(kept)


def test_intake_equals_one_batch_after_the_other(spark, tmp_path):
    """Chains of contradictions over shared keys, batches without keys, ids that do not sort as text."""
    rng, rows = random.Random(4), []
    for b in range(1, 61):
        n = rng.randrange(1, 4)
        rows += [dict(id=len(rows) + k, grp=rng.choice([None, *range(25)]), batch=b, split=rng.choice(["t", "v"]), size=n)
                 for k in range(n)]
    rows += [dict(id=1000 + k, grp=100 + k // 2, batch=70 + k, split="tv"[k % 4 // 2], size=1) for k in range(12)]
    schema, rules = "id long, grp long, batch long, split string, size long", {"group": ("grp", ["split"]), "id": ("id", ["batch"])}
    old = [dict(id=-1, grp=0, batch=-1, split="t", size=1), dict(id=-2, grp=1, batch=-2, split="t", size=1),
           dict(id=-3, grp=1, batch=-3, split="v", size=1)]
    pub, pend, src, mark = (str(tmp_path / n) for n in ("pub", "pend", "src", "mark"))
    spark.createDataFrame([tuple(r.values()) for r in old], schema).write.parquet(f"{pub}/intake=-1")
    spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3).write.parquet(src)
    stream_intake(spark.readStream.schema(schema).parquet(src), pub, pend, mark, "batch", "size", rules)
    got = sorted(r.id for r in spark.read.parquet(pub).where("id >= 0").collect())
    assert got == sequential(rows, rules, old) and 0 < len(got) < len(rows)
    voting = _Versions(spark, pend)
    assert voting.before("voting", 10 ** 6, "round long, batch long").count() == 0 and len(voting.numbers("rows")) <= 2


@pytest.mark.parametrize("table", ["messages", "voting", "rows"])
def test_intake_goes_on_after_a_failure(spark, tmp_path, monkeypatch, table):
    """A micro-batch that dies while it writes is replayed and replaces what it left."""
    rows = [(1, 1, 1, "t", 2), (2, 2, 1, "t", 2), (3, 2, 2, "v", 1), (4, 3, 3, "v", 1), (5, 3, 4, "t", 1)]
    schema, rules = "id long, grp long, batch long, split string, size long", {"group": ("grp", ["split"])}
    pub, pend, src, mark = (str(tmp_path / n) for n in ("pub", "pend", "src", "mark"))
    spark.createDataFrame(rows[:0], schema).write.parquet(f"{pub}/intake=-1")
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(src)
    start = lambda: stream_intake(spark.readStream.schema(schema).parquet(src), pub, pend, mark, "batch", "size", rules)
    write, seen = _Versions.write, []

    def failing(self, df, name, number):
        write(self, df, name, number)
        if name == table and number == 1 and not seen:
            seen.append(number)
            raise OSError("disk gone")

    monkeypatch.setattr(_Versions, "write", failing)
    with pytest.raises(Exception, match="disk gone"):
        start()
    start()
    assert seen == [1] and sorted(r.id for r in spark.read.parquet(pub).collect()) == [1, 2, 4]
    spark.createDataFrame([(6, 1, 5, "v", 1), (7, 3, 6, "v", 1)], schema).write.mode("append").parquet(src)
    start()
    assert sorted(r.id for r in spark.read.parquet(pub).collect()) == [1, 2, 4, 7]


def test_intake_state_is_an_aggregation(spark, tmp_path):
    """No Python runs for a key, and the state holds one row for each key that rows or messages named."""
    schema, rules = "id long, grp long, batch long, split string, size long", {"group": ("grp", ["split"])}
    pub, pend, src, mark = (str(tmp_path / n) for n in ("pub", "pend", "src", "mark"))
    spark.createDataFrame([(-1, 0, -1, "t", 1)], schema).write.parquet(f"{pub}/intake=-1")
    spark.range(3000).selectExpr("id", "id AS grp", "id AS batch", "if(id % 3 = 0, 'v', 't') AS split", "1L AS size").write.parquet(src)
    query = stream_intake(spark.readStream.schema(schema).parquet(src), pub, pend, mark, "batch", "size", rules)
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert {s["operatorName"] for s in states} == {"stateStoreSave"} and states[-1]["numRowsTotal"] == 3000
    assert spark.read.parquet(pub).where("id >= 0").count() == 2999


def test_votes_follow_the_order_of_claims(spark):
    """Hand values, and keys at random against one claim after the other."""
    rng, claims, answers = random.Random(6), [], {}
    for key in map(str, range(300)):
        if rng.random() < 0.9:
            answers[key] = rng.choice([(None, None), ("v", "v"), ("w", "w"), ("v", "w")])
        places = rng.sample([(r, b) for r in (2, 10) for b in (5, 9, 30)], rng.randrange(1, 6))
        claims += [(*p, "group", key, rng.choice("vvw"), None) for p in places]
    claims += [(1, 1, "group", "held", "v", True), (1, 2, "group", "held", "w", None), (2, 1, "group", "held", "v", None)]
    answers["held"] = (None, None)
    schema = "round long, batch long, rule string, key string, value string, yes boolean"
    said = spark.createDataFrame([("group", k, *v) for k, v in answers.items()], "rule string, key string, low string, high string")
    got = {(r.round, r.batch, r.key): r.yes for r in voted(spark.createDataFrame(claims, schema), said).collect()}
    want = {}
    for round_, batch, _, key, value, yes in sorted(claims):
        low, high = answers.get(key, (None, None))
        if low is not None:
            yes = low == high == value
        elif key in answers and {c[4] for c in claims if c[3] == key and c[:2] <= (round_, batch)} == {value}:
            yes = True
        want[round_, batch, key] = yes
    assert got == want and {True, False, None} == set(want.values())
    assert [want[p] for p in ((1, 1, "held"), (1, 2, "held"), (2, 1, "held"))] == [True, None, None]


def test_stream_monitor_drops_late_rows_and_matches_batch(spark, tmp_path):
    schema = "ts timestamp, code string, ms double"
    src, out, mark = (str(tmp_path / n) for n in ("s", "o", "m"))
    rows = [("2024-01-01 00:01:00", "a", 5.0), ("2024-01-01 00:14:00", "a", 200.0), ("2024-01-01 00:31:00", "b", 1.0),
            ("2024-01-01 01:30:00", "a", 1.0)]
    def add(data):
        spark.createDataFrame(data, "t string, code string, ms double").selectExpr("to_timestamp(t) ts", "code", "ms").coalesce(1) \
            .write.mode("append").parquet(src)
    add(rows)
    def run():
        m = stream_monitor(spark.readStream.schema(schema).parquet(src), "ts", "15 minutes", "10 minutes", "code", "ms")
        q = (m.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    run()
    add([("2024-01-01 00:02:00", "a", 9.0), ("2024-01-01 03:00:00", "a", 1.0)])
    run()
    got = values(spark.read.parquet(out), "code", "results", "slow")
    twin = monitor(spark.read.parquet(src).where("ts <> timestamp'2024-01-01 00:02:00' AND ts < timestamp'2024-01-01 02:00:00'"),
                   "ts", "15 minutes", "code", "ms")
    assert got == values(twin, "code", "results", "slow") == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]


def test_stream_dedupe(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("s", "o", "m"))
    df = spark.createDataFrame([(i, f"h{i % 3}") for i in range(9)], "i long, sha string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(src)
    d = stream_dedupe(spark.readStream.schema(df.schema).parquet(src), "ts", "1 hour", ["sha"])
    q = (d.select("sha").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert values(spark.read.parquet(out)) == [("h0",), ("h1",), ("h2",)]


def test_fit_is_deterministic_and_weighted(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("w", F.lit(1.0))
    runs = [values(L.predict(df, L.fit_classifier(df, "embedding", "label", "w"), "embedding", ["vec_id"]), "vec_id", "class_id")
            for _ in range(2)]
    assert runs[0] == runs[1]
    heavy = df.withColumn("w", F.when(F.col("label") == 0, 1e6).otherwise(1e-6))
    only = L.predict(df, L.fit_classifier(heavy, "embedding", "label", "w"), "embedding", ["vec_id"])
    assert {r.class_id for r in only.collect()} == {0}


def test_soft_targets_and_margin(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, 2.0], 1), (2, [1000.0, 0.0, 0.0], 2)], "id int, s array<double>, y int")
    got = {r.id: r for r in df.select("id", L.softmax("s", 2.0).alias("p"), L.margin("s", "y").alias("m"), L.argmax("s").alias("k")).collect()}
    assert abs(sum(got[1].p) - 1) < 1e-12 and got[2].p[0] == 1.0
    assert got[1].m == 1.0 and got[2].m == -1000.0 and (got[1].k, got[2].k) == (1, 0)


def test_refused_additions_refuse_the_set(spark):
    base = spark.createDataFrame([(1, "training"), (2, "validation")], "id long, split string")
    extra = lambda rows: spark.createDataFrame(rows, "id long, split string, src long")
    good = [(10, "training", 1)]
    assert K.append_training(base, extra(good), "split", "src", "id").count() == 3
    for bad in ((11, "validation", 1), (11, "training", 2), (11, "training", None), (11, None, 1)):
        with pytest.raises(ValueError, match="additions refused"):
            K.append_training(base, extra([*good, bad]), "split", "src", "id")


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    from types import SimpleNamespace

    from boardlake.session import base_folder
    there = lambda master, folder: SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: folder), sparkContext=SimpleNamespace(master=master))
    assert base_folder(there("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            base_folder(there(master, None))


def test_selected_cells_are_never_broadcast(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = [(b, i, i % 13, "evaluation", [1, 2, 3]) for b in range(3) for i in (0, 5, 63, 64, 70, -1)]
    rows.append((1, None, 2, "evaluation", [1, 2, 3]))
    spark.createDataFrame(rows, "board_id long, idx long, class_id long, split string, px array<int>").write.partitionBy(
        "split").parquet(path)
    wanted = spark.createDataFrame([(0, 5), (0, 5), (1, 63), (1, 64), (1, None), (2, -1), (2, 6), (9, 0)], "board_id long, idx long")
    out = D.read_cells(spark, path, "evaluation", 3, wanted)
    assert values(out, "board_id", "idx", "valid") == sorted(
        [(0, 5, True), (1, 63, True), (1, 64, False), (2, -1, False)], key=repr)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
