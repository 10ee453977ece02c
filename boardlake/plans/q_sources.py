"""Source, sink, corpus and streaming queries (families S and ST)."""

import io

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from boardlake.functions.placement import literal_array
from boardlake.plans.q_compare import _STAGE, stages
from boardlake.plans.q_features import images
from boardlake.plans.registry import query, sql
from boardlake.session import shared_folder
from boardlake.sources import corpora as K
from boardlake.sources import archives as R
from boardlake.sources import commits as V
from boardlake.sources import datasets as D
from boardlake.sources.images import identify
from boardlake.streaming.intake import stream_dedupe, stream_intake
from boardlake.streaming.monitor import monitor, stream_monitor

@query("s1_image_catalog", sql(
    "SELECT page_id, CASE WHEN k IN (4, 11) THEN 'JPEG' WHEN k = 5 THEN 'OTHER' WHEN k IN (6, 7) THEN NULL ELSE 'PNG' END AS format, CAST(CASE WHEN k IN "
    "(4, 11) THEN 640 WHEN k IN (5, 6, 7) THEN NULL WHEN k = 12 THEN 65536 ELSE 256 + page_id % 256 END AS BIGINT) AS width, CAST(CASE WHEN k IN (4, 11) "
    "THEN 480 WHEN k IN (5, 6, 7) THEN NULL WHEN k = 12 THEN 65536 ELSE 512 END AS BIGINT) AS height, CASE WHEN k = 1 THEN 'I;16' WHEN k NOT IN (5, 6, 7) "
    "THEN 'RGB' END AS mode, CASE WHEN k IN (1, 2, 5, 12) THEN 'UNSUPPORTED_IMAGE' WHEN k IN (3, 6, 7, 13) THEN 'INVALID_IMAGE' END AS error_code FROM "
    "(SELECT page_id, page_id % 14 AS k FROM pages)"))
def s1(t):
    """Page bytes wrapped in image files: every outcome of the catalogue."""
    k, body = F.col("page_id") % 14, F.hex(F.encode("html", "UTF-8"))

    def number(value, digits=8):
        return F.lpad(F.hex(value), digits, "0")

    def chunk(kind, data, flaw=F.lit(0)):
        """Length, kind, data and checksum, in hex."""
        lead = F.concat(F.hex(F.encode(F.lit(kind), "UTF-8")), data)
        return F.concat(number((F.length(data) / 2).cast("long")), lead, number((F.crc32(F.unhex(lead)) + flaw) % 4294967296))

    side = F.when(k == 12, F.lit(65536)).otherwise(256 + F.col("page_id") % 256)
    height = F.when(k == 12, F.lit(65536)).otherwise(F.lit(512))
    kind = F.when(k == 1, "1000").when(k == 8, "1002").otherwise("0802")
    head = F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", F.concat(number(side), number(height), kind, F.lit("000000"))))
    frames = F.when(k == 2, chunk("acTL", F.lit("0000000200000000"))).otherwise("")
    stray = F.concat(body, F.when(k == 10, "6163544C").otherwise(""))
    pixels = chunk("IDAT", stray, F.when(k == 13, 1).otherwise(0))
    png = F.concat(head, frames, pixels, F.when(k == 3, "").otherwise(chunk("IEND", F.lit(""))), F.when(k == 9, body).otherwise(""))
    many = F.when(k == 11, F.repeat(F.lit("FFE200044943"), 300)).otherwise("")
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), many, F.lit("FFC0001108" "01E00280" "03012200021101031101"), body,
                    F.lit("FFD9"))
    hexed = (F.when(k.isin(4, 11), jpeg).when(k == 5, F.concat(F.lit("474946383961"), body)).when(k == 6, "")
             .when(k == 7, body).otherwise(png))
    files = t.pages.select("page_id", F.unhex(hexed).alias("content"))
    return identify(files).drop("sha256")


def _manifest(t):
    entry = F.struct(F.col("board_id").alias("position_id"), (F.col("board_id") % 60 + 1).alias("ply"),
                     F.col("placement").alias("piece_placement"), F.col("conditions").alias("categories"))
    return t.placed("placement").groupBy("position_id").agg(F.array_sort(F.collect_list(entry)).alias("positions")).select(
        F.lit("corpus").alias("dataset_id"), F.struct(F.col("position_id").alias("group_id"), F.lit("training").alias("split")).alias("group"),
        "positions")


@query("s2_read_manifest", sql(
    "SELECT 'corpus' AS dataset_id, position_id AS group_id, board_id AS position_id, board_id % 60 + 1 AS ply, placement AS piece_placement FROM placements"))
def s2(t):
    path = shared_folder(t.spark, "manifest")
    _manifest(t).write.json(path)
    m = D.read_manifest(t.spark, path, "positions")
    return m.select("dataset_id", F.col("group.group_id").alias("group_id"), "position_id", "ply", "piece_placement")


@query("s3_read_index", sql("SELECT board_id, group_id, config_id, split FROM boards WHERE split = 'validation'"))
def s3(t):
    path = shared_folder(t.spark, "index")
    D.publish(t.boards.select("board_id", "group_id", "config_id", "split"), path, ["split"], file_format="json")
    return D.read_index(t.spark, path, "board_id bigint, group_id bigint, config_id string, split string", "validation")


@query("s4_read_cells", sql(
    "SELECT board_id, idx, class_id, class_id <> 5 AS valid FROM cells WHERE split = 'evaluation' AND (board_id + idx) % 3 = 0"))
def s4(t):
    path = shared_folder(t.spark, "cells")
    px = F.when(F.col("class_id") == 5, literal_array([1, 2])).otherwise(literal_array([1, 2, 3]))
    D.publish(t.cells.select("board_id", "idx", "class_id", "split", px.alias("px")), path, ["split"])
    chosen = t.cells.where((F.col("board_id") + F.col("idx")) % 3 == 0)
    return D.read_cells(t.spark, path, "evaluation", 3, chosen).select("board_id", "idx", "class_id", "valid")


def _packed(batches):
    """One archive of 64 cells of 2 x 2 grey pixels for each customer."""
    for pdf in batches:
        rows = []
        for key, px in zip(pdf["c_custkey"], pdf["pixels"]):
            cells = np.asarray(px, np.uint8).reshape(8, 2, 8, 2).swapaxes(1, 2).reshape(64, 2, 2, 1)
            out = io.BytesIO()
            np.savez_compressed(out, images=cells, class_ids=((key + np.arange(64)) % 13).astype(np.uint8))
            rows.append((key, out.getvalue()))
        yield pd.DataFrame(rows, columns=["c_custkey", "content"])


@query("s4_cell_archives", sql(
    "SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'not-in-index' WHEN c_custkey % 11 = 0 THEN 'unreadable' WHEN c_custkey % 13 = 0 THEN "
    "'wrong-labels' END AS problem, CASE WHEN c_custkey % 17 > 0 AND c_custkey % 11 > 0 AND c_custkey % 13 > 0 THEN 64 END::BIGINT AS cells, CASE "
    "WHEN c_custkey % 17 > 0 AND c_custkey % 11 > 0 AND c_custkey % 13 > 0 THEN total END AS total FROM (SELECT c_custkey, CAST(sum(((c_custkey * 31 + y * 17 "
    "+ x * 7 + c_nationkey * x * y) % 256) * (y // 2 * 8 + x // 2 + 1)) AS BIGINT) AS total FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey "
    "FROM customer), (SELECT range AS y FROM range(16)), (SELECT range AS x FROM range(16)) GROUP BY 1)"))
def s4_archives(t):
    """Archives are written, cut, mislabelled or left out of the index, and read back."""
    k, path = F.col("c_custkey"), shared_folder(t.spark, "archives")
    packed = images(t).select("c_custkey", "pixels").mapInPandas(_packed, "c_custkey long, content binary")
    D.publish(packed.withColumn("content", F.when(k % 11 == 0, F.substring("content", 1, 50)).otherwise(F.col("content"))), path, [])
    files = t.spark.read.schema("c_custkey long, content binary").parquet(path).withColumn("path", k.cast("string"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((k + i + F.when(k % 13 == 0, 1).otherwise(0)) % 13).cast("int"))
    index = files.where(k % 17 != 0).select("path", F.sha2("content", 256).alias("sha256"), labels.alias("class_ids"))
    judged = shared_folder(t.spark, "archive-problems")  # read four times below, decoded once
    D.publish(R.archive_problems(files, index, 2, 1), judged, [])
    problems = t.spark.read.schema("path string, problem string").parquet(judged)
    good = problems.where("problem IS NULL").select("path")
    cells = R.read_archives(files.join(good, "path", "left_semi"), index.join(good, "path", "left_semi"), 2, 1)
    place = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v) * (F.col("idx") + 1)
    sums = cells.groupBy("path").agg(F.count("*").alias("cells"), F.sum(place).alias("total"))
    return problems.join(sums, "path", "left").select(F.col("path").cast("long").alias("c_custkey"), "problem", "cells", "total")


@query("s5_publish", sql("SELECT split, count(*) AS boards FROM boards GROUP BY 1"))
def s5(t):
    path = shared_folder(t.spark, "published")
    D.publish(t.boards, path, ["split"])
    return D.published_counts(t.spark, path)


@query("s5_versions", sql(
    "SELECT CAST(1 AS INTEGER) AS version, split, count(*) AS boards FROM boards WHERE split = 'training' GROUP BY 2 UNION ALL "
    "SELECT CAST(2 AS INTEGER), split, count(*) FROM boards WHERE split <> 'evaluation' GROUP BY 2"))
def s5_versions(t):
    """Two versions and a refused one: every reader sees the version it has pinned."""
    path, split = shared_folder(t.spark, "versions"), F.col("split")
    V.publish_new(t.boards.where(split == "training"), path, "first", ["split"])
    V.append_unseen(t.boards.where(split == "validation"), path, ["board_id"], "second", ["split"])
    try:
        V.append_unseen(t.boards.where(split != "training"), path, ["board_id"], "third", ["split"])
    except V.AlreadyCommitted:
        pass
    log, out = V.CommitLog(t.spark, path), None
    for version in range(1, log.version() + 1):
        rows = log.read(t.boards.schema, version).groupBy("split").agg(F.count("*").alias("boards")).select(
            F.lit(version).alias("version"), "split", "boards")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s6_inventory", sql(
    "SELECT CAST(board_id AS VARCHAR) AS board_id, stage, CAST(annotated_errors AS VARCHAR) AS annotated_errors, recovered_squares, introduced_squares, "
    "array_to_string(conditions, '; ') AS conditions FROM s JOIN (SELECT board_id, conditions FROM boards) USING (board_id) WHERE stage <> 'both-correct'", s=_STAGE))
def s6(t):
    rows = stages(t).join(t.boards.select("board_id", "conditions"), "board_id")
    return D.inventory(rows, F.col("stage") != "both-correct",
                       ["board_id", "stage", "annotated_errors", "recovered_squares", "introduced_squares"], ["conditions"])


@query("s7_pending_batches", sql(
    "SELECT group_id, CASE WHEN group_id % 3 = 0 THEN 'pending' WHEN group_id % 5 = 0 THEN 'recipe-conflict' ELSE 'published' END AS state FROM (SELECT DISTINCT group_id FROM boards)"))
def s7(t):
    plan = t.boards.select("group_id").distinct().withColumn("recipe", K.recipe_hash("group_id"))
    g = F.col("group_id")
    done = plan.where(g % 3 != 0).withColumn("recipe", F.when(g % 5 == 0, "other").otherwise(F.col("recipe")))
    return K.pending_batches(plan, done, "group_id", "recipe")


@query("s8_uncached", sql(
    "SELECT board_id FROM boards WHERE (seed_key, orientation) NOT IN (SELECT seed_key, orientation FROM boards WHERE leak_split = 'training')"))
def s8(t):
    cols = ["seed_key", "orientation"]
    done = t.boards.where("leak_split = 'training'").select(K.signature(*cols).alias("signature"))
    return K.uncached(t.boards, done, cols).select("board_id")


@query("s9_merge_corpora", sql(
    "SELECT board_id, CASE WHEN status = 'F' THEN 'previous' ELSE 'expansion' END AS cohort, p[1] || '/' || p[2] || '/' || p[3] AS combination, p[1] || '/' || p[2] || '/' || p[3] = "
    "'beta/green/carved' AS generalization FROM (SELECT board_id, status, string_split(config_id, '-') AS p FROM boards)"))
def s9(t):
    old = F.col("status") == "F"
    b = t.boards.select("board_id", "status", "config_id")
    m = K.merge_corpora(b.where(old), b.where(~old), "config_id", ["beta/green/carved"])
    return m.select("board_id", "cohort", F.col("style.combination").alias("combination"), "generalization")


@query("s10_append_training", sql(
    "SELECT board_id, split, false AS added FROM boards WHERE m < 37 UNION ALL SELECT board_id, split, true FROM boards WHERE m >= 37 AND split = 'training' AND seed_key IN (SELECT board_id "
    "FROM boards WHERE m < 37 AND split = 'training')"))
def s10(t):
    b = t.boards
    base, extra = b.where("m < 37").select("board_id", "split"), b.where("m >= 37").select("board_id", "split", "seed_key")
    bad = K.refused_additions(base, extra, "split", "seed_key", "board_id")
    out = K.append_training(base, extra.join(bad, "board_id", "left_anti"), "split", "seed_key", "board_id")
    return out.select("board_id", "split", "added")


@query("s10_refused_additions", sql(
    "SELECT board_id, CASE WHEN split <> 'training' THEN 'split' ELSE 'source' END AS problem FROM boards WHERE m >= 37 AND (split <> 'training' OR seed_key "
    "NOT IN (SELECT board_id FROM boards WHERE m < 37 AND split = 'training'))"))
def s10b(t):
    b = t.boards
    return K.refused_additions(b.where("m < 37").select("board_id", "split"), b.where("m >= 37").select("board_id", "split", "seed_key"),
                               "split", "seed_key", "board_id").select("board_id", "problem")


@query("s11_reviewed_imports", sql(
    "SELECT CAST(position_id AS VARCHAR) AS batch_id, board_id AS sample_id, split FROM boards WHERE status = 'P'"))
def s11(t):
    sample = F.struct(F.col("board_id").alias("sample_id"), F.when(
        F.col("status") == "P", "reviewed-real-use").otherwise("generated").alias("provenance"), "split",
        F.concat(F.col("board_id").cast("string"), F.lit(".png")).alias("image"), "conditions")
    path = shared_folder(t.spark, "batches")
    (t.boards.groupBy(F.col("position_id").cast("string").alias("batch_id")).agg(
        F.collect_list(sample).alias("samples")).write.json(path))
    return K.reviewed_imports(D.read_manifest(t.spark, path, "batch")).select("batch_id", "sample_id", "split")


@query("s12_partition_members", sql(
    "SELECT DISTINCT group_id, kind, value FROM (SELECT group_id, unnest(['sample', 'game']) AS kind, unnest([CAST(board_id AS VARCHAR), CASE WHEN status = 'P' "
    "THEN category || ':' || CAST(position_id AS VARCHAR) END]) AS value FROM boards) WHERE value IS NOT NULL"))
def s12b(t):
    game = F.when(F.col("status") == "P", F.col("position_id"))
    return K.partition_members(t.boards.withColumn("game", game), "group_id", "board_id", "category", "game")


@query("s12_partition_plan", sql(
    "SELECT group_id, count(DISTINCT board_id) AS samples, count(DISTINCT CASE WHEN status = 'P' THEN category || ':' || CAST(position_id AS VARCHAR) END) AS games FROM boards GROUP BY 1"))
def s12(t):
    game = F.when(F.col("status") == "P", F.col("position_id"))
    m = K.partition_members(t.boards.withColumn("game", game), "group_id", "board_id", "category", "game")
    return K.partition_plan(m, "group_id")


@query("s13_review_draft", sql(
    "SELECT 'real-' || CAST(board_id AS VARCHAR) AS position_id, 'real-' || g AS group_id, CASE WHEN split = 'evaluation' THEN 'evaluation' WHEN g LIKE '%-003' THEN 'validation' ELSE 'training' END AS split, "
    "replace(array_to_string(conditions, ','), 'circle', 'ring') AS conditions, CAST(NULL AS VARCHAR) AS piece_placement, CAST(NULL AS VARCHAR) AS orientation, false AS reviewed FROM (SELECT *, 'game-' || "
    "lpad(CAST(group_id % 7 AS VARCHAR), 3, '0') AS g FROM boards)"))
def s13(t):
    g = F.concat(F.lit("game-"), F.lpad((F.col("group_id") % 7).cast("string"), 3, "0"))
    d = K.review_draft(t.boards.withColumn("g", g), "board_id", "g", "split", "conditions", {"circle": "ring"})
    return d.withColumn("conditions", F.array_join("conditions", ","))



@query("st1_stream_intake", sql(
    "SELECT board_id, leak_split FROM boards WHERE leak_split = 'evaluation' UNION ALL SELECT board_id, leak_split FROM boards WHERE leak_split <> 'evaluation' AND position_id NOT IN "
    "(SELECT position_id FROM boards b WHERE leak_split <> 'evaluation' AND pair_id IN (SELECT pair_id FROM boards GROUP BY 1 HAVING count(DISTINCT leak_split) > 1))"))
def st1(t):
    source, published, pending, mark, sized = (
        shared_folder(t.spark, n) for n in ("incoming", "published", "pending", "intake", "sized"))
    b = t.boards.select("board_id", "pair_id", "position_id", "leak_split")
    done = F.col("leak_split") == "evaluation"
    b = b.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("position_id", done)))
    b.write.parquet(sized)  # read three times below
    b = t.spark.read.schema(b.schema).parquet(sized)
    b.where(done).write.parquet(f"{published}/intake=-1")
    # Half of each batch arrives first; the stream is started again for the other half.
    for half in (0, 1):
        b.where(~done & (F.col("board_id") % 2 == half)).write.mode("append").parquet(source)
        stream_intake(t.spark.readStream.schema(b.schema).parquet(source), published, pending, mark, "position_id", "size",
                      {"pair": ("pair_id", ["leak_split"])})
    return t.spark.read.parquet(published).select("board_id", "leak_split")


def _event_stream(t, name):
    path = shared_folder(t.spark, name)
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(path)
    return t.spark.readStream.schema(events.schema).parquet(path)


def _finish(t, df, name):
    out, mark = shared_folder(t.spark, name), shared_folder(t.spark, f"{name}-state")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


@query("st2_stream_dedupe", sql(
    "SELECT DISTINCT user_id, event_type FROM events"))
def st2(t):
    d = stream_dedupe(_event_stream(t, "requests"), "ts", "2 hours", ["user_id", "event_type"])
    return _finish(t, d.select("user_id", "event_type"), "deduped")


_WIN = ("SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS results, round(sum(value), 6) AS latency_sum, max(value) AS latency_max, "
        "count(*) FILTER (value > 100) AS slow FROM events {w} GROUP BY 1, 2")


def _render(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "results",
                     "latency_sum", "latency_max", "slow")


@query("st3_monitor_batch", sql(_WIN.format(w="")))
def st3b(t):
    return _render(monitor(t.events, "ts", "15 minutes", "event_type", "value"))


@query("st3_stream_monitor", sql(_WIN.format(
    w="WHERE time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")))
def st3(t):
    m = stream_monitor(_event_stream(t, "results"), "ts", "15 minutes", "10 minutes", "event_type", "value")
    return _render(_finish(t, m, "monitor"))
