"""Board, cell and prediction tables derived from the given test tables.

Every table exists twice: as a Spark plan (``Tables``) and as a SQL subquery
(``SQL_TABLES``) with the same names and values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.functions.constants import SYMBOLS
from boardlake.functions.placement import encode_grid, literal_array

L = F.lit

_ENCODE = "array_to_string([substr(grid, CAST(8 * r + 1 AS BIGINT), 8) FOR r IN range(8)], '/')"
for _run in range(8, 0, -1):
    _ENCODE = f"replace({_ENCODE}, '{'.' * _run}', '{_run}')"
ENCODE_SQL = _ENCODE


def expand_sql(col: str) -> str:
    for run in range(1, 9):
        col = f"replace({col}, '{run}', '{'.' * run}')"
    return col


SQL_TABLES = {
    "idx": "SELECT CAST(range AS BIGINT) AS i FROM range(64)",
    "boards": """
        SELECT o_orderkey AS board_id, o_custkey AS group_id, o_orderkey % 40 AS m,
          CASE WHEN o_orderkey % 40 IN (37, 38, 39) THEN o_orderkey - (o_orderkey % 40) + 36
               ELSE o_orderkey END AS seed_key,
          CASE WHEN o_custkey % 10 < 7 THEN 'training' WHEN o_custkey % 10 < 9 THEN 'validation'
               ELSE 'evaluation' END AS split,
          CASE WHEN o_orderkey % 10 < 7 THEN 'training' WHEN o_orderkey % 10 < 9 THEN 'validation'
               ELSE 'evaluation' END AS leak_split,
          CASE WHEN o_orderkey % 2 = 0 THEN 'white-bottom' ELSE 'black-bottom' END AS orientation,
          o_orderpriority AS category, o_orderstatus AS status,
          CASE WHEN o_orderstatus = 'F' THEN ['clean'] WHEN o_orderkey % 3 = 0 THEN ['arrow']
               WHEN o_orderkey % 3 = 1 THEN ['arrow', 'circle'] ELSE ['circle'] END AS conditions,
          ['alpha', 'beta', 'gamma'][o_orderkey % 3 + 1] || '-' ||
          ['brown', 'blue', 'green'][o_custkey % 3 + 1] || '-' ||
          ['plain', 'carved'][o_custkey % 2 + 1] || '-' ||
          ['512', '384'][o_orderkey % 2 + 1] AS config_id,
          o_orderkey // 2 AS pair_id, o_orderkey // 4 AS position_id,
          o_totalprice AS price, o_totalprice / 1000000.0 AS seconds
        FROM orders""",
    "cells": """
        SELECT board_id, group_id, position_id, split, leak_split, orientation, category, pair_id,
          i AS idx, CASE WHEN v < 500 THEN 0 ELSE 1 + v % 12 END AS class_id,
          CASE WHEN board_id % 29 = 0 THEN -1
               WHEN (board_id * 131 + i * 17) % 211 = 0
               THEN (CASE WHEN v < 500 THEN 0 ELSE 1 + v % 12 END + 5) % 13
               ELSE CASE WHEN v < 500 THEN 0 ELSE 1 + v % 12 END END AS pred_id,
          CASE WHEN board_id % 31 = 0 THEN -1
               WHEN (board_id * 137 + i * 19) % 223 = 0
               THEN (CASE WHEN v < 500 THEN 0 ELSE 1 + v % 12 END + 5) % 13
               ELSE CASE WHEN v < 500 THEN 0 ELSE 1 + v % 12 END END AS cand_id
        FROM (SELECT *, (seed_key * 7919 + src * 104729 + (seed_key % 13) * src * 31) % 1000 AS v
              FROM (SELECT boards.*, i, CASE WHEN m = 38 THEN 63 - i
                      WHEN m = 39 THEN (i % 8) * 8 + (7 - i // 8) ELSE i END AS src
                    FROM boards CROSS JOIN idx))""",
    "grids": f"""
        SELECT board_id, string_agg(substr('{SYMBOLS}', class_id + 1, 1), '' ORDER BY idx) AS grid,
          CASE WHEN min(pred_id) >= 0 THEN
            string_agg(substr('{SYMBOLS}', pred_id + 1, 1), '' ORDER BY idx) END AS pred_grid,
          CASE WHEN min(cand_id) >= 0 THEN
            string_agg(substr('{SYMBOLS}', cand_id + 1, 1), '' ORDER BY idx) END AS cand_grid
        FROM cells GROUP BY board_id""",
    "placements": f"""
        SELECT boards.*, grid, pred_grid, cand_grid, {ENCODE_SQL} AS placement
        FROM boards JOIN grids USING (board_id)""",
    "rects": """
        SELECT l_orderkey * 8 + l_linenumber AS box_id, l_orderkey AS board_id,
          l_returnflag AS category,
          l_linenumber * 10 + l_partkey % 50 AS x, l_suppkey % 40 AS y,
          200 + l_partkey % 50 AS w, 200 + l_partkey % 50 AS h,
          l_linenumber * 10 + l_partkey % 50 + CAST(l_quantity AS BIGINT) % 3 AS dx,
          l_suppkey % 40 + CAST(l_quantity AS BIGINT) % 2 AS dy,
          200 + l_partkey % 50 + CAST(l_quantity AS BIGINT) % 5 AS dw,
          200 + l_partkey % 50 - CAST(l_quantity AS BIGINT) % 4 AS dh,
          CAST(l_quantity AS BIGINT) % 11 <> 0 AS found
        FROM lineitem""",
    "quads": """
        SELECT board_id, group_id, category, split, 600 AS image_w, 600 AS image_h,
          CASE WHEN board_id % 50 = 0 THEN 500 ELSE 100 + board_id % 7 END AS ex0,
          100 + board_id % 5 AS ey0,
          CASE WHEN board_id % 50 = 0 THEN 100 ELSE 500 - board_id % 11 END AS ex1,
          100 + board_id % 6 AS ey1,
          CASE WHEN board_id % 37 = 0 THEN 700 ELSE 500 + board_id % 13 END AS ex2,
          500 - board_id % 9 AS ey2, 100 + board_id % 8 AS ex3, 500 + board_id % 10 AS ey3,
          board_id % 3 - 1 AS j0, board_id % 4 - 1 AS j1, group_id % 3 - 1 AS j2,
          CASE WHEN board_id % 17 = 0 THEN 12 ELSE group_id % 5 - 2 END AS j3,
          board_id % 23 <> 0 AS found
        FROM boards""",
    "marks": """
        SELECT board_id, kind, CAST(CASE kind WHEN 'arrow' THEN 1 WHEN 'circle' THEN 2 ELSE 3 END AS BIGINT) AS mark_no,
          CASE WHEN kind = 'arrow' THEN ar * 8 + ac ELSE (board_id * 11) % 64 END AS sq1,
          CASE WHEN kind = 'arrow' THEN br * 8 + bc ELSE (board_id * 13 + 1) % 64 END AS sq2,
          CASE WHEN kind <> 'arrow' THEN NULL WHEN g = 3 THEN 'knight' ELSE 'straight' END AS path,
          CASE WHEN kind = 'arrow' AND g = 3 THEN CASE WHEN board_id % 2 = 0 THEN 'horizontal-first'
               ELSE 'vertical-first' END END AS bend,
          CASE WHEN kind = 'arrow' THEN [0.08, 0.14, 0.22][board_id % 3 + 1] END AS width,
          CASE WHEN board_id % 41 = 0 THEN 0 ELSE 100 + 50 * (board_id % 3) END AS alpha
        FROM (SELECT *, CASE WHEN g = 0 THEN ar
                WHEN g = 3 THEN CASE WHEN ar < 4 THEN ar + 2 ELSE ar - 2 END
                WHEN ar < 4 THEN ar + n ELSE ar - n END AS br,
              CASE WHEN g = 1 THEN ac
                WHEN g = 3 THEN CASE WHEN ac < 4 THEN ac + 1 ELSE ac - 1 END
                WHEN ac < 4 THEN ac + n ELSE ac - n END AS bc
          FROM (SELECT board_id, unnest(list_concat(list_filter(conditions, lambda c: c <> 'clean'),
                  CASE WHEN status = 'P' THEN ['check'] ELSE CAST([] AS VARCHAR[]) END)) AS kind,
                board_id % 4 AS g, 1 + group_id % 4 AS n, (board_id * 7) % 64 // 8 AS ar,
                (board_id * 7) % 8 AS ac FROM boards))""",
    "hashes": """
        SELECT doc_id, sha256(text) AS text_sha,
          sha256(lower(trim(text))) AS norm_sha, sha256(url_part) AS head_sha, lang, source,
          CASE WHEN doc_id % 10 < 7 THEN 'training' WHEN doc_id % 10 < 9 THEN 'validation'
               ELSE 'evaluation' END AS split
        FROM (SELECT *, concat_ws('|', source, lang, CAST(n_chars AS VARCHAR)) AS url_part
              FROM documents)""",
}


NOISE = {"grid": None, "pred_grid": (131, 17, 211, 29), "cand_grid": (137, 19, 223, 31)}


def _grids(names: list[str]):
    """The named grids of a batch of boards: ``Tables._class_at``, ``_source_index`` and ``_noisy`` for 64 cells at once."""
    def run(board: pa.Array, seed: pa.Array, m: pa.Array) -> pa.Array:
        k, s, m = (c.to_numpy(zero_copy_only=False).astype(np.int64)[:, None] for c in (board, seed, m))
        i, symbols = np.arange(64), np.frombuffer(SYMBOLS.encode(), np.uint8)
        src = np.where(m == 38, 63 - i, np.where(m == 39, i % 8 * 8 + 7 - i // 8, i))
        v = np.fmod(s * 7919 + src * (104729 + np.fmod(s, 13) * 31), 1000)
        true, out = np.where(v < 500, 0, 1 + np.fmod(v, 12)), []
        for name in names:
            ids, failed = true, None
            if NOISE[name]:
                a, b, mod, fail = NOISE[name]
                ids, failed = np.where(np.fmod(k * a + i * b, mod) == 0, (true + 5) % 13, true), np.fmod(k[:, 0], fail) == 0
            texts = pa.StringArray.from_buffers(len(k), pa.py_buffer(np.arange(len(k) + 1, dtype=np.int32) * 64),
                                                pa.py_buffer(symbols[ids].tobytes()))
            out.append(texts if failed is None else pc.if_else(pa.array(failed), pa.scalar(None, pa.string()), texts))
        return pa.StructArray.from_arrays(out, names)

    return run


class Tables:
    """Lazy fixture plans over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def literal(self, schema: str, rows: list[tuple]) -> DataFrame:
        """Small fixed table (gates, quotas, scenarios)."""
        return self.spark.createDataFrame(rows, schema)

    @property
    def boards(self) -> DataFrame:
        k, g = F.col("o_orderkey"), F.col("o_custkey")
        m = k % 40

        def split(c: Column) -> Column:
            return (F.when(c % 10 < 7, "training").when(c % 10 < 9, "validation")
                    .otherwise("evaluation"))

        def pick(values, c: Column) -> Column:
            return F.get(literal_array(values), c.cast("int"))

        o = self.orders
        return o.select(
            k.alias("board_id"), g.alias("group_id"), m.alias("m"),
            F.when(m.isin(37, 38, 39), k - m + 36).otherwise(k).alias("seed_key"),
            split(g).alias("split"), split(k).alias("leak_split"),
            F.when(k % 2 == 0, "white-bottom").otherwise("black-bottom").alias("orientation"),
            F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
            F.when(F.col("o_orderstatus") == "F", literal_array(["clean"]))
            .when(k % 3 == 0, literal_array(["arrow"]))
            .when(k % 3 == 1, literal_array(["arrow", "circle"]))
            .otherwise(literal_array(["circle"])).alias("conditions"),
            F.concat_ws("-", pick(["alpha", "beta", "gamma"], k % 3),
                        pick(["brown", "blue", "green"], g % 3),
                        pick(["plain", "carved"], g % 2),
                        pick(["512", "384"], k % 2)).alias("config_id"),
            F.floor(k / 2).alias("pair_id"), F.floor(k / 4).alias("position_id"),
            F.col("o_totalprice").alias("price"),
            (F.col("o_totalprice") / 1000000.0).alias("seconds"))

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """Hash rows by board before the x64 explosion.

        Every later reduction or join on the board then reuses this partitioning, and
        the exchange carries one narrow row per board instead of 64.
        """
        n = max(self.spark.sparkContext.defaultParallelism,
                int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return df.repartition(n, key)

    @staticmethod
    def _class_at(src: Column) -> Column:
        s = F.col("seed_key")
        v = (s * 7919 + src * (104729 + (s % 13) * 31)) % 1000
        return F.when(v < 500, L(0).cast("long")).otherwise(1 + v % 12)

    @staticmethod
    def _source_index(i: Column) -> Column:
        return (F.when(F.col("m") == 38, 63 - i)
                .when(F.col("m") == 39, (i % 8) * 8 + (7 - F.floor(i / 8))).otherwise(i))

    @staticmethod
    def _noisy(c: Column, i: Column, a: int, b: int, mod: int, fail: int) -> Column:
        k = F.col("board_id")
        slip = F.when((k * a + i * b) % mod == 0, 5).otherwise(0)
        return F.when(k % fail == 0, L(-1).cast("long")).otherwise((c + slip) % 13)

    @property
    def cells(self) -> DataFrame:
        """64 rows per board: true, predicted and candidate class ids."""
        return self.cells_by("board_id")

    def cells_by(self, key: str) -> DataFrame:
        """``cells``, dealt out by a column of the board."""
        i = F.col("idx")
        return (self.spread(self.boards, key)
                .select("*", F.explode(literal_array(range(64)).cast("array<bigint>")).alias("idx"))
                .withColumn("class_id", self._class_at(self._source_index(i)))
                .withColumn("pred_id", self._noisy(F.col("class_id"), i, 131, 17, 211, 29))
                .withColumn("cand_id", self._noisy(F.col("class_id"), i, 137, 19, 223, 31))
                .select("board_id", "group_id", "position_id", "split", "leak_split", "orientation",
                        "category", "pair_id", "idx", "class_id", "pred_id", "cand_id", "conditions", "seed_key"))

    def placed(self, *names: str) -> DataFrame:
        """Boards with the named grids (or the placement), no shuffle after ``spread``.

        In a real corpus these are stored columns. Here they come out of a generator, which
        the optimizer does not inline, so they are derived once per row.
        """
        grids = [n for n in ("grid", "pred_grid", "cand_grid") if n in names or n == "grid" and "placement" in names]
        made = F.arrow_udf(_grids(grids), ", ".join(f"{n} string" for n in grids))("board_id", "seed_key", "m")
        rows = self.spread(self.boards, "board_id").select("*", F.inline(F.array(made)))
        if "placement" in names:
            rows = rows.select("*", F.inline(F.array(F.struct(encode_grid("grid").alias("placement")))))
        return rows.select(*self.boards.columns, *names)

    @property
    def placements(self) -> DataFrame:
        return self.placed("grid", "pred_grid", "cand_grid", "placement")

    @property
    def rects(self) -> DataFrame:
        q = F.col("l_quantity").cast("long")
        n, p, s = F.col("l_linenumber").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
        x, y, w = n * 10 + p % 50, s % 40, 200 + p % 50
        return self.lineitem.select(
            (F.col("l_orderkey") * 8 + n).alias("box_id"), F.col("l_orderkey").alias("board_id"),
            F.col("l_returnflag").alias("category"),
            x.alias("x"), y.alias("y"), w.alias("w"), w.alias("h"),
            (x + q % 3).alias("dx"), (y + q % 2).alias("dy"),
            (w + q % 5).alias("dw"), (w - q % 4).alias("dh"), (q % 11 != 0).alias("found"))

    @property
    def quads(self) -> DataFrame:
        k, g = F.col("board_id"), F.col("group_id")

        def n(c) -> Column:
            return (c if isinstance(c, Column) else L(c)).cast("long")

        corners = {
            "ex0": F.when(k % 50 == 0, 500).otherwise(100 + k % 7), "ey0": 100 + k % 5,
            "ex1": F.when(k % 50 == 0, 100).otherwise(500 - k % 11), "ey1": 100 + k % 6,
            "ex2": F.when(k % 37 == 0, 700).otherwise(500 + k % 13), "ey2": 500 - k % 9,
            "ex3": 100 + k % 8, "ey3": 500 + k % 10, "j0": k % 3 - 1, "j1": k % 4 - 1,
            "j2": g % 3 - 1, "j3": F.when(k % 17 == 0, 12).otherwise(g % 5 - 2)}
        return self.spread(self.boards, "board_id").select(
            "board_id", "group_id", "category", "split", n(600).alias("image_w"),
            n(600).alias("image_h"), *[n(c).alias(name) for name, c in corners.items()],
            (k % 23 != 0).alias("found"))

    @property
    def marks(self) -> DataFrame:
        k = F.col("board_id")
        kinds = F.concat(F.filter("conditions", lambda c: c != "clean"),
                         F.when(F.col("status") == "P", literal_array(["check"]))
                         .otherwise(F.array().cast("array<string>")))
        base = self.spread(self.boards, "board_id").select(
            "board_id", F.explode(kinds).alias("kind"), (k % 4).alias("g"),
            (1 + F.col("group_id") % 4).alias("n"), F.floor((k * 7) % 64 / 8).alias("ar"),
            ((k * 7) % 8).alias("ac"))

        def move(c: str, same: int, knight: int) -> Column:
            v, step = F.col(c), F.when(F.col("g") == 3, knight).otherwise(F.col("n"))
            return F.when(F.col("g") == same, v).when(v < 4, v + step).otherwise(v - step)

        arrow = F.col("kind") == "arrow"
        sides = base.withColumn("br", move("ar", 0, 2)).withColumn("bc", move("ac", 1, 1))
        return sides.select(
            "board_id", "kind",
            F.when(arrow, 1).when(F.col("kind") == "circle", 2).otherwise(3).cast("long").alias("mark_no"),
            F.when(arrow, F.col("ar") * 8 + F.col("ac")).otherwise((k * 11) % 64).alias("sq1"),
            F.when(arrow, F.col("br") * 8 + F.col("bc")).otherwise((k * 13 + 1) % 64).alias("sq2"),
            F.when(~arrow, None).when(F.col("g") == 3, "knight").otherwise("straight").alias("path"),
            F.when(arrow & (F.col("g") == 3), F.when(k % 2 == 0, "horizontal-first")
                   .otherwise("vertical-first")).alias("bend"),
            F.when(arrow, F.get(literal_array([0.08, 0.14, 0.22]), (k % 3).cast("int"))).alias("width"),
            F.when(k % 41 == 0, L(0)).otherwise(100 + 50 * (k % 3)).cast("long").alias("alpha"))

    @property
    def hashes(self) -> DataFrame:
        d = F.col("doc_id")
        return self.documents.select(
            d, F.sha2("text", 256).alias("text_sha"),
            F.sha2(F.lower(F.trim("text")), 256).alias("norm_sha"),
            F.sha2(F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string")), 256)
            .alias("head_sha"), "lang", "source",
            F.when(d % 10 < 7, "training").when(d % 10 < 9, "validation")
            .otherwise("evaluation").alias("split"))
