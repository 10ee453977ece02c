"""Dataset scans and sinks: manifests, split indexes, cell tensors, publishing, inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.functions.constants import CELLS, SPLITS

MANIFESTS = {
    "positions": "dataset_id string, group struct<group_id:bigint,split:string>, positions array<struct<"
                 "position_id:bigint,ply:bigint,piece_placement:string,categories:array<string>>>",
    "batch": "batch_id string, recipe string, samples array<struct<sample_id:bigint,provenance:string,split:string,"
             "image:string,conditions:array<string>>>",
}
NESTED = {"positions": "positions", "batch": "samples"}


def read_manifest(spark: SparkSession, path: str, kind: str, multi_line: bool = False) -> DataFrame:
    """Fixed nested schema, fail-fast, exploded to one row per entry."""
    raw = (spark.read.schema(MANIFESTS[kind]).option("mode", "FAILFAST")
           .option("multiLine", str(multi_line).lower()).json(path))
    nested = NESTED[kind]
    outer = [c for c in raw.columns if c != nested]
    return raw.select(*outer, F.inline(nested))


def read_index(spark: SparkSession, path: str, schema: str, split: str) -> DataFrame:
    """One split of a partitioned JSON-lines index; other splits are never opened."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).where(F.col("split") == split)


def read_cells(spark: SparkSession, path: str, split: str, length: int,
               selected: DataFrame | None = None) -> DataFrame:
    """Cell rows of one split with a shape flag, optionally only the selected (board, cell) rows.

    Selected cells are reduced to one bit mask for each board and block of 64 indexes. Their number is unknown before
    they are made, and an estimate may take millions for few, so the join is never left to a broadcast.
    """
    cells = spark.read.parquet(path).where(F.col("split") == split).withColumn("valid", F.coalesce(
        (F.size("px") == length) & F.col("idx").between(0, CELLS - 1) & F.col("class_id").between(0, 12), F.lit(False)))
    if selected is None:
        return cells
    block, bit = F.floor(F.col("idx") / CELLS), F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod("idx", F.lit(CELLS)).cast("int"))
    masks = selected.where(F.col("idx").isNotNull()).select("board_id", block.alias("_block"), bit.alias("_bit")).groupBy(
        "board_id", "_block").agg(F.bit_or("_bit").alias("_mask")).hint("shuffle_hash")
    return (cells.withColumn("_block", block).join(masks, ["board_id", "_block"])
            .where(F.col("_mask").bitwiseAND(bit) != 0).drop("_block", "_mask"))


def publish(df: DataFrame, path: str, partition_by: Sequence[str], file_rows: int = 5_000_000,
            file_format: str = "parquet") -> None:
    """Write once: an existing destination is refused and ``_SUCCESS`` marks the commit.

    A partition may hold most rows, so rows are not gathered per partition value; the
    writer only bounds the rows per file.
    """
    (df.write.mode("errorifexists").option("maxRecordsPerFile", file_rows)
     .partitionBy(*partition_by).format(file_format).save(path))


def published_counts(spark: SparkSession, path: str, split: str = "split") -> DataFrame:
    return spark.read.parquet(path).groupBy(split).agg(F.count("*").alias("boards"))


def inventory(stages: DataFrame, failed: Column, text: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Failure rows as strings, arrays joined by ``; ``."""
    joined = [F.array_join(c, "; ").alias(c) for c in lists]
    return stages.where(failed).select(*[F.col(c).cast("string").alias(c) for c in text], *joined)


def export_inventory(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)
