"""From documents to a training mix: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. All but the last return the
columns of ``documents``. ``n_chars`` follows the text where a stage shortens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm import decontaminate, line_dedup, mixing, near_copies, quality
from boardlake.llm.common import own_column, stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject; it is fitted on labelled rows of ``docs``.

    Null and empty texts are scored like others. Without labels of both classes nothing is rejected.
    """
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.train(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier one has; those left without a word go.

    Null and empty texts and rows with a null id stay; equal rows are one document. An empty table stays empty.
    """
    lines, deleted = own_column(docs, "n_lines"), own_column(docs, "n_deleted")
    out = line_dedup.dedup_lines(docs, counts=(lines, deleted))
    shorter = F.col(deleted) > 0
    out = out.where(~(shorter & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(shorter, F.length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, similarity of 0.8 or more) the row with the smallest id.

    Null texts count as empty, and texts without words as copies of each other; null ids come last. Rows are judged
    one by one, of equal rows one stays, and an empty table stays empty.
    """
    return near_copies.keep_one(docs).select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark passages.

    Each row is judged by its own text; null and empty texts are clean. An empty table stays empty.
    """
    return decontaminate.drop_contaminated_rows(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The reading order of the mix: source, block, position, doc_id, n_tokens.

    Null texts have no tokens; repeated rows are placed each. An empty table gives an empty mix.
    """
    return mixing.mix(docs)


STAGES = [("quality classifier", good_documents), ("line dedup", without_repeated_lines),
          ("near duplicates", without_near_duplicates), ("decontamination", without_benchmarks),
          ("source mixing", mixed_sources)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
