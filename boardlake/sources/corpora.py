"""Corpus assembly: resumable batches, caches, merges, additions and review drafts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions.rules import differs

ONE = "*"


def recipe_hash(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def pending_batches(plan: DataFrame, published: DataFrame, batch: str, recipe: str) -> DataFrame:
    """Each planned batch: pending, published with the same recipe, or a recipe conflict."""
    done = published.groupBy(batch).agg(F.min(recipe).alias("_r1"), F.max(recipe).alias("_r2"),
                                        F.lit(True).alias("_done"))
    j = plan.join(done, batch, "left")
    state = (F.when(F.col("_done").isNull(), "pending")
             .when(differs(recipe, "_r1") | differs(recipe, "_r2"), "recipe-conflict").otherwise("published"))
    return j.select(batch, state.alias("state"))


def signature(*cols: str) -> Column:
    """Content signature of a request: canonical JSON of the sorted fields, hashed."""
    return recipe_hash(*cols)


def uncached(requests: DataFrame, results: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Requests whose signature has no stored result."""
    return (requests.withColumn("signature", signature(*cols))
            .join(results.select("signature"), "signature", "left_anti"))


def with_style(df: DataFrame, config: str) -> DataFrame:
    """Back-fill the style struct from platform-board-pieces-size where it is missing."""
    part = F.split(config, "-")
    style = F.struct(part[0].alias("platform"), part[1].alias("background"), part[2].alias("pieces"),
                     F.concat_ws("/", part[0], part[1], part[2]).alias("combination"))
    return df.withColumn("style", F.coalesce("style", style) if "style" in df.columns else style)


def merge_corpora(parent: DataFrame, addition: DataFrame, config: str, held_out: Sequence[str]) -> DataFrame:
    """Both corpora with cohort, style and the held-out flag."""
    both = (with_style(parent, config).withColumn("cohort", F.lit("previous")).unionByName(
        with_style(addition, config).withColumn("cohort", F.lit("expansion")), allowMissingColumns=True))
    return both.withColumn("generalization", F.col("style.combination").isin(*held_out))


def refused_additions(base: DataFrame, extra: DataFrame, split: str, ref: str, base_id: str) -> DataFrame:
    """Added rows that are not training rows, or whose source is no training row of ``base``."""
    sources = base.where(F.col(split) == "training").select(F.col(base_id).alias(ref)).distinct().withColumn(
        "_known", F.lit(True))
    j = extra.join(sources, ref, "left")
    return j.withColumn("problem", F.when(~F.col(split).eqNullSafe("training"), "split").when(
        F.col("_known").isNull(), "source")).where(F.col("problem").isNotNull()).drop("_known")


def append_training(base: DataFrame, extra: DataFrame, split: str, ref: str, base_id: str) -> DataFrame:
    """Base rows unchanged plus training variants of existing training rows.

    One row that :func:`refused_additions` names refuses the whole set.
    """
    refused = refused_additions(base, extra, split, ref, base_id).groupBy("problem").agg(F.count("*").alias("n")).collect()
    if refused:
        raise ValueError("additions refused: " + ", ".join(sorted(f"{r.problem} {r.n}" for r in refused)))
    return (base.withColumn("added", F.lit(False))
            .unionByName(extra.withColumn("added", F.lit(True)), allowMissingColumns=True))


def reviewed_imports(batches: DataFrame, provenance: str = "reviewed-real-use") -> DataFrame:
    """Samples of published batches that come from reviewed real use."""
    if "samples" in batches.columns:
        outer = [c for c in batches.columns if c != "samples"]
        batches = batches.select(*outer, F.inline("samples"))
    return batches.where(F.col("provenance") == provenance)


def partition_members(samples: DataFrame, group: str, sample: str, category: str, game: str) -> DataFrame:
    """Group members as rows: every sample once, every observed game id once.

    Rows instead of lists, so a group of any size stays distributed.
    """
    pairs = F.array(F.struct(F.lit("sample").alias("kind"), F.col(sample).cast("string").alias("value")),
                    F.struct(F.lit("game").alias("kind"), F.concat(
                        F.col(category), F.lit(":"), F.nullif(F.col(game).cast("string"), F.lit(""))).alias("value")))
    return samples.select(group, F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def partition_plan(members: DataFrame, group: str) -> DataFrame:
    """One row per group: counts of samples and observed games."""
    return members.groupBy(group).agg(
        F.count_if(F.col("kind") == "sample").alias("samples"), F.count_if(F.col("kind") == "game").alias("games"))


def review_draft(samples: DataFrame, sample: str, group: str, split: str, conditions: str,
                 aliases: Mapping[str, str]) -> DataFrame:
    """Pending review rows: renamed conditions, split frozen by group, labels left null."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    frozen = (F.when(F.col(split) == "evaluation", "evaluation")
              .when(F.col(group).endswith("-003"), "validation").otherwise("training"))
    return samples.select(
        F.concat(F.lit("real-"), F.col(sample).cast("string")).alias("position_id"),
        F.concat(F.lit("real-"), F.col(group)).alias("group_id"), frozen.alias("split"),
        F.transform(conditions, lambda c: F.coalesce(F.try_element_at(table, c), c)).alias("conditions"),
        F.lit(None).cast("string").alias("piece_placement"), F.lit(None).cast("string").alias("orientation"),
        F.lit(False).alias("reviewed"))


