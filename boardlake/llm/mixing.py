"""Temperature mixing of sources, realised as budgeted block permutations.

The token share p of each source is raised to an exponent and normalised. The exponent, between 0 (all
sources alike) and 1 (natural shares), is found by repeated section of its range into a hundred parts: a round
is one aggregation over the sources that sums all candidates at once, so the driver sees sums and never the
sources. The chosen exponent is the smallest multiple of 1e-6 whose entropy is not above the target
and under which no source is read more often than the limit.

Each source then gets ``weight * budget`` tokens. It is read in blocks: a block is a permutation of all its
documents by a hash of seed, block and id, and the last block stops where the budget is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import bounded, stored

GRID = 100


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens): tokens are runs of characters other than ASCII white space."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(
        F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"))


def exponent(sources: DataFrame, budget: float, entropy: float, repeats: float) -> float:
    """The exponent for a stored table (source, tokens) of sources with tokens.

    ``entropy`` is a share of the largest entropy, log(number of sources). Both conditions ease
    as the exponent grows; if even 1 does not meet them, it is 1: natural shares repeat least.
    """
    whole = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return 1.0
    share = F.log(F.col("tokens") / F.lit(float(whole["t"])))
    low, step = 0, 1_000_000
    while step > 1:
        step //= GRID
        grid = [min(1_000_000, low + k * step) for k in range(GRID + 1)]
        tried = sources.select("tokens", share.alias("log_p"), F.explode(F.array(*map(F.lit, grid))).alias("a"))
        power = F.exp(F.col("log_p") * F.col("a") / F.lit(1e6))
        sums = tried.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("log_p")).alias("zl"),
                                      F.max(power * F.lit(budget) / F.col("tokens")).alias("worst"))
        at = F.log("z") - F.col("a") / F.lit(1e6) * F.col("zl") / F.col("z")
        fits = (at <= F.lit(entropy) * F.log(F.lit(float(whole["n"]))) + 1e-12) & (
            F.col("worst") / F.col("z") <= F.lit(repeats) + 1e-9)
        fitting = {r["a"] for r in sums.where(fits).select("a").collect()}
        first = next((a for a in grid if a in fitting), None)
        if first is None:
            return 1.0
        if step == 1:
            return first / 1e6
        low = max(low, first - step)
    return 1.0


def mix(docs: DataFrame, budget: int | None = None, entropy: float = 0.95, repeats: float = 4.0, seed: int = 7,
        bucket_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """Return source, block, position, doc_id, n_tokens: the mixed corpus in order of each source.

    ``budget``: tokens of the mix, by default as many as the corpus has. ``entropy`` and ``repeats``: see
    :func:`exponent`. A document is taken while the tokens before it in its block are below what is left of
    the source's budget, so a source exceeds it by less than one document. Null texts and texts of
    white space have no tokens and cost nothing; a source without any token has no weight and is left out.
    A null source is a source; rows with a null id and repeated rows are documents like any other (equal rows
    stand side by side). Empty tables give an empty result. Other columns are not read. Sources of any size are
    cut into hash buckets, whose token sums are taken first, so no task holds a whole source.
    """
    rows = stored(token_counts(docs, id_col, text_col, source_col), "mix-tokens")
    sources = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).where(
        F.col("tokens") > 0), "mix-sources")
    whole = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.max("docs"), F.lit(0)).alias("d"))
    total, largest = whole.first()
    budget = total if budget is None else budget
    a = exponent(sources, float(budget), entropy, repeats)
    power = F.exp(F.log(F.col("tokens") / F.lit(float(max(total, 1)))) * F.lit(a))
    norm = sources.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    target = F.round(power / F.lit(norm) * F.lit(float(budget))).cast("long")
    plan = stored(sources.select(F.col("source").alias("of"), "tokens", target.alias("target")), "mix-plan")
    blocks = F.ceil(F.col("target") / F.col("tokens")).cast("int")
    dealt = rows.join(bounded(plan), F.col("source").eqNullSafe(F.col("of"))).where(F.col("target") > 0).select(
        "doc_id", "source", "n_tokens", "tokens", "target", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("block").cast("string"),
                               F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    buckets = min(1 << 24, max(1, -(-largest // bucket_rows)))
    lead = F.conv(F.substring("order", 1, 6), 16, 10).cast("long")
    dealt = dealt.withColumn("order", order).withColumn("bucket", F.floor(lead * buckets / (1 << 24)).cast("int"))
    # One struct key: a null source compares equal inside it, and the window, sums and join share its exchange.
    keyed = dealt.withColumn("key", F.struct("source", "block", "bucket"))
    inside = Window.partitionBy("key").orderBy("order", "doc_id", "n_tokens")
    before = Window.partitionBy("key.source", "key.block").orderBy("key.bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = keyed.groupBy("key").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).select(
        "key", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    placed = keyed.withColumn("rank", F.row_number().over(inside)).withColumn("run", F.sum("n_tokens").over(
        inside.rowsBetween(Window.unboundedPreceding, 0))).join(sums, "key")
    spent = F.col("block") * F.col("tokens") + F.col("tokens_before") + F.col("run") - F.col("n_tokens")
    return placed.where(spent < F.col("target")).select(
        "source", F.col("block").cast("int").alias("block"),
        (F.col("rows_before") + F.col("rank")).cast("long").alias("position"),
        F.col("doc_id").alias(id_col), "n_tokens")
