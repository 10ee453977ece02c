"""Pairing, membership and lookup operators (family J).

Nothing here enumerates the pairs of a group: duplicate lookups first reduce the
looked-up side to one row per key, so the output grows with the left side only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions.hashing import bucket_rank, value_bucket
from boardlake.functions.constants import SYMBOLS
from boardlake.functions.placement import literal_array
from boardlake.functions.rules import differs, violations
from boardlake.operators import hamming
from boardlake.session import shared_folder

ONE = "*"  # counted as rows; a name, so importing needs no session


def duplicate_keys(df: DataFrame, key: Sequence[str], example: str) -> DataFrame:
    """Keys that occur more than once, with their count and smallest example."""
    return (df.groupBy(*key).agg(F.count(ONE).alias("n"), F.min(example).alias("first_example"))
            .where("n > 1"))


def join_evidence(predictions: DataFrame, geometry: DataFrame, manifest: DataFrame,
                  appearance: DataFrame, key: str, style_key: str) -> DataFrame:
    """All evidence of each identity, and ``problem``: null, or which side lacks or repeats it.

    Every side is first reduced to one row per key with its count, on the partitioning that the
    joins use, so a repeated id is named and never multiplies; ids of any side are kept.
    """
    def single(df: DataFrame, by: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != by]
        return df.groupBy(by).agg(F.count(ONE).alias(f"_n_{name}"), F.min(F.struct(*rest)).alias(f"_{name}"))

    sides = {"manifest": manifest, "predictions": predictions, "geometry": geometry}
    out = None
    for name, df in sides.items():
        part = single(df, key, name)
        out = part if out is None else out.join(part, key, "full")
    out = out.withColumn(style_key, F.col(f"_manifest.{style_key}")).join(
        single(appearance, style_key, "appearance"), style_key, "left")
    counts = [(name, F.coalesce(f"_n_{name}", F.lit(0))) for name in (*sides, "appearance")]
    problems = F.array_compact(F.array(*[
        F.when(n == 0, f"missing-{name}").when(n > 1, f"repeated-{name}") for name, n in counts]))
    fields = [F.col(f"_{name}.{c}").alias(c) for name, df in {**sides, "appearance": appearance}.items()
              for c in df.columns if c not in (key, style_key)]
    return out.select(key, style_key, *fields, F.nullif(F.array_join(problems, ","), F.lit("")).alias("problem"))


def membership_diff(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys present on one side only; empty when both describe the same ids."""
    left = a.select(*key).distinct().withColumn("_a", F.lit(True))
    right = b.select(*key).distinct().withColumn("_b", F.lit(True))
    return (left.join(right, list(key), "full").where("_a IS NULL OR _b IS NULL")
            .select(*key, F.when(F.col("_b").isNull(), "only-left").otherwise("only-right").alias("side")))


def pair_runs(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], label: str,
              value: str) -> DataFrame:
    """Baseline and candidate values of the same item, with a label-equality flag.

    An item of one run only has no equal label and is named in ``problem``.
    """
    old = baseline.select(*keys, F.col(label), F.col(value).alias("baseline"), F.lit(True).alias("_old"))
    new = candidate.select(*keys, F.col(label).alias("_label"), F.col(value).alias("candidate"), F.lit(True).alias("_new"))
    problem = F.when(F.col("_old").isNull(), "only-candidate").when(F.col("_new").isNull(), "only-baseline")
    same = F.col(label).eqNullSafe(F.col("_label")) & problem.isNull()
    return (old.join(new, list(keys), "full").withColumn("same_label", same).withColumn("problem", problem)
            .withColumn(label, F.coalesce(label, "_label")).drop("_label", "_old", "_new"))


def pair_clean(df: DataFrame, pair: str, is_clean: Column, row_id: str, carry: Sequence[str]) -> DataFrame:
    """Each marked row beside the clean control of its pair.

    The control is the smallest clean id, so the right side has one row per pair and
    a pair with very many variants is only split, never multiplied.
    """
    fields = F.struct(row_id, *carry)
    clean = (df.where(is_clean).groupBy(pair).agg(F.min_by(fields, row_id).alias("_c"))
             .select(pair, F.col("_c").getField(row_id).alias(f"clean_{row_id}"),
                     *[F.col("_c").getField(c).alias(f"clean_{c}") for c in carry]))
    return df.where(~is_clean).select(pair, row_id, *carry).join(clean, pair, "left")


def previous_failures(rows: DataFrame, report: DataFrame, key: str) -> DataFrame:
    return rows.join(report.select(key), key, "left_semi")


def unobserved(plan: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Plan rows whose identity the ledger has never seen."""
    return plan.join(ledger.select(key), key, "left_anti")


def observed(plan: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return plan.join(ledger.select(key), key, "left_semi")


def plan_jobs(positions: DataFrame, group: str, position: str, configs: Sequence[str]) -> DataFrame:
    """Capture jobs: every position in standard size, one per group in compact size.

    The compact position is the (group index mod group size)-th one. Configurations and
    sizes are a fixed list multiplied onto each row; ranks use buckets of the ids, which are
    numbers or strings, so neither a large group nor the list of groups is ordered in one task.
    """
    ranked = bucket_rank(positions.select(group, position), [group], value_bucket(positions, position),
                         [position], out="_r", size="_n")
    groups = bucket_rank(positions.select(group).distinct(), [], value_bucket(positions, group),
                         [group], out="_g")
    chosen = F.col("_r") - 1 == (F.col("_g") - 1) % F.col("_n")
    sizes = F.when(chosen, literal_array(["standard", "compact"])).otherwise(literal_array(["standard"]))
    rows = ranked.join(groups, group).select(group, position, F.explode(sizes).alias("size"))
    named = rows.select("*", F.explode(literal_array(configs)).alias("config"))
    return named.withColumn("batch_id", F.concat_ws("-", F.lit("clean"), "config", "size",
                                                    F.col(group).cast("string")))


def _routes_to(end: int) -> list[tuple[int, str]]:
    """(start, geometry) of every square from which a straight or knight arrow can end on ``end``."""
    found = []
    for start in range(64):
        dx, dy = abs(start % 8 - end % 8), abs(start // 8 - end // 8)
        geometry = ("horizontal" if dx and not dy else "vertical" if dy and not dx else "diagonal" if dx and dx == dy else
                    "knight" if dx * dy == 2 else None)
        if geometry:
            found.append((start, geometry))
    return found


def arrow_routes(df: DataFrame, end: str) -> DataFrame:
    """Every start square from which a straight or knight arrow can end on ``end``.

    The routes of the 64 squares are one small literal, from which each row takes those of its square.
    """
    table = F.from_json(F.lit(json.dumps([[{"start": s, "geometry": g} for s, g in _routes_to(e)] for e in range(64)])),
                        "array<array<struct<start:bigint,geometry:string>>>")
    return df.select("*", F.inline(F.get(table, F.col(end).cast("int"))))


def _hash_keys(df: DataFrame, row_id: str, hashes: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(h).alias("kind"), F.col(h).alias("value")) for h in hashes])
    return df.select(row_id, F.inline(pairs)).where(F.col("value").isNotNull())


def duplicate_matches(a: DataFrame, b: DataFrame, a_id: str, b_id: str,
                      hashes: Sequence[str]) -> DataFrame:
    """Rows of ``a`` that share any hash with ``b``: matching kinds, matches, first match.

    ``b`` is reduced to (count, smallest id) per hash before the join.
    """
    right = (_hash_keys(b, b_id, hashes).groupBy("kind", "value")
             .agg(F.count(ONE).alias("_n"), F.min(b_id).alias("_first")))
    hits = _hash_keys(a, a_id, hashes).join(right, ["kind", "value"])
    return hits.groupBy(a_id).agg(
        F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("matched_by"),
        F.sum("_n").alias("matches"), F.min("_first").alias("first_match"))


def nearest_position(sessions: DataFrame, samples: DataFrame, session_id: str, sample_id: str,
                     grid: str, block: int = 2000, sample_block: int = 8000) -> DataFrame:
    """Fewest differing squares from each session grid to any sample grid, and its ties.

    Samples are reduced to distinct grids. Sessions whose grid occurs there are settled by an
    equi-join (distance 0), those with a grid in up to seven other squares by equal segments
    (:mod:`boardlake.operators.hamming`), radius by radius. What is left is proved to be farther than that, where segments of
    few squares would select nearly every pair; it is dealt into blocks by hash, and each block of one side meets each
    block of the distinct samples once, in its own task row, as one matrix product that returns one row for each
    of its session grids. Nothing passes through the driver but counts.
    """
    distinct = _stored(samples.groupBy(grid).agg(F.count(ONE).alias("_n"), F.min(sample_id).alias("_first")), "nearest-samples")
    wanted = sessions.select(session_id, grid)
    exact = wanted.join(distinct, grid).select(
        session_id, F.lit(0).cast("long").alias("distance"), F.col("_n").alias("nearest_samples"),
        F.col("_first").alias("first_nearest"))
    open_grids = _stored(wanted.join(distinct.select(grid), grid, "left_anti").select(grid).distinct(), "nearest-open")
    known, near = hamming.prepared(distinct, grid), []
    for count in hamming.SEGMENTS:
        found = _stored(hamming.near_grids(hamming.prepared(open_grids, grid), known, grid, count), "nearest-found")
        if not found.isEmpty():
            near.append(found)
            open_grids = _stored(open_grids.join(found.select(grid).distinct(), grid, "left_anti"), "nearest-open")
    rows = max(1, -(-open_grids.count() // block))
    columns = max(1, -(-distinct.count() // sample_block))
    left = open_grids.groupBy(F.pmod(F.xxhash64(grid), F.lit(rows)).cast("long").alias("i")).agg(
        F.collect_list(grid).alias("asked")).select("*", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
    right = distinct.groupBy(F.pmod(F.xxhash64(grid), F.lit(columns)).cast("int").alias("j")).agg(
        F.collect_list(F.struct(F.col(grid).alias("g"), "_n", "_first")).alias("s")).select(
        "j", F.col("s.g").alias("grids"), F.col("s._n").alias("counts"), F.col("s._first").alias("firsts"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("i"))
    cells = left.repartition(min(rows * columns, 100_000), "i", "j").join(right, ["i", "j"]).select("asked", "grids", "counts", "firsts")
    kind = samples.schema[sample_id].dataType.simpleString()
    best = cells.mapInPandas(_nearest_in_cells, f"{grid} string, distance long, n long, first {kind}")
    for found in near:
        best = best.unionByName(found)
    ties = best.groupBy(grid, "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    found = ties.groupBy(grid).agg(F.min(F.struct("distance", "n", "first")).alias("b"))
    rest = wanted.join(found, grid).select(session_id, F.col("b.distance").alias("distance"),
                                           F.col("b.n").alias("nearest_samples"), F.col("b.first").alias("first_nearest"))
    return exact.unionByName(rest)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _one_hot(grids) -> np.ndarray:
    symbols = np.frombuffer("".join(grids).encode(), dtype=np.uint8).reshape(len(grids), 64)
    alphabet = np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)
    return (symbols[:, :, None] == alphabet).reshape(len(grids), -1).astype(np.float32)


def _nearest_in_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            asked, counts, firsts = _one_hot(row.asked), np.asarray(row.counts), np.asarray(row.firsts)
            known = _one_hot(row.grids)
            out = []
            for a in range(0, len(asked), 256):
                distance = 64 - (asked[a:a + 256] @ known.T).astype(np.int64)
                low = distance.min(axis=1)
                hit = distance == low[:, None]
                out += [(g, d, int(counts[h].sum()), firsts[h].min()) for g, d, h in zip(row.asked[a:a + 256], low.tolist(), hit)]
            yield pd.DataFrame(out, columns=[0, 1, 2, 3])


def inheritance_violations(child: DataFrame, parent: DataFrame, child_id: str, parent_ref: str,
                           parent_id: str, fields: Sequence[str],
                           crop: Sequence[str] = (), size: Sequence[str] = (), grid: Sequence[str] = ()) -> DataFrame:
    """Fields a variant does not share with its parent; unknown or own parent.

    A cropped variant names its ``crop`` (left, top, right, bottom in the parent's image), its image ``size`` (width,
    height, also the parent's columns) and its ``grid`` box (left, top, right, bottom, also the parent's): the crop lies
    in the parent, its size is the variant's, and the grid moves with it. Rows without a crop are not cropped.
    """
    fields, own = list(fields), [*size, *grid]
    shared = fields
    right = parent.select(F.col(parent_id).alias("_pid"), *[F.col(f).alias(f"_p_{f}") for f in dict.fromkeys([*fields, *own])])
    j = child.join(right, F.col(parent_ref) == F.col("_pid"), "left")
    known = F.col("_pid").isNotNull()
    rules = {"parent": ~known | (F.col(parent_ref) == F.col(child_id))}
    rules.update({f: known & differs(f, f"_p_{f}") for f in shared})
    if crop:
        left, top, right_, bottom = (F.col(c) for c in crop)
        cropped = known & left.isNotNull()
        width, height = (F.col(c) for c in size)
        rules["crop"] = cropped & ~((left >= 0) & (top >= 0) & (left < right_) & (top < bottom)
                                    & (right_ <= F.col(f"_p_{size[0]}")) & (bottom <= F.col(f"_p_{size[1]}")))
        rules["size"] = cropped & ((width != right_ - left) | (height != bottom - top))
        moved = F.lit(False)
        for c, shift in zip(grid, (left, top, left, top)):
            moved = moved | (F.col(c) != F.col(f"_p_{c}") - shift)
        rules["grid"] = cropped & moved
    return violations(j, [child_id], rules)


def map_diff(a: DataFrame, b: DataFrame, key: str, values: str, ignore: Sequence[str]) -> DataFrame:
    """Map entries that differ between two plans of the same id, ignoring some names."""
    def entries(df: DataFrame, out: str) -> DataFrame:
        return (df.select(key, F.explode(values).alias("name", out))
                .where(~F.col("name").isin(*ignore)))
    j = entries(a, "left_value").join(entries(b, "right_value"), [key, "name"], "full")
    return j.where(differs("left_value", "right_value"))


def result_parity(a: DataFrame, b: DataFrame, key: str, placement: str, code: str) -> DataFrame:
    """Successes must agree exactly; failures must carry the same code."""
    right = b.select(key, F.col(placement).alias("_p"), F.col(code).alias("_c"), F.lit(True).alias("_r"))
    j = a.select(key, placement, code, F.lit(True).alias("_l")).join(right, key, "full")
    problem = (F.when(F.col("_l").isNull(), "missing-left").when(F.col("_r").isNull(), "missing-right")
               .when(F.col(placement).isNotNull() & F.col("_p").isNotNull()
                     & (F.col(placement) != F.col("_p")), "placement")
               .when(F.col(placement).isNull() != F.col("_p").isNull(), "status")
               .when(F.col(placement).isNull() & differs(code, "_c"), "code"))
    return j.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


