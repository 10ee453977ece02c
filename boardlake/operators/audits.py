"""Integrity constraints and leakage audits (family C).

Each audit returns the violating rows, so an empty result means the corpus is clean.
Keys are reduced with partial aggregation before any join; the looked-up side is one
row per key, so a key held by a third of the corpus never multiplies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.functions.constants import BACKGROUNDS, MARK_KINDS, N_CLASSES, SPLITS
from boardlake.functions.placement import background, literal_array, square_index
from boardlake.functions.rules import differs, violations
from boardlake.operators.joins import _stored, nearest_position

ONE = "*"  # counted as rows; a name, so importing needs no session


def unpivot(df: DataFrame, keep: Sequence[str], kinds: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """(kind, value) rows for the named columns; unknown (null) values are dropped.

    A kind may name several columns: they share one namespace, so a value in any of them meets the
    same value in any other. A row gives each (kind, value) once.
    """
    named = [(k, c) for k, cols in kinds.items() for c in ([cols] if isinstance(cols, str) else cols)]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in named])
    if len(named) > len(kinds):
        pairs = F.array_distinct(pairs)
    return df.select(*keep, F.inline(pairs)).where(F.col("value").isNotNull())


def split_leaks(df: DataFrame, split: str, kinds: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Keys seen in more than one partition."""
    return (unpivot(df, [split], kinds).groupBy("kind", "value")
            .agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"),
                 F.count(ONE).alias("rows"))
            .where(F.col("splits").contains(",")))


def fd_violations(df: DataFrame, lhs: Sequence[str], rhs: Sequence[str]) -> DataFrame:
    """Left-hand keys with more than one right-hand combination."""
    combos = df.groupBy(*lhs, *rhs).agg(F.count(ONE).alias("_n"))
    return (combos.groupBy(*lhs).agg(F.count(ONE).alias("variants"), F.sum("_n").alias("rows"))
            .where("variants > 1"))


def first_examples(df: DataFrame, by: Sequence[str], example: str, k: int = 3) -> DataFrame:
    """The k smallest examples per key as sorted text; Spark prunes to k before the exchange."""
    w = Window.partitionBy(*by).orderBy(example)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return (top.groupBy(*by).agg(F.array_sort(F.collect_list(example)).alias("_e"))
            .select(*by, F.array_join(F.transform("_e", lambda v: v.cast("string")), ",").alias("examples")))


def overlap_audit(train: DataFrame, reserved: DataFrame, row_id: str,
                  kinds: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Training rows sharing any identity with reserved data, with three reserved examples.

    ``row_id`` is unique. A reserved key keeps three rows before the exchange, however many
    rows hold it. A row with two shared values of one kind is returned for each of them.
    """
    right = first_examples(unpivot(reserved, [row_id], kinds), ["kind", "value"], row_id)
    left = unpivot(train, [row_id], kinds)
    return left.join(right, ["kind", "value"]).select(row_id, "kind", "examples")


def augmentation_violations(base: DataFrame, extra: DataFrame, base_id: str, ref: str, row_id: str,
                            split: str, digest: str, ref_digest: str,
                            identity: Sequence[str]) -> DataFrame:
    """Added variants must come from a training image, unchanged in bytes and identity."""
    source = base.select(F.col(base_id).alias("_sid"), F.col(split).alias("_split"),
                         F.col(digest).alias("_sha"), *[F.col(c).alias(f"_s_{c}") for c in identity])
    j = extra.join(source, F.col(ref) == F.col("_sid"), "left")
    known = F.col("_sid").isNotNull()
    rules = {"source": ~known,
             "split": known & ((F.col("_split") != "training") | (F.col(split) != "training")),
             "pixels": known & differs(ref_digest, "_sha")}
    rules.update({c: known & differs(c, f"_s_{c}") for c in identity})
    return violations(j, [row_id], rules)


def reservation_violations(df: DataFrame, reserved: DataFrame, keys: Sequence[str], combination: str,
                           split: str) -> DataFrame:
    """Reserved style combinations outside evaluation."""
    return (df.join(reserved.select(combination), combination, "left_semi")
            .where(F.col(split) != "evaluation").select(*keys, combination, split))


def addition_violations(old: DataFrame, new: DataFrame, row_id: str, split: str, group: str,
                        family: str, digest: str | Sequence[str], identity: Sequence[str]) -> DataFrame:
    """New training rows that touch reserved groups, families or bytes, or repeat a variant.

    ``digest`` may name several file hashes, which share one namespace.
    """
    kinds = {"group": group, "family": family, "hash": digest}
    reserved = unpivot(old.where(F.col(split) != "training"), [], kinds).distinct()
    hits = (unpivot(new, [row_id], kinds).join(reserved, ["kind", "value"], "left_semi")
            .select(row_id, F.col("kind").alias("problem")).distinct())
    both = (old.select(*identity, F.lit(0).alias("_new"))
            .unionByName(new.select(*identity, F.lit(1).alias("_new"))))
    doubled = both.groupBy(*identity).agg(F.count(ONE).alias("_n")).where("_n > 1")
    again = new.join(doubled, list(identity), "left_semi").select(row_id, F.lit("identity").alias("problem"))
    return hits.unionByName(again)


def detection_reservation(df: DataFrame, refs: DataFrame, row_id: str, digest: str, platform: str,
                          group: str, split: str, box: str) -> DataFrame:
    """Images and games reserved by detection keep their group, platform, box and split.

    References are reduced per hash and per (platform, group); the OR becomes two
    equi-joins.
    """
    held = F.bool_or(F.col(split) == "evaluation")
    source = F.concat_ws("|", platform, group)
    by_hash = refs.groupBy(digest).agg(
        F.min(source).alias("_s1"), F.max(source).alias("_s2"), F.min(box).alias("_b1"),
        F.max(box).alias("_b2"), held.alias("_h1"))
    by_game = refs.groupBy(platform, group).agg(held.alias("_h2"))
    j = df.join(by_hash, digest, "left").join(by_game, [platform, group], "left")
    same = F.col("_s1").isNotNull()
    return violations(j, [row_id], {
        "source": same & ((F.col("_s1") != source) | (F.col("_s2") != source)),
        "held-out": (F.coalesce("_h1", F.lit(False)) | F.coalesce("_h2", F.lit(False)))
        & (F.col(split) != "evaluation"),
        "bounds": same & ((F.col("_b1") != F.col(box)) | (F.col("_b2") != F.col(box)))})


def external_violations(df: DataFrame, corpus: DataFrame, row_id: str, identities: Sequence[str],
                        prefix: str, split: str, splits: Sequence[str], family: str) -> DataFrame:
    """Reviewed external positions: own namespace, frozen split, family unknown elsewhere."""
    known = corpus.select(family).distinct().withColumn("_known", F.lit(True))
    j = df.join(known, family, "left")
    pattern = f"^{prefix}[a-z0-9][a-z0-9_-]{{0,58}}$"
    named = [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in identities]
    bad = ~named[0]
    for ok in named[1:]:
        bad = bad | ~ok
    return violations(j, [row_id], {
        "namespace": bad, "split": ~F.coalesce(F.col(split).isin(*splits), F.lit(False)),
        "family": F.col("_known").isNotNull()})


def game_identity(initial: Column, moves: Column) -> Column:
    """SHA-256 of the canonical JSON of a move list."""
    return F.sha2(F.to_json(F.struct(initial.alias("initialPosition"), moves.alias("moves"))), 256)


def consume(plan: DataFrame, ledger: DataFrame, identity: str) -> DataFrame:
    """Distinct plan identities, each ``new`` (to append) or ``consulted``."""
    seen = ledger.select(identity).distinct().withColumn("_seen", F.lit(True))
    return (plan.groupBy(identity).agg(F.count(ONE).alias("rows")).join(seen, identity, "left")
            .select(identity, "rows", F.when(F.col("_seen"), "consulted").otherwise("new").alias("status")))


def coverage_gaps(cells: DataFrame, split: str, class_id: str, idx: str, group: str, minimum: int,
                  warn_squares: int = 5, warn_groups: int = 3, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Split x class x colour combinations under the minimum, or thin enough to warn.

    Every split of ``splits`` is reported, also one without any row; so is an unknown one.
    """
    by = [split, class_id, "background"]
    counts = (cells.groupBy(split, class_id, background(idx).alias("background"), group)
              .agg(F.count(ONE).alias("_n"))
              .groupBy(*by).agg(F.sum("_n").alias("squares"), F.count(ONE).alias("groups")))
    full = full_grid(cells, {split: splits}, class_id).join(counts, by, "full").na.fill(0, ["squares", "groups"])
    level = (F.when(F.col("squares") < minimum, "insufficient")
             .when((F.col("squares") < warn_squares) | (F.col("groups") < warn_groups), "warning"))
    return full.withColumn("level", level).where(F.col("level").isNotNull())


def full_grid(df: DataFrame, dims: Mapping[str, Sequence[str]], class_id: str) -> DataFrame:
    """Every combination of the listed values, class and square colour: a table of fixed size."""
    grid = df.sparkSession.range(1).select(F.explode(literal_array(range(N_CLASSES)).cast("array<bigint>")).alias(class_id))
    for name, values in {"background": BACKGROUNDS, **dims}.items():
        grid = grid.select("*", F.explode(literal_array(values)).alias(name))
    return grid


def missing_colours(df: DataFrame, split: str, colour: Column, splits: Sequence[str] = SPLITS,
                    colours: Sequence[str] = ("white", "black")) -> DataFrame:
    """Splits without a promotion of some colour; ``colour`` is null for other rows."""
    seen = df.select(F.col(split), colour.alias("colour")).where(F.col("colour").isNotNull()).distinct()
    grid = df.sparkSession.range(1).select(F.explode(literal_array(splits)).alias(split)).select(
        "*", F.explode(literal_array(colours)).alias("colour"))
    return grid.join(seen, [split, "colour"], "left_anti")


def group_composition(df: DataFrame, groups: DataFrame, group: str, category: str,
                      required: Sequence[str], size: int) -> DataFrame:
    """Groups without exactly ``size`` samples, one per required category; unused groups."""
    counts = df.groupBy(group).agg(
        F.count(ONE).alias("samples"),
        *[F.count_if(F.col(category) == c).alias(f"n{i}") for i, c in enumerate(required)])
    j = groups.select(group).distinct().join(counts, group, "left")
    wrong = F.lit(False)
    for i in range(len(required)):
        wrong = wrong | (F.col(f"n{i}") != 1)
    used = F.col("samples").isNotNull()
    return violations(j, [group], {"unused": ~used, "size": used & (F.col("samples") != size),
                                   "categories": used & wrong})


def box_violations(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str, h: str,
                   image_w: Column, image_h: Column, min_side: int, pixels: float = 1) -> DataFrame:
    """Box inside its image, square to ``pixels`` and not too small; a box without a number breaks all."""
    cx, cy, cw, ch = (F.col(c) for c in (x, y, w, h))
    return violations(df, keys, {
        "outside": (cx < 0) | (cy < 0) | (cx + cw > image_w) | (cy + ch > image_h),
        "small": F.least(cw, ch) < min_side,
        "not-square": F.abs(cw - ch) > pixels})


def corner_violations(df: DataFrame, keys: Sequence[str], corners: Sequence[tuple[str, str]],
                      image_w: Column, image_h: Column) -> DataFrame:
    """TL, TR, BR, BL corners: inside the image, convex clockwise, in image order."""
    pts = [(F.col(a), F.col(b)) for a, b in corners]
    outside, turn = F.lit(False), F.lit(False)
    for px, py in pts:
        outside = outside | (px < 0) | (py < 0) | (px > image_w) | (py > image_h)
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = pts[i], pts[(i + 1) % 4], pts[(i + 2) % 4]
        turn = turn | ((bx - ax) * (cy - by) - (by - ay) * (cx - bx) <= 0)
    (tlx, tly), (trx, try_), (brx, bry), (blx, bly) = pts
    order = ~((tlx < trx) & (blx < brx) & (tly < bly) & (try_ < bry))
    return violations(df, keys, {"outside": outside, "not-convex": turn, "order": order})


def grid_line_violations(df: DataFrame, keys: Sequence[str], lines: str, start: Column,
                         stop: Column) -> DataFrame:
    """Exactly seven interior lines, each within one pixel of its even position."""
    off = F.exists(F.transform(lines, lambda v, i: F.abs(v - (start + (i + 1) * (stop - start) / 8)) > 1),
                   lambda bad: bad)
    return violations(df, keys, {"count": F.size(lines) != 7, "alignment": off})


def clip_violations(df: DataFrame, keys: Sequence[str], box: Sequence[str], grid: Sequence[str],
                    image_w: Column, image_h: Column) -> DataFrame:
    """The visible box must be the nominal grid clipped to the image."""
    l, t, r, b = (F.col(c) for c in box)
    gl, gt, gr, gb = (F.col(c) for c in grid)
    zero = F.lit(0).cast("long")
    return violations(df, keys, {
        "clip": (l != F.greatest(zero, gl)) | (t != F.greatest(zero, gt))
        | (r != F.least(image_w, gr)) | (b != F.least(image_h, gb)),
        "empty": (l >= r) | (t >= b)})


def stale_inputs(actual: DataFrame, frozen: DataFrame, path: str, digest: str) -> DataFrame:
    """Paths whose content hash is missing, unexpected or changed."""
    j = actual.select(path, F.col(digest).alias("_now")).join(
        frozen.select(path, F.col(digest).alias("_then")), path, "full")
    problem = (F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "unexpected")
               .when(F.col("_now") != F.col("_then"), "changed"))
    return j.select(path, problem.alias("problem")).where(F.col("problem").isNotNull())


def review_fingerprint(fields: Sequence[str]) -> Column:
    """Hash of the sorted fields a visual approval is bound to."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])), 256)


def stale_reviews(df: DataFrame, keys: Sequence[str], fields: Sequence[str], recorded: str) -> DataFrame:
    return df.where(differs(review_fingerprint(fields), recorded)).select(*keys)


def intake_violations(df: DataFrame, keys: Sequence[str], status: str, placement: str, reviewer: str,
                      method: str, source_digest: str, digest: str) -> DataFrame:
    """Label status rules: transcriptions are reviewed and bound to bytes, others have none."""
    done = F.col(status).eqNullSafe("visual-transcription")
    undone = F.coalesce(F.col(status).isin("pending", "ambiguous"), F.lit(False))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return violations(df, keys, {
        "status": ~F.col(status).isin("visual-transcription", "pending", "ambiguous"),
        "label-without-review": undone & F.col(placement).isNotNull(),
        "missing-label": done & F.col(placement).isNull(),
        "reviewer": done & (blank(reviewer) | (F.col(method) != "visual-board-review")),
        "stale-source": done & differs(source_digest, digest)})


def intake_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows per value of each dimension, and in total, in one aggregation."""
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")),
                    *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                      for d in dims])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(ONE).alias("n"))


def repeated_values(df: DataFrame, value: str, row_id: str, k: int = 3) -> DataFrame:
    """Values that occur more than once with their count and first examples."""
    rows = df.where(F.col(value).isNotNull()).select(value, row_id)
    many = rows.groupBy(value).agg(F.count(ONE).alias("n")).where("n > 1")
    return many.join(first_examples(rows, [value], row_id, k), value)


def mark_violations(marks: DataFrame, cells: DataFrame, board: str, mark: str, kind: str, squares: str,
                    rgba: str, path: str, bend: str, width: str, start: str, end: str) -> DataFrame:
    """Overlay rules: kinds, squares of each kind, kings under a check mark, colour, arrow geometry.

    ``squares`` is the list of square names of a box mark; a last move has two, a selection one, a check at
    most two, all of them kings. ``start`` and ``end`` are the indexes of an arrow. A king is looked up once for
    each square of a check mark, before the marks are judged.
    """
    arrow = F.col(kind).eqNullSafe("arrow")
    n = F.size(squares)
    named = F.coalesce((n > 0) & F.forall(squares, lambda s: F.coalesce(s.rlike("^[a-h][1-8]$"), F.lit(False)))
                       & (F.size(F.array_distinct(squares)) == n), F.lit(False))
    dx = F.abs(F.col(end) % 8 - F.col(start) % 8)
    dy = F.abs(F.floor(F.col(end) / 8) - F.floor(F.col(start) / 8))
    straight = ((dx > 0) | (dy > 0)) & ((dx == 0) | (dy == 0) | (dx == dy))
    kings = cells.where(F.col("class_id").isin(6, 12)).select(F.col(board).alias("_b"), F.col("idx").alias("_i"))
    asked = marks.where(F.col(kind) == "check").select(board, mark, F.explode(squares).alias("_s")).withColumn(
        "_at", F.when(F.col("_s").rlike("^[a-h][1-8]$"), square_index("_s")))
    off = asked.join(kings, (F.col(board) == F.col("_b")) & (F.col("_at") == F.col("_i")), "left_anti").select(
        board, mark).distinct().withColumn("_off", F.lit(True))
    j = marks.join(off, [board, mark], "left")
    is_kind = lambda k: F.col(kind).eqNullSafe(k)
    return violations(j, [board, mark], {
        "kind": ~F.col(kind).isin("arrow", *MARK_KINDS),
        "squares": ~arrow & (~named | (is_kind("last-move") & (n != 2)) | (is_kind("selection") & (n != 1))
                             | (is_kind("check") & (n > 2))),
        "check": is_kind("check") & F.coalesce("_off", F.lit(False)),
        "path": arrow & F.coalesce(F.when(F.col(path) == "straight", ~straight | F.col(bend).isNotNull())
                                   .when(F.col(path) == "knight", (dx * dy != 2) | F.col(bend).isNull()), F.lit(True)),
        "width": arrow & ~F.coalesce(F.col(width).between(0.04, 0.30), F.lit(False)),
        "colour": ~F.coalesce((F.size(rgba) == 4) & F.forall(rgba, lambda v: F.coalesce(v.between(0, 255), F.lit(False)))
                              & (F.element_at(rgba, -1) > 0), F.lit(False))})


def doubled_kinds(marks: DataFrame, board: str, kind: str) -> DataFrame:
    """A mark kind other than arrows may be used once per board."""
    return (marks.where(F.col(kind) != "arrow").groupBy(board, kind).agg(F.count(ONE).alias("n"))
            .where("n > 1"))


def capture_audit(batch: DataFrame, expected: DataFrame, key: Sequence[str],
                  rules: Mapping[str, Column]) -> DataFrame:
    """Captures against the planned grid: missing, unexpected, doubled, and field rules."""
    want = expected.select(*key).distinct().withColumn("_want", F.lit(True))
    count = batch.groupBy(*key).agg(F.count(ONE).alias("_n"))
    state = want.join(count, list(key), "full")
    grid = violations(state, key, {
        "missing": F.col("_n").isNull(), "unexpected": F.col("_want").isNull(),
        "doubled": F.coalesce("_n", F.lit(0)) > 1})
    return grid.unionByName(violations(batch, key, rules))


def duplicate_archives(df: DataFrame, digest: str, source: str, row_id: str) -> DataFrame:
    """Archives that occur more than once, over how many sources, and the first holder."""
    per = df.groupBy(digest, source).agg(F.count(ONE).alias("_n"), F.min(row_id).alias("_f"))
    return (per.groupBy(digest).agg(F.sum("_n").alias("n"), F.count(ONE).alias("sources"),
                                    F.min("_f").alias("first_row")).where("n > 1"))


def later_duplicates(df: DataFrame, digest: str, row_id: str) -> DataFrame:
    """Every repeat after the first holder, without ordering a group in one task."""
    first = df.groupBy(digest).agg(F.min(row_id).alias("_f"), F.count(ONE).alias("_n")).where("_n > 1")
    return (df.select(row_id, digest).join(first, digest).where(F.col(row_id) != F.col("_f"))
            .select(row_id, F.col("_f").alias("first_row")))


def session_membership(images: DataFrame, listing: DataFrame, image: str, session: str,
                       kind: str) -> DataFrame:
    """Every image is listed by exactly one session, its own, under its own kind."""
    listed = listing.groupBy(image).agg(
        F.count(ONE).alias("_n"), F.min(session).alias("_s1"), F.max(session).alias("_s2"),
        F.min(kind).alias("_k1"), F.max(kind).alias("_k2"))
    j = images.select(image, session, kind, F.lit(True).alias("_img")).join(listed, image, "full")
    both = F.col("_img").isNotNull() & F.col("_n").isNotNull()
    return violations(j, [image], {
        "unknown-image": F.col("_img").isNull(), "unassigned": F.col("_n").isNull(),
        "several-sessions": F.coalesce("_n", F.lit(0)) > 1,
        "wrong-session": both & ((F.col(session) != F.col("_s1")) | (F.col(session) != F.col("_s2"))),
        "wrong-kind": both & ((F.col(kind) != F.col("_k1")) | (F.col(kind) != F.col("_k2")))})


def session_overlap(sessions: DataFrame, cohort: DataFrame, row_id: str, family: str, source: str,
                    digest: str) -> DataFrame:
    """Status per session: shared bytes, family or known source; and provenance."""
    out = sessions.select(row_id, family, source, digest)
    for name, col in (("duplicate", digest), ("family", family), ("source", source)):
        seen = (cohort.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(ONE).alias(f"{name}_matches")))
        out = out.join(seen, col, "left")
    counts = [F.coalesce(f"{n}_matches", F.lit(0).cast("long")).alias(f"{n}_matches")
              for n in ("duplicate", "family", "source")]
    hit = F.coalesce("duplicate_matches", "family_matches", "source_matches").isNotNull()
    return out.select(
        row_id, *counts, F.when(hit, "overlap-found").otherwise("no-observed-overlap").alias("status"),
        F.when(F.col(source).isNotNull(), "known-source").otherwise("unresolved-source").alias("provenance"))


def overlap_report(sessions: DataFrame, cohorts: Mapping[str, DataFrame], decisive: Sequence[str], row_id: str,
                   sample_id: str, grid: str, family: str, source: str, hashes: Sequence[str]) -> DataFrame:
    """One row per session and cohort: equal positions, families, sources, files, nearest positions, and the status.

    ``<kind>_matches`` counts the cohort's rows of the same value, ``distance`` the fewest differing squares to any of its grids.
    The status belongs to the session: overlap if it shares a family or known source with a ``decisive``
    cohort, or a file (one of ``hashes``) with the first cohort. The nearest position is a clue and decides
    nothing. Counts are taken per key before any join. A cohort without rows has zeros and no distance. Sessions and
    cohorts are stored first, as each is read once for every kind and for the nearest position.
    """
    kinds = {"exact": grid, "family": family, "source": source, **{h: h for h in hashes}}
    cols, out = list(dict.fromkeys(kinds.values())), None
    sessions = _stored(sessions.select(*dict.fromkeys([row_id, *cols])), "overlap-sessions")
    cohorts = {name: _stored(c.select(*dict.fromkeys([sample_id, *cols])), "overlap-cohort") for name, c in cohorts.items()}
    for place, (name, cohort) in enumerate(cohorts.items()):
        part = sessions
        for kind, col in kinds.items():
            seen = cohort.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(ONE).alias(f"{kind}_matches"))
            part = part.join(seen, col, "left")
        near = nearest_position(sessions.where(F.col(grid).isNotNull()), cohort.where(F.col(grid).isNotNull()), row_id,
                                sample_id, grid)
        counts = [F.coalesce(f"{k}_matches", F.lit(0).cast("long")).alias(f"{k}_matches") for k in kinds]
        counting = [k for k in kinds if (name in decisive and k in ("family", "source")) or (not place and k in hashes)]
        hit = [F.col(f"{k}_matches").isNotNull() for k in counting]
        part = part.select(row_id, F.lit(name).alias("cohort"), *counts, F.col(source).isNotNull().alias("_known"),
                           reduce(or_, hit, F.lit(False)).alias("_hit")).join(near, row_id, "left")
        out = part if out is None else out.unionByName(part)
    any_hit = out.groupBy(row_id).agg(F.bool_or("_hit").alias("_any"))
    return out.drop("_hit").join(any_hit, row_id).select(
        row_id, "cohort", *[f"{k}_matches" for k in kinds], "distance", "nearest_samples", "first_nearest",
        F.when(F.col("_any"), "overlap-found").otherwise("no-observed-overlap").alias("status"),
        F.when(F.col("_known"), "known-source").otherwise("unresolved-source").alias("provenance"))


def matching_files(targets: DataFrame, cohort: DataFrame, target_id: str, sample_id: str,
                   hashes: Sequence[str]) -> DataFrame:
    """(kind, value, side, id): the members of every hash that both sides have.

    A hash with m target and n cohort files gives m + n rows and no pairs, however hot it is.
    """
    kinds = {h: h for h in hashes}
    left = unpivot(targets, [F.col(target_id).alias("id")], kinds)
    right = unpivot(cohort, [F.col(sample_id).alias("id")], kinds)
    shared = left.select("kind", "value").distinct().join(right.select("kind", "value").distinct(), ["kind", "value"])
    both = left.withColumn("side", F.lit("target")).unionByName(right.withColumn("side", F.lit("cohort")))
    return both.join(shared, ["kind", "value"]).select("kind", "value", "side", "id")


def cached_mismatch(cache: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields of a cached record that no longer equal the current annotation."""
    now = current.select(key, F.lit(True).alias("_now"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    j = cache.join(now, key, "left")
    known = F.col("_now").isNotNull()
    return violations(j, [key], {"unknown": ~known,
                                 **{f: known & differs(f, f"_n_{f}") for f in fields}})


def assignment_check(plan: DataFrame, rows: DataFrame, batch: str, row_id: str, group: str) -> DataFrame:
    """Each batch is one source group, and the frozen ids equal the reviewed ids."""
    groups = (rows.groupBy(batch, group).agg(F.count(ONE).alias("_n"))
              .groupBy(batch).agg(F.count(ONE).alias("_g")).where("_g > 1")
              .select(batch, F.lit(None).cast("bigint").alias(row_id), F.lit("several-groups").alias("problem")))
    a = plan.select(batch, row_id).withColumn("_p", F.lit(True))
    b = rows.select(batch, row_id).withColumn("_r", F.lit(True))
    diff = (a.join(b, [batch, row_id], "full")
            .withColumn("problem", F.when(F.col("_r").isNull(), "not-reviewed")
                        .when(F.col("_p").isNull(), "not-planned"))
            .where(F.col("problem").isNotNull()).select(batch, row_id, "problem"))
    return groups.unionByName(diff)
