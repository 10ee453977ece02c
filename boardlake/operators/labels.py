"""Label operators: encode, expand, canonicalise, tag and validate boards (family B)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.functions import placement as P
from boardlake.functions.constants import ERROR_STATUS, SYMBOLS
from boardlake.functions.rules import violations


def encode_cells(cells: DataFrame, board: str, idx: str = "idx", class_id: str = "class_id") -> DataFrame:
    """64 cell rows to a placement; null when cells are missing, doubled or unknown."""
    symbol = F.when((F.col(class_id) >= 0) & (F.col(class_id) < len(SYMBOLS)),
                    F.substring(F.lit(SYMBOLS), (F.col(class_id) + 1).cast("int"), F.lit(1))).otherwise("?")
    cells_in_order = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), symbol.alias("s"))))
    whole = F.transform(F.col("_c"), lambda c: c["i"]) == P.all_indexes()
    grid = F.array_join(F.transform("_c", lambda c: c["s"]), "")
    return (cells.groupBy(board).agg(cells_in_order.alias("_c"))
            .select(board, P.encode_grid(F.when(whole, grid)).alias("placement")))


def expand_placement(boards: DataFrame, keys: Sequence[str], placement: str = "placement") -> DataFrame:
    """Placement to 64 rows of (idx, symbol); non-canonical placements give no rows."""
    return (boards.select(*keys, P.grid_or_empty(placement).alias("_g"))
            .select(*keys, "_g", F.explode(P.all_indexes()).alias("idx"))
            .where(F.col("_g") != "")
            .select(*keys, "idx", P.symbol_at("_g", "idx").alias("symbol")))


def square_labels(boards: DataFrame, keys: Sequence[str], placement: str, orientation: str) -> DataFrame:
    """Every cell's square, label, class id, colour and place in the image."""
    rows = expand_placement(boards, [*keys, orientation], placement)
    image = P.canonical_index("idx", orientation)
    return rows.select(
        *keys, "idx", P.square_name("idx").alias("square"), P.label_of_symbol("symbol").alias("label"),
        P.symbol_class("symbol").alias("class_id"), P.background("idx").alias("background"),
        F.floor(image / 8).alias("image_row"), (image % 8).alias("image_column"))


def to_canonical(cells: DataFrame, idx: str, orientation: str) -> DataFrame:
    return cells.withColumn(idx, P.canonical_index(idx, orientation))


def placement_family(boards: DataFrame, keys: Sequence[str], grid: str) -> DataFrame:
    return boards.select(*keys, P.family_key(grid).alias("family"))


def placement_ids(boards: DataFrame, keys: Sequence[str], grid: str) -> DataFrame:
    return boards.select(*keys, P.grid_ids(grid).alias("ids"))


def diff_placement(boards: DataFrame, keys: Sequence[str], expected: str, actual: str) -> DataFrame:
    """Wrong squares of two grids, one row each; unprocessed boards are left out."""
    return (boards.where(F.col(expected) != F.col(actual))
            .select(*keys, F.inline(P.wrong_squares(expected, actual))))


def diff_summary(boards: DataFrame, keys: Sequence[str], expected: str, actual: str) -> DataFrame:
    wrong = F.size(P.wrong_squares(expected, actual)).cast("long")
    done = F.col(actual).isNotNull()
    return boards.select(*keys, F.when(done, 64 - wrong).alias("correct"),
                         F.when(done, wrong).alias("wrong"))


def raster_bounds(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str, h: str) -> DataFrame:
    """Half-even rounding of both edges; right and bottom are exclusive."""
    left, top = F.bround(x, 0), F.bround(y, 0)
    right, bottom = F.bround(F.col(x) + F.col(w), 0), F.bround(F.col(y) + F.col(h), 0)
    named = {"left": left, "top": top, "right": right, "bottom": bottom,
             "width": right - left, "height": bottom - top}
    return df.select(*keys, *[v.cast("long").alias(k) for k, v in named.items()])


def occupied(grid: Column | str) -> Column:
    g = F.col(grid) if isinstance(grid, str) else grid
    return F.length(F.replace(g, F.lit("."), F.lit(""))).cast("long")


def position_tags(df: DataFrame, keys: Sequence[str], grid: str, ply: str, promoted: Column) -> DataFrame:
    """Tags a position satisfies, from its cell count, ply and last move."""
    n, p = occupied(grid), F.col(ply)
    rules = [("opening", (p == 12) & (n >= 28)), ("middlegame", (p >= 32) & n.between(12, 26)),
             ("endgame", n.between(3, 10)), ("promotion", promoted),
             ("dense", n >= 28), ("sparse", n <= 10)]
    tags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return df.select(*keys, n.alias("occupied"), tags.alias("tags"))


def tag_violations(df: DataFrame, keys: Sequence[str], grid: str, ply: str, promoted: Column,
                   tags: str) -> DataFrame:
    """Declared tags the placement does not support, and density tags left out."""
    n, p = occupied(grid), F.col(ply)
    has = lambda name: F.array_contains(tags, name)
    problems = {
        "density": (has("dense") != (n >= 28)) | (has("sparse") != (n <= 10)),
        "opening": has("opening") & ~((p == 12) & (n >= 28)),
        "middlegame": has("middlegame") & ~((p >= 32) & n.between(12, 26)),
        "endgame": has("endgame") & ~n.between(3, 10),
        "promotion": has("promotion") & ~promoted,
    }
    return violations(df, keys, problems)


def style_dimensions(df: DataFrame, keys: Sequence[str], config: str, held_out: Sequence[str],
                     side: str | None = None) -> DataFrame:
    """platform-board-pieces-size into dimensions, combination and held-out flag."""
    part = F.split(config, "-")
    combination = F.concat_ws("/", part[0], part[1], part[2])
    return df.select(
        *keys, part[0].alias("platform"), F.concat_ws("/", part[0], part[1]).alias("background"),
        F.concat_ws("/", part[0], part[2]).alias("pieces"), combination.alias("combination"),
        F.substring_index(config, "-", 3).alias("base_config"),
        (F.col(side) if side else F.regexp_extract(config, r"(\d+)$", 1)).alias("board_side"),
        F.when(combination.isin(*held_out), "held-out-combination")
        .otherwise("seen-combination").alias("generalization"))


def mark_case(kinds: Column | str) -> Column:
    """Unique kinds in drawing order joined by ``+``."""
    return F.array_join(F.array_distinct(kinds), "+")


def assign_pool(df: DataFrame, keys: Sequence[str], dataset: str, kinds: str, conditions: str,
                photo: str, targeted: Column, backgrounds: DataFrame, photo_datasets: Sequence[str],
                arrow_datasets: Sequence[str]) -> DataFrame:
    """Sampling pool per board; ``pool`` is null where the rules do not cover it."""
    joined = df.join(backgrounds.select(F.col(photo), F.col("board_appearance")), photo, "left")
    is_photo = F.col(dataset).isin(*photo_datasets)
    pool = (F.when(is_photo & targeted, "photo-targeted")
            .when(is_photo & F.col("board_appearance").isNull(), F.lit(None))
            .when(is_photo & (F.col("board_appearance") == "wood-texture"), "photo-old-wood")
            .when(is_photo, "photo-old-other")
            .when(F.col(dataset).isin(*arrow_datasets), "digital-arrowheads")
            .when(F.col(conditions) == F.array(F.lit("clean")), "digital-clean")
            .when(F.array_contains(kinds, "arrow"), "digital-arrows")
            .when(F.size(kinds) > 0, "digital-simple-marks"))
    return joined.select(*keys, pool.alias("pool"))


ID_PATTERN = r"^[a-z0-9][a-z0-9_-]{0,63}$"
MOVE_PATTERN = r"^[a-h][1-8][a-h][1-8][qrbn]?$"
SQUARE_PATTERN = r"^[a-h][1-8]$"


def format_violations(df: DataFrame, keys: Sequence[str], identity: str, moves: str, ply: str,
                      placement: str) -> DataFrame:
    return violations(df, keys, {
        "identifier": ~F.coalesce(F.col(identity).rlike(ID_PATTERN), F.lit(False)),
        "moves": ~F.coalesce((F.size(moves) > 0) & F.forall(moves, lambda m: m.rlike(MOVE_PATTERN)),
                             F.lit(False)),
        "ply": ~F.coalesce((F.col(ply) > 0) & (F.col(ply) <= F.size(moves)), F.lit(False)),
        "placement": ~P.is_canonical(placement)})


def error_text(expected: Column | str, actual: Column | str) -> Column:
    """``sq:exp->got; ...``, ``OK`` or ``NOT_DETECTED``."""
    items = F.transform(P.wrong_squares(expected, actual), lambda w: F.concat(
        w["square"], F.lit(":"), w["expected"], F.lit("->"), w["actual"]))
    a = F.col(actual) if isinstance(actual, str) else actual
    return (F.when(a.isNull(), "NOT_DETECTED").when(F.size(items) == 0, "OK")
            .otherwise(F.array_join(items, "; ")))


def source_key(video: str, platform: str, game: str, platforms: Sequence[str]) -> Column:
    """Identity of a source; null (never equal to another) when it is unknown."""
    v, g = F.col(video).cast("string"), F.col(game).cast("string")
    return (F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit("video:"), v))
            .when(F.col(platform).isin(*platforms) & (F.coalesce(g, F.lit("")) != ""),
                  F.concat(F.col(platform), F.lit(":"), g)))


PAYLOAD = "piecePlacement string, error struct<code:string,message:string>"


def audit_payloads(df: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """Transport status of each JSON result, null with a reason when it is invalid."""
    parsed = F.from_json(body, PAYLOAD)
    names = F.json_object_keys(body)
    error_names = F.json_object_keys(F.get_json_object(body, "$.error"))
    code, message = parsed["error"]["code"], parsed["error"]["message"]
    table = F.create_map(*[F.lit(x) for pair in ERROR_STATUS.items() for x in pair])
    text_valued = lambda name: F.col(body).rlike(f'"{name}"\\s*:\\s*"')
    doubled = F.size(F.array_distinct(names)) < F.size(names)
    is_ok = F.coalesce(names == F.array(F.lit("piecePlacement")), F.lit(False))
    is_error = F.coalesce((names == F.array(F.lit("error")))
                          & (F.array_sort(error_names) == F.array(F.lit("code"), F.lit("message"))),
                          F.lit(False))
    status = (F.when(is_ok & text_valued("piecePlacement") & P.is_canonical(parsed["piecePlacement"]),
                     F.lit(200))
              .when(is_error & text_valued("code") & text_valued("message")
                    & (F.coalesce(message, F.lit("")) != ""), F.try_element_at(table, code)))
    problem = (F.when(names.isNull(), "not-an-object").when(doubled, "duplicate-key")
               .when(is_ok & status.isNull(), "placement").when(is_error & status.isNull(), "error-fields")
               .when(status.isNull(), "fields"))
    return df.select(*keys, F.when(~F.coalesce(doubled, F.lit(False)), status).cast("long").alias("status"),
                     problem.alias("problem"))


def coverage_label(config: str, known: Sequence[str]) -> Column:
    """``shared`` when the configuration without its size is known, else ``new``."""
    base = F.regexp_replace(config, "-[^-]*$", "")
    return F.when(base.isin(*known), "shared").otherwise("new")


def control_mask(cohort: str, conditions: str, policy: str) -> Column:
    """Boards that must not get worse: the previous cohort, or boards without arrows."""
    if policy == "previous":
        return F.col(cohort) == "previous"
    return ~F.array_contains(conditions, "arrow")


def baseline_exact(cells: DataFrame, expected: str, predicted: str, board: str) -> DataFrame:
    """Control boards of the third policy: those the baseline reads without error."""
    ok = F.col(expected).eqNullSafe(F.col(predicted))
    return cells.groupBy(board).agg(F.bool_and(ok).alias("_ok")).where("_ok").select(board)
