"""Column expressions over placement strings and 64-symbol grids.

A *grid* is 64 symbols from a8 to h1 with ``.`` for empty; a *placement* is its
run-length form with ``/`` between ranks. Everything here is a plain expression,
so it composes into one projection and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardlake.functions.constants import CELLS, CLASSES, FILES, SYMBOLS

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Filters pushed below a projection copy the projected expression into every
    reference; a lambda variable keeps an expensive argument to one evaluation.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def encode_grid(grid: Column | str) -> Column:
    """64-symbol grid to placement; null unless it is 64 known symbols.

    The argument appears once, so an optimizer that inlines it does not repeat it.
    """
    known = F.regexp_extract(_col(grid), r"^[.PNBRQKpnbrqk]{64}$", 0)
    ranks = F.regexp_replace(known, r"(.{8})(?=.)", "$1/")
    for run in range(8, 0, -1):  # a run never crosses '/', so longest first is exact
        ranks = F.replace(ranks, F.lit("." * run), F.lit(str(run)))
    return F.nullif(ranks, F.lit(""))


def expand_runs(placement: Column | str) -> Column:
    """Replace digits by dots; keeps the rank separators."""
    p = _col(placement)
    for run in range(1, 9):
        p = F.replace(p, F.lit(str(run)), F.lit("." * run))
    return p


def grid_or_empty(placement: Column | str) -> Column:
    marked = F.regexp_replace(_col(placement), r"[1-8](?=[1-8])|[.]", "!")
    valid = r"^[.PNBRQKpnbrqk]{8}(/[.PNBRQKpnbrqk]{8}){7}$"
    return F.replace(F.regexp_extract(expand_runs(marked), valid, 0), F.lit("/"), F.lit(""))


def is_canonical(placement: Column | str) -> Column:
    """Eight ranks of eight cells, known symbols, no two neighbouring digits."""
    return F.coalesce(grid_or_empty(placement) != "", F.lit(False))


def placement_grid(placement: Column | str) -> Column:
    """Placement to 64-symbol grid; null when the placement is not canonical."""
    return F.nullif(grid_or_empty(placement), F.lit(""))


def square_name(idx: Column | str) -> Column:
    i = _col(idx)
    return F.concat(F.substring(F.lit(FILES), (i % 8 + 1).cast("int"), F.lit(1)),
                    (8 - F.floor(i / 8)).cast("string"))


def square_index(square: Column | str) -> Column:
    s = _col(square)
    rank = F.substring(s, 2, 1).cast("long")
    return ((8 - rank) * 8 + F.ascii(F.substring(s, 1, 1)) - 97).cast("long")


def background(idx: Column | str) -> Column:
    i = _col(idx)
    return F.when((F.floor(i / 8) + i % 8) % 2 == 0, "light").otherwise("dark")


def class_label(class_id: Column | str) -> Column:
    """Class id to label; a failed cell (-1) has the label ``processing-error``."""
    c = _col(class_id)
    return F.when(c < 0, "processing-error").otherwise(
        F.get(literal_array(CLASSES), c.cast("int")))


def symbol_class(symbol: Column | str) -> Column:
    """Symbol to class id, -1 for anything outside the vocabulary."""
    return (F.instr(F.lit(SYMBOLS), _col(symbol)) - 1).cast("long")


def symbol_at(grid: Column | str, idx: Column | str) -> Column:
    return F.substring(_col(grid), (_col(idx) + 1).cast("int"), F.lit(1))


def label_of_symbol(symbol: Column | str) -> Column:
    s = _col(symbol)
    return F.when(s == ".", "empty").otherwise(s)


def all_indexes() -> Column:
    return literal_array(range(CELLS)).cast("array<bigint>")


def grid_ids(grid: Column | str) -> Column:
    """64-symbol grid to the array of class ids."""
    return let(_col(grid), lambda g: F.transform(
        all_indexes(), lambda i: symbol_class(symbol_at(g, i))))


def swap_colour(grid: Column | str) -> Column:
    return F.translate(_col(grid), "PNBRQKpnbrqk", "pnbrqkPNBRQK")


def canonical_index(idx: Column | str, orientation: Column | str) -> Column:
    """Image index to canonical index; black-bottom views reverse both axes."""
    i = _col(idx)
    return F.when(_col(orientation) == "black-bottom", 63 - i).otherwise(i)


def family_key(grid: Column | str) -> Column:
    """Smallest of the 16 equivalent grids (8 symmetries, colours as is or swapped).

    Reversing the text is a half turn and reversing the order of the ranks a flip; both of the grid and of its
    transpose are all eight views, so only the transpose reads single cells.
    """
    def views(g: Column) -> list[Column]:
        flipped = F.concat(*[F.substring(g, 8 * r + 1, 8) for r in range(7, -1, -1)])
        return [g, flipped, F.reverse(g), F.reverse(flipped)]

    def smallest(both: Column) -> Column:
        forms = [*views(both["g"]), *views(both["t"])]
        return F.least(*forms, *map(swap_colour, forms))

    def turned(g: Column) -> Column:
        cells = F.concat(*[F.substring(g, 8 * r + c + 1, 1) for c in range(8) for r in range(8)])
        return let(F.struct(g.alias("g"), cells.alias("t")), smallest)

    return let(_col(grid), turned)


def wrong_squares(expected: Column | str, actual: Column | str) -> Column:
    """Array of (idx, square, expected, actual) where two grids differ."""
    def compare(both: Column) -> Column:
        wrong = F.filter(all_indexes(), lambda i: symbol_at(both["e"], i) != symbol_at(both["a"], i))
        return F.transform(wrong, lambda i: F.struct(
            i.alias("idx"), square_name(i).alias("square"),
            label_of_symbol(symbol_at(both["e"], i)).alias("expected"),
            label_of_symbol(symbol_at(both["a"], i)).alias("actual")))

    both = F.struct(_col(expected).alias("e"), _col(actual).alias("a"))
    return F.when(both["e"].isNotNull() & both["a"].isNotNull(), let(both, compare))
