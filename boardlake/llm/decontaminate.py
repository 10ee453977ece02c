"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings (term, row, pos) of the training texts, sorted by term in each file, with
one length entry for each text. Postings are kept of every term that some test item has; others
cannot match. A phrase query starts with the rarest term of each window, by counts over the whole index, and
intersects offset-adjusted lists: the list of a term at offset ``o`` of an item, shifted by ``o``, holds the
places (row, place) where the item would start. Two lists leave few places; the lists of all other
terms are then read for those places alone. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import ascii_lower, bounded, own_column, stored

WINDOW = 13


def words(text: Column) -> Column:
    """Words of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(pieces, "")


@dataclass
class Index:
    """Stored postings (term, row, pos, doc_id); the entry of term '' has the length as pos, and the id."""

    postings: DataFrame
    items: DataFrame  # item, item_id, terms
    slots: DataFrame  # item, off, term, size, n (postings of the term)

    def lengths(self) -> DataFrame:
        return self.postings.where(F.col("term") == "").select("row", "doc_id", F.col("pos").alias("n_words"))


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text: str = "text") -> Index:
    """Index ``docs`` for the terms of ``items``; items without words or id are left out.

    Nothing is shuffled: each task writes the index of the texts it reads. ``row`` numbers the rows of
    ``docs`` as they are written, so repeated rows and null ids keep apart.
    """
    asked = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("terms")).where(F.size("terms") > 0).distinct()
    asked = stored(asked.select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"), "index-items")
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    vocabulary = stored(vocabulary.union(vocabulary.sparkSession.createDataFrame([("",)], "term string")), "index-terms")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                           F.concat(words(F.col(text_col)), F.array(F.lit(""))).alias("words"))
    entries = numbered.select("row", "doc_id", F.posexplode("words").alias("pos", "term"))
    kept = entries.join(bounded(vocabulary), "term").select(
        "term", "row", "pos", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"))
    postings = stored(kept.sortWithinPartitions("term"), "index-postings")
    counts = postings.where(F.col("term") != "").groupBy("term").agg(F.count("*").alias("n"))
    places = asked.select("item", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    slots = stored(places.join(counts, "term", "left").select("item", "off", "term", "size",
                                                              F.coalesce("n", F.lit(0)).alias("n")), "index-slots")
    return Index(postings, asked, slots)


def rarest(index: Index, window: int, ranks: int = 2) -> DataFrame:
    """(item, off, term, size, step): the offsets of the ``ranks`` rarest terms of each possible window.

    A window with a term that the index lacks cannot occur and is left out.
    """
    terms = index.slots.groupBy("item").agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("off", "n", "term"))).alias("slots"))
    length = F.least(F.col("size"), F.lit(window))
    start = terms.select("item", "size", length.alias("length"), "slots", F.explode(
        F.sequence(F.lit(0), F.col("size") - length)).alias("start"))
    ranked = F.array_sort(F.transform(F.slice("slots", F.col("start") + 1, F.col("length")), lambda s: F.struct(
        s["n"].alias("n"), s["off"].alias("off"), s["term"].alias("term"))))
    picked = start.select("item", "size", ranked.alias("r")).where(F.col("r")[0]["n"] > 0)
    # A window of one word has no second term: its first one stands for both.
    return picked.select("item", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda k: F.get(
        "r", F.least(k, F.size("r") - 1)))).alias("step", "s")).select(
        "item", "size", F.col("s.off").alias("off"), F.col("s.term").alias("term"), "step").distinct()


def phrase_places(index: Index, window: int = WINDOW) -> DataFrame:
    """(row, item, place, size): where the two rarest terms of some window stand as in the item."""
    chosen = stored(rarest(index, window), "index-rarest")
    lists = [index.postings.join(bounded(chosen.where(F.col("step") == k)), "term").select(
        "row", "item", (F.col("pos") - F.col("off")).alias("place"), "size").distinct() for k in (0, 1)]
    first = stored(lists[0], "index-first")
    second = lists[1].join(bounded(first), ["row", "item", "place"], "left_semi")
    return stored(second, "index-places")


def phrase_runs(index: Index, window: int = WINDOW) -> DataFrame:
    """(row, item, start, length): maximal runs of at least a window where a text has an item's words in order."""
    places = phrase_places(index, window)
    inside = (index.postings["row"] == places["row"]) & (F.col("pos") >= F.col("place")) & (
        F.col("pos") < F.col("place") + F.col("size"))
    near = index.postings.join(bounded(places), inside).select(
        places["row"], "item", "place", "size", (F.col("pos") - F.col("place")).cast("int").alias("off"), "term")
    hits = near.join(bounded(index.slots.select("item", "off", "term")), ["item", "off", "term"], "left_semi")
    order = Window.partitionBy("row", "item", "place").orderBy("off")  # at most the words of one item
    runs = hits.withColumn("island", F.col("off") - F.row_number().over(order)).groupBy(
        "row", "item", "place", "island").agg(F.min("off").alias("first"), F.count("*").alias("length"),
                                              F.max("size").alias("size"))
    return runs.where(F.col("length") >= F.least(F.col("size"), F.lit(window))).select(
        "row", "item", (F.col("place") + F.col("first")).alias("start"), "length")


def proximity_matches(index: Index, within: int, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, item_id): texts where both rarest terms of some window stand at most ``within`` words apart.

    Places are dealt by blocks of ``within`` positions, and the second list is copied to the blocks beside
    its own, so only neighbours meet.
    """
    chosen = stored(rarest(index, window), "index-rarest")
    block = F.floor(F.col("pos") / F.lit(max(1, within))).cast("long")
    a, b = [index.postings.join(bounded(chosen.where(F.col("step") == k)), "term").select(
        "row", "item", "pos", block.alias("block")).distinct() for k in (0, 1)]
    b = b.select("row", "item", F.col("pos").alias("other"), F.explode(F.array(
        F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    met = a.join(b, ["row", "item", "block"]).where(F.abs(F.col("pos") - F.col("other")) <= within).select(
        "row", "item").distinct()
    return met.join(index.lengths(), "row").join(index.items, "item").select("row", "doc_id", "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Return doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item (of all its words, if it
    has fewer). Null and empty texts have no words and are clean; items without words or with a null id
    take no part; rows of one item id count as one item. Repeated rows and null doc ids are judged row by row.
    A text without items has the digest of the empty string. Empty tables give clean rows or none.
    """
    index = build_index(docs, items, id_col, text_col, item_col, item_text)
    runs = phrase_runs(index, window).join(bounded(index.items.select("item", "item_id")), "item")
    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    seen = F.coalesce(F.max(end).over(before), F.lit(0))
    fresh = runs.withColumn("fresh", F.greatest(end - F.greatest(F.col("start"), seen), F.lit(0)))
    found = stored(fresh.groupBy("row").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(
        F.col("item_id").cast("string"))).alias("named")), "index-found")
    out = index.lengths().join(bounded(found, 200_000), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("doc_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.size("named"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("named", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id has no contaminated text; rows with a null id stay."""
    judged = contamination(docs, items, id_col=id_col, text_col=text_col)
    gone = stored(judged.where("contaminated").select(id_col).distinct(), "index-gone")
    return docs.join(bounded(gone), id_col, "left_anti")


def drop_contaminated_rows(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose own text is not contaminated, whatever their id: null and repeated ids are judged alike."""
    key = own_column(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    judged = contamination(keyed.select(key, text_col), items, id_col=key, text_col=text_col)
    gone = stored(judged.where("contaminated").select(key).distinct(), "index-gone")
    return keyed.join(bounded(gone), key, "left_anti").select(docs.columns)
