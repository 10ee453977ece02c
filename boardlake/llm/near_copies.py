"""Near copies of whole texts: five-word shingles, similarity of 0.8 or more, links verified exactly.

Edits scattered over a text move its SimHash by 4 to 17 bits, more than covering anchors can take. So each text
has several fingerprints: one of the whole, linked within 3 bits through the anchors of ``simhash``, and those of
parts. Parts end at shingles whose hash is the smallest within ``RADIUS`` places, so they depend on their own
words alone: an edit leaves the others as they are, and their fingerprints equal. Of the parts of a text, however
long, the ``parts`` ones with the smallest mixed fingerprints stand for it, so that similar texts choose the same.

Texts meet under equal fingerprints. A fingerprint that more than ``crowd`` texts share deals them again by pairs
of their parts. Under each key, all meet the ``leaders`` texts with the smallest hashes there: all pairs, if the
key has no more, and otherwise leaders that differ from key to key. Each pair whose lengths allow it is then
verified by the Jaccard similarity of the two whole shingle sets.

What these fingerprints miss is found by an exact prefix filter between the groups that they made: two texts of the
similarity share one of the first ``n - ceil(0.8 n) + 1`` shingles of each, in any order that all texts use, and k of
the first ``n - ceil(0.8 n) + k``. In the order of hashes most texts share fewer with other groups and are settled. The others are ordered again,
shingles of one group first (they link nothing that is not linked), then those of few holders. Texts of different
groups that share a shingle of these prefixes are compared, all of them, by the shingles that more than one group has.
So the groups are those of all pairs. The work of this part grows with the pairs of texts in different groups that share
a rare shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import bounded, own_column, short_batches, stored
from boardlake.llm.components import components
from boardlake.llm.simhash import SEED, _words, link_fingerprints

SIZE = 5
RADIUS = 4
BLOCK = 1 << 13
EXTRA = 20


def shingle_hashes(text: str, size: int = SIZE) -> np.ndarray:
    """XXH64 of every shingle of ``size`` lower-cased words, repeats included; of fewer words, of all of them."""
    found, kept, total, digest = [], [], 0, xxhash.xxh64_intdigest
    for words in _words(text.encode().lower()):
        total += len(words)
        words = kept + words
        if len(words) >= size:
            ends = np.cumsum([len(w) + 1 for w in words])
            joined = b" ".join(words)
            starts = [0, *(ends[:-size].tolist())]
            found.append(np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[size - 1:].tolist())],
                                  dtype=np.uint64))
        kept = words[max(0, len(words) - size + 1):]
    if 0 < total < size:
        found.append(np.array([digest(b" ".join(kept), SEED)], dtype=np.uint64))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def part_starts(hashes: np.ndarray) -> np.ndarray:
    """First shingle of each part: the start, and every smallest hash within ``RADIUS`` places."""
    wide = np.pad(hashes, RADIUS, constant_values=np.iinfo(np.uint64).max)
    least = hashes.copy()
    for shift in range(2 * RADIUS + 1):
        np.minimum(least, wide[shift:shift + len(hashes)], out=least)
    cuts = np.flatnonzero(hashes == least)
    return cuts if len(cuts) and cuts[0] == 0 else np.concatenate(([0], cuts))


def mixed(fp: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose order has nothing to do with that of the fingerprints."""
    with np.errstate(over="ignore"):
        fp = (fp ^ (fp >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return fp ^ (fp >> np.uint64(29))


def sketch(text: str, parts: int = 8, size: int = SIZE) -> tuple[int, int, np.ndarray]:
    """(distinct shingles, SimHash of the whole, chosen SimHashes of parts); (0, 0, [0]) without words."""
    return _sketch(shingle_hashes(text, size), parts)


def _sketch(hashes: np.ndarray, parts: int) -> tuple[int, int, np.ndarray]:
    if not len(hashes):
        return 0, 0, np.zeros(1, dtype=np.uint64)
    starts, whole, found = part_starts(hashes), np.zeros(64, dtype=np.int64), []
    stops = np.append(starts[1:], len(hashes))
    for a in range(0, len(starts), BLOCK):
        first, last = starts[a:a + BLOCK], stops[a:a + BLOCK]
        rows = hashes[first[0]:last[-1]].astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(np.unpackbits(rows, axis=1, bitorder="little"), first - first[0], axis=0, dtype=np.int64)
        whole += sums.sum(axis=0)
        found.append(np.packbits(2 * sums > (last - first)[:, None], axis=1, bitorder="little").view("<u8").ravel())
    fps = np.unique(np.concatenate(found))
    chosen = fps[np.argsort(mixed(fps))[:parts]]
    return len(np.unique(hashes)), int(np.packbits(2 * whole > len(hashes), bitorder="little").view("<u8")[0]), chosen


def prefix_size(n: int, percent: int) -> int:
    """First shingles of a set of ``n`` that are stored: so many that any set of the similarity has ``n // EXTRA + 1`` of them.

    If the other set is smaller, its own number holds, which is at least that of ``percent`` of ``n``.
    """
    needed = -(-percent * n // 100)
    return n - needed + min(n // EXTRA + 1, needed)


def _sketches(docs: DataFrame, parts: int, size: int, percent: int) -> DataFrame:
    """(doc_id, sig, n, fp, parts, prefix) of every row of (doc_id, sig, text); the prefix is in the order of hashes."""
    def run(batches):
        for batch in batches:
            got, firsts = [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), size)
                got.append(_sketch(hashes, parts))
                firsts.append(np.unique(hashes)[:prefix_size(got[-1][0], percent)].view(np.int64))
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int64()),
                pa.array(np.array([g[1] for g in got], dtype=np.uint64).view(np.int64)),
                pa.array([g[2].view(np.int64) for g in got], pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
                names=["doc_id", "sig", "n", "fp", "parts", "prefix"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sig long, n long, fp long, "
                                "parts array<long>, prefix array<long>")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(sig, shingles): the distinct shingle hashes of every row of (sig, text)."""
    def run(batches):
        for batch in batches:
            for sig, text in zip(batch.column(0), batch.column(1)):
                yield pa.record_batch([pa.array([sig.as_py()], pa.int64()), pa.array(
                    [np.unique(shingle_hashes(text.as_py(), size)).view(np.int64)], pa.list_(pa.int64()))],
                    names=["sig", "shingles"])

    return docs.mapInArrow(run, "sig long, shingles array<long>")


def _keys(nodes: DataFrame, crowd: int) -> DataFrame:
    """(key, sig, n): the texts under each fingerprint that more than one has; crowded ones dealt again by pairs."""
    def key(*values):
        return F.xxhash64(*values)

    one = nodes.select("sig", "n", F.explode(F.array_distinct(F.concat("parts", F.array("fp")))).alias("part"))
    counts = stored(one.groupBy("part").agg(F.count("*").alias("held")).where("held > 1"), "near-counts")
    met = stored(one.join(counts, "part").select("part", "sig", "n", (F.col("held") > crowd).alias("crowded")), "near-met")
    other = met.where("crowded").join(nodes.select("sig", "parts"), "sig").select(
        "sig", "n", "part", F.explode("parts").alias("other")).where("part < other")
    again = other.select(key("part", "other").alias("key"), "sig", "n")
    return stored(met.select(key("part").alias("key"), "sig", "n").union(again).distinct(), "near-keys")


def _pairs(nodes: DataFrame, crowd: int, leaders: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) with a < b whose lengths allow the similarity."""
    keys = _keys(nodes, crowd)
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "sig"), "sig")
    heads = stored(keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= leaders).select(
        "key", F.col("sig").alias("other"), F.col("n").alias("m")), "near-heads")
    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    led = keys.join(heads, "key").where((F.col("sig") != F.col("other")) & near).select(
        F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b"))
    # Fingerprints of wholes within 3 bits, through the anchors; each stands for its text with the smallest hash.
    whole = stored(nodes.groupBy("fp").agg(F.min(F.struct("sig", "n")).alias("of")).select("fp", "of.sig", "of.n"),
                   "near-wholes")
    links = stored(link_fingerprints(whole), "near-anchored").distinct()
    left = links.join(whole, F.col("a") == F.col("fp")).select("b", "sig", "n")
    right = whole.select(F.col("fp").alias("b"), F.col("sig").alias("other"), F.col("n").alias("m"))
    anchored = left.join(right, "b").where(near).select(
        F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b"))
    return stored(led.union(anchored).distinct(), "near-pairs")


def _sets_of(sigs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(sig, shingles) of the texts named by ``sigs``, once each."""
    wanted = stored(sigs.join(nodes, "sig").select(F.col("sig").alias("want"), F.col("doc_id").alias("want_id"),
                                                 (F.col("copies") > 1).alias("several")), "near-wanted")
    texts = rows.join(bounded(wanted), (F.col("sig") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("want_id")),
                      "inner")
    once = texts.where(~F.col("several")).select("sig", "text")
    again = texts.where("several").select("sig", "text").dropDuplicates(["sig"])
    with short_batches(rows.sparkSession):
        return stored(_shingle_sets(once.union(again), size), "near-sets")


def _links(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs whose whole shingle sets have the similarity; sets are computed for texts in pairs only."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), rows, nodes, size)
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    return stored(both.where(alike).select("a", "b"), "near-links")


def _between_groups(rows: DataFrame, of: DataFrame) -> DataFrame:
    """(token, sig, root, held) of the rows (token, sig) whose token more than one group holds.

    Tokens of one text are most of all and go first, so that they carry no group.
    """
    alone = Window.partitionBy("token")
    two = stored(rows.select("token", "sig", F.min("sig").over(alone).alias("low"), F.max("sig").over(alone).alias("high")).where(
        "low < high").select("token", "sig"), "near-tokens")
    two = two.join(of, "sig", "left").select("token", "sig", F.coalesce("root", "sig").alias("root"))
    return stored(two.select("*", F.min("root").over(alone).alias("low"), F.max("root").over(alone).alias("high"), F.count("*").over(
        alone).alias("held")).where("low < high").select("token", "sig", "root", "held"), "near-shared")


def _missed_links(rows: DataFrame, nodes: DataFrame, found: DataFrame, roots: DataFrame, percent: int, size: int) -> DataFrame:
    """Every pair (a, b) of the similarity whose texts are in different groups of ``roots``."""
    of = roots.select(F.col("node").alias("sig"), "root")
    least = F.ceil(percent * F.col("n") / 100)  # common shingles of a text and any that is similar to it; also the least size
    shared = _between_groups(found.select("sig", F.explode("prefix").alias("token")), of)
    enough = F.col("common") >= F.least(F.floor(least / EXTRA) + 1, F.ceil(percent * least / 100))
    for _ in range(2):  # the second time without what only settled texts share
        met = shared.groupBy("sig").agg(F.countDistinct("token").alias("common")).join(nodes.select("sig", "n"), "sig")
        met = stored(met.where(enough).select("sig"), "near-met")
        shared = _between_groups(shared.join(met, "sig", "left_semi"), of)
    met = shared.groupBy("sig").agg(F.countDistinct("token").alias("common")).join(nodes.select("sig", "n"), "sig").where(
        enough).select("sig")
    sets = _sets_of(met, rows, nodes, size)
    shared = _between_groups(sets.select("sig", F.explode("shingles").alias("token")), of).join(nodes.select("sig", "n"), "sig")
    # Only shingles of several groups can be common to two groups, and a text needs enough of them to be linked.
    # The others come first in the order, so a text's place in it is known from their number.
    held = shared.withColumn("all", F.count("*").over(Window.partitionBy("sig"))).where(F.col("all") >= least)
    place = F.row_number().over(Window.partitionBy("sig").orderBy("held", "token"))
    held = stored(held.withColumn("place", F.col("n") - F.col("all") + place), "near-held")
    keys = stored(held.where(F.col("place") <= F.col("n") - least + 1).select("token", "sig", "n", "root", "place"), "near-prefixes")
    # Under a key, texts outside its largest group meet all others; inside a group nothing is left to link.
    sizes = keys.groupBy("token", "root").agg(F.count("*").alias("size"))
    largest = stored(sizes.groupBy("token").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("groups"))
                     .where("groups > 1").select("token", F.col("top.root").alias("top")), "near-largest")
    several = keys.join(largest, "token")
    left = several.where("root <> top").select("token", F.col("sig").alias("a"), F.col("n").alias("x"), F.col("root").alias("from"),
                                               F.col("place").alias("i"))
    right = several.select("token", F.col("sig").alias("b"), F.col("n").alias("y"), F.col("root").alias("to"),
                           F.col("place").alias("j"), "top")
    # If this is their first common shingle, no more than those from here on are common; of linked texts one key says so.
    most = 1 + F.least(F.col("x") - F.col("i"), F.col("y") - F.col("j"))
    near = (100 + percent) * most >= percent * (F.col("x") + F.col("y"))
    pairs = stored(left.join(right, "token").where((F.col("from") != F.col("to")) & near & (
        (F.col("to") == F.col("top")) | (F.col("a") < F.col("b")))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-others")
    lists = stored(held.groupBy("sig").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")), "near-lists")
    both = pairs.join(lists.select(F.col("sig").alias("a"), F.col("n").alias("x"), F.col("tokens").alias("s")), "a")
    both = both.join(lists.select(F.col("sig").alias("b"), F.col("n").alias("y"), F.col("tokens").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    return both.where(100 * common >= percent * (F.col("x") + F.col("y") - common)).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SIZE,
                parts: int = 8, leaders: int = 8, crowd: int = 64) -> DataFrame:
    """Return (sig, keep, keep_id, repeated) for every text that has a copy or near copy in ``docs``.

    ``sig`` is the xxhash64 of the text. Linked texts form a group, of which the row with the smallest id stays
    (null ids come last, ties go to the smaller sig): its text has ``keep`` true and its id is ``keep_id``;
    ``repeated`` tells that several rows have that id and text. Null texts count as empty; texts without words are
    copies of each other. Texts of any length are read whole. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sig"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with short_batches(docs.sparkSession):
        found = stored(_sketches(rows, parts, size, percent), "near-sketches")
    each = found.groupBy("sig", "doc_id").agg(F.count("*").alias("copies"), F.first("n").alias("n"),
                                              F.first("fp").alias("fp"), F.first("parts").alias("parts"))
    least = F.min_by(F.struct("doc_id", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id"))
    nodes = stored(each.groupBy("sig").agg(
        F.sum("copies").alias("held"), least.alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"),
        F.first("parts").alias("parts")).select("sig", "held", "least.*", "n", "fp", "parts"), "near-nodes")
    links = _links(rows, nodes, _pairs(nodes, crowd, leaders, percent), percent, size)
    roots = components(links)
    missed = stored(_missed_links(rows, nodes, found, roots, percent, size), "near-missed")
    if not missed.isEmpty():
        roots = components(links.union(missed))
    linked = stored(roots.join(nodes.select("sig", "doc_id"), F.col("node") == F.col("sig")).select(
        "root", "sig", "doc_id"), "near-linked")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sig")).alias("first"))
    of = stored(linked.join(first, "root").select("sig", (F.col("first.sig") == F.col("sig")).alias("stays")), "near-of")
    return nodes.join(of, "sig", "left").where("held > 1 or stays is not null").select(
        "sig", F.coalesce("stays", F.lit(True)).alias("keep"), F.col("doc_id").alias("keep_id"),
        (F.col("copies") > 1).alias("repeated"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without near copies: one row of each group of ``near_copies``, as it is.

    Rows are judged one by one: a row with a null id goes if its text is a copy, a clean row stays although its
    id repeats, and of rows equal in id and text one stays (any, if they differ in other columns).
    """
    names = [own_column(docs, f"near_{c}") for c in ("sig", "keep", "keep_id", "repeated")]
    sig, keep, keep_id, repeated = names
    acts = stored(near_copies(docs, id_col, text_col, **options), "near-acts").toDF(*names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    judged = docs.join(bounded(acts), F.xxhash64(text) == F.col(sig), "left").where(
        F.col(sig).isNull() | (F.col(keep) & F.col(id_col).eqNullSafe(F.col(keep_id))))
    single = judged.where(F.col(sig).isNull() | ~F.col(repeated)).select(docs.columns)
    place = own_column(docs, "near_place")
    again = judged.where(F.col(repeated)).withColumn(place, F.row_number().over(Window.partitionBy(sig).orderBy(sig)))
    return single.union(again.where(F.col(place) == 1).select(docs.columns))
