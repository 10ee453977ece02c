"""Line dedup by pairwise alignment.

Documents become sequences of line hashes. Every run of consecutive lines that just reaches
``block_words`` words points from every document that has it to the first one (smallest id) that has it:
these are the pairs, at most two for a line, never all pairs of a group. Any longer common block is made
of such runs, so neither the length nor the frequency of its lines hides it. The two sequences of a pair
are aligned with patience diff, and blocks of lines that stand in both in a row, with at least
``block_words`` words, are deleted from the later document. What an alignment cannot match, blocks in another
order or repeated in the later document, is found by exact matches of runs and deleted too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import bounded, own_column, stored

BASE, PRIME = 0x1F3D5B79A2C4E687, (1 << 61) - 1


def run_keys(lines: list[int], words: list[int], least: int) -> list[int]:
    """Distinct hashes of the shortest runs of at least ``least`` words from each line on and up to each line.

    Each line of a longer run is in a shortest run inside of it: those from its lines on, then those up to them.
    """
    prefix, power, total = [0], [1], [0]
    for x, n in zip(lines, words):
        prefix.append((prefix[-1] * BASE + x) % PRIME)
        power.append(power[-1] * BASE % PRIME)
        total.append(total[-1] + n)
    keys, end, start = set(), 0, 0
    for i in range(len(lines)):
        while end < len(lines) and total[end] - total[i] < least:
            end += 1
        if total[end] - total[i] >= least:
            keys.add((prefix[end] - prefix[i] * power[end - i]) % PRIME)
        while total[i + 1] - total[start + 1] >= least and start < i:
            start += 1
        if total[i + 1] - total[start] >= least:
            keys.add((prefix[i + 1] - prefix[start] * power[i + 1 - start]) % PRIME)
    return list(keys)


def line_rows(batches):
    """(doc_id, sig, lines, words): hashes of the lines without surrounding white space, and their word counts."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        hashes, words = [], []
        for text in batch.column(2):
            lines = text.as_py().split("\n")
            hashes.append([digest(x.strip().encode()) - (1 << 63) for x in lines])
            words.append([len(x.split()) for x in lines])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())),
                               pa.array(words, pa.list_(pa.int32()))], names=["doc_id", "sig", "lines", "words"])


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with ascending second parts, of pairs in order of their first parts."""
    tails, ends, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: matched line numbers of both sequences, ascending.

    Equal lines at both ends of a stretch match; inside, lines that are unique in both parts are
    matched along a longest common order and cut the stretch; a stretch without such lines has no more matches.
    """
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            matched.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            matched.append((j, q))
        if i == j or p == q:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[p:q])
        where = {x: p + n for n, x in enumerate(b[p:q]) if in_b[x] == 1}
        anchors = _increasing([(n, where[a[n]]) for n in range(i, j) if in_a[a[n]] == 1 and a[n] in where])
        if not anchors:
            continue
        matched += anchors
        for (x, y), (z, w) in zip([(i - 1, p - 1), *anchors], [*anchors, (j, q)]):
            todo.append((x + 1, z, y + 1, w))
    return sorted(matched)


def longest_ends(a: list[int], b: list[int]) -> list[int]:
    """For each line of ``b`` the length of the longest run of lines ending there that stands in ``a``.

    A suffix automaton of the lines of ``a`` that ``b`` has; time and memory grow with the lines of both.
    """
    here, kept = set(b), []
    for x in a:
        if x in here:
            kept.append(x)
        elif kept and kept[-1] is not None:
            kept.append(None)  # no run crosses a line that b does not have
    link, size, step, last = [-1], [0], [{}], 0
    for x in kept:
        new, p = len(link), last
        link.append(0), size.append(size[last] + 1), step.append({})
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if size[q] > size[p] + 1:
                twin = len(link)
                link.append(link[q]), size.append(size[p] + 1), step.append(dict(step[q]))
                link[q] = twin
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
                q = twin
            link[new] = q
        last = new
    out, at, n = [], 0, 0
    for x in b:
        while at and x not in step[at]:
            at = link[at]
            n = size[at]
        if x in step[at]:
            at, n = step[at][x], n + 1
        out.append(n)
    return out


def common_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Lines of ``b`` in blocks of at least ``least`` words that stand in ``a``.

    Aligned blocks first. Where they leave words, all runs that ``a`` has too follow: moved and repeated ones.
    """
    out, block, previous = set(), [], None
    for x, y in [*align(a, b), (None, None)]:
        if previous is not None and (x, y) != (previous[0] + 1, previous[1] + 1):
            if sum(words[k] for k in block) >= least:
                out.update(block)
            block = []
        if y is not None:
            block.append(y)
            previous = (x, y)
    if len(out) == len(b):
        return sorted(out)
    total = [0]
    for n in words:
        total.append(total[-1] + n)
    start = len(b)
    for j, n in reversed(list(enumerate(longest_ends(a, b)))):
        # Of the runs that end here or later, the one that reaches furthest back.
        if total[j + 1] - total[j + 1 - n] >= least:
            start = min(start, j + 1 - n)
        if start <= j:
            out.add(j)
    return sorted(out)


def deleted_lines(docs: DataFrame, block_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sig, gone): line numbers to delete, for the texts that lose some; a stored table."""
    def keys(batches):
        for batch in batches:
            runs = [run_keys(lines, words, block_words) for lines, words in
                    zip(*(batch.column(i).to_pylist() for i in (2, 3)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64()))],
                                  names=["doc_id", "sig", "runs"])

    def cut(batches):
        for batch in batches:
            gone = [common_blocks(first, own, words, block_words) for first, own, words in
                    zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))],
                                  names=["doc_id", "sig", "gone"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    # Repeated rows are one document here.
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("sig"),
                                                        text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketches = stored(rows.mapInArrow(line_rows, f"doc_id {kind}, sig long, lines array<long>, words array<int>"),
                      "line-sketches")
    sketches = stored(sketches.dropDuplicates(["doc_id", "sig"]), "line-sketches")
    runs = sketches.mapInArrow(keys, f"doc_id {kind}, sig long, runs array<long>").select(
        F.struct("doc_id", "sig").alias("doc"), F.explode("runs").alias("run"))
    runs = stored(runs, "line-runs")
    shared = stored(runs.groupBy("run").agg(F.count("*").alias("docs"), F.min("doc").alias("first")).where("docs > 1").select(
        "run", "first"), "line-shared")
    pairs = stored(runs.join(shared, "run").where(F.col("first") != F.col("doc")).select(
        "doc.*", F.col("first.doc_id").alias("first_id"), F.col("first.sig").alias("first_sig")).distinct(), "line-pairs")
    own = sketches.select("doc_id", "sig", F.col("lines").alias("own"), "words")
    first = sketches.select(F.col("doc_id").alias("first_id"), F.col("sig").alias("first_sig"), F.col("lines").alias("other"))
    both = stored(pairs.join(own, ["doc_id", "sig"]), "line-own").join(first, ["first_id", "first_sig"]).select(
        "doc_id", "sig", "other", "own", "words")
    cuts = both.mapInArrow(cut, f"doc_id {kind}, sig long, gone array<int>")
    return stored(cuts.where(F.size("gone") > 0).groupBy("doc_id", "sig").agg(
        F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "line-cuts")


def dedup_lines(docs: DataFrame, block_words: int = 12, id_col: str = "doc_id", text_col: str = "text",
                counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """All columns of ``docs`` with shortened texts, plus ``n_lines`` and ``n_deleted``.

    Lines end at ``\\n``. Deletions are judged on the input texts, not on what is left of the earlier one. Null
    and empty texts, and rows with a null id, stay as they are and shorten no other. Equal rows are one
    document and get the same result; different texts of one id come in the order of their
    xxhash64. Empty tables give an empty result. Columns of ``docs`` with the
    names in ``counts`` are replaced; no other name clashes. Very long texts take time in proportion to their lines.
    """
    cut_id, cut_sig, gone = names = [own_column(docs, c) for c in ("cut_id", "cut_sig", "gone")]
    cuts = deleted_lines(docs, block_words, id_col, text_col).select("doc_id", "sig", "gone").toDF(*names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(bounded(cuts, 300_000), (F.col(id_col) == F.col(cut_id)) & (F.xxhash64(text) == F.col(cut_sig)), "left")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.transform(F.array(lines), lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))[0]
    return joined.withColumns({
        counts[0]: F.size(lines).cast("long"), counts[1]: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)}).drop(*names)
