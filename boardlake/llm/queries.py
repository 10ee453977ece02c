"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm import (decontaminate, filter_audit, html_text, line_dedup, mixing, packing, periodic, quality, simhash, suffix_dedup,
                           tokens, topk, url_filter)
from boardlake.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", (F.octet_length("ids") / packing.WIDTH).cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_mixing, op3_line_dedup, op4_decontaminate, op5_quality, op6_top_k, op7_html_text,
                            op8_token_counts, op9_suffix_dedup, op10_url_filter, op11_periodic_runs, op12_packing, op13_filter_audit)}

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
                  AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(0, len(w) - least(len(w), 13) + 1),
               lambda i: array_to_string(w[i + 1:i + least(len(w), 13)], ' '))) AS g FROM b WHERE len(w) > 0),
places AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM d, (SELECT DISTINCT n FROM win)
           WHERE len(w) >= n),
occ AS (SELECT p.doc_id, win.item_id, p.i, p.n FROM places p JOIN win ON win.n = p.n
        AND win.g = array_to_string(p.w[p.i + 1:p.i + p.n], ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ)
        GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY source HAVING sum(n) > 0),
w AS (SELECT sum(tokens) AS total, count(*) AS k FROM s),
p AS (SELECT source, tokens, ln(tokens / CAST(total AS DOUBLE)) AS lp, CAST(total AS DOUBLE) AS total, k FROM s, w),
g1 AS (SELECT a, sum(exp(lp * a / 1e6)) AS z, sum(exp(lp * a / 1e6) * lp) AS zl, max(exp(lp * a / 1e6) * total / tokens)
              AS worst, max(k) AS k FROM p, (SELECT unnest(range(0, 1000001, 1000)) AS a) GROUP BY a),
f1 AS (SELECT coalesce(min(a), 1000000) AS a FROM g1
       WHERE ln(z) - a / 1e6 * zl / z <= 0.95 * ln(k) + 1e-12 AND worst / z <= 4.0 + 1e-9),
g2 AS (SELECT a, sum(exp(lp * a / 1e6)) AS z, sum(exp(lp * a / 1e6) * lp) AS zl, max(exp(lp * a / 1e6) * total / tokens)
              AS worst, max(k) AS k FROM p, (SELECT unnest(range(greatest(0, a - 1000), a + 1)) AS a FROM f1) GROUP BY a),
e AS (SELECT coalesce(min(a), 1000000) / 1e6 AS a FROM g2
      WHERE ln(z) - a / 1e6 * zl / z <= 0.95 * ln(k) + 1e-12 AND worst / z <= 4.0 + 1e-9),
u AS (SELECT source, tokens, total, exp(lp * e.a) AS x FROM p, e),
t AS (SELECT source, tokens, CAST(round(x / (SELECT sum(x) FROM u) * total) AS BIGINT) AS target FROM u),
b AS (SELECT d.doc_id, d.source, d.n, t.tokens, t.target,
             unnest(range(0, CAST(ceil(t.target / CAST(t.tokens AS DOUBLE)) AS BIGINT))) AS block
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE t.target > 0),
o AS (SELECT *, row_number() OVER x AS position, sum(n) OVER x AS run FROM b
      WINDOW x AS (PARTITION BY source, block ORDER BY sha256('7|' || block || '|' || coalesce(CAST(doc_id AS VARCHAR), '')),
                   doc_id, n ROWS UNBOUNDED PRECEDING))
SELECT source, CAST(block AS INTEGER) AS block, position, doc_id, n AS n_tokens FROM o
WHERE block * tokens + run - n < target
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
             + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
             + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS quality, max(CAST(toxic = 1 AS INTEGER)) AS toxic
      FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(coalesce(quality, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, b)),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
      FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31),
s AS (SELECT filter_order, step, bits[step] AS b, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, b, sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & b > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before > 0 AND mask & b > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & b > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & b > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM g, s GROUP BY part, filter_order, step, b)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM x
"""

ORACLE: dict[str, str] = {"op2_mixing": OP2_SQL, "op4_decontaminate": OP4_SQL, "op6_top_k": OP6_SQL, "op13_filter_audit": OP13_SQL}
