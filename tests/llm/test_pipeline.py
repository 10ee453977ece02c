"""The stages one after the other, each judged on its own input."""

import xxhash  # noqa: F401  (the operators need it)
from pyspark.sql import functions as F

import corpus_pipeline
from boardlake.llm import decontaminate, mixing, near_copies, quality
from boardlake.llm.common import stored, table


def test_stages(spark, sf):
    docs, previous, seen = table(spark, sf, "documents"), None, {}
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        previous, docs = docs, stored(stage(spark, docs, sf), "test-stage")
        seen[name] = (previous, docs)
        if name != "source mixing":
            assert docs.columns == columns and docs.schema == previous.schema
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in previous.select("doc_id").collect()} and ids
    before, after = seen["quality classifier"]
    kept = {r.doc_id for r in after.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.95 * len(good)
    before, after = seen["line dedup"]
    assert after.where(F.length("text") != F.col("n_chars")).count() == before.where(F.length("text") != F.col("n_chars")).count()
    before, after = seen["near duplicates"]
    gone = near_copies.near_copies(before)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in near_copies.keep_one(before).collect()}
    assert gone.where("keep").count() > 0 and after.count() < before.count()
    before, after = seen["decontamination"]
    bad = decontaminate.contamination(before, table(spark, sf, "benchmark")).where("contaminated").count()
    assert after.count() == before.count() - bad
    before, after = seen["source mixing"]
    assert after.columns == ["source", "block", "position", "doc_id", "n_tokens"]
    total = mixing.token_counts(before).agg(F.sum("n_tokens")).first()[0]
    assert abs(after.agg(F.sum("n_tokens")).first()[0] - total) < 0.2 * total
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, after.collect()))


def test_stages_take_any_documents(spark, sf):
    odd = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2), (2, None, "en", None, 3, 3),
           (3, "word " * 30_000, "en", "a", 150_000, 4), (4, "line\n" * 2_000, "de", "b", None, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    for rows in (odd, []):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(rows, schema), sf).collect()
            assert len(out) <= 20 * len(rows)


def test_keep_good_passes_columns(spark):
    model = quality.fit([], __import__("numpy").zeros(0))
    df = spark.createDataFrame([(1, "a", [1, 2]), (None, None, None)], "doc_id long, text string, more array<int>")
    assert sorted(map(tuple, quality.keep_good(df, model).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
