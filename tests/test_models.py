"""Fits with hard and soft labels, and predictions, against numpy over all rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from boardlake.operators import models as L
from boardlake.plans.fixtures import Tables
from boardlake.plans.q_features import soft_rows, weighted


def table(spark, n=300, classes=4, width=3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1.5, (classes, width))
    rows = []
    for i in range(n):
        y = int(rng.integers(classes))
        target = rng.dirichlet(np.ones(classes)).tolist() if i % 3 == 0 else None
        rows.append((i, (centres[y] + rng.normal(0, 1, width)).tolist(), y, float(rng.uniform(0.5, 2)), target))
    return spark.createDataFrame(rows, "id long, x array<double>, label int, weight double, target array<double>").repartition(2).cache()


def test_gradient_equals_finite_differences(spark):
    df = table(spark)
    rows = df.select("x", F.col("label").cast("long").alias("label"), "weight", "target")
    p = np.random.default_rng(2).normal(0, 0.5, (4, 4))
    loss, gradient = L.soft_loss(rows, p, 0.7, 3.0, 0.05)
    for i, j in ((0, 0), (3, 3)):
        e = np.zeros_like(p)
        e[i, j] = 1e-5
        slope = (L.soft_loss(rows, p + e, 0.7, 3.0, 0.05)[0] - L.soft_loss(rows, p - e, 0.7, 3.0, 0.05)[0]) / 2e-5
        assert abs(slope - gradient[i, j]) < 1e-7
    again = L.soft_loss(rows, p, 0.7, 3.0, 0.05)
    assert again[0] == loss and (again[1] == gradient).all()


def test_loss_by_definition(spark):
    df = table(spark, 60)
    data, p = df.collect(), np.random.default_rng(3).normal(0, 1, (4, 4))
    hard = soft = weight = taught = 0.0
    for r in data:
        z = p @ np.array([*r.x, 1.0])
        logp = z - np.log(np.exp(z).sum())
        hard -= r.weight * logp[r.label]
        weight += r.weight
        if r.target:
            logq = z / 2 - np.log(np.exp(z / 2).sum())
            soft += sum(t * (np.log(t) - q) for t, q in zip(r.target, logq))
            taught += 1
    want = hard / weight + 0.3 * 4 * soft / taught + 0.01 / 2 * (p[:, :-1] ** 2).sum()
    rows = df.select("x", F.col("label").cast("long").alias("label"), "weight", "target")
    assert abs(L.soft_loss(rows, p, 0.3, 2.0, 0.01)[0] - want) < 1e-12


def test_weights_equal_the_expanded_fit(spark):
    """At temperature 1 the soft loss is that of one weighted row for each class of a target."""
    df, share, l2 = table(spark), 0.4, 0.02
    fit = L.fit_soft(df, "x", "label", "weight", "target", 4, share, 1.0, l2, epochs=60, tolerance=1e-6)
    weight, taught = df.agg(F.sum("weight"), F.count("target")).first()
    targets = df.where("target IS NOT NULL").select("id", "target")
    rows = L.distillation_rows(df, targets, ["id"], "label", "weight", share * weight / taught).join(df.select("id", "x"), "id")
    ready = rows.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), "weight")
    total = rows.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(weightCol="weight", maxIter=500, tol=1e-12, regParam=l2 * weight / total, standardization=False,
                               family="multinomial").fit(ready)
    # Equal losses up to a factor; a constant added to all intercepts changes nothing.
    assert np.allclose(model.coefficientMatrix.toArray(), fit.weights, atol=2e-4)
    b = model.interceptVector.toArray()
    assert np.allclose(b - b.mean(), fit.intercepts - fit.intercepts.mean(), atol=2e-4)
    losses = [h["loss"] for h in fit.history]
    assert losses == sorted(losses, reverse=True) and len(losses) < 60


def test_scores_params_and_refusals(spark):
    df, epochs = table(spark, 80), []
    fit = L.fit_soft(df, "x", "label", "weight", "target", 4, epochs=3, on_epoch=lambda n, f: epochs.append((n, f.weights.copy())))
    assert [n for n, _ in epochs] == [1, 2, 3] and not np.allclose(epochs[0][1], epochs[2][1])
    for r in df.select("x", fit.scores(F.col("x")).alias("s")).collect():
        assert np.allclose(r.s, fit.weights @ np.array(r.x) + fit.intercepts)
    params = {(r.name, r.i): r.value for r in fit.params(spark).collect()}
    assert params["weights", 4] == fit.weights.ravel()[4] and params["intercepts", 3] == fit.intercepts[3]
    with pytest.raises(ValueError, match="no rows"):
        L.fit_soft(df.limit(0), "x", "label", "weight", "target", 4)
    bad = df.withColumn("x", F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0)))
    with pytest.raises(ValueError, match="not finite"):
        L.fit_soft(bad, "x", "label", "weight", "target", 4)
    untaught = L.fit_soft(df.withColumn("target", F.lit(None).cast("array<double>")), "x", "label", "weight", "target", 4, epochs=2)
    assert np.isfinite(untaught.weights).all()


def test_predictions_equal_the_exported_coefficients(spark, sf):
    """Classes and scores of all rows from the coefficients alone."""
    t = Tables(spark, sf)
    df = weighted(t)
    model = L.fit_classifier(df, "embedding", "label", "weight")
    w, b = model.stages[0].coefficientMatrix.toArray(), model.stages[0].interceptVector.toArray()
    x = {r.vec_id: (np.array(r.embedding, float), r.label) for r in t.embeddings.collect()}
    rows = L.predict(t.embeddings, model, "embedding", ["vec_id"]).collect()
    assert len(rows) == len(x)
    for r in rows:
        z = w @ x[r.vec_id][0] + b
        assert np.allclose(z, r.scores, atol=1e-9) and r.class_id == int(z.argmax())
    # At the fit the gradient of the weighted loss vanishes for the free intercepts.
    p = {r.vec_id: np.exp(np.array(r.scores) - max(r.scores)) for r in rows}
    weights = {r.vec_id: r.weight for r in df.collect()}
    slope = sum(weights[i] * (q / q.sum() - np.eye(len(b))[x[i][1]]) for i, q in p.items()) / sum(weights.values())
    assert np.abs(slope).max() < 1e-3


def test_soft_fit_learns_the_given_table(spark, sf):
    t = Tables(spark, sf)
    fit = L.fit_soft(soft_rows(t), "embedding", "label", "weight", "target", 10, 0.25, 2.0, epochs=5)
    ok = t.embeddings.where(L.argmax(fit.scores(F.col("embedding"))) == F.col("label")).count()
    most = max(r["count"] for r in t.embeddings.groupBy("label").count().collect())
    assert ok > 2 * most  # the labels are noisy; twice as good as the most common one
