"""Weighted fits, soft targets, averaging and candidate selection (family M)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.functions.placement import let, literal_array
from boardlake.functions.rules import differs
from boardlake.operators.metrics import count_of, ratio
from boardlake.operators.setops import select_best

ONE = "*"


def fit_classifier(df: DataFrame, features: str, label: str, weight: str, iterations: int = 30,
                   l2: float = 0.01) -> PipelineModel:
    """Weighted multinomial fit over a table; deterministic (no sampling, L-BFGS)."""
    ready = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"),
                      F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
    model = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=l2, family="multinomial").fit(ready)
    return PipelineModel([model])


def predict(df: DataFrame, model: PipelineModel, features: str, keys: Sequence[str]) -> DataFrame:
    """Class ids and raw scores for every row."""
    ready = df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    return model.transform(ready).select(*keys, F.col("prediction").cast("long").alias("class_id"),
                                         vector_to_array("rawPrediction").alias("scores"))


def score_with(df: DataFrame, score_fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Extension point: any DataFrame-to-DataFrame scorer (a fitted model or mapInPandas)."""
    return score_fn(df)


def argmax(scores: Column | str) -> Column:
    """Index of the largest score, first on ties."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return let(s, lambda v: (F.array_position(v, F.array_max(v)) - 1)).cast("long")


def softmax(scores: Column | str, temperature: float = 1.0) -> Column:
    s = F.col(scores) if isinstance(scores, str) else scores

    def scaled(v: Column) -> Column:
        top = F.array_max(v)
        return let(F.struct(v.alias("v"), top.alias("m")), lambda b: F.transform(
            b["v"], lambda x: F.exp((x - b["m"]) / temperature)))

    return let(let(s, scaled), lambda e: let(
        F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("t")),
        lambda b: F.transform(b["e"], lambda x: x / b["t"])))


def soft_targets(df: DataFrame, keys: Sequence[str], scores: str, temperature: float,
                 where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.select(*keys, softmax(F.col(scores).cast("array<double>"), temperature).alias("target"))


def distillation_rows(hard: DataFrame, targets: DataFrame, keys: Sequence[str], label: str, weight: str,
                      soft_weight: float) -> DataFrame:
    """Hard rows plus one weighted row per class of a soft target."""
    own = hard.select(*keys, F.col(label).cast("long").alias("label"), F.col(weight).cast("double").alias("weight"))
    soft = targets.select(*keys, F.posexplode("target").alias("_k", "_p")).select(
        *keys, F.col("_k").cast("long").alias("label"), (F.col("_p") * soft_weight).alias("weight"))
    return own.unionByName(soft)


def teacher_mask(df: DataFrame, keys: Sequence[str], pool: str, pools: Sequence[str], label: str,
                 target_class: Column, guard: bool) -> DataFrame:
    """Rows the teacher may speak on; the guard drops empty cells with a piece target."""
    mask = F.col(pool).isin(*pools)
    if guard:
        mask = mask & ~((F.col(label) == 0) & (target_class != 0))
    return df.select(*keys, F.coalesce(mask, F.lit(False)).alias("use_teacher"))


def average_params(a: DataFrame, b: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(1 - f) a + f b for every fraction over (name, i, value) tables."""
    j = a.select("name", "i", F.col("value").alias("_a")).join(
        b.select("name", "i", F.col("value").alias("_b")), ["name", "i"])
    return j.select("name", "i", "_a", "_b", F.explode(literal_array(fractions)).alias("fraction")).select(
        "fraction", "name", "i", (F.col("_a") * (1 - F.col("fraction")) + F.col("_b") * F.col("fraction")).alias("value"))


def incompatible_params(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names whose length differs or that only one model has."""
    def sizes(df, out):
        return df.groupBy("name").agg(F.count(ONE).alias(out))
    j = sizes(a, "left_size").join(sizes(b, "right_size"), "name", "full")
    return j.where(differs("left_size", "right_size"))


def validate(df: DataFrame, model: Sequence[str], board: str, label: str, scores: str,
             control: Column) -> DataFrame:
    """Loss, accuracy, macro recall, exact and control-exact boards per candidate."""
    p = F.get(F.col("_p"), F.col(label).cast("int"))
    rows = df.withColumn("_p", softmax(F.col(scores).cast("array<double>"))).select(
        *model, board, label, (-F.log(p)).alias("_loss"), (argmax("_p") == F.col(label)).alias("_ok"),
        control.alias("_control"))
    per = rows.groupBy(*model, board, label, "_control").agg(
        F.count(ONE).alias("_n"), count_of(F.col("_ok")).alias("_c"), F.sum("_loss").alias("_l"))
    boards = per.groupBy(*model, board, "_control").agg(
        F.sum("_n").alias("_n"), F.sum("_c").alias("_c"), F.sum("_l").alias("_l"))
    exact = F.col("_n") == F.col("_c")
    out = boards.groupBy(*model).agg(
        F.count(ONE).alias("boards"), count_of(exact).alias("exact_boards"),
        count_of(exact & F.col("_control")).alias("control_exact_boards"),
        ratio(F.sum("_c"), F.sum("_n")).alias("accuracy"),
        F.round(F.sum("_l") / F.sum("_n"), 6).alias("loss"))
    recall = per.groupBy(*model, label).agg(ratio(F.sum("_c"), F.sum("_n")).alias("_r")).groupBy(*model).agg(
        F.round(F.avg("_r"), 9).alias("macro_recall"))
    return out.join(recall, list(model))


def select_candidate(metrics: DataFrame, eligible: Column, ranking: Sequence[Column]) -> DataFrame:
    """Best candidate among those that preserve the reference; earliest wins ties."""
    return select_best(metrics.where(eligible), ranking)


def preserves_reference(cells: DataFrame, model: str, board: str, baseline_ok: str, ok: str) -> DataFrame:
    """Per candidate: no baseline-exact board lost and no fewer correct cells."""
    b = cells.groupBy(model, board).agg(
        F.bool_and(baseline_ok).alias("_b"), F.bool_and(ok).alias("_o"),
        count_of(F.col(baseline_ok)).alias("_bn"), count_of(F.col(ok)).alias("_on"))
    return b.groupBy(model).agg(
        count_of(F.col("_b") & ~F.col("_o")).alias("lost_boards"), count_of(F.col("_o")).alias("exact_boards"),
        F.sum("_on").alias("correct_cells"),
        ((count_of(F.col("_b") & ~F.col("_o")) == 0) & (F.sum("_on") >= F.sum("_bn"))).alias("preserved"))


def margin(scores: Column | str, label: Column | str) -> Column:
    """True score minus the best other score."""
    s = F.col(scores) if isinstance(scores, str) else scores
    y = F.col(label) if isinstance(label, str) else label
    return let(F.struct(s.alias("s"), y.cast("int").alias("y")), lambda b: F.get(b["s"], b["y"]) - F.array_max(
        F.transform(b["s"], lambda v, i: F.when(i != b["y"], v))))


class SoftFit:
    """Fitted weights (classes, features), intercepts, and what every epoch reached."""

    def __init__(self, weights: np.ndarray, intercepts: np.ndarray, history: list[dict]):
        self.weights, self.intercepts, self.history = weights, intercepts, history

    def scores(self, features: Column) -> Column:
        """Raw scores of a feature array, as a column expression."""
        x = features.cast("array<double>")
        rows = [F.aggregate(F.zip_with(x, literal_array(w.tolist()), lambda a, b: a * b), F.lit(float(b)), lambda a, v: a + v)
                for w, b in zip(self.weights, self.intercepts)]
        return F.array(*rows)

    def params(self, spark: SparkSession) -> DataFrame:
        """(name, i, value) rows, as :func:`average_params` takes them."""
        rows = [("weights", i, v) for i, v in enumerate(self.weights.ravel().tolist())]
        rows += [("intercepts", i, v) for i, v in enumerate(self.intercepts.tolist())]
        return spark.createDataFrame(rows, "name string, i long, value double")


def batch_loss(x: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray, teach: np.ndarray, params: np.ndarray,
               temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums over some rows: (hard loss, its weight, soft loss, its rows) and both gradients, one after the other.

    ``params`` has a row for each class, the intercept last. The hard loss is weighted cross-entropy, the soft one
    the divergence of the softened scores from ``target`` on the rows of ``teach``.
    """
    ones = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    z = ones @ params.T

    def log_soft(v):
        v = v - v.max(axis=1, keepdims=True)
        return v - np.log(np.exp(v).sum(axis=1, keepdims=True))

    logp = log_soft(z)
    rows = np.arange(len(x))
    d = np.exp(logp)
    d[rows, label] -= 1
    hard = -(weight * logp[rows, label]).sum()
    t, logq = target[teach], log_soft(z[teach] / temperature)
    soft = (t * (np.log(np.where(t > 0, t, 1.0)) - logq)).sum()
    g_soft = ((np.exp(logq) * t.sum(axis=1, keepdims=True) - t) / temperature).T @ ones[teach]
    return np.array([hard, weight.sum(), soft, teach.sum()]), np.concatenate(((d * weight[:, None]).T @ ones, g_soft)).ravel()


def soft_loss(df: DataFrame, params: np.ndarray, soft_weight: float, temperature: float, l2: float,
              slots: int = 64) -> tuple[float, np.ndarray]:
    """Loss and gradient over a whole table (x, label, weight, target or null) in one job.

    Every partition sends one array of fixed size; slots add them up in the order of the partitions, so the sum is the same each
    time and at most ``slots`` arrays reach the driver.
    """
    classes, width = params.shape
    size = 4 + 2 * classes * width

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if not len(pdf):
                continue
            teach = pdf["target"].notna().to_numpy()
            target = np.zeros((len(pdf), classes))
            if teach.any():
                target[teach] = np.stack(pdf["target"][teach])
            sums, gradient = batch_loss(np.stack(pdf["x"]), pdf["label"].to_numpy(), pdf["weight"].to_numpy(), target, teach, params,
                                        temperature)
            total[:4] += sums
            total[4:] += gradient
        total[~np.isfinite(total)] = np.inf  # NaN would travel as null
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [total]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "sums": [np.sum(np.stack(pdf["sums"]), axis=0)]})

    schema = "part int, sums array<double>"
    parts = df.mapInPandas(partial, schema)
    rows = parts.groupBy((F.col("part") % slots).alias("slot")).applyInPandas(add, schema).collect()
    total = np.sum([np.array(r.sums) for r in sorted(rows, key=lambda r: r.part)], axis=0) if rows else np.zeros(size)
    hard, weight, soft, taught = total[:4]
    g_hard, g_soft = total[4:].reshape(2, classes, width)
    free = np.concatenate((params[:, :-1], np.zeros((classes, 1))), axis=1)  # intercepts are not drawn to zero
    scale = soft_weight * temperature ** 2 / max(taught, 1)
    loss = hard / max(weight, 1e-300) + scale * soft + l2 / 2 * (free ** 2).sum()
    return float(loss), g_hard / max(weight, 1e-300) + scale * g_soft + l2 * free


def _direction(gradient: np.ndarray, steps: list) -> np.ndarray:
    """L-BFGS: the gradient bent by the last (step, change of gradient) pairs."""
    q, held = gradient.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        held.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(held)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def fit_soft(df: DataFrame, features: str, label: str, weight: str, target: str, classes: int, soft_weight: float = 0.25,
             temperature: float = 1.0, l2: float = 0.01, epochs: int = 30, tolerance: float = 1e-7,
             on_epoch: Callable[[int, SoftFit], None] | None = None) -> SoftFit:
    """Multinomial fit of hard labels and soft targets together, deterministic, with one row for each cell.

    The loss is the weighted mean cross-entropy, plus ``soft_weight`` times temperature squared times the mean divergence from
    ``target`` on the rows that have one (softened with the same temperature), plus l2. ``on_epoch`` sees every epoch's parameters,
    for example to compute validation metrics for :func:`select_candidate`. A loss that is not finite is an error.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("long").alias("label"),
                     F.col(weight).cast("double").alias("weight"), F.col(target).cast("array<double>").alias("target"))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        raise ValueError("no rows to fit")
    at, steps, history = np.zeros(classes * (width + 1)), [], []

    def evaluate(p):
        loss, gradient = soft_loss(rows, p.reshape(classes, -1), soft_weight, temperature, l2)
        if not np.isfinite(loss):
            raise ValueError("the loss is not finite")
        return loss, gradient.ravel()

    def fitted(p):
        shaped = p.reshape(classes, -1)
        return SoftFit(shaped[:, :-1].copy(), shaped[:, -1].copy(), history)

    loss, gradient = evaluate(at)
    for epoch in range(1, epochs + 1):
        move = _direction(gradient, steps)
        pace, slope = (1.0 if steps else min(1.0, 1.0 / max(np.abs(gradient).max(), 1e-12))), gradient @ move
        new = at + pace * move
        new_loss, new_gradient = evaluate(new)
        while new_loss > loss + 1e-4 * pace * slope and pace > 1e-6:
            pace /= 2
            new = at + pace * move
            new_loss, new_gradient = evaluate(new)
        if new_loss >= loss:  # nothing left to gain but rounding
            break
        step, change = new - at, new_gradient - gradient
        if step @ change > 1e-12:
            steps = [*steps[-9:], (step, change)]
        at, loss, gradient = new, new_loss, new_gradient
        history.append({"epoch": epoch, "loss": loss})
        if on_epoch:
            on_epoch(epoch, fitted(at))
        if np.abs(gradient).max() <= tolerance:
            break
    return fitted(at)
