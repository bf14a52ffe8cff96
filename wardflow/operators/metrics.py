"""Evaluation tables over a long scored frame ``(model, record_id, label, pred, score)``.

Every metric groups by ``model``, so any number of models is compared in one
pass. Curves work on the per-(model, score) histogram: the number of rows
never matters, only the number of distinct scores, and even that is ranked
with G1 (no single partition).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.operators.ranks import running_totals

EPS = float(np.finfo(np.float64).eps)
# Inner edges of 10 uniform calibration bins, as linspace(0, 1, 11) gives them.
CALIBRATION_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)[1:-1]]


def _div0(a, b):
    """a / b, 0 when b is 0 (the scorer's zero-division rule)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(scored: DataFrame) -> DataFrame:
    """Counts on the full 2x2 spine per model (absent cells are 0)."""
    counts = scored.groupBy("model", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    spine = (
        scored.select("model").distinct()
        .withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("pred", F.explode(F.array(F.lit(0), F.lit(1))))
    )
    return spine.join(counts, ["model", "label", "pred"], "left").select(
        "model", "label", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def _cells(scored: DataFrame) -> DataFrame:
    y, p = F.col("label"), F.col("pred")
    return scored.groupBy("model").agg(
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("fn"),
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).alias("tn"),
    )


def precision_recall(scored: DataFrame) -> DataFrame:
    """Precision, recall, accuracy (0 on an empty denominator)."""
    c = _cells(scored)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "model",
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def classification_report(scored: DataFrame) -> DataFrame:
    """Per class P/R/F1/support, then accuracy, macro and weighted averages."""
    c = _cells(scored)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def f1(p, r):
        return F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))

    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    wide = c.select(
        "model", p0.alias("p0"), r0.alias("r0"), f1(p0, r0).alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1(p1, r1).alias("f1"), s1.alias("s1"),
        _div0(tp + tn, n).alias("acc"), n.cast("double").alias("n"),
    )
    P, R, F1, S = (F.col(x) for x in ("p0", "r0", "f0", "s0"))
    Q, U, G, V = (F.col(x) for x in ("p1", "r1", "f1", "s1"))
    N = F.col("n")
    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), s.cast("double").alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", P, R, F1, S),
        row("1", Q, U, G, V),
        row("accuracy", none, none, F.col("acc"), N),
        row("macro avg", (P + Q) / 2, (R + U) / 2, (F1 + G) / 2, N),
        row("weighted avg", _div0(P * S + Q * V, N), _div0(R * S + U * V, N), _div0(F1 * S + G * V, N), N),
    )
    return wide.select("model", F.explode(rows).alias("r")).select("model", "r.*")


def score_histogram(scored: DataFrame) -> DataFrame:
    """Per (model, distinct score): positives and negatives."""
    return scored.where(F.col("score").isNotNull()).groupBy("model", "score").agg(
        F.sum(F.col("label")).cast("long").alias("pos"),
        F.sum(1 - F.col("label")).cast("long").alias("neg"),
    )


def cumulative(scored: DataFrame) -> DataFrame:
    """Descending-score cumulative TP/FP per model (G1): one row per distinct score.

    Columns: model, score, pos, neg, tp (= cum pos), fp (= cum neg), P, N.
    """
    h = score_histogram(scored)
    rt = running_totals(h, "score", ["pos", "neg"], partition_cols=["model"], descending=True)
    return rt.select(
        "model", "score", "pos", "neg",
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("total_pos").alias("P"), F.col("total_neg").alias("N"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact ROC-AUC with ties (trapezoids between distinct scores)."""
    c = cumulative(scored)
    d = lambda name: F.col(name).cast("double")  # noqa: E731  products of counts pass 2**63
    area = d("neg") * (2 * d("tp") - d("pos")) / 2.0
    return c.groupBy("model").agg(
        F.try_divide(F.sum(area), F.first(d("P")) * F.first(d("N"))).alias("auc")
    )


def roc_curve(scored: DataFrame) -> DataFrame:
    """E5: (fpr, tpr) at every distinct score, positive = score >= threshold."""
    c = cumulative(scored)
    return c.select(
        "model", F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("P")).alias("tpr"),
    )


def pr_curve(scored: DataFrame) -> DataFrame:
    """(precision, recall) at every distinct score."""
    c = cumulative(scored)
    return c.select(
        "model", F.col("score").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("P")).alias("recall"),
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """AP = sum over distinct scores of (R_n - R_(n-1)) * P_n; NULL for a model without positives."""
    c = cumulative(scored)
    term = F.try_divide(F.col("pos"), F.col("P")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.groupBy("model").agg(F.sum(term).alias("average_precision"))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Precision, recall, accuracy for every distinct score as threshold (>=), one pass."""
    c = cumulative(scored)
    tn = F.col("N") - F.col("fp")
    return c.select(
        "model", F.col("score").alias("threshold"),
        _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div0(F.col("tp"), F.col("P")).alias("recall"),
        _div0(F.col("tp") + tn, F.col("P") + F.col("N")).alias("accuracy"),
    )


def brier(scored: DataFrame) -> DataFrame:
    """E8."""
    return scored.groupBy("model").agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))


def log_loss(scored: DataFrame, score_col: str = "score", by=("model",)) -> DataFrame:
    """Mean binary cross-entropy, scores clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(score_col), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col("label")
    return scored.groupBy(*by).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def calibration_bin(score) -> F.Column:
    """Bin id = number of inner edges strictly below the score (edge values go down)."""
    s = F.col(score) if isinstance(score, str) else score
    return sum((F.when(s > F.lit(e), 1).otherwise(0) for e in CALIBRATION_EDGES), F.lit(0))


def calibration(scored: DataFrame) -> DataFrame:
    """10 uniform bins; empty bins are absent."""
    return (
        scored.where(F.col("score").isNotNull())
        .withColumn("bin", calibration_bin("score"))
        .groupBy("model", "bin")
        .agg(F.avg("label").alias("prob_true"), F.avg("score").alias("prob_pred"), F.count(F.lit(1)).alias("n"))
    )


def metric_summary(scored: DataFrame) -> DataFrame:
    """AUC, precision, recall, accuracy, Brier in one row per model."""
    return (
        roc_auc(scored)
        .join(precision_recall(scored), "model")
        .join(brier(scored), "model")
        .select("model", "auc", "precision", "recall", "accuracy", "brier")
    )
