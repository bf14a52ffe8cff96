"""Classifiers, calibration and staged boosting scores with Spark ML.

Models train on ``(record_id, label, features: Vector)`` frames. Scores come
back in the long evaluation shape ``(model, record_id, label, score)`` so every
metric in :mod:`wardflow.operators.metrics` compares any number of models.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow import catalog
from wardflow.session import checkpoint_dir, cut


def with_vector(df: DataFrame, array_col: str = "features", out: str = "features") -> DataFrame:
    """array<double> -> ML Vector (JVM-side)."""
    return df.withColumn(out, array_to_vector(F.col(array_col)))


#: Bytes of vectors in one task of a fit that goes over its rows many times.
FIT_BYTES = 1 << 25


def dealt_for_fit(train: DataFrame) -> DataFrame:
    """Training rows in as many partitions as their vectors fill, by record and in its order, in the checkpoint folder.

    Boosting runs a job for every level of every tree: a task must be worth its start, and every job plans anew
    whatever its rows come from, so they come from files. The rows that a tree draws go by their place, so a fixed
    place makes the model independent of how ``train`` was laid out.
    """
    checkpoint_dir(train.sparkSession)
    rows, width = train.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array("features")))).first()
    parts = max(1, math.ceil(rows * (width or 0) * 8 / FIT_BYTES))
    return train.repartition(parts, "record_id").sortWithinPartitions("record_id").checkpoint()


def train_gbt(train: DataFrame, **overrides) -> GBTClassificationModel:
    """M1: boosting with the reference's hyper-parameters (overridable)."""
    params = {**catalog.GBT_PARAMS, **overrides}
    return GBTClassifier(featuresCol="features", labelCol="label", **params).fit(dealt_for_fit(train))


def train_mlp(train: DataFrame, n_features: int, hidden: int = catalog.MLP_HIDDEN, max_iter: int = 50,
              seed: int = catalog.SEED) -> MultilayerPerceptronClassificationModel:
    """M2: one hidden layer, two outputs (softmax = sigmoid of the logit difference)."""
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label", layers=[n_features, hidden, 2], maxIter=max_iter, seed=seed
    ).fit(train)


def positive_score(model, df: DataFrame, name: str) -> DataFrame:
    """M3: positive-class probability as ``(model, record_id, label, score)``."""
    out = model.transform(df)
    return out.select(
        F.lit(name).alias("model"), "record_id", "label",
        vector_to_array(F.col("probability")).getItem(1).alias("score"),
    )


def weight_correction(scored: DataFrame, w0: float, w1: float) -> DataFrame:
    """M2 class weights as an odds correction: p' = w1 p / (w1 p + w0 (1 - p))."""
    p = F.col("score")
    return scored.withColumn("score", (F.lit(w1) * p) / (F.lit(w1) * p + F.lit(w0) * (1 - p)))


#: A round of pooling merges the blocks of this many neighbouring ranges in one task.
MERGE = 8
_BLOCK = "low double, high double, labels double, weight double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent violators among the sorted blocks of one task pooled: what stays has strictly rising means."""
    kept: list[list[float]] = []
    for batch in batches:
        for block in zip(*(batch.column(i).to_pylist() for i in range(4))):
            low, high, labels, weight = block
            while kept and kept[-1][2] * weight >= labels * kept[-1][3]:
                last = kept.pop()
                low, labels, weight = last[0], labels + last[2], weight + last[3]
            kept.append([low, high, labels, weight])
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    for i in range(0, len(kept), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*kept[i : i + 10_000])], names=names)


def pooled_blocks(scored: DataFrame) -> DataFrame:
    """M6: blocks ``(low, high, labels, weight)`` of the isotonic fit, pooled by score range.

    Tied scores meet in one weighted point first. Each round deals the blocks by range, pools the violators
    of every range in its task and writes what is left; the next round has ``MERGE`` times fewer ranges.
    Pooling within a range never undoes a pool of the whole fit, so the order of the rounds changes nothing,
    and sums of labels and weights are whole numbers, exact up to 2^53. The blocks of up to ``MERGE`` last
    ranges may still hold violators at the seams. NULL scores or labels are left out.
    """
    score, label = F.col("score").cast("double"), F.col("label").cast("double")
    points = scored.where(score.isNotNull() & label.isNotNull()).groupBy(score.alias("low")).agg(
        F.sum(label).alias("labels"), F.count(F.lit(1)).cast("double").alias("weight"))
    blocks = cut(points.select("low", F.col("low").alias("high"), "labels", "weight"), "isotonic-points")
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = blocks.repartitionByRange(ranges, "low").sortWithinPartitions("low")
        blocks = cut(dealt.mapInArrow(_pool, _BLOCK), "isotonic-blocks")
        if ranges <= MERGE:
            return blocks
        ranges = -(-ranges // MERGE)


def fit_isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    """M6 fit: monotone map score -> observed rate (ties averaged), from every distinct score.

    Spark's own fit gathers the pooled points of all partitions on the driver; here it gets the two ends of
    each block of :func:`pooled_blocks`, so the driver holds the blocks of the last merge, about what the
    fitted model itself holds.
    """
    blocks = pooled_blocks(scored)
    rate = F.col("labels") / F.col("weight")
    alone = F.col("low") == F.col("high")
    ends = F.when(alone, F.array("low")).otherwise(F.array("low", "high"))
    points = blocks.select(rate.alias("label"), (F.col("weight") / F.size(ends)).alias("weight"), F.explode(ends).alias("score"))
    return IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight",
                              predictionCol="calibrated").fit(points)


def calibrate(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    """M6 predict: interpolated, clipped to the fitted range."""
    cols = scored.columns
    out = model.transform(scored)
    return out.select(*[F.col("calibrated").alias("score") if c == "score" else F.col(c) for c in cols])


def leaf_values(model: GBTClassificationModel) -> list[list[float]]:
    """Per tree its leaves' predictions from left to right, the order in which ``leafCol`` numbers them."""
    trees = re.split(r"^ *Tree \d+ .*$", model.toDebugString, flags=re.M)[1:]
    return [[float(v) for v in re.findall(r"^ *Predict: (\S+)$", t, flags=re.M)] for t in trees]


def staged_scores(model: GBTClassificationModel, df: DataFrame, name: str = "gbt") -> DataFrame:
    """M4 + W2: probability after every boosting round.

    One transform gives a record's leaf in every tree; a constant table (one value per leaf of the model,
    times the tree's weight) turns them into contributions. Their running sums come from sums of blocks of
    about sqrt(trees), within the row, and are exploded to ``(record_id, stage)`` rows: no exchange.
    p = 1 / (1 + exp(-2 F)).
    """
    table = [[v * w for v in leaves] for leaves, w in zip(leaf_values(model), model.treeWeights)]
    n = len(table)
    width = math.isqrt(n - 1) + 1
    leaf_model = model.copy()
    leaf_model.setLeafCol("_leaf")
    x = leaf_model.transform(df.select("record_id", "label", "features"))
    values = F.from_json(F.lit(json.dumps(table)), "array<array<double>>")  # folded to one constant
    x = x.select("record_id", "label", F.zip_with(vector_to_array("_leaf"), values, lambda at, v: F.get(v, at.cast("int"))).alias("_v"))

    def total(first, count):
        return F.aggregate(F.slice("_v", first + 1, count), F.lit(0.0), lambda s, v: s + v)

    starts = F.array(*(F.lit(i) for i in range(0, n, width)))
    x = x.withColumn("_blocks", F.transform(starts, lambda i: total(i, F.lit(width))))
    x = x.withColumn("_before", F.transform(starts, lambda i: F.aggregate(
        F.slice("_blocks", F.lit(1), (i / width).cast("int")), F.lit(0.0), lambda s, v: s + v)))

    def upto(i):
        block = F.floor(i / width).cast("int")
        return F.get("_before", block) + total(block * width, i - block * width + 1)

    margins = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), upto)
    long = x.select("record_id", "label", F.posexplode(margins).alias("i", "margin"))
    return long.select(
        F.lit(name).alias("model"), "record_id", "label", (F.col("i") + 1).alias("stage"),
        (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score"),
    )


def staged_metrics(staged: DataFrame, threshold: float = 0.23, strict: bool = False) -> DataFrame:
    """M5: log-loss, recall, accuracy per boosting round."""
    from wardflow.operators.metrics import EPS

    p = F.least(F.greatest(F.col("score"), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col("label")
    pred = (F.col("score") > threshold) if strict else (F.col("score") >= threshold)
    pred = pred.cast("int")
    tp = F.sum(y * pred)
    return staged.groupBy("model", "stage").agg(
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.coalesce(F.try_divide(tp.cast("double"), F.sum(y).cast("double")), F.lit(0.0)).alias("recall"),
        F.avg((pred == y).cast("double")).alias("accuracy"),
    )


def save_pipeline(path: str, model, scaler_stats: DataFrame) -> str:
    """Persist the fitted model and scaler statistics side by side."""
    model.write().overwrite().save(os.path.join(path, "model"))
    scaler_stats.write.mode("overwrite").parquet(os.path.join(path, "scaler"))
    return path


def load_pipeline(spark, path: str, kind: str = "mlp"):
    """Load once, reuse for every scoring batch."""
    loader = {
        "mlp": MultilayerPerceptronClassificationModel,
        "gbt": GBTClassificationModel,
    }[kind]
    model = loader.load(os.path.join(path, "model"))
    stats = spark.read.parquet(os.path.join(path, "scaler"))
    return model, stats
