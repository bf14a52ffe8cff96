"""Registered queries: vectors, sequences, models, calibration, staged scores, form scoring.

Model outputs are not expressible in SQL: those entries have no oracle and
the driver checks rows only. Vector and sequence reshapes have oracles.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from wardflow import catalog
from wardflow.operators import features as fx
from wardflow.operators import intake as ik
from wardflow.operators import metrics as me
from wardflow.operators import models as mo
from wardflow.operators import sample as sm
from wardflow.operators import scale as sc
from wardflow.operators.challenge import challenge_scores
from wardflow.plans import q_features as QF
from wardflow.plans import q_intake as QI
from wardflow.plans import q_streams as QS
from wardflow.plans import sqltext as S
from wardflow.plans.registry import query, rounded, stable
from wardflow.session import cut, scratch_path
from wardflow.sources import standins as SI
from wardflow.streaming.streams import read_latest, score_rows, score_stream


def _scaled_long(spark, sf_dir):
    ft = QF.feature_table_df(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return sc.apply_scaler(ft, sc.fit_scaler(ft.where(F.col("split") == "a")))


def _vectors(spark, sf_dir, rounded_values: bool = True):
    """(record_id, split, features array<double>) of scaled features, fixed order (rounded for the oracles only)."""
    long = _scaled_long(spark, sf_dir)
    v = fx.to_vector(stable(long) if rounded_values else long, QF.feature_names())
    return v.join(QF.split_records(spark, sf_dir), "record_id", "inner")


_VEC_SQL = S.with_(*QF._FULL, QF._SCALER) + """, sv AS (SELECT f.record_id, f.split, f.feature,
    round((f.value - s.mean) / s.scale, 9) AS value FROM ftab f LEFT JOIN stats s USING (feature))
"""


@query("feature_vectors", _VEC_SQL + "SELECT record_id, split, list(value ORDER BY feature) AS features "
                            "FROM sv GROUP BY record_id, split")
def feature_vectors(spark, sf_dir):
    """R2 (scalable form): scaled features as one fixed-order array per record."""
    return _vectors(spark, sf_dir)


_OUT_SQL = """outc AS (SELECT user_id AS record_id,
    CAST(arg_max(event_type, (ts, event_id)) = 'error' AS INTEGER) AS label FROM events GROUP BY user_id)"""


@query("sequences", _VEC_SQL + ", " + _OUT_SQL + """SELECT v.record_id, [list(CAST(value AS FLOAT) ORDER BY feature)] AS sequence,
  o.label FROM sv v JOIN outc o USING (record_id) GROUP BY v.record_id, o.label""")
def sequences(spark, sf_dir):
    """(N, F) -> (N, 1, F) float tensors joined to labels by id, with width/id checks.

    Records without an outcome (customers without events) have no label to join.
    """
    out = SI.event_outcomes(spark, sf_dir)
    v = _vectors(spark, sf_dir).select("record_id", "features").join(out, "record_id", "left_semi")
    return fx.to_sequences(v, out, len(QF.feature_names()))


def _training(spark, sf_dir):
    """Scaled vectors with labels, per split (a = train, b = test, c = validation), in the checkpoint folder.

    Fits and scores start from there: their hundreds of jobs plan nothing of the feature table. A checkpoint
    keeps rows in their places, by which the MLP adds up its gradients.
    """
    v = _vectors(spark, sf_dir, rounded_values=False).join(SI.event_outcomes(spark, sf_dir), "record_id", "inner")
    return mo.with_vector(v).select("record_id", "split", "label", "features").persist(StorageLevel.MEMORY_AND_DISK).checkpoint()


def _gbt_monitored(spark, sf_dir):
    """Boosting fitted on the undersampled training split (the monitored fit)."""
    data = _training(spark, sf_dir)
    train = sm.undersample_majority(data.where(F.col("split") == "a"), seed=catalog.SEED)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    return mo.train_gbt(train), train, data


@query("gbt_scores")
def gbt_scores(spark, sf_dir, data=None):
    """M1 + U2 + M3 + P5: boosting refitted on training + validation splits stacked, test split scored (>= 0.23)."""
    data = _training(spark, sf_dir) if data is None else data
    stacked = data.where(F.col("split") == "a").unionByName(data.where(F.col("split") == "c"))
    model = mo.train_gbt(stacked)
    s = mo.positive_score(model, data.where(F.col("split") == "b"), "gbt")
    thr, strict = catalog.THRESHOLDS["gbt"]
    return s.withColumn("pred", ((F.col("score") >= thr) if not strict else (F.col("score") > thr)).cast("int"))


@query("gbt_staged")
def gbt_staged(spark, sf_dir):
    """M4 + M5 + W2: log-loss, recall and accuracy after every boosting round, train and validation."""
    model, train, data = _gbt_monitored(spark, sf_dir)
    parts = []
    for frame, name in ((train, "train"), (data.where(F.col("split") == "c"), "validation")):
        st = mo.staged_scores(model, frame, name)
        parts.append(mo.staged_metrics(st))
    return parts[0].unionByName(parts[1])


def _mlp(spark, sf_dir, data=None):
    data = _training(spark, sf_dir) if data is None else data
    train = data.where(F.col("split") == "a")
    weights = {r["label"]: r["weight"] for r in sm.class_weights(train).collect()}  # one row per class
    model = mo.train_mlp(train, len(QF.feature_names()))
    return model, data, weights


def _mlp_scored(model, data, weights, split, name="mlp"):
    s = mo.positive_score(model, data.where(F.col("split") == split), name)
    if len(weights) == 2:
        s = mo.weight_correction(s, weights.get(0, 1.0), weights.get(1, 1.0))
    return s


@query("mlp_calibrated")
def mlp_calibrated(spark, sf_dir, data=None):
    """M2 + M6: MLP with class-weight odds correction, isotonic fit on validation, test scored (> 0.35)."""
    model, data, weights = _mlp(spark, sf_dir, data)
    iso = mo.fit_isotonic(_mlp_scored(model, data, weights, "c"))
    test = mo.calibrate(iso, _mlp_scored(model, data, weights, "b"))
    thr, strict = catalog.THRESHOLDS["mlp"]
    return test.withColumn("pred", ((F.col("score") > thr) if strict else (F.col("score") >= thr)).cast("int"))


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """M7 + E11 + E12/E14: both models on the same test split, every metric grouped by model."""
    data = _training(spark, sf_dir)
    g = gbt_scores(spark, sf_dir, data)
    m = mlp_calibrated(spark, sf_dir, data)
    scored = g.unionByName(m).persist(StorageLevel.MEMORY_AND_DISK)
    return me.metric_summary(scored).join(challenge_scores(scored), "model", "left")


def _learns(session):
    """The third of the sessions (by id hash) that the form's model is fitted on."""
    return F.pmod(F.crc32(session.cast("binary")), F.lit(3)) == 0


def form_model(spark, sf_dir) -> str:
    """Scaler and MLP fitted on the learning sessions, with the session's latest order status as label, saved
    to the shared folder; the path."""
    rows = ik.answers_to_features(ik.replay_answers(QI.answers_df(spark, sf_dir).where(_learns(F.col("session_id")))))
    rows = cut(rows.withColumnRenamed("session_id", "record_id"), "form-rows")
    names = ik.model_feature_names()
    o = SI.table(spark, sf_dir, "orders")
    lab = o.groupBy(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("record_id")).agg(
        (F.max_by("o_orderstatus", "o_orderkey") == "F").cast("int").alias("label"))
    stats = sc.fit_scaler(rows)
    train = mo.with_vector(fx.to_vector(sc.apply_scaler(rows, stats), names).join(lab, "record_id", "inner"))
    path = scratch_path(spark, "form-pipeline")
    mo.save_pipeline(path, mo.train_mlp(train, len(names)), stats)
    return path


@query("score_answers")
def score_answers(spark, sf_dir, path: str | None = None):
    """F11 + S5 + I6 + P6: form rows -> scaler -> MLP (saved and loaded once) -> RISK band on the raw score.

    The model is fitted on a third of the sessions and scores the others.
    """
    model, stats = mo.load_pipeline(spark, path or form_model(spark, sf_dir), "mlp")
    others = QI.answers_df(spark, sf_dir).where(~_learns(F.col("session_id")))
    return score_rows(ik.answers_to_features(ik.replay_answers(others)), model, stats, ik.model_feature_names(), catalog.THRESHOLDS["mlp"][0])


@query("score_stream")
def score_stream_query(spark, sf_dir, path: str | None = None):
    """T1 + F11: the same sessions scored as their answers arrive; equals ``score_answers`` under one model."""
    answers = QS.answers_stream(spark, sf_dir).where(~_learns(F.col("session_id")))
    out = scratch_path(spark, "score-stream")
    score_stream(answers, out, path or form_model(spark, sf_dir), catalog.THRESHOLDS["mlp"][0])
    return read_latest(spark, out, ["session_id"])


@query("stacked_rows", S.with_(*QF._FULL) + "SELECT record_id, split, feature, round(value, 9) AS value FROM ftab "
       "WHERE split IN ('a', 'c')")
def stacked_rows(spark, sf_dir):
    """Training and validation rows stacked, as the final fit reads them."""
    ft = QF.feature_table_df(spark, sf_dir)
    return stable(ft.where(F.col("split") == "a").unionByName(ft.where(F.col("split") == "c")).select("record_id", "split", "feature", "value"))
