"""Registered queries: thresholds, evaluation tables, challenge score (over ``orders`` stand-in)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow.functions.scalar import risk_band
from wardflow.operators import challenge as ch
from wardflow.operators import metrics as me
from wardflow.plans import sqltext as S
from wardflow.plans.registry import query, rounded, stable
from wardflow.session import scratch_path
from wardflow.sources import readings as rd
from wardflow.sources import standins as SI

_SCORED = """sc AS (
  SELECT *, CASE WHEN model = 'mlp' THEN CASE WHEN score > 0.35 THEN 1 ELSE 0 END
                 ELSE CASE WHEN score >= 0.23 THEN 1 ELSE 0 END END AS pred
  FROM (SELECT 'mlp' AS model, o_orderkey AS record_id, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
               round(o_totalprice / 500000, 2) AS score FROM orders
        UNION ALL
        SELECT 'gbt', o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER),
               round((o_totalprice / 500000 + (o_custkey % 100) / 100.0::DOUBLE) / 2, 3) FROM orders))"""

_CUM = """hist AS (SELECT model, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
  FROM sc WHERE score IS NOT NULL GROUP BY model, score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY model) AS totp, sum(neg) OVER (PARTITION BY model) AS totn
  FROM hist WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_CELLS = """cells AS (SELECT model,
    CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
    CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM sc GROUP BY model)"""


def _d0(a, b):
    return f"coalesce(({a}) / nullif({b}, 0), 0.0)"


def scored(spark, sf_dir):
    return SI.scored_orders(spark, sf_dir)


@query("thresholds", S.with_(_SCORED) + "SELECT model, record_id, pred FROM sc")
def thresholds(spark, sf_dir):
    """P5: score -> 0/1 with the model's threshold (> 0.35 for mlp, >= 0.23 for gbt)."""
    return scored(spark, sf_dir).select("model", "record_id", "pred")


@query("risk_band", S.with_(_SCORED) + """SELECT record_id, CASE WHEN score > 0.35 THEN 'RISK' ELSE 'NO RISK' END AS band,
  round(score, 3) AS risk_score FROM sc WHERE model = 'mlp'""")
def risk_band_q(spark, sf_dir):
    """RISK / NO RISK label and the score to 3 places (mlp rows)."""
    s = scored(spark, sf_dir).where(F.col("model") == "mlp")
    band, r3 = risk_band("score", 0.35)
    return s.select("record_id", band.alias("band"), r3.alias("risk_score"))


@query("confusion", S.with_(_SCORED) + """SELECT m.model, l.label, p.pred, CAST(count(sc.record_id) AS BIGINT) AS n
FROM (SELECT DISTINCT model FROM sc) m, (VALUES (0), (1)) l(label), (VALUES (0), (1)) p(pred)
LEFT JOIN sc ON sc.model = m.model AND sc.label = l.label AND sc.pred = p.pred GROUP BY ALL""")
def confusion(spark, sf_dir):
    """2x2 confusion counts per model."""
    return me.confusion(scored(spark, sf_dir))


@query("precision_recall", rounded(S.with_(_SCORED, _CELLS) + f"""SELECT model, {_d0('tp', 'tp + fp')} AS precision,
  {_d0('tp', 'tp + fn')} AS recall, {_d0('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM cells""",
       ["precision", "recall", "accuracy"]))
def precision_recall(spark, sf_dir):
    """E2."""
    return stable(me.precision_recall(scored(spark, sf_dir)))


def _report_sql():
    p1, r1 = _d0("tp", "tp + fp"), _d0("tp", "tp + fn")
    p0, r0 = _d0("tn", "tn + fn"), _d0("tn", "tn + fp")

    def f1(p, r):
        return f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"

    w = f"""w AS (SELECT model, {p0} AS p0, {r0} AS r0, {f1(p0, r0)} AS f0, tn + fp AS s0,
    {p1} AS p1, {r1} AS r1, {f1(p1, r1)} AS f1, tp + fn AS s1, {_d0('tp + tn', 'tp + fp + fn + tn')} AS acc,
    tp + fp + fn + tn AS n FROM cells)"""
    body = """SELECT model, '0' AS "row", p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM w
UNION ALL SELECT model, '1', p1, r1, f1, s1 FROM w
UNION ALL SELECT model, 'accuracy', NULL, NULL, acc, n FROM w
UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM w
UNION ALL SELECT model, 'weighted avg', """ + ", ".join(
        _d0(f"{a} * s0 + {b} * s1", "n") for a, b in (("p0", "p1"), ("r0", "r1"), ("f0", "f1"))
    ) + ", n FROM w"
    return rounded(S.with_(_SCORED, _CELLS, w) + body, ["precision", "recall", "f1"])


@query("classification_report", _report_sql())
def classification_report(spark, sf_dir):
    """Per class P/R/F1/support, accuracy, macro and weighted averages."""
    return stable(me.classification_report(scored(spark, sf_dir)))


@query("roc_auc", rounded(S.with_(_SCORED, _CUM) + """SELECT model,
  sum(neg * (2 * tp - pos) / 2.0) / (max(totp) * max(totn)) AS auc FROM cum GROUP BY model""", ["auc"]))
def roc_auc(spark, sf_dir):
    """Exact AUC with ties, G1 cumulative counts over distinct scores."""
    return stable(me.roc_auc(scored(spark, sf_dir)))


@query("roc_curve", rounded(S.with_(_SCORED, _CUM) + """SELECT model, score AS threshold,
  fp::DOUBLE / totn AS fpr, tp::DOUBLE / totp AS tpr FROM cum""", ["threshold", "fpr", "tpr"]))
def roc_curve(spark, sf_dir):
    """E5."""
    return stable(me.roc_curve(scored(spark, sf_dir)))


@query("pr_curve", rounded(S.with_(_SCORED, _CUM) + """SELECT model, score AS threshold,
  tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / totp AS recall FROM cum""", ["threshold", "precision", "recall"]))
def pr_curve(spark, sf_dir):
    """Precision-recall points."""
    return stable(me.pr_curve(scored(spark, sf_dir)))


@query("average_precision", rounded(S.with_(_SCORED, _CUM) + """SELECT model,
  sum(pos::DOUBLE / totp * (tp::DOUBLE / (tp + fp))) AS average_precision FROM cum GROUP BY model""",
       ["average_precision"]))
def average_precision(spark, sf_dir):
    """Average precision."""
    return stable(me.average_precision(scored(spark, sf_dir)))


@query("threshold_sweep", rounded(S.with_(_SCORED, _CUM) + f"""SELECT model, score AS threshold,
  {_d0('tp::DOUBLE', 'tp + fp')} AS precision, {_d0('tp::DOUBLE', 'totp')} AS recall,
  {_d0('(tp + totn - fp)::DOUBLE', 'totp + totn')} AS accuracy FROM cum""",
       ["threshold", "precision", "recall", "accuracy"]))
def threshold_sweep(spark, sf_dir):
    """Every distinct score as threshold in one pass."""
    return stable(me.threshold_sweep(scored(spark, sf_dir)))


@query("brier", rounded(S.with_(_SCORED) + "SELECT model, avg(pow(score - label, 2)) AS brier FROM sc GROUP BY model",
       ["brier"]))
def brier(spark, sf_dir):
    """E8."""
    return stable(me.brier(scored(spark, sf_dir)))


@query("log_loss", rounded(S.with_(_SCORED) + f"""SELECT model,
  avg(-(label * ln(least(greatest(score, {me.EPS!r}), {1 - me.EPS!r}))
      + (1 - label) * ln(1 - least(greatest(score, {me.EPS!r}), {1 - me.EPS!r})))) AS log_loss
FROM sc GROUP BY model""", ["log_loss"]))
def log_loss(spark, sf_dir):
    """E9."""
    return stable(me.log_loss(scored(spark, sf_dir)))


def _bin_sql(col):
    return "(" + " + ".join(f"CASE WHEN {col} > {e!r} THEN 1 ELSE 0 END" for e in me.CALIBRATION_EDGES) + ")"


@query("calibration", rounded(S.with_(_SCORED) + f"""SELECT model, CAST({_bin_sql('score')} AS INTEGER) AS bin,
  avg(label) AS prob_true, avg(score) AS prob_pred, count(*) AS n FROM sc WHERE score IS NOT NULL GROUP BY ALL""",
       ["prob_true", "prob_pred"]))
def calibration(spark, sf_dir):
    """10 uniform bins, edge values go to the lower bin."""
    return stable(me.calibration(scored(spark, sf_dir)))


@query("metric_summary", rounded(S.with_(_SCORED, _CUM, _CELLS) + f"""SELECT a.model, a.auc, c.precision, c.recall,
  c.accuracy, b.brier FROM
  (SELECT model, sum(neg * (2 * tp - pos) / 2.0) / (max(totp) * max(totn)) AS auc FROM cum GROUP BY model) a
  JOIN (SELECT model, {_d0('tp', 'tp + fp')} AS precision, {_d0('tp', 'tp + fn')} AS recall,
        {_d0('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM cells) c USING (model)
  JOIN (SELECT model, avg(pow(score - label, 2)) AS brier FROM sc GROUP BY model) b USING (model)""",
       ["auc", "precision", "recall", "accuracy", "brier"]))
def metric_summary(spark, sf_dir):
    """E11."""
    return stable(me.metric_summary(scored(spark, sf_dir)))


# --- challenge score ----------------------------------------------------------------------

_E1 = """e1 AS (SELECT model, se, ppv, CASE WHEN se < ppv THEN se ELSE ppv END AS event1 FROM (
  SELECT model, tp / nullif(tp + fn, 0) AS se, tp / nullif(tp + fp, 0) AS ppv FROM cells))"""
_DEC = """d AS (SELECT model, record_id, label, score,
    ntile(10) OVER (PARTITION BY model ORDER BY score, record_id) AS decile FROM sc WHERE score IS NOT NULL),
dec AS (SELECT model, decile, count(*) AS n, sum(score) / count(*) AS centroid,
    CAST(sum(label) AS DOUBLE) AS observed, sum(score) AS expected FROM d GROUP BY model, decile)"""
_E2 = """e2 AS (SELECT model, h, h / nullif(arg_max(centroid, decile) - arg_min(centroid, decile), 0) AS event2 FROM (
  SELECT model, sum(pow(observed - expected, 2) / (n * (centroid * (1 - centroid) + 0.001))) AS h,
    arg_max(centroid, decile) AS cl, arg_min(centroid, decile) AS cf FROM dec GROUP BY model) x
  JOIN dec USING (model) GROUP BY model, h)"""


@query("event1", rounded(S.with_(_SCORED, _CELLS, _E1) + "SELECT model, se, ppv, event1 FROM e1", ["se", "ppv", "event1"]))
def event1(spark, sf_dir):
    """Se, PPV and min(Se, PPV)."""
    return stable(ch.event1(scored(spark, sf_dir)))


@query("risk_groups", rounded(S.with_(_SCORED, _DEC) + "SELECT model, decile, n, centroid, observed, expected FROM dec",
       ["centroid", "observed", "expected"]))
def risk_groups(spark, sf_dir):
    """Deciles by (risk, id): size, centroid, observed and expected deaths."""
    return stable(ch.risk_groups(scored(spark, sf_dir)))


@query("event2", rounded(S.with_(_SCORED, _DEC, _E2) + "SELECT model, h, event2 FROM e2", ["h", "event2"]))
def event2(spark, sf_dir):
    """Hosmer-Lemeshow H over the deciles divided by the decile risk range."""
    return stable(ch.event2(ch.risk_groups(scored(spark, sf_dir))))


@query("comparison", rounded(S.with_(_SCORED, _CELLS, _E1, _DEC, _E2) + """SELECT model, event1, event2
  FROM e1 FULL JOIN e2 USING (model)
UNION ALL SELECT * FROM (VALUES ('Winner (Bayesian Ensemble)', 0.5310::DOUBLE, 26.44::DOUBLE),
  ('Contestant (MLP)', 0.27::DOUBLE, 22.83::DOUBLE)) v(model, event1, event2)""", ["event1", "event2"]))
def comparison(spark, sf_dir):
    """Own event scores next to the published ones."""
    return stable(ch.comparison_table(ch.challenge_scores(scored(spark, sf_dir))))


@query("prediction_match", S.with_(_SCORED) + """SELECT
  (SELECT count(*) FROM sc p JOIN customer c ON c.c_custkey = p.record_id WHERE p.model = 'mlp') AS matched,
  (SELECT count(*) FROM sc p WHERE p.model = 'mlp' AND p.record_id NOT IN (SELECT c_custkey FROM customer)) AS only_left,
  (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT record_id FROM sc WHERE model = 'mlp')) AS only_right""")
def prediction_match(spark, sf_dir):
    """Predictions matched to an outcome table by id; mismatches counted both ways."""
    pred = scored(spark, sf_dir).where(F.col("model") == "mlp")
    other = SI.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"))
    return ch.alignment_report(pred, other)


@query("strict_match", S.with_(_SCORED) + """SELECT p.model, p.record_id, p.pred, p.score, CAST(o.o_orderstatus = 'F' AS INTEGER) AS outcome
  FROM sc p JOIN orders o ON o.o_orderkey = p.record_id""")
def strict_match(spark, sf_dir):
    """Every model's predictions joined to their outcomes; a repeated or unmatched id fails the job."""
    outcomes = SI.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderstatus") == "F").cast("int").alias("outcome"))
    return ch.match_outcomes(scored(spark, sf_dir).select("model", "record_id", "pred", "score"), outcomes)


@query("predictions_roundtrip", S.with_(_SCORED) + "SELECT record_id, pred, score FROM sc WHERE model = 'mlp'")
def predictions_roundtrip(spark, sf_dir):
    """Header-less prediction CSV written to the shared folder and read back."""
    path = scratch_path(spark, "predictions")
    rd.write_predictions(scored(spark, sf_dir).where(F.col("model") == "mlp"), path)
    return rd.read_predictions(spark, path)


@query("ranked_predictions", S.with_(_SCORED) + """SELECT model, record_id, score,
  row_number() OVER (PARTITION BY model ORDER BY score, record_id) AS "rank" FROM sc WHERE score IS NOT NULL""")
def ranked_predictions(spark, sf_dir):
    """W3 + G1: every row's position in (risk, id) order per model, without a single partition."""
    from wardflow.operators.ranks import row_ranks

    s = scored(spark, sf_dir).select("model", "record_id", "score")
    return row_ranks(s, "score", tie_cols=["record_id"], partition_cols=["model"]).select(
        "model", "record_id", "score", "rank")
