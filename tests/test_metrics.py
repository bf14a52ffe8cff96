"""Evaluation (E1-E11), challenge score (E12-E15, J5): edge_bins, ties, no_pos, score20, id_mismatch."""

import random

import pytest

from wardflow.operators import challenge as ch
from wardflow.operators import metrics as me


def scored_df(spark, rows, model="m"):
    return spark.createDataFrame([(model, i, y, p, s) for i, (y, p, s) in enumerate(rows)],
                                 "model string, record_id long, label int, pred int, score double")


def brute_auc(rows):
    pos = [s for y, _, s in rows if y == 1]
    neg = [s for y, _, s in rows if y == 0]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_and_symmetry(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), 0, round(rnd.random(), 1)) for _ in range(80)]
    auc = me.roc_auc(scored_df(spark, rows)).first()["auc"]
    assert auc == pytest.approx(brute_auc(rows))
    flipped = [(y, p, 1 - s) for y, p, s in rows]
    assert me.roc_auc(scored_df(spark, flipped)).first()["auc"] == pytest.approx(1 - auc)
    sweep = {r.threshold: r for r in me.threshold_sweep(scored_df(spark, rows)).collect()}
    assert len(sweep) == len({s for _, _, s in rows})  # one row per distinct score
    for t, r in sweep.items():
        tp = sum(1 for y, _, s in rows if s >= t and y == 1)
        fp = sum(1 for y, _, s in rows if s >= t and y == 0)
        assert r.precision == pytest.approx(tp / (tp + fp))
        acc = sum(1 for y, _, s in rows if (s >= t) == (y == 1)) / len(rows)
        assert r.accuracy == pytest.approx(acc)


def test_edge_bins(spark):
    probs = [0.0, 0.1, 0.3, 0.30000000000000004, 1.0]
    df = scored_df(spark, [(0, 0, p) for p in probs])
    got = sorted(r.b for r in df.select(me.calibration_bin("score").alias("b")).collect())
    assert got == [0, 0, 2, 2, 9]


def test_no_positive_prediction(spark):
    rows = [(1, 0, 0.1), (0, 0, 0.2), (1, 0, 0.3)]
    pr = me.precision_recall(scored_df(spark, rows)).first()
    assert pr["precision"] == 0.0 and pr["recall"] == 0.0
    e1 = ch.event1(scored_df(spark, rows)).first()
    assert e1["ppv"] is None and e1["event1"] is None  # C gives NaN; the comparison picks PPV


def test_classification_report(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.2), (0, 0, 0.1), (0, 1, 0.7), (0, 0, 0.3)]
    rep = {r.row: r for r in me.classification_report(scored_df(spark, rows)).collect()}
    assert rep["1"]["precision"] == 0.5 and rep["1"]["recall"] == 0.5 and rep["1"]["support"] == 2
    assert rep["0"]["recall"] == pytest.approx(2 / 3) and rep["accuracy"]["f1"] == 0.6
    assert rep["weighted avg"]["support"] == 5


def c_scorer(rows):
    """The scorer's loop, by hand: rows (id, pred, risk, death), N divisible by 10."""
    r = sorted(rows, key=lambda x: (x[2], x[0]))
    n = len(r)
    m = n // 10
    tp = fn = fp = 0
    h = 0.0
    cen = obs = 0.0
    deciles = []
    for i, (_, pred, risk, death) in enumerate(r):
        if death:
            tp += pred
            fn += 1 - pred
            obs += 1
        else:
            fp += pred
        cen += risk
        if (i + 1) % m == 0:
            cen /= m
            exp = m * cen
            h += (obs - exp) ** 2 / (m * (cen * (1 - cen) + 0.001))
            deciles.append((cen, obs, exp))
            cen = obs = 0.0
    se, ppv = tp / (tp + fn), tp / (tp + fp)
    return min(se, ppv) if se == se else ppv, h / (deciles[-1][0] - deciles[0][0]), deciles


def test_score20_by_hand(spark):
    rnd = random.Random(20)
    rows = [(1000 + i, rnd.randint(0, 1), round(rnd.choice([0.1, 0.2, 0.2, 0.5, 0.8]), 2), rnd.randint(0, 1))
            for i in range(20)]
    df = spark.createDataFrame([("m", i, d, p, s) for i, p, s, d in rows],
                               "model string, record_id long, label int, pred int, score double")
    e1, e2, dec = c_scorer(rows)
    got = sorted(ch.risk_groups(df).collect(), key=lambda r: r.decile)
    assert [r.n for r in got] == [2] * 10
    for g, (cen, obs, exp) in zip(got, dec):
        assert g.centroid == pytest.approx(cen) and g.observed == obs and g.expected == pytest.approx(exp)
    s = ch.challenge_scores(df).first()
    assert s["event1"] == pytest.approx(e1) and s["event2"] == pytest.approx(e2)


def test_id_mismatch(spark):
    pred = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "record_id long, pred int, score double")
    outc = spark.createDataFrame([(1, 1), (3, 0)], "record_id long, label int")
    with pytest.raises(Exception, match="record 2 lacks its outcome|record 3 lacks its prediction"):
        ch.match_outcomes(pred, outc).collect()
    with pytest.raises(Exception, match="lacks its"):
        ch.match_outcomes(pred, outc).count()
    assert [r.record_id for r in ch.match_outcomes(pred, outc, strict=False).collect()] == [1]
    whole = ch.match_outcomes(pred, spark.createDataFrame([(1, 1), (2, 0)], "record_id long, label int"))
    assert sorted(map(tuple, whole.collect())) == [(1, 1, 0.9, 1), (2, 0, 0.1, 0)]
    none = spark.createDataFrame([(None, 1)], "record_id long, label int")
    with pytest.raises(Exception, match="record NULL lacks its prediction"):
        ch.match_outcomes(pred.limit(0), none).collect()
    rep = ch.alignment_report(pred, outc).first()
    assert (rep["matched"], rep["only_left"], rep["only_right"]) == (1, 1, 1)


def test_comparison_has_published_rows(spark):
    df = scored_df(spark, [(i % 2, i % 2, i / 20) for i in range(20)])
    names = {r.model for r in ch.comparison_table(ch.challenge_scores(df)).collect()}
    assert {"m", "Winner (Bayesian Ensemble)", "Contestant (MLP)"} <= names
