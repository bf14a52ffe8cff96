"""Results outside what the stand-in data touches: overflow, NULLs, repeated ids, odd numerals."""

import pytest
from pyspark.sql import functions as F

from wardflow.functions.scalar import gender_code, risk_band, safe_float
from wardflow.operators import challenge as ch
from wardflow.operators import intake as ik
from wardflow.operators import metrics as me
from wardflow.operators.sample import undersample_majority
from wardflow.sources.readings import with_record_id


def test_auc_of_very_many_rows(spark, monkeypatch):
    big = 4_000_000_000
    rows = [("m", 0.9, big, 0, big, 0), ("m", 0.1, 0, big, big, big)]
    frame = spark.createDataFrame(rows, "model string, score double, pos long, neg long, tp long, fp long").withColumns({"P": F.lit(big), "N": F.lit(big)})
    monkeypatch.setattr(me, "cumulative", lambda scored: frame)
    assert me.roc_auc(None).first()["auc"] == pytest.approx(1.0)


def test_average_precision_without_positives(spark):
    df = spark.createDataFrame([("a", 1, 1, 0, 0.4), ("b", 2, 0, 0, 0.3), ("a", 3, 0, 0, 0.2)], "model string, record_id long, label int, pred int, score double")
    got = {r["model"]: r["average_precision"] for r in me.average_precision(df).collect()}
    assert got == {"a": 1.0, "b": None}


@pytest.mark.parametrize("text,want", [("72f", None), ("1d", None), ("0x1p3", None), ("NaN", None), ("Infinity", None), ("1e999", None), (" 1.5e2 ", 150.0), ("-.5", -0.5), ("7.", 7.0), ("", None), (None, None)])
def test_numeric_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(safe_float("x").alias("v")).first()["v"] == want


def test_gender_code_of_odd_values(spark):
    rows = [("99999999999", None), ("NaN", None), (" Male ", 1), ("female", 0), ("1.9", 1)]
    df = spark.createDataFrame(rows, "x string, want int").withColumn("got", gender_code("x"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_null_score_has_no_band(spark):
    df = spark.createDataFrame([(None,), (0.9,), (0.1,)], "s double")
    assert [r[0] for r in df.select(risk_band("s")[0]).collect()] == [None, "RISK", "NO RISK"]


def test_undersampling_leaves_null_labels_out(spark):
    df = spark.createDataFrame([(i, 1 if i < 8 else 0 if i < 38 else None) for i in range(40)], "record_id long, label int")
    got = {r["label"]: r["count"] for r in undersample_majority(df).groupBy("label").count().collect()}
    assert got == {1: 8, 0: 8}


def test_repeated_ids_are_counted_once_and_refused(spark):
    pred = spark.createDataFrame([("m", 1, 0.1), ("m", 1, 0.2), ("m", 2, 0.3)], "model string, record_id long, score double")
    out = spark.createDataFrame([(1, 0), (1, 1), (3, 1)], "record_id long, label int")
    assert tuple(ch.alignment_report(pred, out).first()) == (1, 1, 1)
    with pytest.raises(Exception, match="repeated outcome: 1|repeated prediction"):
        ch.match_outcomes(pred, out, strict=False).collect()
    with pytest.raises(Exception, match="repeated outcome: 1"):
        ch.match_outcomes(spark.createDataFrame([("m", 1, 0.1), ("m", 3, 0.3)], pred.schema), out).collect()
    with pytest.raises(Exception, match="repeated prediction: 1 m"):
        ch.match_outcomes(pred, out.where("record_id = 3"), strict=False).count()


def test_record_without_an_id_fails(spark):
    rows = [("f1", "a", 0, "RecordID", 5.0), ("f1", "a", 0, "HR", 70.0), ("f2", "a", 0, "HR", 71.0)]
    raw = spark.createDataFrame(rows, "file string, split string, t int, parameter string, value double")
    assert with_record_id(raw.where("file = 'f1'")).first()["record_id"] == 5
    with pytest.raises(Exception, match="no single RecordID"):
        with_record_id(raw).collect()


def test_float_text_has_no_exponent(spark):
    df = spark.createDataFrame([(12000000.0, "12000000.0"), (0.0005, "0.0005"), (1.25, "1.25"), (3.0, "3.0")], "x double, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", ik.float_text(F.col("x"))).collect())
