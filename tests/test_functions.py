"""Scalar functions P1, P2, P5-P8."""

from pyspark.sql import functions as F

from wardflow.functions import scalar as fn


def test_to_minutes_and_back(spark):
    df = spark.createDataFrame([("48:00",), ("24:54",), ("00:00",)], "t string")
    got = [r.m for r in df.select(fn.to_minutes("t").alias("m")).collect()]
    assert got == [2880, 1494, 0]
    back = spark.range(1).select(fn.elapsed_hhmm(F.lit(6001)).alias("s")).first()["s"]
    assert back == "100:01"


def test_gender_and_safe_float(spark):
    df = spark.createDataFrame([(" MALE ",), ("female",), ("1.7",), ("x",), (None,)], "v string")
    got = [(r.g, r.f) for r in df.select(fn.gender_code("v").alias("g"), fn.safe_float("v").alias("f")).collect()]
    assert got == [(1, None), (0, None), (1, 1.7), (None, None), (None, None)]


def test_threshold_and_band(spark):
    df = spark.createDataFrame([(0.35,), (0.3501,), (0.23,)], "s double")
    strict = [r.p for r in df.select(fn.apply_threshold("s", 0.35, True).alias("p")).collect()]
    loose = [r.p for r in df.select(fn.apply_threshold("s", 0.23, False).alias("p")).collect()]
    assert strict == [0, 1, 0] and loose == [1, 1, 1]
    band, r3 = fn.risk_band("s", 0.35)
    assert [r.b for r in df.select(band.alias("b")).collect()] == ["NO RISK", "RISK", "NO RISK"]


def test_mask_sentinel(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,)], "v double")
    assert [r.m for r in df.select(fn.mask_sentinel("v").alias("m")).collect()] == [None, 2.0]
