"""Cleaning, aggregates, imputation, biometrics (named cases of FIXTURES.md section 2)."""

import math

import pytest

from conftest import features_of, readings_df
from wardflow.operators import features as fx


def test_dup_sentinel_mean_then_mask(spark):
    r = readings_df(spark, [(1, 0, "HR", -1.0), (1, 0, "HR", 5.0), (1, 60, "HR", -1.0)])
    cells = {(x.t): x.value for x in fx.clean_cells(r).collect()}
    assert cells[0] == 2.0  # averaged first, so the -1 does not vanish
    assert cells[60] is None  # a lone sentinel is masked


def test_single_reading(spark):
    r = readings_df(spark, [(1, 30, "HR", 80.0)])
    agg = fx.vital_aggregates(fx.clean_cells(r), r.select("record_id").distinct(), ["HR"]).first()
    assert agg["std"] == 0.0 and agg["delta"] == 0.0 and agg["range"] == 0.0
    assert agg["first"] == agg["last"] == 80.0 and agg["missing"] == 0.0


def test_null_first_skipped(spark):
    r = readings_df(spark, [(1, 0, "HR", -1.0), (1, 10, "HR", 70.0), (1, 20, "HR", 90.0)])
    agg = fx.vital_aggregates(fx.clean_cells(r), r.select("record_id").distinct(), ["HR"]).first()
    assert agg["first"] == 70.0 and agg["last"] == 90.0 and agg["delta"] == 20.0


def test_population_std_and_median_over_distinct_times(spark):
    r = readings_df(spark, [(1, 0, "HR", 1.0), (1, 0, "HR", 3.0), (1, 5, "HR", 4.0), (1, 9, "HR", 8.0)])
    agg = fx.vital_aggregates(fx.clean_cells(r), r.select("record_id").distinct(), ["HR"]).first()
    vals = [2.0, 4.0, 8.0]
    mean = sum(vals) / 3
    assert agg["median"] == 4.0
    assert agg["std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in vals) / 3))


def test_none_record_survives_with_imputed_values(spark):
    r = readings_df(spark, [(1, 0, "HR", 60.0), (2, 0, "HR", 80.0), (3, 0, "Age", 50.0)])
    recs = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    f = features_of(fx.vital_features(r, ["HR", "Temp"], records=recs), 3)
    assert len(f) == 20  # 2 vitals x 10 aggregates
    assert f[(3, "HR_missing")] == 1.0 and f[(3, "Temp_missing")] == 1.0
    assert f[(3, "HR_mean")] == 70.0  # median of the other records' means
    assert f[(3, "Temp_mean")] is None  # no record has Temp: median is NULL too


def test_blank_parameter_dropped(spark):
    r = readings_df(spark, [(1, 0, None, 5.0), (1, 0, "HR", 5.0)])
    assert fx.clean_cells(r).count() == 1


def test_late_weight_and_gender_tie(spark):
    # record 1: Weight -1 at 00:00 (masked), 80 at 05:00 -> first row gets the median, not 80
    r = readings_df(spark, [
        (1, 0, "Weight", -1.0), (1, 300, "Weight", 80.0), (1, 0, "Gender", 1.0),
        (2, 0, "Weight", 60.0), (2, 0, "Gender", 0.0),
        (3, 0, "Weight", 70.0), (3, 0, "Gender", -1.0),
    ])
    cells = fx.clean_cells(r)
    rows = fx.descriptor_rows(cells, ["Gender", "Weight"])
    recs = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    out = {x.record_id: x for x in fx.impute_biometrics(rows, recs, continuous=["Weight"]).collect()}
    assert out[1]["Weight"] == 70.0  # median over time rows (60, 70, 80), not the later 80
    assert out[3]["Gender"] == 0.0  # one 0 and one 1: the smallest mode


def test_one_hot_with_nan(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None)], "record_id long, ICUType double")
    rows = {r.record_id: r for r in fx.icu_one_hot(df).collect()}
    assert rows[1]["ICUType_3.0"] == 1.0 and rows[1]["ICUType_nan"] == 0.0
    assert rows[2]["ICUType_nan"] == 1.0 and rows[2]["ICUType_1.0"] == 0.0


def test_matrix_columns_sorted(spark):
    long = spark.createDataFrame([(1, "pH_max", 7.0), (1, "Age", 50.0), (1, "HR_mean", 80.0)],
                                 "record_id long, feature string, value double")
    m = fx.to_matrix(long, ["pH_max", "HR_mean", "Age"])
    assert m.columns == ["record_id", "Age", "HR_mean", "pH_max"]  # ASCII order: pH last
    v = fx.to_vector(long, ["pH_max", "HR_mean", "Age"]).first()
    assert v["features"] == [50.0, 80.0, 7.0]


def test_sequences_checks(spark):
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "record_id long, features array<double>")
    lab = spark.createDataFrame([(1, 0), (2, 1)], "record_id long, label int")
    seq = fx.to_sequences(vec, lab, 2).orderBy("record_id").collect()
    assert seq[1]["sequence"] == [[3.0, 4.0]]
    with pytest.raises(Exception, match="do not pair up at record 2"):
        fx.to_sequences(vec, lab.where("record_id = 1"), 2).collect()  # id_mismatch: never positional
    with pytest.raises(Exception, match="do not pair up at record 2"):
        fx.to_sequences(vec.where("record_id = 1"), lab, 2).count()
    with pytest.raises(Exception, match="not the 3 features"):
        fx.to_sequences(vec, lab, 3).collect()


def test_feature_plan_stays_jvm_side(spark):
    from wardflow.plans import q_features as QF

    plan = QF.features_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_pivot_readings_wide(spark):
    r = readings_df(spark, [(1, 0, "HR", -1.0), (1, 0, "HR", 5.0), (1, 0, "Temp", -1.0), (1, 60, "HR", 70.0),
                            (1, 60, None, 3.0)])
    wide = fx.pivot_readings(r, ["HR", "Temp", "pH"])
    assert wide.columns == ["record_id", "t", "HR", "Temp", "pH"]
    rows = {x.t: x for x in wide.collect()}
    assert rows[0]["HR"] == 2.0 and rows[0]["Temp"] is None and rows[0]["pH"] is None
    assert rows[60]["HR"] == 70.0 and len(rows) == 2
