"""Scaler (const_feature), class weights, exact undersampling."""

import pytest

from wardflow.operators import sample as sm
from wardflow.operators import scale as sc


def test_const_feature(spark):
    train = spark.createDataFrame([("f", 5.0), ("f", 5.0), ("g", 1.0), ("g", 3.0)], "feature string, value double")
    test = spark.createDataFrame([("f", 7.0), ("g", 3.0)], "feature string, value double")
    stats = sc.fit_scaler(train)
    got = {r.feature: r.value for r in sc.apply_scaler(test, stats).collect()}
    assert got["f"] == 2.0  # zero spread: x - mean
    assert got["g"] == pytest.approx(1.0)  # population std = 1


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(10)], "record_id long, label int")
    w = {r.label: r.weight for r in sm.class_weights(df).collect()}
    assert w[1] == pytest.approx(10 / (2 * 2)) and w[0] == pytest.approx(10 / (2 * 8))


def test_undersample_exact_and_deterministic(spark):
    df = spark.createDataFrame([(i, 1 if i % 7 == 0 else 0) for i in range(200)], "record_id long, label int")
    a = sm.undersample_majority(df, seed=42)
    counts = {r.label: r.n for r in sm.class_counts(a).collect()}
    assert counts[0] == counts[1] == 29
    assert sorted(r.record_id for r in a.collect()) == sorted(r.record_id for r in sm.undersample_majority(df, seed=42).collect())
    assert set(r.record_id for r in a.where("label = 1").collect()) == {i for i in range(200) if i % 7 == 0}


def test_undersample_takes_the_smallest_hashes(spark):
    """Against a plain sort, with repeated ids at the cut, NULL ids and NULL labels."""
    def h(x):
        for _ in range(2):
            x = (x * 48271 + 42) % (2**31 - 1)
        return x

    ids = [i // 3 for i in range(3000)]
    rows = [(i, 0) for i in ids] + [(10_000 + i, 1) for i in range(700)] + [(None, 0), (5, None)]
    df = spark.createDataFrame(rows, "record_id long, label int")
    out = sm.undersample_majority(df, seed=42)
    kept = sorted(r.record_id for r in out.where("label = 0").collect())
    assert kept == sorted(sorted(ids, key=lambda i: (h(i), i))[:700])
    assert out.where("label = 1").count() == 700 and out.count() == 1400


def test_undersample_leaves_a_small_or_single_class(spark):
    one = spark.createDataFrame([(i, 1) for i in range(5)], "record_id long, label int")
    assert sm.undersample_majority(one).count() == 5 and sm.undersample_majority(one.limit(0)).count() == 0
    even = spark.createDataFrame([(i, i % 2) for i in range(10)], "record_id long, label int")
    assert sm.undersample_majority(even).count() == 10
    three = spark.createDataFrame([(i, "abc"[min(i // 4, 2)]) for i in range(20)], "record_id long, label string")
    got = {r.label: r.n for r in sm.class_counts(sm.undersample_majority(three)).collect()}
    assert got == {"a": 4, "b": 4, "c": 4}
