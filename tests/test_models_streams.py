"""Models (M3/M4/M6, S5), streams equal batch, the driver entry."""

import os

import pytest
from pyspark.sql import functions as F

from wardflow.operators import models as mo


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, i % 3 == 0 and 1 or 0, [float(i % 5), float(i % 3 == 0), float(i % 7)]) for i in range(120)]
    df = spark.createDataFrame(rows, "record_id long, label int, features array<double>")
    return mo.with_vector(df).persist()


def test_staged_last_stage_equals_score(spark, train):
    model = mo.train_gbt(train, maxIter=5, minInstancesPerNode=1, subsamplingRate=1.0)
    final = {r.record_id: r.score for r in mo.positive_score(model, train, "gbt").collect()}
    staged = mo.staged_scores(model, train).where(F.col("stage") == 5).collect()
    assert len(staged) == 120
    for r in staged:
        assert r.score == pytest.approx(final[r.record_id], abs=1e-9)
    m = mo.staged_metrics(mo.staged_scores(model, train))
    assert m.count() == 5


def test_isotonic_monotone_and_clipped(spark):
    df = spark.createDataFrame([(i, i % 2, i / 10) for i in range(10)], "record_id long, label int, score double")
    iso = mo.fit_isotonic(df)
    test = spark.createDataFrame([(0, 0, -1.0), (1, 0, 0.45), (2, 0, 2.0)], "record_id long, label int, score double")
    got = [r.score for r in mo.calibrate(iso, test).orderBy("record_id").collect()]
    assert got == sorted(got) and 0.0 <= got[0] and got[-1] <= 1.0


def test_mlp_save_load(spark, train, tmp_path):
    model = mo.train_mlp(train, 3, max_iter=10)
    stats = spark.createDataFrame([("f", 0.0, 1.0)], "feature string, mean double, scale double")
    path = mo.save_pipeline(str(tmp_path / "p"), model, stats)
    m2, s2 = mo.load_pipeline(spark, path, "mlp")
    a = {r.record_id: r.score for r in mo.positive_score(model, train, "x").collect()}
    b = {r.record_id: r.score for r in mo.positive_score(m2, train, "x").collect()}
    assert a == b and s2.count() == 1


def test_streams_equal_batch(spark):
    import __spark_entry__ as E

    q = E.queries()
    sf = "/root/testdata/sf0.001"
    s = sorted(tuple(r) for r in q["validate_stream"](spark, sf).collect())
    b = sorted(tuple(r) for r in q["validate_answers"](spark, sf).collect())
    assert s == b
    v = q["vitals_stream"](spark, sf)
    assert v.count() > 0 and set(v.columns) >= {"record_id", "parameter", "mean", "first", "last", "n"}


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["record_id", "feature", "value"] and df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_isotonic_weighted_points_equal_raw_fit(spark):
    from pyspark.ml.regression import IsotonicRegression

    rows = [(i, (i * 7) % 3 == 0 and 1 or 0, round((i % 13) / 13, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "record_id long, label int, score double")
    raw = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(
        df.select("score", F.col("label").cast("double")))
    agg = mo.fit_isotonic(df)
    test = spark.createDataFrame([(i, 0, i / 50) for i in range(51)], "record_id long, label int, score double")
    a = [r.calibrated for r in raw.transform(test).orderBy("record_id").collect()]
    b = [r.score for r in mo.calibrate(agg, test).orderBy("record_id").collect()]
    assert a == pytest.approx(b)


def test_session_stream_equals_ungated_batch(spark):
    import __spark_entry__ as E
    from wardflow.operators import intake as ik
    from wardflow.sources import standins as SI

    sf = "/root/testdata/sf0.001"
    stream = sorted(tuple(r) for r in E.queries()["session_stream"](spark, sf).collect())
    batch = ik.session_state(ik.validate(SI.answers(spark, sf)), gate_optional=False)
    batch = sorted(tuple(r) for r in batch.select("session_id", "field", "section", "value", "number", "seq").collect())
    assert stream == batch and len(stream) > 0


@pytest.mark.parametrize("partitions", ["2", "8", "70"])
def test_isotonic_pools_by_range_without_rounding(spark, partitions):
    """Scores that differ in the 7th place stay apart; any number of ranges gives Spark's own fit of the raw rows."""
    from pyspark.ml.regression import IsotonicRegression

    import random

    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < (i % 300) / 300), 1e-7 * (i % 300)) for i in range(1500)]
    df = spark.createDataFrame(rows, "record_id long, label int, score double")
    raw = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(
        df.select("score", F.col("label").cast("double")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        blocks = mo.pooled_blocks(df)
        n_blocks, weight = blocks.count(), blocks.agg(F.sum("weight")).first()[0]
        fitted = mo.fit_isotonic(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n_blocks < 150 and weight == 1500
    a = [r.calibrated for r in raw.transform(df).orderBy("record_id").collect()]
    b = [r.score for r in mo.calibrate(fitted, df).orderBy("record_id").collect()]
    assert a == pytest.approx(b, abs=1e-12) and len(set(b)) > 5


def test_isotonic_nulls_and_ties(spark):
    rows = [(1, 1, None), (2, None, 0.5), (3, 0, 0.2), (4, 1, 0.2), (5, 1, 0.9)]
    df = spark.createDataFrame(rows, "record_id long, label int, score double")
    got = {r.record_id: r.score for r in mo.calibrate(mo.fit_isotonic(df), df.where("score is not null")).collect()}
    assert got[3] == got[4] == pytest.approx(0.5) and got[5] == pytest.approx(1.0)


def test_staged_every_stage_from_one_transform(spark, train):
    """Every stage equals the trees added up one by one, and the plan transforms once."""
    model = mo.train_gbt(train, maxIter=7, minInstancesPerNode=1, subsamplingRate=1.0)
    assert [len(v) for v in mo.leaf_values(model)] == [(t.numNodes + 1) // 2 for t in model.trees]
    staged = mo.staged_scores(model, train)
    got = {(r.record_id, r.stage): r.score for r in staged.collect()}
    assert len(got) == 7 * 120
    import math

    for row in train.limit(20).collect():
        margin = 0.0
        for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
            margin += weight * tree.predict(row.features)
            assert got[(row.record_id, i + 1)] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-12)
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_boosting_reads_few_partitions_and_one_order(spark, train, monkeypatch):
    """A fit starts from as many partitions as the vectors fill, from files, and gives one model for any layout of the rows."""
    seen, fit = [], mo.GBTClassifier.fit

    def watched(self, frame):
        seen.append((frame.rdd.getNumPartitions(), frame._jdf.queryExecution().executedPlan().toString()))
        return fit(self, frame)

    monkeypatch.setattr(mo.GBTClassifier, "fit", watched)
    a = mo.train_gbt(train.repartition(24), maxIter=3, minInstancesPerNode=1)
    b = mo.train_gbt(train.repartition(5, "label"), maxIter=3, minInstancesPerNode=1)
    assert [n for n, _ in seen] == [1, 1] and not any("Exchange" in plan for _, plan in seen)
    assert a.toDebugString.split("\n", 1)[1] == b.toDebugString.split("\n", 1)[1]
    monkeypatch.setattr(mo, "FIT_BYTES", 120 * 3 * 8 // 4)
    assert mo.dealt_for_fit(train).rdd.getNumPartitions() == 4
    assert mo.dealt_for_fit(train.where("false")).count() == 0
    mo.train_gbt(train, maxIter=2, minInstancesPerNode=1)
    assert seen[-1][0] == 4


def test_fits_start_from_files(spark):
    """Training rows come from a checkpoint: the jobs of a fit plan nothing of the feature table."""
    from wardflow.plans import q_models as QM

    rows = [(i, "abc"[i % 3], i % 2, [float(i), 1.0]) for i in range(12)]
    made = spark.createDataFrame(rows, "record_id long, split string, label int, features array<double>")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(QM, "_vectors", lambda *a, **k: made.drop("label").join(made.select("record_id").distinct(), "record_id"))
        patch.setattr(QM.SI, "event_outcomes", lambda *a: made.select("record_id", "label"))
        data = QM._training(spark, "")
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "InMemory" not in plan and "Exchange" not in plan and "Join" not in plan
    assert sorted((r.record_id, r.split, r.label, r.features.toArray().tolist()) for r in data.collect()) == [tuple(r) for r in rows]
