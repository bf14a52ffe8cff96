"""G1: running totals / ranks / exact median, both the plain and the bucketed (hot) path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_in_one_partition
from wardflow.operators.ranks import exact_median, exact_mode, row_ranks, running_totals


def test_running_totals_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(g, float(k), rnd.randint(0, 5)) for g in ("a", "b") for k in rnd.sample(range(1000), 60)]
    rows += [("c", 1.0, 2)]
    df = spark.createDataFrame(rows, "g string, k double, v long")
    out = running_totals(df, "k", ["v"], partition_cols=["g"], max_cols=["v"]).collect()
    for r in out:
        same = [x for x in rows if x[0] == r.g]
        assert r.cum_v == sum(x[2] for x in same if x[1] <= r.k)
        assert r.total_v == sum(x[2] for x in same)
        assert r.runmax_v == max(x[2] for x in same if x[1] <= r.k)


def test_descending_and_ranks(spark):
    df = spark.createDataFrame([(float(k), k % 3) for k in range(50)], "k double, id long")
    got = {r.k: r.rank for r in row_ranks(df, "k", descending=True).collect()}
    assert got[49.0] == 1 and got[0.0] == 50
    tied = spark.createDataFrame([(1.0, i) for i in range(30)], "k double, id long")
    got = {r.id: r.rank for r in row_ranks(tied, "k", tie_cols=["id"]).collect()}
    assert got == {i: i + 1 for i in range(30)}


def test_hot_path_plan_has_no_single_partition(spark):
    df = spark.range(0, 2000).selectExpr("cast(id as double) as k", "1L as v")
    out = running_totals(df, "k", ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not rows_in_one_partition(plan) and "NestedLoop" not in plan
    got = sorted((r.k, r.cum_v, r.total_v) for r in out.collect())
    assert got == [(float(i), i + 1, 2000) for i in range(2000)]
    grouped = running_totals(df.withColumn("g", F.col("k") % 2), "k", ["v"], partition_cols=["g"])
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert not rows_in_one_partition(plan) and "NestedLoop" not in plan


@pytest.mark.parametrize("n", [1, 2, 7, 10])
def test_exact_median_even_odd(spark, n):
    rnd = random.Random(n)
    vals = [round(rnd.uniform(0, 10), 2) for _ in range(n)] + [3.0] * (n // 2)
    df = spark.createDataFrame([("x", v) for v in vals] + [("x", None)], "g string, v double")
    got = exact_median(df, ["g"], "v").first()["median"]
    assert got == pytest.approx(float(np.median(vals)))


def test_exact_median_bucketed(spark):
    vals = [float(i * 7 % 101) for i in range(101)]
    df = spark.createDataFrame([("x", v) for v in vals], "g string, v double")
    assert exact_median(df, ["g"], "v").first()["median"] == float(np.median(vals))


def test_one_giant_and_many_small_groups(spark):
    rows = [("giant", i, i % 7) for i in range(3000)] + [(f"g{k}", i, 1) for k in range(60) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): (r.cum_v, r.total_v) for r in running_totals(df, "k", ["v"], partition_cols=["g"]).collect()}
    assert len(got) == len(rows) and all(got[f"g{k}", i] == (i + 1, 20) for k in range(60) for i in range(20))
    total = sum(i % 7 for i in range(3000))
    run = 0
    for i in range(3000):
        run += i % 7
        assert got["giant", i] == (run, total)


def test_keys_keep_their_type(spark):
    names = spark.createDataFrame([(f"k{i:03d}",) for i in range(300)], "k string")
    assert {r.k: r["rank"] for r in row_ranks(names, "k").collect()} == {f"k{i:03d}": i + 1 for i in range(300)}
    big = spark.createDataFrame([(2**60 + i,) for i in range(50)], "k long")
    assert {r.k: r["rank"] for r in row_ranks(big, "k", descending=True).collect()} == {2**60 + i: 50 - i for i in range(50)}
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, k long")
    assert sorted((r.g or "", r.k, r["rank"], r.n) for r in row_ranks(nulls, "k", partition_cols=["g"]).collect()) == [("", 1, 1, 2), ("", 2, 2, 2), ("a", 1, 1, 1)]


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1.0,), (0.0,), (None,)], "v double")
    assert exact_mode(df, [], "v").first()["mode"] == 0.0


@pytest.mark.parametrize("descending", [False, True])
def test_heavy_key_is_cut_by_ties_and_no_job_runs_at_build_time(spark, descending):
    rnd = random.Random(2)
    rows = [(5.0, i) for i in range(600)] + [(float(rnd.randrange(20)), 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "k double, id long").repartition(4)
    tracker, group = spark.sparkContext.statusTracker(), f"build-{descending}"
    spark.sparkContext.setJobGroup(group, "")
    ranked = row_ranks(df, "k", tie_cols=["id"], descending=descending)
    assert len(tracker.getJobIdsForGroup(group)) == 0
    spark.sparkContext.setJobGroup("", "")
    want = sorted(rows, key=lambda r: (-r[0] if descending else r[0], r[1]))
    assert [(r.k, r.id) for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == want
    from wardflow.operators.ranks import _bucketed

    sizes = [r["count"] for r in _bucketed(df, "k", "id", descending).groupBy("_b").count().collect()]
    assert max(sizes) < 150  # the heavy key alone holds over 600 rows


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "decimal(20,3)", "float", "int"])
def test_other_kinds_of_keys(spark, kind):
    from_days = "date_add(date'2020-01-01', cast(id as int))" if kind in ("date", "timestamp", "timestamp_ntz") else "id * 7 - 300"
    df = spark.range(150).selectExpr(f"cast({from_days} as {kind}) as k", "id")
    assert {r.id: r["rank"] for r in row_ranks(df, "k").collect()} == {i: i + 1 for i in range(150)}
