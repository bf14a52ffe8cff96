"""Ranks and medians under any number of shuffle partitions (a cluster's default is 200, not the tests' 8)."""

import random
import statistics

import pytest

from wardflow.operators.ranks import exact_median, row_ranks


@pytest.fixture(params=[63, 64, 200])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_median_and_ranks_at_many_partitions(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(g, round(rnd.uniform(-50, 50), 1)) for g in ("a", "b") for _ in range(301)] + [("a", 7.0)] * 200 + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    assert got == {g: pytest.approx(statistics.median(v for h, v in rows if h == g and v is not None)) for g in "ab"}
    keyed = spark.createDataFrame([(v, i) for i, (_, v) in enumerate(rows) if v is not None], "v double, id long")
    ranks = {r["id"]: r["rank"] for r in row_ranks(keyed, "v", tie_cols=["id"], descending=True).collect()}
    order = sorted((-r.v, r.id) for r in keyed.collect())
    assert ranks == {i: k + 1 for k, (_, i) in enumerate(order)}
