
import pytest

from tests.conftest import rows_in_one_partition

SF = "/root/testdata/sf0.001"
MODEL_QUERIES = {"gbt_scores", "gbt_staged", "mlp_calibrated", "model_comparison", "score_answers"}
STREAMS = {"validate_stream", "session_stream", "vitals_stream", "predictions_roundtrip"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    import __spark_entry__  # noqa: F401  loads the registry
    from wardflow.plans import registry

    registry.load_all()
    return registry.QUERIES


def test_no_python_evaluation_in_any_plan(spark, queries):
    for name, fn in queries.items():
        if name in MODEL_QUERIES | STREAMS:
            continue
        p = plan_of(fn(spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


@pytest.mark.parametrize("name", ["roc_auc", "threshold_sweep", "pr_curve", "risk_groups", "event2",
                                  "ranked_predictions", "undersample_toxic", "feature_medians"])
def test_global_order_without_single_partition(spark, queries, name):
    p = plan_of(queries[name](spark, SF))
    assert not rows_in_one_partition(p), name


def test_scan_prunes_columns_and_pushes_filters(spark, queries):
    p = queries["features_events"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), In(event_type" in p
    assert "props" not in p  # the unused JSON column is never read


def test_strict_match_deals_each_side_once_and_starts_no_job(spark, queries):
    """One exchange by id and one sort per side of the join; the checks add none and run nothing at build time."""
    from wardflow.operators.challenge import match_outcomes

    p = plan_of(queries["strict_match"](spark, SF))
    dealt = [x for x in p.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 2 and all("record_id" in x for x in dealt)
    assert sum("- Sort [" in x for x in p.splitlines()) == 2
    pred = spark.range(9).selectExpr("'m' AS model", "id AS record_id", "0.5D AS score")
    out = spark.range(9).selectExpr("id AS record_id", "1 AS label")
    group = "strict-match"
    spark.sparkContext.setJobGroup(group, "building the plan")
    try:
        built = match_outcomes(pred, out)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert built.count() == 9
