"""Intake at size: answers dealt before they are checked, stages short enough for the JIT, orders spread over tasks."""

import contextlib
import io
import re

from wardflow.operators import features as fx
from wardflow.operators import intake as ik
from wardflow.operators import replay as rp
from wardflow.plans import q_intake as QI
from wardflow.session import METHOD_BYTES, METHOD_CONF
from wardflow.sources import standins as SI


def orders(spark, path, n=400):
    spark.range(n).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus").coalesce(1).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_answers_dealt_first_replay_alike(spark, tmp_path):
    a = SI.answers(spark, orders(spark, tmp_path))
    nowhere = a.limit(2).selectExpr("cast(null AS string) AS session_id", "seq", "section", "action", "field", "raw_value")
    a = a.unionByName(nowhere)
    rows = lambda d: sorted(map(str, ik.held_rows(d).collect()))
    for gate in (True, False):
        got = rows(ik.replay_answers(a, gate))
        assert got and got == rows(rp.replay(ik.validate(a), gate))


def test_no_stage_of_the_replay_is_too_long_for_the_jit(spark, tmp_path):
    path = orders(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            QI.sessions_df(spark, path).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000


def test_checks_fused_with_their_input_do_not_run_as_a_method_too_long_for_the_jit(spark, tmp_path):
    path = orders(spark, tmp_path)
    before = spark.conf.get(METHOD_CONF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set(METHOD_CONF, "65535")  # Spark's default, as on the driver's cluster
    try:
        checked, text = QI.validate_answers(spark, path), io.StringIO()
        with contextlib.redirect_stdout(text):
            checked.explain("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
        limit = int(spark.conf.get(METHOD_CONF))
        assert sizes and all(x < METHOD_BYTES or x > limit for x in sizes)
        spark.conf.set(METHOD_CONF, "5000")  # a lower limit of the session's own is kept
        QI.validate_answers(spark, path)
        assert spark.conf.get(METHOD_CONF) == "5000"
    finally:
        spark.conf.set(METHOD_CONF, before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_file_is_spread_over_as_many_tasks_as_a_shuffle(spark, tmp_path):
    path = orders(spark, tmp_path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert SI.spread(SI.table(spark, path, "orders")).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_answer_texts(spark, tmp_path):
    raw = {(r.field, r.seq): r.raw_value for r in SI.answers(spark, orders(spark, tmp_path)).collect()}
    numbers = [v for (f, _), v in raw.items() if f == "temp" and v != "n/a"]
    assert numbers and all(re.fullmatch(r"-?\d+\.\d\d", v) for v in numbers)
    assert any(re.fullmatch(r"\d+\.5", v) for (f, _), v in raw.items() if f == "age")


def test_vectors_of_whole_and_partial_records(spark):
    names = ["c", "a", "b"]
    rows = [(1, n, float(i)) for i, n in enumerate(names)] + [(2, "b", 5.0), (2, "x", 9.0), (3, "a", None), (3, "b", 1.0), (3, "c", 2.0)]
    got = {r.record_id: r.features for r in fx.to_vector(spark.createDataFrame(rows, "record_id long, feature string, value double"), names).collect()}
    assert got == {1: [1.0, 2.0, 0.0], 2: [None, 5.0, None], 3: [None, 1.0, 2.0]}
