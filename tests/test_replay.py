"""The associative replay against a plain one, event by event; its exchanges; one session with many rows."""

import random

import pytest

from wardflow import catalog
from wardflow.operators import intake as ik
from wardflow.operators import replay as rp

VALIDATED = "session_id string, seq long, section string, action string, field string, ok boolean, value string, number double"
OPTIONAL = list(catalog.OPTIONAL_FIELDS)[:4]


def events(seed, sizes):
    rng, rows = random.Random(seed), []
    for s, n in enumerate(sizes):
        for seq in rng.sample(range(10 * n), n):
            u = rng.random()
            if u < 0.03:
                rows.append((f"s{s}", seq, "required", "restart", None, None, None, None))
            elif u < 0.06:
                rows.append((f"s{s}", seq, "optional", "restart", None, None, None, None))
            else:
                field = rng.choice(OPTIONAL if u > 0.6 else catalog.REQUIRED_FIELDS)
                section = "optional" if field in OPTIONAL else "required"
                rows.append((f"s{s}", seq, section, "submit", field, rng.random() < 0.9, None, float(seq)))
    return rows


def plain(rows, gate=True):
    held = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = held.setdefault(r[0], ({}, {}))
        if r[3] == "restart":
            mine[r[2] == "optional"].clear()
        elif r[5] and (r[2] == "required" or not gate or len(mine[0]) == len(catalog.REQUIRED_FIELDS)):
            mine[r[2] == "optional"][r[4]] = r[1]
    return sorted((s, f, q) for s, both in held.items() for part in both for f, q in part.items())


def state(df):
    return sorted((r["session_id"], r["field"], r["seq"]) for r in df.collect())


@pytest.mark.parametrize("gate", [True, False])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_replay_equals_plain_replay_however_rows_are_cut(spark, gate, batch):
    rows = events(3, [1, 2, 30, 60, 400, 25, 3000])  # the last session holds most rows
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), VALIDATED).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert state(ik.session_state(df, gate)) == plain(rows, gate)
        assert rp.replay(df, gate).count() == len({r[0] for r in rows})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_gate_opens_by_a_run_before(spark):
    """Optional answers that depend on captures of earlier runs, with a restart between runs."""
    full = [("s", i, "required", "submit", f, True, None, 1.0) for i, f in enumerate(catalog.REQUIRED_FIELDS)]
    opt = lambda q: ("s", q, "optional", "submit", OPTIONAL[0], True, None, float(q))
    rows = full[:5] + [opt(20)] + [(*full[i][:1], 30 + i, *full[i][2:]) for i in range(5, 9)] + [opt(50)]
    rows += [("s", 60, "required", "restart", None, None, None, None), opt(70)]
    df = spark.createDataFrame(rows, VALIDATED)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert state(ik.session_state(df)) == plain(rows) == [("s", OPTIONAL[0], 50)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_one_exchange_of_rows_and_one_by_session(spark):
    df = spark.createDataFrame(events(1, [20]), VALIDATED)
    for out in (ik.session_state(df), ik.progress(rp.replay(df)), ik.required_status(rp.replay(df)), ik.section_summary(rp.replay(df)), ik.answers_to_features(rp.replay(df))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        lines = [x.split("Exchange ")[1] for x in plan.splitlines() if "Exchange " in x]
        assert [x.split("(")[0] for x in lines] == ["hashpartitioning", "rangepartitioning"] and "Join" not in plan, plan


def test_empty_answers(spark):
    df = spark.createDataFrame([], VALIDATED)
    assert state(ik.session_state(df)) == [] and rp.replay(df).count() == 0


def test_sessions_without_valid_answers_stay(spark):
    df = spark.createDataFrame([("a", 1, "required", "submit", "age", False, None, None), ("b", 2, None, "submit", "no such field", False, None, None)], VALIDATED)
    got = {r["session_id"]: r for r in ik.required_status(rp.replay(df)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["n_missing"] == len(catalog.REQUIRED_FIELDS) and not got["b"]["complete"]
