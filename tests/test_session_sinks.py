"""T1's model rows: a sink of several batches equals the batch replay; one batch is read without moving a row."""

import os
import shutil

from wardflow.operators import intake as ik
from wardflow.session import scratch_path
from wardflow.streaming import streams as st

REQUIRED = [f["name"] for f in sorted(ik._fields("required"), key=lambda f: f["position"])]


def submitted(session, first, fields, raw="1"):
    return [(session, first + i, None, "submit", f, raw) for i, f in enumerate(fields)]


def files(spark, folder, batches):
    """One file per batch, in this order of arrival."""
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        at = f"{folder}-{i}"
        spark.createDataFrame(rows, ik.ANSWER_SCHEMA).coalesce(1).write.parquet(at)
        part = next(x for x in os.listdir(at) if x.startswith("part-"))
        shutil.copyfile(os.path.join(at, part), to := os.path.join(folder, f"{i}.parquet"))
        os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


BATCHES = [
    submitted("s1", 0, REQUIRED, "3") + submitted("s2", 0, REQUIRED[:4], "2") + [("s3", 5, None, "submit", "no such field", "1")],
    # earlier places of s1 come later; s2 begins anew; s4 is new
    submitted("s1", -20, REQUIRED, "60") + [("s2", 90, "required", "restart", None, None)] + submitted("s4", 0, REQUIRED[:1], "n/a"),
    submitted("s2", 100, REQUIRED, "40") + submitted("s1", 50, REQUIRED[:2], "50"),
]


def rows(df):
    return sorted((r.session_id, r.feature, r.value) for r in df.collect())


def streamed(spark, folder, max_files=None):
    out = scratch_path(spark, "sink-test")
    st.feature_stream(st.file_stream(spark, folder, ik.ANSWER_SCHEMA, max_files=max_files), out, "sink")
    return out


def test_batches_of_sessions_equal_one_replay(spark, tmp_path):
    folder = files(spark, str(tmp_path / "in"), BATCHES)
    every = spark.createDataFrame([r for b in BATCHES for r in b], ik.ANSWER_SCHEMA)
    want = rows(ik.answers_to_features(ik.replay_answers(every)))
    assert {r[0] for r in want} == {"s1", "s2", "s3", "s4"}
    out = streamed(spark, folder, max_files=1)
    assert len(st._batches(spark, out)) == 3
    assert rows(st.read_latest_sessions(spark, out)) == want
    assert rows(st.read_latest(spark, out, ["session_id", "feature"])) == want


def test_one_batch_is_read_as_it_is(spark, tmp_path):
    folder = files(spark, str(tmp_path / "in"), BATCHES)
    every = spark.createDataFrame([r for b in BATCHES for r in b], ik.ANSWER_SCHEMA)
    out = streamed(spark, folder)
    assert len(st._batches(spark, out)) == 1
    for df in (st.read_latest_sessions(spark, out), st.read_latest(spark, out, ["session_id", "feature"])):
        assert rows(df) == rows(ik.answers_to_features(ik.replay_answers(every)))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
    # kept of an answer: what a replay takes
    assert set(spark.read.parquet(os.path.join(out, "answers")).columns) == {"session_id", "seq", "code", "value", "number", "batch"}


def test_session_state_is_kept_on_disk(spark, tmp_path):
    """T2 folds several batches through a state store whose memory is bounded; an answer keeps a section of its own."""
    own = [("s9", 1, "my section", "submit", REQUIRED[0], "40"), ("s9", 2, None, "submit", REQUIRED[1], "40"), ("s9", 3, "optional", "restart", None, None)]
    batches = [BATCHES[0] + own, *BATCHES[1:]]
    folder = files(spark, str(tmp_path / "in"), batches)
    out = scratch_path(spark, "state-test")
    store = st._STORE + "providerClass"
    before = spark.conf.get(store)
    with st.disk_state(spark):
        answers = st.validate_stream(st.file_stream(spark, folder, ik.ANSWER_SCHEMA, max_files=1))
        st.run_to_parquet(st.session_stream(answers), out, "update", "t2state")
    assert spark.conf.get(store) == before
    kept = [x for _, _, names in os.walk(os.path.join(out, "checkpoint", "state")) for x in names]
    assert any(x.endswith(".zip") for x in kept) and not any(x.endswith(".delta") for x in kept)  # RocksDB's files, not those of a map on the heap

    key = lambda r: (r.session_id, r.field)
    got = {key(r): (r.section, r.value, r.number, r.seq) for r in st.fold_session_output(st.read_latest(spark, out, ["session_id", "field"])).collect()}
    every = spark.createDataFrame([r for b in batches for r in b], ik.ANSWER_SCHEMA)
    want = {key(r): (r.section, r.value, r.number, r.seq) for r in ik.session_state(ik.validate(every), gate_optional=False).collect()}
    assert got.pop(("s9", REQUIRED[0]), (None,))[0] == ("my section" if want.pop(("s9", REQUIRED[0]), None) else None)
    assert got == want and any(k[0] == "s1" for k in want)
