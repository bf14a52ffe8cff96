"""Registered queries: streams run to completion (``availableNow``) and read back.

Each equals its batch counterpart, so each reuses that oracle text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow.plans import q_intake as QI
from wardflow.plans.registry import query, rounded, stable
from wardflow.sources import standins as SI
from wardflow.streaming import streams as st


def _orders_stream(spark, sf_dir):
    schema = SI.table(spark, sf_dir, "orders").schema
    return st.file_stream(spark, f"{sf_dir}/orders.parquet", schema)


def answers_stream(spark, sf_dir):
    """The answers recipe applied to a stream of ``orders`` files (stateless)."""
    orders = SI.spread(_orders_stream(spark, sf_dir))
    return SI.answers_from_orders(spark, orders)


@query("validate_stream", QI._BASE + "SELECT session_id, seq, field, ok, value, number, message FROM val")
def validate_stream(spark, sf_dir):
    """Answers validated as they arrive; equals the batch validation."""
    out = st.stream_out(spark, "validate-stream")
    st.run_to_parquet(st.validate_stream(answers_stream(spark, sf_dir)), out, "append", "t1")
    return st.read_all(spark, out).select("session_id", "seq", "field", "ok", "value", "number", "message")


@query("feature_stream", rounded(QI._features_sql(False), ["value"]))
def feature_stream(spark, sf_dir):
    """T1 + F10: answers validated as they arrive and turned into model rows; equals the batch rows."""
    out = st.stream_out(spark, "feature-stream")
    st.feature_stream(answers_stream(spark, sf_dir), out)
    return stable(st.read_latest_sessions(spark, out))


@query("session_stream", QI._UNGATED + "SELECT session_id, field, section, value, number, seq FROM state")
def session_stream(spark, sf_dir):
    """Per-session answers folded in update mode (no optional gate)."""
    out = st.stream_out(spark, "session-stream")
    v = st.validate_stream(answers_stream(spark, sf_dir))
    with st.disk_state(spark):
        st.run_to_parquet(st.session_stream(v), out, "update", "t2")
    return st.fold_session_output(st.read_latest(spark, out, ["session_id", "field"]))


_T3_SQL = """WITH r AS (SELECT user_id AS record_id, event_type AS parameter, ts, event_id,
    nullif(CASE WHEN event_id % 11 = 0 THEN -1.0 ELSE value END, -1.0) AS value FROM events)
SELECT record_id, parameter, avg(value) AS "mean", min(value) AS "min", max(value) AS "max",
  stddev_pop(value) AS "std",
  arg_min(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS "first",
  arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS "last",
  count(value) AS n
FROM r GROUP BY record_id, parameter"""


@query("vitals_stream", rounded(_T3_SQL, ["mean", "std"]))
def vitals_stream(spark, sf_dir):
    """Running per-(user, event type) aggregates over an ``events`` file stream."""
    schema = SI.table(spark, sf_dir, "events").schema
    ev = st.file_stream(spark, f"{sf_dir}/events.parquet", schema)
    readings = ev.select(
        F.col("user_id").alias("record_id"), F.col("event_type").alias("parameter"), "ts", "event_id",
        F.when(F.pmod("event_id", F.lit(SI.SENTINEL_EVERY)) == 0, F.lit(-1.0)).otherwise(F.col("value")).alias("value"),
    )
    out = st.stream_out(spark, "vitals-stream")
    st.run_to_parquet(st.vitals_stream(readings), out, "update", "t3")
    return stable(st.read_latest(spark, out, ["record_id", "parameter"]))
