"""A stream that scores equals the batch, row for row, and writes a repeated batch to the same place."""

import os

from pyspark.sql import functions as F

from wardflow import catalog
from wardflow.plans import q_models as QM
from wardflow.plans import q_streams as QS
from wardflow.session import scratch_path
from wardflow.sources import standins as SI
from wardflow.streaming import streams as st

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["session_id"], r["band"], r["risk_score"]) for r in df.collect())


def test_score_stream_equals_batch(spark, tmp_path):
    path = QM.form_model(spark, SF)
    want = rows(QM.score_answers(spark, SF, path))
    assert want and {r[1] for r in want} <= {"RISK", "NO RISK"} and len({r[0] for r in want}) == len(want)
    assert rows(QM.score_stream_query(spark, SF, path)) == want

    # several batches: a session's later answers replace its score, whatever batch they come in
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    parts = str(tmp_path / "orders")
    for i in range(3):
        orders.where(F.pmod("o_orderkey", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(parts)
    out = scratch_path(spark, "score-batches")
    stream = SI.answers_from_orders(spark, st.file_stream(spark, parts, orders.schema, max_files=1))
    st.score_stream(stream.where(~QM._learns(F.col("session_id"))), out, path, catalog.THRESHOLDS["mlp"][0])
    assert len([x for x in os.listdir(os.path.join(out, "data")) if x.startswith("batch=")]) == 3
    assert rows(st.read_latest(spark, out, ["session_id"])) == want
    assert QS.answers_stream(spark, SF).isStreaming
