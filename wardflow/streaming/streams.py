"""Structured Streaming versions of the form and the vital aggregates.

Sources are file streams (a directory or glob of Parquet files); sinks go
through ``foreachBatch`` into Parquet under the shared checkpoint folder, each
row tagged with its batch id, so a replayed batch after a failure rewrites
the same rows (idempotent by ``batch_id``) and readers keep the latest
version per key. Checkpoints live next to the output, never on local disk of
one machine.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.scalar import mask_sentinel, risk_band
from wardflow.operators import features as fx
from wardflow.operators import intake as ik
from wardflow.operators import models as mo
from wardflow.operators import scale as sc
from wardflow.operators.replay import coded, compose, deal, states
from wardflow.session import release, scratch_path


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A Parquet file stream; a single file is addressed through a one-file glob."""
    if path.endswith(".parquet") and not any(ch in path for ch in "*?["):
        path = path[:-1] + "[" + path[-1] + "]"
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


#: State in RocksDB on the executors' disks. What all stores of an executor keep in memory is bounded, whatever the
#: number of keys; rows are not counted as they are put, which would read each key first.
_STORE = "spark.sql.streaming.stateStore."
DISK_STATE = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.boundedMemoryUsage": "true",
    _STORE + "rocksdb.maxMemoryUsageMB": "256",
    _STORE + "rocksdb.trackTotalNumberOfRows": "false",
    _STORE + "rocksdb.compression": "zstd",
}


@contextmanager
def disk_state(spark: SparkSession):
    """Streams that start in here keep their state on disk (settings that the session has stay as they are)."""
    ours = {k: v for k, v in DISK_STATE.items() if spark.conf.get(k, None) is None}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


def run_to_parquet(stream: DataFrame, out: str, mode: str = "append", name: str = "stream") -> str:
    """Run a stream with ``availableNow`` into ``out`` (Parquet, one folder per batch id)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            os.path.join(out, "data", f"batch={batch_id}")
        )

    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", os.path.join(out, "checkpoint"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .queryName(f"{name}_{os.path.basename(out).replace('-', '_')}")
        .start()
    )
    q.awaitTermination()
    return out


def read_latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Sink contents, the latest batch's row per key (update-mode outputs).

    A batch writes a key once, so the rows of a lone batch are read as they are: nothing is moved.
    """
    df = spark.read.parquet(os.path.join(out, "data"))
    cols = [c for c in df.columns if c not in keys and c not in ("_batch", "batch")]
    if len(_batches(spark, out)) == 1:
        return df.select(*keys, *cols)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("_batch")).alias("s")).select(*keys, "s.*")


def read_latest_sessions(spark: SparkSession, out: str) -> DataFrame:
    """Sink contents of :func:`_by_session`: the rows that the latest batch of each session wrote.

    A batch writes all rows of a session that it touches. So the latest batch is found per session, and rows move
    once to meet it if there are several batches, and not at all if there is one.
    """
    df = spark.read.parquet(os.path.join(out, "data"))
    cols = [c for c in df.columns if c not in ("_batch", "batch")]
    if len(_batches(spark, out)) == 1:
        return df.select(*cols)
    last = df.groupBy(F.col("session_id").alias("_session")).agg(F.max("_batch").alias("_last"))
    return df.join(last, F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("_batch") == F.col("_last")), "left_semi").select(*cols)


def _batches(spark: SparkSession, out: str) -> list[str]:
    """The sink's folders of batches, listed by the driver through Hadoop, as readers do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(out, "data"))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [name for f in files if (name := f.getPath().getName()).startswith("batch=")]


def read_all(spark: SparkSession, out: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(out, "data"))
    return df.drop("_batch", "batch")


def validate_stream(answers: DataFrame) -> DataFrame:
    """Stateless per-row validation of arriving answers (same output as the batch F1-F3)."""
    return ik.validate(answers)


def _by_session(answers: DataFrame, out: str, name: str, finish) -> str:
    """Run ``finish(replayed sessions)`` on every session that a batch of answers touches, with all its answers so far.

    Each batch is validated, and what a replay takes of its answers (:func:`wardflow.operators.replay.coded`) is kept
    under ``out/answers``; the touched sessions are replayed whole (optional gate included) and what ``finish`` makes
    of them is written under ``out/data``, both by batch id: a batch that is run again writes the same rows to the same
    place. Answers of earlier batches join by session; a first batch has none and its answers move once, to be dealt.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, kept = batch.sparkSession, os.path.join(out, "answers")
        here = os.path.join(kept, f"batch={batch_id}")
        answers = coded(ik.validate(batch, spark))
        answers.write.mode("overwrite").option("compression", "zstd").parquet(here)
        release(spark)  # what moved to make the answers is not needed to replay them
        seen = spark.read.schema(answers.schema).parquet(here)
        if batch_id:
            now = seen.select("session_id").distinct()
            earlier = spark.read.parquet(kept).where(F.col("batch") < batch_id).select(*answers.columns)
            seen = seen.unionByName(earlier.join(now, "session_id", "left_semi"))
        rows = finish(compose(states(deal(seen))))
        rows = rows.withColumn("_batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(out, "data", f"batch={batch_id}"))
        release(spark)

    q = (
        answers.writeStream.option("checkpointLocation", os.path.join(out, "checkpoint"))
        .foreachBatch(write).trigger(availableNow=True)
        .queryName(f"{name}_{os.path.basename(out).replace('-', '_')}").start()
    )
    q.awaitTermination()
    return out


def feature_stream(answers: DataFrame, out: str, name: str = "t1") -> str:
    """Model rows (long) of every session that a batch touches."""
    return _by_session(answers, out, name, ik.answers_to_features)


def score_stream(answers: DataFrame, out: str, model_path: str, threshold: float, name: str = "t1s") -> str:
    """T1 + F11: ``(session_id, band, risk_score)`` of every session that a batch touches.

    Model and scaler are read once, when the stream starts; every batch is scored with them.
    """
    model, stats = mo.load_pipeline(answers.sparkSession, model_path, "mlp")
    names = ik.model_feature_names()
    return _by_session(answers, out, name, lambda sessions: score_rows(ik.answers_to_features(sessions), model, stats, names, threshold))


def score_rows(rows: DataFrame, model, stats: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """T1 + F11: scale and score model rows (long) with a saved model: ``(session_id, band, risk_score)``."""
    rows = rows.withColumnRenamed("session_id", "record_id")
    vec = mo.with_vector(fx.to_vector(sc.apply_scaler(rows, stats), names).withColumn("label", F.lit(None).cast("int")))
    band, r3 = risk_band("score", threshold)
    return mo.positive_score(model, vec, "mlp").select(F.col("record_id").alias("session_id"), band.alias("band"), r3.alias("risk_score"))


def session_stream(validated: DataFrame) -> DataFrame:
    """Submissions folded per (session, field) in update mode.

    The latest valid submission or restart per field wins; the optional gate
    of the batch replay is not applied (it needs the order of whole epochs).
    State holds one row per (session, field); start it within :func:`disk_state`, as their number has no bound.
    Rows travel, and are kept, in short: the field as its position, its section only where it is not the catalogue's.
    """
    spark = validated.sparkSession
    subs = validated.where((F.col("action") == "submit") & F.col("ok")).select(
        "session_id", "seq", "section", "action", "field", "value", "number")
    restarts = ik._restart_rows(validated, spark)
    rows = subs.unionByName(restarts).where(F.col("seq").isNotNull())
    places = "map(" + ", ".join(f"'{f['name']}', {f['position']}" for f in ik._fields()) + ")"
    names, sections = ("array(" + ", ".join(f"'{f[k]}'" for f in ik._fields()) + ")" for k in ("name", "section"))
    rows = rows.selectExpr("session_id", f"{places}[field] AS place", "section", "seq", "action = 'submit' AS given", "value", "number")
    last = rows.groupBy("session_id", "place").agg(F.max(F.struct(
        "seq", "given", F.expr(f"if(section = get({sections}, place), null, struct(section))").alias("own"), "value", "number")).alias("l"))
    section = f"if(l.own IS NULL, get({sections}, place), l.own.section)"
    return last.selectExpr(
        "session_id", f"get({names}, place) AS field",
        f"named_struct('action', if(l.given, 'submit', 'restart'), 'section', {section}, 'value', l.value, 'number', l.number) AS s", "l.seq AS seq")


def fold_session_output(latest: DataFrame) -> DataFrame:
    """Answered fields from T2's sink (a restart as latest means not answered)."""
    return latest.where(F.col("s.action") == "submit").select(
        "session_id", "field", "s.section", "s.value", "s.number", "seq")


def vitals_stream(readings: DataFrame) -> DataFrame:
    """Running per-(record, vital) aggregates as readings arrive.

    The sentinel is masked on raw readings; first/last go by (ts, event_id).
    Duplicate-time averaging and medians stay batch-only (they need whole groups).
    """
    v = readings.withColumn("value", mask_sentinel("value"))
    order = F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))
    return v.groupBy("record_id", "parameter").agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_pop("value").alias("std"),
        F.min_by("value", order).alias("first"),
        F.max_by("value", order).alias("last"),
        F.count("value").alias("n"),
    )


def stream_out(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
