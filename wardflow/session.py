"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytes of a method that HotSpot compiles at most; Spark's own limit on a fused stage is 65535.
METHOD_CONF, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "wardflow") -> SparkSession:
    """A local session for tests and the benchmark (no UI, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # A fused stage whose generated method passes HotSpot's 8000-byte JIT limit runs
        # interpreted; at this limit Spark splits such stages instead.
        .config(METHOD_CONF, str(METHOD_BYTES))
        .getOrCreate()
    )
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and only read here. A local
    session without it (tests, bench) gets a scratch folder; a cluster session
    without it fails, as folders of single machines are not shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current.rstrip("/")
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf:
        if not sc.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all machines share")
        conf = tempfile.mkdtemp(prefix="wardflow-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, conf)
    sc.setCheckpointDir(conf)
    got = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else conf
    return (got or conf).rstrip("/")


def compiled_stages(spark: SparkSession) -> None:
    """Stages of this session that are too long for the JIT as one method run operator by operator instead.

    A fused stage beyond the limit runs interpreted, row by row; the limit changes no result. A lower one is kept.
    """
    if int(spark.conf.get(METHOD_CONF)) > METHOD_BYTES:
        spark.conf.set(METHOD_CONF, str(METHOD_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for sinks and stream state)."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut(df, name: str):
    """``df`` written to the shared folder and read back: later jobs start from the files."""
    path, schema = scratch_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the frames of finished steps; Spark then drops their shuffle files, which else stay until a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _sql_literal(v, dt) -> str:
    from pyspark.sql import types as T

    if v is None:
        return f"CAST(NULL AS {dt.simpleString()})"
    if isinstance(dt, T.ArrayType):
        inner = ", ".join(_sql_literal(x, dt.elementType) for x in v)
        return f"CAST(array({inner}) AS {dt.simpleString()})"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            return f"CAST('{v!r}' AS DOUBLE)"
        return f"CAST({v!r}D AS {dt.simpleString()})"
    if isinstance(v, int):
        return f"CAST({v} AS {dt.simpleString()})"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{text}' AS {dt.simpleString()})"


def local_frame(spark: SparkSession, rows, schema):
    """A small constant table kept JVM-side: one SQL ``VALUES`` text (a LocalRelation,
    no Python worker, one driver round trip), for declared constants.
    """
    from pyspark.sql import types as T

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    rows = list(rows)
    names = [f"`{f.name}`" for f in schema.fields]
    if not rows:
        cols = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {n}" for f, n in zip(schema.fields, names))
        return spark.sql(f"SELECT {cols} WHERE FALSE")
    body = ", ".join(
        "(" + ", ".join(_sql_literal(v, f.dataType) for v, f in zip(r, schema.fields)) + ")" for r in rows
    )
    aliases = ", ".join(f"c{i}" for i in range(len(names)))
    proj = ", ".join(f"c{i} AS {n}" for i, n in enumerate(names))
    return spark.sql(f"SELECT {proj} FROM VALUES {body} AS t({aliases})")
