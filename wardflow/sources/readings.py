"""Reading logs, outcomes and prediction files.

One multi-file scan per call (never a Python loop over files); the record id
is lifted from each file's ``RecordID`` row by an aggregate on the file path.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.functions.scalar import to_minutes

READING_SCHEMA = T.StructType([
    T.StructField("Time", T.StringType(), True),
    T.StructField("Parameter", T.StringType(), True),
    T.StructField("Value", T.DoubleType(), True),
])

SPLITS = ("a", "b", "c")


def _check_split(spark: SparkSession, root: str, split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f'split must be one of {", ".join(SPLITS)}')
    path = os.path.join(root, f"set-{split}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):  # wherever the path lies
        raise FileNotFoundError(f"Dataset directory not found: {path}")
    return path


def read_raw(spark: SparkSession, root: str, splits=SPLITS, files: str = "*.txt") -> DataFrame:
    """S1 + U1: all record files of the given splits in one scan.

    Columns: file, split, t (minutes), parameter, value. Small files are packed
    into partitions by ``spark.sql.files.openCostInBytes``. ``files`` names them
    inside a split's folder.
    """
    paths = [os.path.join(_check_split(spark, root, s), files) for s in splits]
    df = spark.read.schema(READING_SCHEMA).option("header", True).csv(paths)
    path = F.col("_metadata.file_path")
    return df.select(
        path.alias("file"),
        F.regexp_extract(path, r"set-([a-z])/", 1).alias("split"),
        to_minutes("Time").alias("t"),
        F.col("Parameter").alias("parameter"),
        F.col("Value").alias("value"),
    )


def with_record_id(raw: DataFrame, from_content: bool = True) -> DataFrame:
    """Lift each file's ``RecordID`` row to a ``record_id`` column and drop that row.

    A file without such a row, or with two that differ, fails the job: no record is lost silently.

    ``from_content`` reads the id from the row (one aggregate per file, joined
    back on the file path); otherwise the numeric file name is used.
    """
    body = raw.where((F.col("parameter") != "RecordID") | F.col("parameter").isNull())
    if not from_content:
        rid = F.regexp_extract(F.col("file"), r"([0-9]+)\.txt$", 1).cast("long")
        return body.withColumn("record_id", rid)
    ids = raw.where(F.col("parameter") == "RecordID").groupBy("file").agg(
        F.min("value").cast("long").alias("_id"), F.max("value").cast("long").alias("_id2")
    )
    one = F.when(F.col("_id") == F.col("_id2"), F.col("_id")).otherwise(
        F.raise_error(F.concat(F.lit("no single RecordID in "), F.col("file"))).cast("long"))
    return body.join(ids, "file", "left").withColumn("record_id", one).drop("_id", "_id2")


def read_readings(spark: SparkSession, root: str, splits=SPLITS, files: str = "*.txt") -> DataFrame:
    """S1 + S2: ``(split, record_id, t, parameter, value)`` for the splits."""
    return with_record_id(read_raw(spark, root, splits, files)).select("split", "record_id", "t", "parameter", "value")


def compact_readings(readings: DataFrame, out: str) -> str:
    """Write the tiny record files once as Parquet partitioned by split."""
    readings.write.mode("overwrite").partitionBy("split").parquet(out)
    return out


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """S3: outcomes CSV -> ``(record_id, label)`` with label = in-hospital death == 1."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(
        F.col("RecordID").cast("long").alias("record_id"),
        (F.col("`In-hospital_death`").cast("int") == 1).cast("int").alias("label"),
    )


def write_predictions(pred: DataFrame, path: str) -> str:
    """Header-less ``record_id, pred, score`` CSV (a directory of part files)."""
    pred.select("record_id", F.col("pred").cast("int"), F.col("score").cast("double")).write.mode(
        "overwrite"
    ).option("header", False).csv(path)
    return path


PREDICTION_SCHEMA = T.StructType([
    T.StructField("record_id", T.LongType(), True),
    T.StructField("pred", T.IntegerType(), True),
    T.StructField("score", T.DoubleType(), True),
])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).option("header", False).csv(path)
