"""Registered queries of the file sources: the stand-ins written as record files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow.functions.scalar import elapsed_hhmm
from wardflow.plans import sqltext as S
from wardflow.plans.q_features import _OUTCOMES
from wardflow.plans.registry import query
from wardflow.session import scratch_path
from wardflow.sources import readings as rd
from wardflow.sources import standins as SI


# Tasks move their own files into place; by default the driver moves all of them, one after another.
COMMIT = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


@query("readings_roundtrip", S.with_(S.READINGS) + "SELECT " + S.split_sql("record_id")
       + " AS split, record_id, t, parameter, value FROM readings")
def readings_roundtrip(spark, sf_dir):
    """S1 + S2 + U1: event readings as one file per record, read as all three splits in one scan."""
    root = scratch_path(spark, "record-files")
    cells = SI.event_readings(spark, sf_dir).withColumn("split", SI.split_of("record_id"))
    ids = cells.select("split", "record_id").distinct().select(
        "split", "record_id", F.lit(-1).alias("t"), F.lit("RecordID").alias("parameter"), F.col("record_id").cast("double").alias("value"))
    rows = cells.unionByName(ids).repartition("record_id").sortWithinPartitions("record_id", "t")
    splits = sorted(r["split"] for r in cells.select("split").distinct().collect())  # at most three; a small table may lack one
    for split in splits:
        rows.where(F.col("split") == split).select(
            F.concat(F.col("record_id").cast("string"), F.lit(".txt")).alias("file"),
            elapsed_hhmm(F.greatest("t", F.lit(0))).alias("Time"), F.col("parameter").alias("Parameter"), F.col("value").alias("Value"),
        ).write.partitionBy("file").option("header", True).option(*COMMIT).csv(f"{root}/set-{split}")
    return rd.read_readings(spark, root, splits, files="file=*.txt/*.csv")


@query("outcomes_roundtrip", S.with_(_OUTCOMES) + "SELECT record_id, label FROM outc")
def outcomes_roundtrip(spark, sf_dir):
    """S3: outcomes in the six-column file form, read back as labels."""
    path = scratch_path(spark, "outcomes")
    zero = F.lit(0)
    SI.event_outcomes(spark, sf_dir).select(
        F.col("record_id").alias("RecordID"), zero.alias("Survival"), zero.alias("c3"), zero.alias("c4"), zero.alias("c5"),
        F.col("label").alias("In-hospital_death")).write.option("header", True).csv(path)
    return rd.read_outcomes(spark, path)
