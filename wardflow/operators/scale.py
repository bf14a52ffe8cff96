"""I5 + I6: standard scaler on long features (fit on one frame, apply to any).

Population standard deviation; a feature with zero spread is divided by 1,
so an unseen value keeps its offset (x - mean). The fitted statistics hold
one row per feature and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(long: DataFrame, group_cols=("feature",)) -> DataFrame:
    std = F.stddev_pop("value")
    return long.groupBy(*group_cols).agg(
        F.avg("value").alias("mean"),
        F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std).alias("scale"),
    )


def apply_scaler(long: DataFrame, stats: DataFrame, group_cols=("feature",)) -> DataFrame:
    cols = long.columns
    return (
        long.join(F.broadcast(stats), list(group_cols), "left")
        .withColumn("value", (F.col("value") - F.col("mean")) / F.col("scale"))
        .select(*cols)
    )
