"""G1: running totals and exact order statistics without a single partition.

Spark plans ``Window.orderBy(...)`` without ``partitionBy`` as one task over all
rows, and ``percentile`` keeps every distinct value of a group in one buffer.
Both break when a group is large. Here a row's place is cut in two: its bucket, a
pure expression of its key, and its place among the rows of the bucket. Buckets
lie between edges, quantiles of the keys, that a subquery of the same plan finds (an approximate
sketch does: any edges give right results, they only spread rows). The sums of each (group, bucket), a
table with at most one row per group and bucket, give every bucket its offset.
Nothing is written, collected or sampled, and building a query starts no job.

A key that equals an edge has a bucket of its own; where such a key holds many rows
(several quantiles are that key) the bucket is cut again, by edges of the first tie column. Strings are
cut by their first bytes as a number, dates and numbers as they are. Rows that agree in group, key
and first tie column share a bucket: aggregate to distinct keys first (a histogram), or add a
tie-breaker via ``tie_cols``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a string that make its number, and the least and most edges (the number of shuffle partitions lies between).
LETTERS, LEAST_EDGES, MOST_EDGES = 7, 15, 4095


def _number(df: DataFrame, col: str) -> Column:
    """The key, or for strings a number that never falls where they rise."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(F.col(col), "UTF-8"), 1, LETTERS)), 2 * LETTERS, "0")
        return F.conv(head, 16, 10).cast("long")
    if isinstance(kind, T.BooleanType):
        return F.col(col).cast("int")
    return F.unix_micros(F.col(col).cast("timestamp")) if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) else F.col(col)


def _edges(df: DataFrame, col: str, n: int) -> Column:
    """``n`` quantiles of the key, in order, as a subquery of the plan."""
    # A text of literals: a quantile must be a constant, and a column built of thousands of parts is slow.
    at = F.expr("array(" + ", ".join(f"{(i + 1) / (n + 1)!r}D" for i in range(n)) + ")")
    # All columns are asked for, so that the rows below are those of the plan around and an exchange among them is shared.
    found = F.percentile_approx(_number(df, col), at, 20 * n).alias("edges")
    return df.agg(F.struct(found, *(F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns))).alias("s")).scalar()["edges"]


def _below(edges: Column, key: Column, n: int) -> Column:
    """How many of the ``n`` (2**i - 1) edges lie below the key: a binary search."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((n + 1).bit_length() - 1))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < key, at + step).otherwise(at))


def _bucketed(df: DataFrame, order_col: str, tie: str | None, descending: bool) -> DataFrame:
    """``df`` plus ``_b``, a bucket that never falls in the order of (key, tie); ties ascend in either direction of the key."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = (1 << min(max(partitions, LEAST_EDGES), MOST_EDGES).bit_length()) - 1
    key = _number(df, order_col)
    cut = df.withColumn("_e", _edges(df, order_col, n)).withColumn("_k", key)
    cut = cut.withColumn("_at", _below(F.col("_e"), F.col("_k"), n))
    own = F.coalesce(F.get("_e", F.col("_at")) == F.col("_k"), F.lit(False))
    # Never null: else a join on it puts tests of it (and the subquery) on the scans, and exchanges are not shared.
    bucket = F.coalesce(2 * F.col("_at") + F.when(own, 1).otherwise(0), F.lit(0)).cast("long") * (-1 if descending else 1)
    exact = not isinstance(df.schema[order_col].dataType, T.StringType)
    if tie is None or not exact:
        return cut.withColumn("_b", bucket).drop("_e", "_k", "_at")
    heavy = own & (F.get("_e", F.col("_at")) == F.get("_e", F.col("_at") + 1))
    cut = cut.withColumn("_te", _edges(df, tie, n)).withColumn("_t", F.when(heavy, _below(F.col("_te"), _number(df, tie), n)).otherwise(0))
    return cut.withColumn("_b", bucket * (n + 1) + F.coalesce("_t", F.lit(0))).drop("_e", "_k", "_at", "_te", "_t")


def running_totals(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    tie_cols: Sequence[str] = (),
    descending: bool = False,
    max_cols: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in key order) and ``total_<c>``
    (sum over the partition) for every ``c`` in ``sum_cols``, and
    ``runmax_<c>`` (inclusive running max) for every ``c`` in ``max_cols``.

    Rows with a NULL order key are dropped. ``descending`` sorts the key high
    to low (ties on ``tie_cols`` still ascend).
    """
    parts = list(partition_cols)
    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    order = [key, *(F.col(t).asc() for t in tie_cols)]
    x = _bucketed(df.where(F.col(order_col).isNotNull()), order_col, tie_cols[0] if tie_cols else None, descending)
    sums = x.groupBy(*parts, "_b").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sum_cols], *[F.max(c).alias(f"_m_{c}") for c in max_cols]
    )
    # Over a table of one row per group and bucket.
    whole = Window.partitionBy(*parts)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(p).alias(f"_g_{i}") for i, p in enumerate(parts)]
    offs = sums.select(
        *named, F.col("_b").alias("_gb"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_s_{c}").over(whole).alias(f"_t_{c}") for c in sum_cols],
        *[F.max(f"_m_{c}").over(before).alias(f"_p_{c}") for c in max_cols],
    )
    on = F.col("_b") == F.col("_gb")
    for i, p in enumerate(parts):
        on = on & F.col(p).eqNullSafe(F.col(f"_g_{i}"))
    within = Window.partitionBy(*parts, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.join(offs, on).select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.sum(c).over(within)).alias(f"cum_{c}") for c in sum_cols],
        *[F.col(f"_t_{c}").alias(f"total_{c}") for c in sum_cols],
        *[F.greatest(F.col(f"_p_{c}"), F.max(c).over(within)).alias(f"runmax_{c}") for c in max_cols],
    )


def row_ranks(
    df: DataFrame,
    order_col: str,
    tie_cols: Sequence[str] = (),
    partition_cols: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``rank`` (1-based row number in (order_col, tie_cols) order) and ``n``.

    A key value that holds a large share of the rows is split by its first tie column.
    """
    out = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order_col, ["_one"], partition_cols=partition_cols,
                         tie_cols=tie_cols, descending=descending)
    return out.select(*df.columns, F.col("cum__one").alias("rank"), F.col("total__one").alias("n"))


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str, alias: str = "median") -> DataFrame:
    """Exact interpolated median of ``value_col`` per group (NULLs skipped).

    Distributed: a value histogram, G1 running counts over it, then the one or
    two middle values per group. No group is ever held in one buffer.
    """
    hist = df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n"))
    rt = running_totals(hist, value_col, ["_n"], partition_cols=group_cols)
    n = F.col("total__n")
    p1 = F.floor((n + 1) / 2)
    p2 = F.floor(n / 2) + 1
    start = F.col("cum__n") - F.col("_n")
    lo = F.when((start < p1) & (p1 <= F.col("cum__n")), F.col(value_col))
    hi = F.when((start < p2) & (p2 <= F.col("cum__n")), F.col(value_col))
    return rt.groupBy(*group_cols).agg(((F.max(lo) + F.max(hi)) / 2).alias(alias))


def exact_mode(df: DataFrame, group_cols: Sequence[str], value_col: str, alias: str = "mode") -> DataFrame:
    """Most frequent non-NULL value per group, the smallest one on ties."""
    counts = (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*group_cols, value_col)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # min_by over (-count, value) gives the smallest value among the most frequent.
    return counts.groupBy(*group_cols).agg(
        F.min_by(F.col(value_col), F.struct(-F.col("_n"), F.col(value_col))).alias(alias)
    )
