"""Class counts, balanced weights, exact majority undersampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions.scalar import lehmer
from wardflow.operators.ranks import row_ranks

#: Splits a hash below 2^31 into a high half of 15 bits and a low one of 16.
HALF = 1 << 16


def class_counts(df: DataFrame, label_col: str = "label", by=()) -> DataFrame:
    """Rows per (group, label)."""
    return df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("n"))


def distinct_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A12."""
    return df.select(label_col).where(F.col(label_col).isNotNull()).distinct()


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A10: 'balanced' weights n / (k * n_c). The window runs over k rows only."""
    c = class_counts(df, label_col)
    w = Window.partitionBy(F.lit(0))
    return c.select(
        label_col, "n",
        (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"),
    )


def undersample_majority(df: DataFrame, label_col: str = "label", id_col: str = "record_id",
                         seed: int = 42) -> DataFrame:
    """I4: cut the majority class to the minority size, without replacement.

    The kept majority rows are those with the smallest (hash(id, seed), id):
    an exact count (unlike ``sampleBy``), reproducible in SQL. Two counting rounds
    find the last hash that is kept: the first counts rows per class and high half of the hash,
    the second those of the one high half that holds the cut. Rows below it pass a
    filter and are never shuffled; only rows of that very hash are ranked (G1). Rows
    with a NULL label are of no class: they set no size and are not in the result.
    """
    df = df.where(F.col(label_col).isNotNull())
    h = lehmer(id_col, seed)
    high = F.floor(h / HALF)
    # at most 2^15 rows per class; a NULL id has no hash and its rows come last
    rows = df.groupBy(F.col(label_col).alias("label"), high.alias("high")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["label"]] = sizes.get(r["label"], 0) + r["n"]
    if len(sizes) < 2:
        return df
    n_min = min(sizes.values())
    majority = sorted(sizes, key=lambda label: (-sizes[label], label))[0]
    is_major = F.col(label_col) == F.lit(majority)
    maj, rest = df.where(is_major), df.where(~is_major)
    counts = {r["high"]: r["n"] for r in rows if r["label"] == majority and r["high"] is not None}
    at, left = _last(counts, n_min)
    if at is None:  # no more rows than wanted
        return maj.where(h.isNotNull()).unionByName(rest)
    low = maj.where(high == at).groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2^16 rows
    cut_hash, left = _last({r["h"]: r["n"] for r in low}, left)
    edge = row_ranks(maj.where(h == cut_hash).withColumn("_h", h), "_h", tie_cols=[id_col])
    kept = edge.where(F.col("rank") <= left).select(*df.columns)
    return df.where(~is_major | (h < cut_hash)).unionByName(kept)


def _last(counts: dict[int, int], wanted: int) -> tuple[int | None, int]:
    """The key that holds the ``wanted``-th row in key order, and which of its rows that is; (None, 0) beyond all rows."""
    for key in sorted(counts):
        if wanted <= counts[key]:
            return key, wanted
        wanted -= counts[key]
    return None, 0
