"""Feature table: R1, P2, P3, P12, A1-A9, P4, P9, P10, J1-J3, D1, W1, R2, R3.

Readings stay long, ``(record_id, t, parameter, value)``, until the very
end: a 369-column projection would switch whole-stage codegen off, while the
long form keeps every step a narrow, codegen'd aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow import catalog
from wardflow.functions.scalar import mask_sentinel, one_hot, required
from wardflow.operators.ranks import exact_median, exact_mode
from wardflow.session import local_frame

AGG_COLUMNS = ("mean", "median", "min", "max", "std", "first", "last", "missing", "delta", "range")


def clean_cells(readings: DataFrame, sentinel: float = catalog.SENTINEL) -> DataFrame:
    """R1 + P3 + P2: one value per (record, time, parameter).

    Duplicates are averaged first and the sentinel masked afterwards, so a
    duplicate pair (-1, 5) keeps 2. A NULL parameter is dropped. The
    aggregate is partial (map-side), so a hot record is combined before the
    shuffle.
    """
    return (
        readings.where(F.col("parameter").isNotNull())
        .groupBy("record_id", "t", "parameter")
        .agg(F.avg("value").alias("value"))
        .withColumn("value", mask_sentinel("value", sentinel))
    )


def select_parameters(df: DataFrame, names: Sequence[str], keep: bool = True) -> DataFrame:
    """Keep (or drop) the listed parameters."""
    cond = F.col("parameter").isin(list(names))
    return df.where(cond if keep else ~cond)


def record_spine(records: DataFrame, vitals: Sequence[str]) -> DataFrame:
    """Every record x every declared vital (an explode of a literal list, no join)."""
    return records.select(
        "record_id", F.explode(F.array(*[F.lit(v) for v in vitals])).alias("parameter")
    )


def vital_aggregates(cells: DataFrame, records: DataFrame, vitals: Sequence[str]) -> DataFrame:
    """A1-A8 + P4 in one aggregate, wide per (record, vital).

    Records without any reading of a vital keep a row (spine rows carry a
    NULL value): ``missing`` = 1 and every statistic NULL. Statistics run over
    distinct times (cells), ``std`` is the population one, first/last skip
    NULLs and go by time. A (record, vital) group holds at most one value per
    distinct time, so the exact median stays bounded per group.
    """
    v = select_parameters(cells, vitals).select("record_id", "parameter", "t", "value")
    spine = record_spine(records, vitals).select(
        "record_id", "parameter", F.lit(None).cast("int").alias("t"), F.lit(None).cast("double").alias("value")
    )
    both = v.unionByName(spine.withColumn("t", F.col("t").cast(v.schema["t"].dataType)))
    timed = F.when(F.col("value").isNotNull(), F.col("t"))
    agg = both.groupBy("record_id", "parameter").agg(
        F.avg("value").alias("mean"),
        F.percentile(F.col("value"), F.lit(0.5)).alias("median"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_pop("value").alias("std"),
        F.min_by("value", timed).alias("first"),
        F.max_by("value", timed).alias("last"),
        (F.count("value") == 0).cast("double").alias("missing"),
    )
    return agg.withColumn("delta", F.col("last") - F.col("first")).withColumn(
        "range", F.col("max") - F.col("min")
    )


def to_long(wide: DataFrame, id_cols: Sequence[str] = ("record_id",), base_col: str = "parameter",
            value_cols: Sequence[str] = AGG_COLUMNS) -> DataFrame:
    """Wide aggregates -> ``(record_id, feature, value)`` with ``<base>_<suffix>``."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("suffix"), F.col(c).cast("double").alias("value")) for c in value_cols])
    ).alias("kv")
    return wide.select(*id_cols, base_col, pairs).select(
        *id_cols,
        F.concat_ws("_", F.col(base_col), F.col("kv.suffix")).alias("feature"),
        F.col("kv.value").alias("value"),
    )


def impute_median(long: DataFrame, group_cols: Sequence[str] = ("feature",)) -> DataFrame:
    """NULL -> that feature's exact median over the same frame (one split).

    The median table has one row per feature (catalogue-bounded), so it is
    broadcast.
    """
    long = long.persist(StorageLevel.MEMORY_AND_DISK)  # read by the median pass and the fill
    med = exact_median(long, list(group_cols), "value", alias="_median")
    cols = long.columns
    return (
        long.join(F.broadcast(med), list(group_cols), "left")
        .withColumn("value", F.coalesce(F.col("value"), F.col("_median")))
        .select(*cols)
    )


def vital_features(readings: DataFrame, vitals: Sequence[str], records: DataFrame | None = None,
                   impute: bool = True, split_col: str | None = None) -> DataFrame:
    """The vital part of A9, long: ``(record_id, feature, value)``.

    With ``split_col`` (a column of ``records``) each split is imputed from
    its own medians, and the split is kept as a column.
    """
    if records is None:
        records = readings.select("record_id").distinct()
    cells = clean_cells(readings)
    long = to_long(vital_aggregates(cells, records.select("record_id"), vitals))
    if split_col:
        long = long.join(records.select("record_id", split_col), "record_id", "inner")
    if not impute:
        return long
    return impute_median(long, [split_col, "feature"] if split_col else ["feature"])


# ---------------------------------------------------------------------------
# Descriptors: biometrics (I2, I3, D1, J3) and ICU type one-hot
# ---------------------------------------------------------------------------


def descriptor_rows(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide per (record, time) over *all* time rows: one column per descriptor.

    Every time row is kept (also those holding only vitals), so "the record's
    first time row" and "median over time rows" mean what they mean in the
    pivoted per-record table.
    """
    return cells.groupBy("record_id", "t").agg(
        *[F.max(F.when(F.col("parameter") == n, F.col("value"))).alias(n) for n in names]
    )


def impute_biometrics(rows: DataFrame, records: DataFrame, continuous: Sequence[str] = catalog.CONTINUOUS_BIOMETRICS,
                      mode_col: str | None = "Gender", group_cols: Sequence[str] = ()) -> DataFrame:
    """I2 + I3 + D1: one row per record from its first time row after filling.

    Continuous biometrics are filled with the exact median over *time rows*
    (not records) of the same group (split), the mode column with the
    smallest mode; then the earliest time row of each record is taken (a
    record whose first Weight is missing gets the median even when a later
    Weight exists). Records without any time row keep NULLs. The fill tables
    hold one row per group and are broadcast.
    """
    groups = list(group_cols)
    if not groups:
        rows = rows.withColumn("_g", F.lit(0))
        groups = ["_g"]
    cols = [c for c in continuous if c in rows.columns]
    filled = rows
    if cols:
        stacked = rows.select(
            *groups,
            F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in cols])).alias("kv"),
        ).select(*groups, "kv.name", "kv.v")
        meds = exact_median(stacked, [*groups, "name"], "v", alias="m")
        wide = meds.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == c, F.col("m"))).alias(f"_m_{c}") for c in cols])
        filled = filled.join(F.broadcast(wide), groups, "left")
        for c in cols:
            filled = filled.withColumn(c, F.coalesce(F.col(c), F.col(f"_m_{c}"))).drop(f"_m_{c}")
    if mode_col and mode_col in rows.columns:
        mode = exact_mode(rows, groups, mode_col, alias="_mode")
        filled = filled.join(F.broadcast(mode), groups, "left").withColumn(
            mode_col, F.coalesce(F.col(mode_col), F.col("_mode"))
        ).drop("_mode")
    keep = [c for c in rows.columns if c not in ("record_id", "t", "_g", *group_cols)]
    first = filled.groupBy("record_id").agg(
        F.min_by(F.struct(*[F.col(c) for c in keep]), F.col("t")).alias("r")
    ).select("record_id", *[F.col(f"r.{c}").alias(c) for c in keep])
    return records.join(first, "record_id", "left")


def icu_one_hot(first_rows: DataFrame, col: str = "ICUType", categories=catalog.ICU_TYPES,
                prefix: str = "ICUType") -> DataFrame:
    """P11 + J2: one-hot of the record's first category, with a NaN column."""
    return first_rows.select("record_id", *one_hot(col, categories, prefix, dummy_na=True))


def descriptor_features(first_rows: DataFrame, biometrics: Sequence[str], category_col: str,
                        categories, prefix: str) -> DataFrame:
    """Biometrics + one-hot columns as long ``(record_id, feature, value)``."""
    oh = one_hot(category_col, categories, prefix, dummy_na=True)
    names = list(biometrics) + [f"{prefix}_{k}" for k in categories] + [f"{prefix}_nan"]
    wide = first_rows.select("record_id", *[F.col(b).cast("double").alias(b) for b in biometrics], *oh)
    kv = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names]))
    return wide.select("record_id", kv.alias("kv")).select("record_id", "kv.feature", "kv.value")


def feature_index(names: Sequence[str]) -> dict[str, int]:
    """P10: fixed feature order (ASCII sort) as an index."""
    return {n: i for i, n in enumerate(sorted(names))}


def to_matrix(long: DataFrame, names: Sequence[str], id_cols: Sequence[str] = ("record_id",)) -> DataFrame:
    """R2: long features -> one row per record, columns in sorted name order.

    ``pivot`` with declared values needs no extra job to discover them.
    """
    ordered = sorted(names)
    return long.groupBy(*id_cols).pivot("feature", ordered).agg(F.first("value"))


def to_vector(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """R2 (scalable): ``(record_id, features array<double>)`` in sorted name order.

    Per record the array has a fixed, catalogue-bounded length; missing
    features are NULL. Stays narrow for codegen until ML needs a vector.
    """
    idx = feature_index(names)
    n = len(idx)
    places = F.broadcast(local_frame(long.sparkSession, idx.items(), "feature string, _i int"))
    entries = F.array_sort(F.collect_list(F.struct("_i", "value")))
    grouped = long.join(places, "feature").groupBy("record_id").agg(entries.alias("_e"))
    # A record with every feature once is read in order; a lookup of each place costs n squared steps.
    whole = (F.size("_e") == n) & ~F.exists(F.transform("_e", lambda e, i: e["_i"] != i), lambda x: x)
    looked_up = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.map_from_entries("_e")[i])
    return grouped.select("record_id", F.when(whole, F.transform("_e", lambda e: e["value"])).otherwise(looked_up).alias("features"))


def to_sequences(vectors: DataFrame, labels: DataFrame, n_features: int) -> DataFrame:
    """``(N, F)`` -> ``(N, 1, F)`` joined to labels by id.

    The job fails at a vector of another width and at an id that only one side has; the checks
    are part of the one join, so building the plan runs no job.
    """
    wide = vectors.where(required(F.size("features") == n_features, f"a vector has not the {n_features} features declared"))
    both = wide.withColumn("_x", F.lit(1)).join(labels.withColumn("_y", F.lit(1)), "record_id", "full")
    text = F.concat(F.lit("vectors and labels do not pair up at record "), F.coalesce(F.col("record_id").cast("string"), F.lit("NULL")))
    return both.where(required(F.col("_x").isNotNull() & F.col("_y").isNotNull(), text)).select(
        "record_id", F.array(F.col("features").cast("array<float>")).alias("sequence"), "label"
    )


DESCRIPTOR_NAMES = ("Age", "Gender", "Height", "ICUType", "Weight")


def build_features(readings: DataFrame, records: DataFrame, vitals: Sequence[str],
                   split_col: str = "split", biometrics: Sequence[str] = catalog.BIOMETRICS,
                   category_col: str = "ICUType", categories=catalog.ICU_TYPES) -> DataFrame:
    """The whole feature table, long ``(record_id, split, feature, value)``.

    ``readings`` holds vitals and descriptors; ``records`` is ``(record_id,
    split)``. Vital features are imputed per split from that split's medians;
    biometrics are filled per split over time rows; the category is one-hot
    encoded from each record's first time row.
    """
    cells = clean_cells(readings).persist(StorageLevel.MEMORY_AND_DISK)  # vitals and descriptors
    vit = vital_features_from_cells(cells, records, vitals, split_col)
    names = [n for n in DESCRIPTOR_NAMES if n in set(biometrics) | {category_col}]
    rows = descriptor_rows(cells, names).join(records.select("record_id", split_col), "record_id", "inner")
    first = impute_biometrics(rows, records.select("record_id", split_col), group_cols=[split_col])
    desc = descriptor_features(first, biometrics, category_col, categories, category_col)
    desc = desc.join(records.select("record_id", split_col), "record_id", "inner")
    return vit.unionByName(desc)


def vital_features_from_cells(cells: DataFrame, records: DataFrame, vitals: Sequence[str], split_col: str) -> DataFrame:
    long = to_long(vital_aggregates(cells, records.select("record_id"), vitals))
    long = long.join(records.select("record_id", split_col), "record_id", "inner")
    return impute_median(long, [split_col, "feature"])


def pivot_readings(readings: DataFrame, parameters: Sequence[str], sentinel: float = catalog.SENTINEL) -> DataFrame:
    """R1 (wide form): one row per (record, time), one column per declared parameter.

    Duplicates are averaged, then the sentinel is masked. The declared list
    means no extra job to discover the columns. The pipeline itself stays long
    (:func:`clean_cells`); this is the per-record table for inspection/export.
    """
    r = readings.where(F.col("parameter").isNotNull())
    wide = r.groupBy("record_id", "t").pivot("parameter", list(parameters)).agg(F.avg("value"))
    return wide.select("record_id", "t", *[mask_sentinel(F.col(f"`{p}`"), sentinel).alias(p) for p in parameters])
