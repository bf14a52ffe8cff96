"""The challenge score (event 1: min(Se, PPV); event 2: Hosmer-Lemeshow H / range).

Rows are ordered by (risk, id) and cut into 10 equal groups (``ntile``
sizes). Ordering uses G1 on the distinct risks; only the few risk values
whose block straddles a group boundary are ranked by id, again with G1,
so neither a global sort nor one large tied block lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow import catalog
from wardflow.functions.scalar import required
from wardflow.operators.ranks import row_ranks, running_totals
from wardflow.session import cut
from wardflow.session import local_frame


def alignment_report(left: DataFrame, right: DataFrame, key: str = "record_id",
                     names=("matched", "only_left", "only_right")) -> DataFrame:
    """One row counting distinct ids on both sides and on one side only."""
    j = _sides(left, right, key)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    return j.agg(
        n((F.col("_l") > 0) & (F.col("_r") > 0)).alias(names[0]),
        n(F.col("_r") == 0).alias(names[1]),
        n(F.col("_l") == 0).alias(names[2]),
    )


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per id how many rows each side has: a counted union, combined before the one shuffle."""
    a = left.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = right.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    return a.unionByName(b).groupBy(key).agg(F.sum("_a").alias("_l"), F.sum("_b").alias("_r"))


def match_outcomes(pred: DataFrame, outcomes: DataFrame, strict: bool = True) -> DataFrame:
    """Predictions joined to outcomes by id. The job fails when an outcome id, or a (model, id) of the
    predictions, occurs twice; with ``strict`` also when an id has no partner on the other side.

    The checks are part of the one join: each side is shuffled by id once, and building the plan runs no
    job. A NULL id has no partner: an error when ``strict``, else such rows are left out. Without ``strict``
    an empty side gives an empty result, whatever the other side holds.
    """
    per = [c for c in ("record_id", "model") if c in pred.columns]  # in this order one sort serves the count and the join
    left, right = _once(pred, per, "prediction"), _once(outcomes, ["record_id"], "outcome")
    # A full join also where only pairs are wanted: an inner one stops reading a side whose partner has ended.
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), "record_id", "full")
    lacks = F.when(F.col("_l").isNull(), F.lit("prediction")).otherwise(F.lit("outcome"))
    text = F.concat(F.lit("record "), _shown("record_id"), F.lit(" lacks its "), lacks)
    if strict:
        paired = required(F.col("_l").isNotNull() & F.col("_r").isNotNull(), text)
    else:
        paired = F.coalesce("_l", F.lit(0)) + F.coalesce("_r", F.lit(0)) == 2  # of both sides, so the join stays a full one
    return both.where(paired).drop("_l", "_r")


def _shown(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit("NULL"))


def _once(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``rows``, dealt by record id; a key that occurs twice fails the job."""
    counted = rows.repartition("record_id").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    text = F.concat(F.lit(f"repeated {what}: "), F.concat_ws(" ", *(_shown(k) for k in keys)))
    return counted.where(required(F.col("_n") == 1, text)).drop("_n")


def event1(scored: DataFrame) -> DataFrame:
    """Se, PPV, min(Se, PPV). 0/0 gives NULL (the C scorer's NaN); a NULL Se or PPV
    picks PPV exactly as the C comparison does."""
    y, p = F.col("label"), F.col("pred")
    c = scored.groupBy("model").agg(
        F.sum(y * p).alias("tp"), F.sum(y * (1 - p)).alias("fn"), F.sum((1 - y) * p).alias("fp")
    )
    se = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    ppv = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    return c.select("model", se.alias("se"), ppv.alias("ppv")).withColumn(
        "event1", F.when(F.col("se") < F.col("ppv"), F.col("se")).otherwise(F.col("ppv"))
    )


def _group_of(rank, n, groups):
    """ntile group (0-based) of a 1-based rank among n rows."""
    q = F.floor(n / groups)
    r = n - q * groups
    big = r * (q + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (q + 1))).otherwise(
        r + F.floor((rank - 1 - big) / F.when(q == 0, F.lit(1)).otherwise(q))
    ).cast("int")


def _boundary(g, n, groups):
    """Last rank of group g (0-based)."""
    q = F.floor(n / groups)
    r = n - q * groups
    return (g + 1) * q + F.least(g + 1, r)


def risk_groups(scored: DataFrame, groups: int = catalog.RISK_GROUPS) -> DataFrame:
    """Per (model, decile): n, centroid, observed, expected."""
    base = scored.where(F.col("score").isNotNull())
    hist = base.groupBy("model", "score").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("label").cast("long").alias("pos")
    )
    rt = running_totals(hist, "score", ["cnt"], partition_cols=["model"]).select(
        "model", "score", "cnt", "pos", F.col("cum_cnt").alias("end"), F.col("total_cnt").alias("n")
    )
    start = F.col("end") - F.col("cnt")
    g_first = _group_of(start + 1, F.col("n"), groups)
    g_last = _group_of(F.col("end"), F.col("n"), groups)
    # Read by two branches, and the rows of the second one three times: each written once.
    rt = cut(rt.withColumn("g_first", g_first).withColumn("g_last", g_last), "risk-ranks")

    whole = rt.where(F.col("g_first") == F.col("g_last")).select(
        "model", F.col("g_first").alias("decile"), "cnt",
        (F.col("cnt") * F.col("score")).alias("risk"), "pos",
    )
    # Blocks of one risk value that cross a group boundary: at most groups-1 per model.
    split = rt.where(F.col("g_first") != F.col("g_last")).select(
        "model", "score", (F.col("end") - F.col("cnt")).alias("start"), F.col("n").alias("rows_total")
    )
    rows = cut(base.join(F.broadcast(split), ["model", "score"], "inner"), "risk-boundaries")
    ranked = row_ranks(rows, "record_id", partition_cols=["model", "score"])
    parts = ranked.select(
        "model", _group_of(F.col("start") + F.col("rank"), F.col("rows_total"), groups).alias("decile"),
        F.lit(1).cast("long").alias("cnt"), F.col("score").alias("risk"), F.col("label").cast("long").alias("pos"),
    )
    allp = whole.unionByName(parts)
    out = allp.groupBy("model", "decile").agg(
        F.sum("cnt").alias("n"), F.sum("risk").alias("risk"), F.sum("pos").alias("observed")
    )
    return out.select(
        "model", (F.col("decile") + 1).alias("decile"), "n",
        (F.col("risk") / F.col("n")).alias("centroid"),
        F.col("observed").cast("double").alias("observed"),
        F.col("risk").alias("expected"),
    )


def event2(deciles: DataFrame, groups: int = catalog.RISK_GROUPS) -> DataFrame:
    """Sum over groups of (obs - exp)^2 / (M (c (1 - c) + 0.001)), divided by c_last - c_first."""
    c = F.col("centroid")
    term = F.pow(F.col("observed") - F.col("expected"), 2) / (F.col("n") * (c * (1 - c) + F.lit(catalog.HL_EPSILON)))
    return deciles.groupBy("model").agg(
        F.sum(term).alias("h"),
        F.max_by("centroid", "decile").alias("c_last"),
        F.min_by("centroid", "decile").alias("c_first"),
    ).select("model", "h", F.try_divide(F.col("h"), F.col("c_last") - F.col("c_first")).alias("event2"))


def challenge_scores(scored: DataFrame) -> DataFrame:
    """E12 + E14 per model: (model, event1, event2)."""
    e1 = event1(scored).select("model", "event1")
    e2 = event2(risk_groups(scored)).select("model", "event2")
    return e1.join(e2, "model", "full_outer")


def comparison_table(scores: DataFrame) -> DataFrame:
    """Own scores plus the published rows (model, event1, event2)."""
    spark = scores.sparkSession
    pub = local_frame(spark, list(catalog.PUBLISHED_SCORES), "model string, event1 double, event2 double")
    return scores.select("model", "event1", "event2").unionByName(pub)
