"""Quality rules (operator 3): hashed n-gram log-likelihood ratio, on built-in functions only.

Every text is a bag of hashed words and word pairs. Two multinomials over the same ``DIMS`` buckets
are counted: one from trusted rows, one from all rows of the corpus. A text's score is the sum of
its n-grams' log ratios (trusted over corpus) divided by their number. Ratios are rounded to
millionths and summed as integers, so the verdict does not depend on the order of summation.
Before that a base rule rejects texts that are too short or repeat themselves.

The corpus counts cover all rows. The trusted counts come from at most ``TRUSTED`` rows of the
label table (those of least id hash), whose ids are broadcast; a label table without trusted rows
leaves the base rule alone to decide. The table of ratios has DIMS entries whatever the input.

Defined cases: null text has no words and fails the base rule; repeated rows count as often as they
occur and get equal verdicts; a row with a null id is never trusted; several labels of one id count as trusted if any is; an empty
table gives no rows; further columns stay as they are in :func:`keep` and are ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import WORD_SPACE

DIMS, TRUSTED, UNIT, SMOOTH = 1 << 16, 20_000, 1_000_000, 8.0
#: Least mean log ratio of a kept text.
THRESHOLD = -0.15
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), "")


def hashes(ws: Column) -> Column:
    """A 64-bit hash per word; n-grams and windows are made of these, so a word is hashed once."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def _pairs(hs: Column) -> Column:
    """Bucket of each word with its neighbour (the last word pairs with nothing)."""
    return F.zip_with(hs, F.slice(hs, 2, F.greatest(F.size(hs), F.lit(1))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(DIMS)).cast("int"))


def grams(hs: Column) -> Column:
    """Buckets of the words (given by their hashes), then of the pairs of neighbours."""
    return F.concat(F.transform(hs, lambda h: F.pmod(h, F.lit(DIMS)).cast("int")), _pairs(hs))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) plus ``ws``, ``hs`` (the words' hashes) and the base counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("ws", words(F.col("text"))).withColumn("hs", hashes(F.col("ws")))
    out = out.withColumns({
        "n_words": F.size("ws").cast("long"),
        "word_chars": F.length(F.concat_ws("", "ws")).cast("long"),
        "n_symbols": (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long"),
        "lines_": lines,
        "windows_": F.when(F.size("ws") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("ws") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hs", i, WINDOW)))).otherwise(F.array().cast("array<long>")),
    })
    out = out.withColumns({
        "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        # windows in order of (hash, place), only where some hash occurs twice
        "sorted_": F.when(F.size(F.array_distinct("windows_")) < F.size("windows_"), F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop("lines_", "windows_")
    twice = F.expr("filter(sorted_, (x, j) -> (j > 0 and get(sorted_, j - 1).h = x.h) or (j < size(sorted_) - 1 and get(sorted_, j + 1).h = x.h))")
    out = out.withColumn("places_", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("sorted_")
    covered = F.aggregate(F.zip_with("places_", F.slice("places_", 2, F.greatest(F.size("places_"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places_")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def log_ratios(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> list[int] | None:
    """Per bucket: round(UNIT * log((t + SMOOTH) / (e + SMOOTH))) with t the trusted count and e the count
    that the corpus share would give, so a bucket speaks up only with evidence; None if none is trusted."""
    spark = docs.sparkSession
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).withColumn("trusted", F.lit(1))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    each = marked.select(F.coalesce("trusted", F.lit(0)).alias("t"), hashes(words(F.col("text"))).alias("hs")).select("t", F.explode(grams(F.col("hs"))).alias("k"))
    counts = each.groupBy("k").agg(F.sum("t").alias("t"), F.count("*").alias("c"))
    full = spark.range(DIMS).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").select("k", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("c", F.lit(0)).alias("c"))
    rows = sorted((r["k"], r["t"], r["c"]) for r in full.collect())
    t_all, c_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not t_all:
        return None
    return [round(UNIT * math.log((t + SMOOTH) / (c * t_all / c_all + SMOOTH))) for _, t, c in rows]


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """``docs`` plus the base counts, ``base_failed``, ``score`` (mean log ratio, null without words) and ``kept``."""
    ratios = log_ratios(docs, labels, trusted)
    out = measures(docs)
    if ratios is None:
        total = F.lit(None).cast("long")
    else:
        table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # folded to one constant
        one = F.aggregate("hs", F.lit(0).cast("long"), lambda s, h: s + F.get(table, F.pmod(h, F.lit(DIMS)).cast("int")))
        total = F.aggregate(_pairs(F.col("hs")), one, lambda s, k: s + F.get(table, k))
    out = out.withColumn("total_", total).withColumn("n_grams_", 2 * F.col("n_words"))
    good = F.coalesce(F.col("total_") >= F.round(F.lit(threshold * UNIT)).cast("long") * F.col("n_grams_"), F.lit(True))
    out = out.withColumns({"score": F.when(F.col("n_grams_") > 0, F.col("total_") / F.col("n_grams_") / UNIT), "kept": ~F.col("base_failed") & good})
    return out.drop("ws", "hs", "total_", "n_grams_")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """The kept rows of ``docs``, with its columns.

    The row number in the condition keeps the optimizer from moving the filter below the columns it
    reads, which would copy their expressions into it many times over.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own_")
    rows = verdicts(docs.select("doc_id", "text", own), labels, threshold, trusted).withColumn("row_", F.monotonically_increasing_id())
    return rows.where(F.col("kept") & (F.col("row_") >= 0)).select("own_.*")
