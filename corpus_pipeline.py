"""A text corpus from raw documents to packed sequences: five stages, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but
the last return the columns of ``docs``. No SQL expresses the stages (trained ratios, similarity
components, edit distance, token ids), so ``ORACLE_SQL`` is None and the tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import decontaminate, jaccard, packing, private, quality
from wardflow.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the log-likelihood ratio keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    return jaccard.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data and disclosing terms masked in their texts (and their lengths set anew)."""
    rows = private.sanitise(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in rows.columns else rows


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, each with its place in a sequence."""
    index, _ = packing.pack(docs)
    return index


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
