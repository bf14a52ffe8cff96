"""The registered queries of this subpackage: ``opN_<name>`` over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import alignment, chat, clustering, decontaminate, jaccard, language, lm, packing, private, quality, sharding, simhash, toxicity
from wardflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard (0 to 23, near equal bytes) and its gapless slot there."""
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


@register
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-duplicate component."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and the quality verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.verdicts(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal-data counts, base digest and all spans."""
    return private.report(table(spark, sf_dir, "documents"))


@register
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair where the item occurs within its error budget."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language and score."""
    return language.identify(table(spark, sf_dir, "documents"))


@register
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a 2048-token sequence."""
    index, _ = packing.pack(table(spark, sf_dir, "documents"))
    return index


#: A conversation whose texts hold control strings, added to the table by the contract.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@register
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted as ids and read back: turn and loss digests."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in PLANTED) + " AS t(conv_id, turn, role, text)")
    return chat.digest(chat.format_chat(turns.unionByName(planted)))


@register
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and its log10 probability under the hierarchical Pitman-Yor model."""
    return lm.score(table(spark, sf_dir, "documents"))


@register
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds, with distances, inertia and its centroid's digest."""
    return clustering.report(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """The centroids after round ``k`` (table c{k}: cluster, d, x) from those before."""
    return f"""
a{k} AS (SELECT vec_id, rn, arg_min(cluster, (dist, cluster)) AS cluster, min(dist) AS distance
  FROM (SELECT q.vec_id, q.rn, c.cluster, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS dist FROM q JOIN c{k} c ON q.d = c.d GROUP BY ALL) GROUP BY ALL)"""


def _means(k: int) -> str:
    return f"""
m{k} AS (SELECT a.cluster, q.d, sum(q.x)::BIGINT AS s, count(*) AS n FROM a{k} a JOIN q ON a.rn = q.rn GROUP BY ALL),
c{k + 1} AS (SELECT c.cluster, c.d, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM c{k} c LEFT JOIN m{k} m ON m.cluster = c.cluster AND m.d = c.d)"""


ORACLES["op11_centroids"] = f"""
WITH e AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, [floor(64 * y::DOUBLE)::BIGINT FOR y IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
q AS MATERIALIZED (SELECT vec_id, rn, unnest(range(64)) AS d, unnest(v) AS x FROM e),
h AS (SELECT rn, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS cluster FROM e),
c0 AS (SELECT h.cluster, q.d, q.x FROM h JOIN q ON h.rn = q.rn WHERE h.cluster < 16),
{_round(0)}, {_means(0)}, {_round(1)}, {_means(1)}, {_round(2)}, {_means(2)}, {_round(3)},
g AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY cluster),
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, i.cluster_inertia, (SELECT sum(distance)::BIGINT FROM a3) AS inertia, g.centroid_sha256
FROM a3 a JOIN i ON a.cluster = i.cluster JOIN g ON a.cluster = g.cluster
"""


@register
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of fingerprints within three bits."""
    return simhash.detect(table(spark, sf_dir, "documents"))


@register
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between two tokenizers, with the corpus-wide counts of its linked ids."""
    return alignment.report(table(spark, sf_dir, "documents"))
