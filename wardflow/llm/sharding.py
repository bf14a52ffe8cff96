"""Sharding (operator 1): histogram sort into shards of near equal bytes.

Rows are ordered by (hash of the text, id), so that equal texts lie side by side. Rounds of exact
counting find the boundaries: every partition counts bytes and rows between candidate keys, the
counts are summed, and the candidates around each wanted boundary close in until its bytes meet
the tolerance. Then the rows move once. A shard is made of several buckets, each with a boundary
of its own, so no task holds a whole shard; the counted rows below a bucket give its first slot.

Driver state: the candidate boundaries, at most ``shards * max_per_shard`` buckets times ``probes``.

Defined cases: null text has size 8 and crc 0; a null id sorts first; repeated rows (same id and
text) share a key, are interchangeable, and lie on one side of a boundary, so a boundary can miss its tolerance by
such a block only; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm.common import cut, small_batches

SHARDS, TOLERANCE, PROBES = 24, 0.001, 15
BUCKET_BYTES, MAX_PER_SHARD = 16 << 20, 4096
LOW = -(1 << 63)


def _packed(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(h, d) as 16 big-endian bytes whose byte order is the order of the signed pairs."""
    out = np.empty((len(h), 2), ">u8")
    flip = np.uint64(1 << 63)
    out[:, 0] = h.view(np.uint64) ^ flip
    out[:, 1] = d.view(np.uint64) ^ flip
    return out.view("S16").ravel()


class Keys:
    """Keys (h, d) as integers ``(h + 2**63) * span + (d - least d)``, dense in d, and back."""

    def __init__(self, d_min: int, d_max: int):
        self.d_min, self.span = d_min, d_max - d_min + 1
        self.end = (1 << 64) * self.span

    def packed(self, keys: list[int]) -> np.ndarray:
        hs = [k // self.span + LOW for k in keys]
        ds = [k % self.span + self.d_min for k in keys]
        return _packed(np.array(hs, np.int64), np.array(ds, np.int64))


def histogram(slim: DataFrame, edges: np.ndarray) -> list[tuple[int, int]]:
    """Exact (bytes, rows) strictly below each edge, over all partitions."""

    def run(it):
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in it:
            h, d, s = (b.column(i).to_numpy() for i in range(3))
            at = np.searchsorted(edges, _packed(h, d), "right")
            np.add.at(size, at, s)
            np.add.at(rows, at, 1)
        i = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(size[i]), pa.array(rows[i])], names=["i", "size", "n"])

    got = slim.select("h", "d", "size").mapInArrow(run, "i long, size long, n long").groupBy("i").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    size, rows = [0] * (len(edges) + 1), [0] * (len(edges) + 1)
    for r in got.collect():
        size[r["i"]], rows[r["i"]] = r["size"], r["n"]
    return list(zip(np.cumsum(size).tolist(), np.cumsum(rows).tolist()))[: len(edges)]


def find_splitters(slim: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES, bucket_bytes: int = BUCKET_BYTES, max_per_shard: int = MAX_PER_SHARD):
    """``(keys, per_shard, [(key, bytes below, rows below)])``, one entry per bucket after the first."""
    t = slim.agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    total, n = t["size"] or 0, t["n"]
    keys = Keys(t["lo"] or 0, t["hi"] or 0)
    per_shard = max(1, min(max_per_shard, -(-total // (shards * bucket_bytes))))
    buckets = shards * per_shard
    wanted = [j * total / buckets for j in range(1, buckets)]
    slack = [(tolerance if j % per_shard == 0 else 0.1 / per_shard) * total / shards for j in range(1, buckets)]
    below = {0: (0, 0), keys.end: (total, n)}
    while True:
        ks = sorted(below)
        bs = [below[k][0] for k in ks]
        tries: set[int] = set()
        for want, s in zip(wanted, slack):
            hi = min(bisect.bisect_left(bs, want), len(ks) - 1)
            lo = max(hi - 1, 0)
            if min(abs(bs[hi] - want), abs(bs[lo] - want)) > s and ks[hi] - ks[lo] > 1:
                gap = ks[hi] - ks[lo]
                tries.update(ks[lo] + gap * p // (probes + 1) for p in range(1, probes + 1))
        tries -= below.keys()
        if not tries:
            break
        edges = sorted(tries)
        below.update(zip(edges, histogram(slim, keys.packed(edges))))
    ks = sorted(below)
    bs = [below[k][0] for k in ks]
    chosen = []
    for want in wanted:
        i = min(bisect.bisect_left(bs, want), len(ks) - 1)
        i = i - 1 if i and want - bs[i - 1] <= bs[i] - want else i
        chosen.append((ks[i], *below[ks[i]]))
    return keys, per_shard, chosen


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, text, size, law, shard, slot, grown_shard``: all rows, moved once."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select("doc_id", "text").withColumns({
        "h": F.xxhash64("text"),
        "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)),
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8,
    })
    slim = cut(keyed.select("h", "d", "size"), "shard-keys")
    keys, per_shard, chosen = find_splitters(slim, shards, tolerance, bucket_bytes=bucket_bytes)
    inner = [(k, n, j + 1) for j, (k, _, n) in enumerate(chosen) if k < keys.end]
    edges = keys.packed([k for k, _, _ in inner])
    bucket_of = np.array([0] + [j for _, _, j in inner], np.int64)
    first_row = [0] + [n for _, _, n in chosen]
    shard_row = np.array([first_row[j - j % per_shard] for j in range(len(first_row))], np.int64)
    first = np.array(first_row, np.int64) - shard_row

    @F.pandas_udf("struct<bucket long, shard int, first long>")
    def place(h, d):
        import pandas as pd

        b = bucket_of[np.searchsorted(edges, _packed(h.to_numpy(), d.to_numpy()), "right")]
        return pd.DataFrame({"bucket": b, "shard": (b // per_shard).astype(np.int32), "first": first[b]})

    rows = keyed.withColumn("at", place("h", "d")).select("*", F.col("at.bucket").alias("bucket"), F.col("at.shard").alias("shard"), F.col("at.first").alias("first"))
    w = Window.partitionBy("bucket").orderBy("h", "d")
    return rows.withColumn("slot", F.col("first") + F.row_number().over(w) - 1).select(
        "doc_id", "text", "size", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
