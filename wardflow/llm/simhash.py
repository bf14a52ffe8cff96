"""SimHash near-dedup (operator 12): covering locality-sensitive hashing of 64-bit fingerprints.

A fingerprint holds, bit by bit, the majority of the XXH64 hashes of a text's word shingles. Equal
fingerprints are one node. Two nodes link when they differ in at most ``radius`` bits; links are
found by tables of bit masks that cannot miss one:

* Every bit position gets a non-zero vector of ``radius + 1`` bits. Table ``v`` (non-zero, too) keeps the
  positions whose vector has an odd product with ``v``. Any ``radius`` positions leave some ``v`` with even
  products with all of them, so a pair that differs only there agrees in table ``v``: 15 tables for
  radius 3, each keeping about half of the bits.
* A bucket (table and kept bits) of at most ``TILE`` nodes is compared in one task. A larger one is first
  compared in parts, its links are contracted, and only if it still holds several components do its
  nodes go down a level: the positions that its table does not keep are covered by 15 tables in the
  same way. After three levels at most 9 positions are free, so no bucket has more than 512 nodes,
  whatever the data. Nothing is capped, and what a bucket gives is a star per component, never all pairs.

Masks are constants (15, 225 and 3,375 of them) and the one thing that is broadcast.

Defined cases: texts that are null or have no words have fingerprint zero and link like others; fewer
words than a shingle make one shingle of all; repeated rows share a node; a component's id is the
least id in it that is not null (null where all are); an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import cut, small_batches, words_of
from wardflow.llm.components import components
from wardflow.session import local_frame

BITS, WIDTH, SEED, RADIUS = 64, 3, 42, 3
LEVELS, TILE, BLOCK = 3, 1024, 1 << 15


def shingles(text: str | None, width: int = WIDTH) -> list[bytes]:
    """The space-joined runs of ``width`` words, repeats included (one of all words if fewer; none if none)."""
    words = words_of(text)
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [line[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half the shingle hashes (unsigned)."""
    parts = shingles(text, width)
    if not parts:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(parts), BLOCK):
        some = parts[at : at + BLOCK]
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in some), "<u8", len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every row."""

    def run(it):
        for b in it:
            fp = np.fromiter((fingerprint(t, width, seed) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def covering(positions: list[int], radius: int = RADIUS) -> list[list[int]]:
    """Positions that each table keeps: for any ``radius`` of them, some table keeps none of those."""
    side = 1 << (radius + 1)
    vector = {p: 1 + i % (side - 1) for i, p in enumerate(positions)}
    return [[p for p in positions if (vector[p] & v).bit_count() % 2] for v in range(1, side)]


def masks(level: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """``(parent table, table, mask)`` of a level; a mask holds its parent's bits too."""
    out = [(0, 0, 0)]
    for _ in range(level):
        above, out = out, []
        for _, t, mask in above:
            free = [p for p in range(BITS) if not mask >> p & 1]
            for i, kept in enumerate(covering(free, radius)):
                out.append((t, t * ((2 << radius) - 1) + i, mask | sum(1 << p for p in kept)))
    return out


def stars(table: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one node of a component, another) that join what links within each run of (table, key)."""
    edge = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
    a, b = [], []
    two = first[last - first == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
    a.append(fp[two[near]])
    b.append(fp[two[near] + 1])
    for lo, hi in zip(*(x[last - first > 2].tolist() for x in (first, last))):
        left = fp[lo:hi]
        while len(left) > 1:  # grow the component of the first node, take it away, go on
            inside = np.zeros(len(left), bool)
            todo = [0]
            inside[0] = True
            while todo:
                hit = ~inside & (np.bitwise_count(left ^ left[todo.pop()]) <= radius)
                inside |= hit
                todo += np.flatnonzero(hit).tolist()
            grown = left[inside][1:]
            a.append(np.full(len(grown), left[0]))
            b.append(grown)
            left = left[~inside]
    return np.concatenate(a), np.concatenate(b)


def _compare(buckets: DataFrame, radius: int) -> DataFrame:
    """``a, b``: joins of what links inside each bucket part (t, key, part); parts are of bounded size."""

    def run(it):
        rest = None
        for batch in it:
            now = [batch.column(c).to_numpy() for c in range(4)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            t, key, part, fp = now
            # The last run may go on in the next batch.
            end = np.flatnonzero((t != t[-1]) | (key != key[-1]) | (part != part[-1]))
            stop = int(end[-1]) + 1 if len(end) else 0
            rest = [x[stop:] for x in now]
            if stop:
                yield found(*(x[:stop] for x in now))
        if rest is not None:
            yield found(*rest)

    def found(t, key, part, fp):
        a, b = stars(t.astype(np.int64) << 32 | part, key, fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    dealt = buckets.select("t", "key", "part", "fp").repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _level(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """``t, key, fp, k`` (bucket size) of the rows (t, fp) in each table below theirs, where a bucket has several."""
    table = local_frame(rows.sparkSession, [(p, t, m - (1 << 64) if m >> 63 else m) for p, t, m in masks(level, radius)], "t int, next int, mask long")
    put = rows.join(F.broadcast(table), "t").select(F.col("next").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), *(c for c in rows.columns if c != "t"))
    per = put.groupBy("t", "key").agg(F.count("*").alias("k"), *([F.min("comp").alias("lo"), F.max("comp").alias("hi")] if "comp" in rows.columns else []))
    some = per.where("k > 1") if level == 1 else per.where("lo <> hi")
    return put.join(some.select("t", "key", "k"), ["t", "key"])


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b`` over distinct fingerprints (fp): pairs whose components are those of all links."""
    rows = cut(_level(nodes.select(F.lit(0).alias("t"), "fp"), 1, radius), "simhash-buckets")
    parts = F.when(F.col("k") <= tile, 0).otherwise(F.pmod(F.xxhash64("fp"), F.ceil(F.col("k") / tile).cast("long"))).cast("long")
    found = cut(_compare(rows.withColumn("part", parts), radius), "simhash-links")
    large = rows.where(F.col("k") > tile).select("t", "key", "fp")
    for level in range(2, LEVELS + 1):
        if large.isEmpty():
            break
        comp = cut(components(found), "simhash-comp")
        known = large.join(comp, F.col("fp") == F.col("node"), "left").select("t", "key", "fp", F.coalesce("comp", "fp").alias("comp"))
        mixed = known.groupBy("t", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("t", "key")
        rows = cut(_level(known.join(mixed, ["t", "key"]).select("t", F.col("key").alias("above"), "fp", "comp"), level, radius), "simhash-buckets")
        last = level == LEVELS
        more = _compare(rows.where(F.lit(last) | (F.col("k") <= tile)).withColumn("part", F.lit(0).cast("long")), radius)
        found = cut(found.unionByName(more), "simhash-links")
        large = rows.where(F.lit(not last) & (F.col("k") > tile)).select("t", "key", "fp")
    return found


def detect(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = cut(fingerprints(docs, width, seed), "simhash-rows")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("d")), "simhash-nodes")
    comp = components(links(nodes, radius, tile))
    named = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "d", F.coalesce("comp", "fp").alias("comp"))
    named = cut(named, "simhash-named")
    ids = named.join(named.groupBy("comp").agg(F.min("d").alias("component_id")), "comp").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(ids, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
