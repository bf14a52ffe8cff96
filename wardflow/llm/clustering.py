"""Centroid clustering (operator 11): exact k-means on integers through subvector dictionaries.

Vectors become integers ``floor(scale * x)``. They are stored in chunks, and each chunk is
dictionary-encoded without loss: its dimensions are cut into blocks of ``width``, every block has a
dictionary of the distinct subvectors that occur there, and a vector is one code per block. In a
round, the distances of each dictionary's subvectors to the centroids are computed once, and a
vector's distance is the sum of its codes' entries. All of it is integer arithmetic, so results do
not depend on how rows are dealt.

A dictionary belongs to its chunk (at most ``CHUNK`` vectors), as in a column file: it can be no
larger than the chunk, and a round moves no vectors. Rounds exchange sums alone: one row per
centroid and task, added up in Spark as decimals. The driver holds ``k`` centroids.

Defined cases: vectors of another length, null vectors, and vectors with a null, infinite or NaN
component are left out; a null id counts as the empty text in the hash that picks first centroids;
rows of equal hash are ordered by their integers; repeated rows each count; with fewer than ``k``
vectors there are as many centroids as vectors; an empty table gives no rows; further columns are
ignored. Integers beyond ``LARGEST`` (their squared distances may pass 64 bits) raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import cut, small_batches
from wardflow.session import local_frame

DIMS, K, ROUNDS, SEED, SCALE, WIDTH = 64, 16, 3, 1, 64, 2
CHUNK = 16384
LARGEST = 1 << 26


def vectors(rows: DataFrame, vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, q`` (integers) of the vectors that are kept."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = rows.where(F.col(vector).isNotNull()).where((F.size(vector) == dims) & ~bad)
    whole = F.transform(x, lambda v: F.floor(v * scale))
    too_large = F.exists(x, lambda v: F.abs(v * scale) >= LARGEST)
    whole = F.when(too_large, F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}")).cast("array<bigint>")).otherwise(whole)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` kept vectors of least hash, in that order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    least = kept.select(F.sha2(text.cast("binary"), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in least], np.int64)


def encode(q: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Dictionaries (one array of distinct subvectors per block) and codes (rows x blocks)."""
    words, codes = [], []
    for at in range(0, q.shape[1], width):
        part = np.ascontiguousarray(q[:, at : at + width])
        _, first, code = np.unique(part.view(f"V{8 * part.shape[1]}").ravel(), return_index=True, return_inverse=True)
        words.append(part[first])
        codes.append(code.ravel())
    return words, np.stack(codes, 1)


def chunks(kept: DataFrame, dims: int = DIMS, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """``vec_ids, sizes, words, codes``: one row per chunk, its dictionaries and its codes."""
    def row(ids, q):
        words, codes = encode(q, width)
        kind = "<u2" if max(map(len, words)) <= 1 << 16 else "<u4"
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(w) for w in words]], pa.list_(pa.int32())), pa.array([b"".join(w.astype("<i4").tobytes() for w in words)], pa.binary()), pa.array([codes.astype(kind).tobytes()], pa.binary())],
            names=["vec_ids", "sizes", "words", "codes"],
        )

    def run(it):
        ids, parts, n = [], [], 0
        for b in it:
            q = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            for at in range(0, len(q), chunk):
                ids += b.column(0).slice(at, chunk).to_pylist()
                parts.append(q[at : at + chunk])
                n += len(parts[-1])
                if n >= chunk:
                    yield row(ids, np.concatenate(parts))
                    ids, parts, n = [], [], 0
        if n:
            yield row(ids, np.concatenate(parts))

    return kept.mapInArrow(run, "vec_ids array<long>, sizes array<int>, words binary, codes binary")


def nearest(sizes: list[int], words: bytes, codes: bytes, centroids: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Dictionaries, codes, and each vector's centroid (the least number on ties) and squared distance."""
    dims, spots = centroids.shape[1], len(sizes)
    kind = "<u2" if max(sizes) <= 1 << 16 else "<u4"
    code = np.frombuffer(codes, kind).reshape(-1, spots)
    flat, at, dictionary = np.frombuffer(words, "<i4").astype(np.int64), 0, []
    total = np.zeros((len(code), len(centroids)), np.int64)
    for s, size in enumerate(sizes):
        w = min(width, dims - s * width)
        sub = flat[at : at + size * w].reshape(size, w)
        at += size * w
        apart = sub[:, None, :] - centroids[None, :, s * width : s * width + w]
        total += (apart * apart).sum(2)[code[:, s]]
        dictionary.append(sub)
    best = total.argmin(1)
    return dictionary, code, best, total[np.arange(len(total)), best]


def sums(stored: DataFrame, centroids: np.ndarray, width: int) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty centroid: how many vectors are nearest to it, and their exact componentwise sums."""

    def run(it):
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object)
        for b in it:
            for sizes, words, codes in zip(*(b.column(c).to_pylist() for c in range(3))):
                dictionary, code, best, _ = nearest(sizes, words, codes, centroids, width)
                for c in np.unique(best):
                    at = best == c
                    n[c] += int(at.sum())
                    for s, sub in enumerate(dictionary):  # sums by code: a subvector times how often it occurs
                        times = np.bincount(code[at, s], minlength=len(sub))
                        total[c, s * width : s * width + sub.shape[1]] += (sub * times[:, None]).sum(0).astype(object)
        used = [int(c) for c in np.flatnonzero(n)]
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([int(n[c]) for c in used], pa.int64()), pa.array([[int(x) for x in total[c]] for c in used], pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    per_task = stored.select("sizes", "words", "codes").mapInArrow(run, "cluster int, n long, total array<long>")
    spread = per_task.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at")
    rows = spread.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["at"])):
        out.setdefault(r["cluster"], (int(r["n"]), []))[1].append(int(r["x"]))
    return out


def assign(stored: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """``vec_id, cluster, distance`` of every stored vector."""

    def run(it):
        for b in it:
            for ids, sizes, words, codes in zip(*(b.column(c).to_pylist() for c in range(4))):
                _, _, best, apart = nearest(sizes, words, codes, centroids, width)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best.astype(np.int32)), pa.array(apart)], names=["vec_id", "cluster", "distance"])

    return stored.select("vec_ids", "sizes", "words", "codes").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, vector: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, width: int = WIDTH, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of every kept vector after ``rounds`` rounds, and the final centroids."""
    spark = rows.sparkSession
    small_batches(spark)
    kept = vectors(rows, vector, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return local_frame(spark, [], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    stored = cut(chunks(kept, dims, width, chunk), "cluster-chunks")
    for _ in range(rounds):
        fresh = centroids.copy()
        for c, (n, total) in sums(stored, centroids, width).items():
            fresh[c] = [x // n for x in total]
        centroids = fresh
    return cut(assign(stored, centroids, width), "cluster-assigned"), centroids


def report(rows: DataFrame, **how) -> DataFrame:
    """Every kept vector's cluster with its distance, its cluster's and the whole inertia, and its centroid's digest."""
    found, centroids = cluster(rows, **how)
    spent = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["cluster"]: int(r["s"]) for r in spent}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = local_frame(rows.sparkSession, [(c, s, sum(by.values()), digest[c]) for c, s in sorted(by.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
