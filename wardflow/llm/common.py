"""Shared helpers: tables, the shared folder, Arrow batch bounds, word splitting and hashing."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.session import release, scratch_path  # noqa: F401  release: for the operators

#: Rows and bytes of one Arrow batch, so that a batch of very long texts fits a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: Word boundaries of every word-based operator: space, tab, LF, VT, FF, CR.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes for the Python stages of this session, and let Python
    workers import this package from where the driver found it (a cluster ships it with --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def write_shared(df: DataFrame, name: str) -> str:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and return its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs start from the files."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(write_shared(df, name))


def crc_mod(col: Column | str, mod: int) -> Column:
    """``crc32(id as text) mod m``, the rule that fixes held-out rows (a null id counts as empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split has this very set)."""
    return text.encode().lower().split() if text else []


class WordHash(dict):
    """word -> 64-bit xxh3, remembered for frequent words; emptied when it holds too many."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), elementwise on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of each run of ``width`` words (one of all words if fewer; none if none)."""
    n = len(h)
    if n == 0:
        return h
    width = min(width, n)
    acc = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i]
    return mix(acc + np.uint64(width))


def batches(it: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Arrow batches as dicts of Python lists."""
    for b in it:
        if b.num_rows:
            yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}


def signed(a: np.ndarray) -> np.ndarray:
    """uint64 hashes as the long that Spark holds (same bits)."""
    return a.astype(np.uint64).view(np.int64)


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
