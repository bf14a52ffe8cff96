"""Benchmark decontamination (operator 6): pigeonhole edit matching.

Texts and test items become word sequences (``\\w+``, lower case). An item of m words may occur with
up to ``e = floor(rate * m)`` word edits (insert, delete, replace). It is split into e + 1 pieces, of
which at least one must occur unchanged, so exact piece hits (hashed runs of words, looked up in a
table of all pieces) give every candidate place; Myers' bit-parallel distance then decides each.

The document side is one pass without a shuffle; items travel to the tasks in blocks of at most
``BLOCK_BYTES`` of text, one pass per block, so what is broadcast is bounded.

Defined cases: an item without words (null or empty text included) matches nothing; null or empty
documents match nothing; several places of one item in a document give one row with the least
distance (ties: the first end); repeated documents or items each give their rows; an empty table on
either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import WordHash, shingle_hashes, small_batches

RATE, BLOCK_BYTES = 0.15, 8 << 20
_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, distance long, item_words long, end_word long"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def budget(n_words: int, rate: float = RATE) -> int:
    return int(rate * n_words)


def pieces(n_words: int, errors: int) -> list[tuple[int, int]]:
    """(start, length) of errors + 1 pieces that cover the item, of near equal length."""
    cuts = [i * n_words // (errors + 1) for i in range(errors + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[int], text: list[int], at_most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any run of ``text`` and the first end of such a run."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= at_most else None


class Index:
    """Pieces of a block of items by length and hash, behind a small bit table."""

    def __init__(self, items: list[tuple[int, list[int]]], rate: float):
        self.items = items
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, ws) in enumerate(items):
            h = np.array(ws, np.uint64)
            for start, length in pieces(len(ws), budget(len(ws), rate)):
                found[length].append((int(shingle_hashes(h[start : start + length], length)[0]), k, start))
        self.tables = {}
        for length, rows in found.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[hashes & np.uint64((1 << 20) - 1)] = True
            self.tables[length] = (hashes, rows, seen)

    def hits(self, h: np.ndarray):
        """(position, item, piece start) of every exact piece hit in the words ``h``."""
        for length, (hashes, rows, seen) in self.tables.items():
            if len(h) < length:
                continue
            g = shingle_hashes(h, length)
            for p in np.flatnonzero(seen[g & np.uint64((1 << 20) - 1)]):
                lo, hi = np.searchsorted(hashes, g[p], "left"), np.searchsorted(hashes, g[p], "right")
                for r in rows[lo:hi]:
                    yield int(p), r[1], r[2]


class Finder:
    """Looks for a block of items in batches of texts."""

    def __init__(self, block: list[tuple[int, str]], rate: float):
        self.hashed, self.rate = WordHash(), rate
        items = [(i, self.words(t).tolist()) for i, t in block]
        self.index = Index([x for x in items if x[1]], rate)

    def words(self, text: str | None) -> np.ndarray:
        return self.hashed.of([w.encode("utf-8", "replace") for w in words(text)])

    def rows(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item id, distance, words of the item, end word)`` of every match."""
        each = [self.words(t) for t in texts]
        if not each:
            return []
        ends, flat = np.cumsum([len(x) for x in each]), np.concatenate(each)
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p, k, start in self.index.hits(flat):
            doc = int(np.searchsorted(ends, p, "right"))
            places[doc, k].add(p - start - int(ends[doc] - len(each[doc])))
        out = []
        for (doc, k), starts in sorted(places.items()):
            item_id, ws = self.index.items[k]
            e, text, best = budget(len(ws), self.rate), each[doc].tolist(), None
            spans: list[list[int]] = []  # overlapping windows of one item are read once
            for s in sorted(starts):
                lo, hi = max(s - e, 0), min(s + len(ws) + e, len(text))
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                got = myers(ws, text[lo:hi], e)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], got[1] + lo)
            if best:
                out.append((doc, item_id, best[0], len(ws), best[1]))
        return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in lists of about ``block_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("b")).first()["b"] or 0
    n = max(1, -(-size // block_bytes))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield [(r["item_id"], r["text"]) for r in part]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per (document, item) where the item occurs within its budget of word edits."""
    spark = docs.sparkSession
    small_batches(spark)

    def search(block):
        def run(it):
            finder = Finder(block, rate)
            for b in it:
                ids = b.column(0).to_pylist()
                out = [(ids[r[0]], *r[1:]) for r in finder.rows(b.column(1).to_pylist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "distance", "item_words", "end_word"])

        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(benchmark, block_bytes):
        out = out.union(search(block))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item; rows are passed on where they are."""
    small_batches(docs.sparkSession)

    def without(block):
        def run(it):
            finder = Finder(block, rate)
            for b in it:
                at = b.schema.get_field_index("text")
                bad = {r[0] for r in finder.rows(b.column(at).to_pylist())}
                if bad:
                    b = b.filter(pa.array([i not in bad for i in range(b.num_rows)]))
                if b.num_rows:
                    yield b

        return run

    out = docs
    for block in blocks(benchmark, block_bytes):
        out = out.mapInArrow(without(block), docs.schema)
    return out
