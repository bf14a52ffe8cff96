"""Packing (operator 8): shortest-pack-first over the length histogram.

Documents become token ids (byte-level BPE of a public vocabulary file, one end id), are cut into
full pieces and one remainder, and the histogram of piece lengths alone is packed: lengths are
placed longest first, each into the pack patterns with the most room, and a placement only changes
pattern counts. Patterns then meet documents by rank: the r-th piece of a length takes the r-th
slot of that length. The driver holds the histogram (``max_len`` counts) and the patterns; ranks
come from a window over (length, salt), so a length that most pieces share is still split.

Defined cases: null text counts as empty (the end id alone); repeated rows are packed once each;
an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm.common import batches, crc32, cut, small_batches

MAX_LEN, END_ID, SALTS = 2048, 1, 64
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"

_encoders: dict[str, object] = {}


def encoder(ranks_path: str, json_path: str):
    """``text -> ids`` of the public byte-level BPE file.

    The ids are those of the tokenizers file ``json_path`` (its special token in a text included);
    the same vocabulary as ranks gives them several times faster, and the tokenizers library takes
    over for a text that the faster library refuses.
    """
    if ranks_path not in _encoders:
        import public_tokenizers as public
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": 50256}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except Exception:  # a run that its pattern engine gives up on
                from tokenizers import Tokenizer

                return Tokenizer.from_file(json_path).encode(text, add_special_tokens=False).ids

        _encoders[ranks_path] = encode
    return _encoders[ranks_path]


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")


def cut_tokens(docs: DataFrame, paths: tuple[str, str] | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit): full pieces, then the remainder."""
    paths = paths or tokenizer_paths()

    def run(it):
        encode = encoder(*paths)
        for b in batches(it):
            out = defaultdict(list)
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = encode(text) if text else []
                ids.append(end_id)
                raw = np.asarray(ids, "<u4").tobytes()
                for start in range(0, len(ids), max_len):
                    part = raw[4 * start : 4 * (start + max_len)]
                    for k, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"), (doc_id, start, len(part) // 4, crc32(part), len(ids), part)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_histogram(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first on a histogram: ``[(copies, [(length, times), ...])]``.

    Lengths go longest first, each into the pack patterns with the most room; where a pattern has
    more copies than pieces are left, its copies are split into two patterns. Within a pattern as
    many pieces are placed at once as it has copies.
    """
    heap: list[tuple[int, int, int, list]] = []  # (-room, order, copies, content)
    order = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            order += 1
            if heap and -heap[0][0] >= length:
                neg, _, copies, content = heapq.heappop(heap)
                take = min(copies, left)
                if take < copies:
                    heapq.heappush(heap, (neg, order, copies - take, content))
                    order += 1
                grown = content[:-1] + [(length, content[-1][1] + 1)] if content[-1][0] == length else content + [(length, 1)]
                heapq.heappush(heap, (neg + length, order, take, grown))
                left -= take
            else:
                heapq.heappush(heap, (length - max_len, order, left, [(length, 1)]))
                left = 0
    return [(copies, content) for _, _, copies, content in sorted(heap, key=lambda x: x[1])]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks of its slot runs, the first sequence of each run, its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    nxt: Counter = Counter()
    first = 0
    for copies, content in patterns:
        at = 0
        for length, times in content:
            for _ in range(times):
                runs[length].append((nxt[length], first, at))
                nxt[length] += copies
                at += length
        first += copies
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def assign(pieces: DataFrame, max_len: int = MAX_LEN, salts: int = SALTS) -> DataFrame:
    """``pieces`` (without ids) plus ``sequence_id`` and ``offset``.

    The driver reads at most ``max_len * salts`` counts, whatever the number of documents.
    """
    slim = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    slim = slim.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = {(r["length"], r["salt"]): r["n"] for r in slim.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()}
    counts: Counter = Counter()
    before: dict[int, np.ndarray] = {}
    for (length, salt), n in sorted(by_salt.items()):
        before.setdefault(length, np.zeros(salts, np.int64))[salt] = counts[length]
        counts[length] += n
    place = slots(pack_histogram(counts, max_len))

    def run(it):
        for b in it:
            length, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "salt", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                r = rank[at] - 1 + before[int(k)][salt[at]]
                starts, firsts, offsets = place[int(k)]
                j = np.searchsorted(starts, r, "right") - 1
                seq[at], off[at] = firsts[j] + r - starts[j], offsets[j]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names[:2]), pa.array(length.astype(np.int64)), *(b.column(b.schema.get_field_index(c)) for c in names[3:]), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    w = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = slim.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, max_len: int = MAX_LEN, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """``(index, pieces)``: where each piece goes, and the pieces with their ids in the shared folder."""
    pieces = cut(cut_tokens(docs, max_len=max_len), "pieces")
    return assign(pieces, max_len, salts), pieces


def sequences(index: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ids of its pieces in order (padding is left to the reader)."""
    keys = ["doc_id", "start", "ids_crc32"]
    ids = pieces.dropDuplicates(keys).select(*keys, "ids")
    on = F.col("i.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("i.start") == F.col("p.start")) & (F.col("i.ids_crc32") == F.col("p.ids_crc32"))
    joined = index.alias("i").join(ids.alias("p"), on).select("i.sequence_id", "i.offset", "p.ids")
    return joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
