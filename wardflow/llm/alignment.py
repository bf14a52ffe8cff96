"""Cross-tokenizer alignment (operator 13): common token ends cut two encodings of a text into groups.

Each text is encoded by two tokenizers without special tokens (their strings in a text are plain
text), and tokens become the bytes they stand for. The cumulative byte ends of either side go into a
dictionary end -> index; the keys that both dictionaries hold, sorted, slice both id lists into groups,
and the links (token pairs whose byte ranges overlap) are expanded slice by slice.

Both tokenizers begin a token at a space between two signs that are no white space (A's pattern puts
such a space in front of a word; none of B's pieces holds a space behind another sign, which is
tested when it is loaded). A text is therefore cut there first, each segment is aligned on its own, and a
segment that was met before is not encoded again; the result is that of the whole text.

A pair's count is how many links of the whole corpus hold it. Documents are stored with their distinct pairs
and how often each occurs; pair counts come from these by an aggregate with map-side sums, and a
document's sums meet the counts in two ways: the most frequent pairs, at most ``FREQUENT``, travel to
the tasks and are looked up there; all others are joined on Spark. A pair in the join is rarer
than all that travel, so no key of it is hot. ``FREQUENT`` moves work, never a result.

Defined cases: a text that is null, empty, or whose joined bytes of either side differ from a space
plus the text has no tokens: zeros and an empty digest column; repeated rows each count; an empty
table gives no rows; further columns are ignored. A text stays in one task.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import cut, small_batches

FREQUENT, SIDE, BLOCK = 1 << 18, 1 << 32, 1 << 20
REMEMBERED, LONG = 1 << 18, 64
COUNTS = ("n_a", "n_b", "n_groups", "n_links")

#: A space between two signs that are no white space.
SPACE = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[tuple[str, str, str], tuple] = {}


def paths() -> tuple[str, str, str]:
    """The files of tokenizer A (as ranks, and as the tokenizers library reads it) and of tokenizer B."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def encoders(files: tuple[str, str, str]):
    """``(encode a, bytes of a's ids, encode a list of texts by b, bytes of b's ids)``, loaded once per worker.

    A's ids are those of its tokenizers file; the same vocabulary as ranks gives them several times
    faster, and the tokenizers library takes over for a text that the faster library refuses.
    """
    if files not in _encoders:
        import public_tokenizers as public
        import sentencepiece
        import tiktoken

        with open(files[0], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("a", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        bytes_a = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            bytes_a[i] = word

        def encode_a(text: str) -> list[int]:
            try:
                return fast.encode_ordinary(text)
            except Exception:  # a run that its pattern engine gives up on
                from tokenizers import Tokenizer

                slow = Tokenizer.from_file(files[1])
                slow.encode_special_tokens = True
                return slow.encode(text, add_special_tokens=False).ids

        b = sentencepiece.SentencePieceProcessor(model_file=files[2])
        pieces = [(i, b.id_to_piece(i)) for i in range(b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for _, p in pieces):
            raise ValueError(f"{files[2]} has pieces that reach over a space between words: texts cannot be cut there")
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        _encoders[files] = encode_a, bytes_a, lambda texts: b.encode(texts, num_threads=1), bytes_b
    return _encoders[files]


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a, of b, end at or before each place where both sides end one, in order."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    return tuple(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))


def slice_links(ends_a: list[int], ends_b: list[int], a: int, b: int, count: int) -> tuple[list[int], list[int]]:
    """Indices of the ``count`` overlapping pairs of a group that begins at tokens a and b: the side that ends first
    moves on (inside a group the two never end together)."""
    left, right = [a], [b]
    for _ in range(count - 1):
        if ends_a[a] < ends_b[b]:
            a += 1
        else:
            b += 1
        left.append(a)
        right.append(b)
    return left, right


def links(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token indices of every link, slice by slice, and how many links end with each slice. A slice of m and n tokens
    has m + n - 1 links; where either side is one token, that token links with all of the other."""
    from_a, from_b = (np.concatenate([[0], c[:-1]]) for c in (cut_a, cut_b))
    m, n = cut_a - from_a, cut_b - from_b
    last = np.cumsum(m + n - 1)
    group = np.repeat(np.arange(len(m)), m + n - 1)
    step = np.arange(len(group)) - (last - (m + n - 1))[group]
    left, right = from_a[group] + np.minimum(step, m[group] - 1), from_b[group] + np.minimum(step, n[group] - 1)
    several = np.flatnonzero((m > 1) & (n > 1))
    if len(several):
        list_a, list_b, x, y = ends_a.tolist(), ends_b.tolist(), [], []
        for a, b, count in zip(from_a[several].tolist(), from_b[several].tolist(), (m + n - 1)[several].tolist()):
            some = slice_links(list_a, list_b, a, b, count)
            x += some[0]
            y += some[1]
        at = ((m > 1) & (n > 1))[group]
        left[at], right[at] = x, y
    return left, right, last


SIGNS = ",|;\n"


def text_of(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, closing: np.ndarray, names: np.ndarray) -> list[str]:
    """The groups as ``a1,a2|b1;a3|b2,b3``, a new text after each of the ``closing`` groups; ``names`` has every
    id with each of SIGNS behind it."""
    sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    sign_a[cut_a - 1], sign_b[cut_b - 1] = 1, 2
    sign_b[cut_b[closing] - 1] = 3
    from_a, from_b = (np.concatenate([[0], c[:-1]]) for c in (cut_a, cut_b))
    line = np.empty(len(ids_a) + len(ids_b), np.int64)
    line[np.arange(len(ids_a)) + np.repeat(from_b, cut_a - from_a)] = len(SIGNS) * ids_a + sign_a
    line[np.arange(len(ids_b)) + np.repeat(cut_a, cut_b - from_b)] = len(SIGNS) * ids_b + sign_b
    signs = names[line].view(np.uint8)
    return signs[signs > 0].tobytes().decode().split("\n")[:-1]


class Segments(dict):
    """segment of a text -> ``(n_a, n_b, n_groups, groups as text, an id pair a * 2**32 + b per link)``, or None
    where a side's bytes differ. Up to ``limit`` are remembered, as words come again and again."""

    def __init__(self, files: tuple[str, str, str], limit: int = REMEMBERED):
        super().__init__()
        self.encoders, self.limit, self.long = encoders(files), limit, []
        self.sizes = [np.array(list(map(len, words))) for words in self.encoders[1::2]]
        self.names = np.array([f"{i}{sign}" for i in range(max(map(len, self.sizes))) for sign in SIGNS], "S")

    def read(self, segments: list[str]) -> None:
        """Align all that are not known yet."""
        encode_a, bytes_a, encode_b, bytes_b = self.encoders
        for s in self.long:  # these come once
            del self[s]
        if len(self) > self.limit:
            self.clear()
        new = [s for s in dict.fromkeys(segments) if s not in self]
        self.long = [s for s in new if len(s) > LONG]
        known = []
        for s, ids_b in zip(new, encode_b(new)):
            ids_a, whole = encode_a(" " + s), (" " + s).encode()
            if b"".join([bytes_a[i] for i in ids_a]) == whole and b"".join([bytes_b[i] for i in ids_b]) == whole:
                known.append((s, ids_a, ids_b))
            else:
                self[s] = None
        if known:
            self.align(*zip(*known))

    def align(self, names: tuple[str, ...], each_a: tuple[list[int], ...], each_b: tuple[list[int], ...]) -> None:
        """Align segments in one go, as if they were one text: both sides end a token where a segment ends."""
        n_a, n_b = np.array(list(map(len, each_a))), np.array(list(map(len, each_b)))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((each_a, n_a), (each_b, n_b)))
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        cut_a, cut_b = groups(ends_a, ends_b)
        left, right, last = links(ends_a, ends_b, cut_a, cut_b)
        closing = np.searchsorted(cut_a, np.cumsum(n_a))
        pairs, stop = (a[left] * SIDE + b[right]).tolist(), last[closing].tolist()
        of = [tuple(pairs[i:j]) for i, j in zip([0, *stop], stop)]
        self.update(zip(names, zip(n_a.tolist(), n_b.tolist(), np.diff(closing, prepend=-1).tolist(), text_of(a, b, cut_a, cut_b, closing, self.names), of)))


def aligned(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """``row_, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times``: every document's groups (text
    ``a1,a2|b1;a3|b2,b3``) and its distinct linked id pairs."""
    files = files or paths()
    names = ["row_", "doc_id", *COUNTS, "groups", "pairs", "times"]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(it):
        known = Segments(files)

        def one(segments):
            if not segments:
                return 0, 0, 0, 0, "", [], []
            found = [known[s] for s in segments]
            if None in found:
                return one([])
            n_a, n_b, n_groups, text, links = zip(*found)
            pairs, times = np.unique(np.fromiter(chain.from_iterable(links), np.int64), return_counts=True)
            return sum(n_a), sum(n_b), sum(n_groups), int(times.sum()), ";".join(text), pairs, times.astype(np.int32)

        for b in it:
            texts, done, at = b.column(2).to_pylist(), [], 0
            while at < len(texts):  # as many texts at once as make a block
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < BLOCK):
                    size += len(texts[stop] or "")
                    stop += 1
                split = [SPACE.split(t) if t else [] for t in texts[at:stop]]
                known.read(list(chain.from_iterable(split)))
                done += map(one, split)
                at = stop
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[i] for x in done], k) for i, k in enumerate(kinds[2:]))], names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row_ long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def pair_counts(stored: DataFrame) -> DataFrame:
    """``pair, count, best``: links that hold the pair in the whole corpus, and whether no pair of its b id has more."""
    each = stored.select(F.inline(F.arrays_zip("pairs", "times"))).toDF("pair", "times")
    counts = cut(each.groupBy("pair").agg(F.sum(F.col("times").cast("long")).alias("count")), "align-counts")
    b = F.col("pair") % SIDE
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # a row per id of b's vocabulary
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, limit: int) -> int:
    """The least power of two that at most ``limit`` pairs reach with their counts."""
    per = {r["p"]: r["n"] for r in counts.groupBy(F.length(F.bin("count")).alias("p")).agg(F.count("*").alias("n")).collect()}
    total, power = 0, 64
    while power > 1 and total + per.get(power - 1, 0) <= limit:
        power -= 1
        total += per.get(power, 0)
    return 1 << (power - 1) if power < 64 else (1 << 63) - 1


def summed(stored: DataFrame, counts: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """The stored rows with ``n_best`` and ``count_sum``."""
    least = frequent_from(counts, limit)
    near = counts.where(F.col("count") >= least).toArrow().sort_by("pair")
    known, count, best = (near[c].to_numpy() for c in ("pair", "count", "best"))

    def run(it):
        for b in it:
            end = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(b.num_rows), np.diff(end, prepend=0))
            pairs, times = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            n_best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
            np.add.at(total, row[hit], times[hit] * count[at[hit]])
            rest = [pa.ListArray.from_arrays(pa.array(np.searchsorted(row[~hit], np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_best), pa.array(total), *rest], names=["row_", "n_best", "count_sum", "pairs", "times"])

    part = stored.select("row_", "pairs", "times").mapInArrow(run, "row_ long, n_best long, count_sum long, pairs array<long>, times array<long>")
    part = cut(part, "align-parts")
    rare = part.select("row_", F.inline(F.arrays_zip("pairs", "times"))).toDF("row_", "pair", "times").join(counts.where(F.col("count") < least), "pair")
    more = rare.groupBy("row_").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    both = part.select("row_", "n_best", "count_sum").unionByName(more).groupBy("row_").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return stored.drop("pairs", "times").join(both, "row_").drop("row_")


def report(docs: DataFrame, limit: int = FREQUENT, files: tuple[str, str, str] | None = None) -> DataFrame:
    """``doc_id``, token, group and link counts, ``n_best``, ``count_sum`` and the digest of the groups."""
    rows = aligned(docs, files)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    stored = cut(rows.withColumn("groups_sha256", digest).drop("groups"), "align-rows")
    counts = cut(pair_counts(stored), "align-pairs")
    return summed(stored, counts, limit).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
