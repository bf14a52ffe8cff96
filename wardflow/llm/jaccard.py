"""N-gram Jaccard join (operator 2): a count-vector R-tree over hashed shingle groups.

A document is the set of its distinct 5-word shingles (64-bit hashes); equal sets are one node. Two
nodes link when 100 * |A and B| >= 80 * |A or B|, that is, when the overlap is at least 4/9 of the sum
of sizes. Steps:

1. Order. Shingles are ordered by how common they are (counts in ``ORDER`` hashed counters over all
   documents, in steps above chance), then by hash. Any order is right; this one keeps common
   passages out of the front.
2. Blocks. Linked sets share one of the first ``n - ceil(0.8 n) + 1`` shingles of either (else too
   few are left to overlap). Nodes that share such a shingle meet in the block of the least of
   them, so a node's place is sent once per block, not once per shingle.
3. Index. Shingles are hashed into groups; the counts per group are a node's point, and the sum of
   coordinate minima of two points bounds their overlap from above. A first round runs through
   every block with a few centres in hand and proposes a node to the first centre that its bound
   allows. One proposal per node is verified on the sets, and links are contracted to components.
4. Search. Blocks that still hold several components are cut into tiles of bounded size (a block of P
   parts makes a tile of each two parts) and packed into R-trees (nodes of 16, corners of maxima). Every point
   searches its tree for points of other components whose bound allows a link; nodes with such points fetch
   their sets, and the pairs are verified on them tile by tile. Pairs inside a component, found so far, need no test: a link between
   them changes nothing. So no link is lost, and copies are never expanded into pairs.

Verification reads only the texts of nodes in question; the rows to read are found through a bit table
of fixed size and then an exact join.

Defined cases: documents without words have the empty set, link with nothing and are their own
component; fewer than 5 words make one shingle; repeated rows share a node; rows with a null id
count, with a null id, and a component's id is the least id that is not null in it; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import WordHash, cut, mix, release, shingle_hashes, signed, small_batches, words_of
from wardflow.llm.components import components

WIDTH, ORDER, BITS, CENTRES, FAN = 5, 1 << 20, 1 << 25, 16, 16
TILE = 1024
SEEN = 1 << 20
LOW = -(1 << 63)
PLACE = np.uint64(0x2545F4914F6CDD1D)


def needed(n):
    """Least overlap that links two sets of ``n`` shingles together (sum of both sizes)."""
    return (4 * n + 8) // 9


def front(n: int) -> int:
    """How many first shingles of a set of n can hold the first common one."""
    return n - (8 * n + 9) // 10 + 1


class Sets:
    """Distinct shingle hashes of texts, sorted by hash."""

    def __init__(self):
        self.hashed = WordHash()

    def of(self, text: str | None) -> np.ndarray:
        return np.unique(shingle_hashes(self.hashed.of(words_of(text)), WIDTH))


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def slot(s: np.ndarray) -> np.ndarray:
    """Counter of each shingle: bits apart from those that order by hash."""
    return (s * PLACE >> np.uint64(44)).astype(np.int64)


def vector(s: np.ndarray) -> np.ndarray:
    """Counts per group (uint8); the number of groups is a power of two near a quarter of the set."""
    size = 1 << min(max(len(s).bit_length() - 2, 4), 12)
    g = mix(s).astype(np.int64)
    while True:
        v = np.bincount(g & (size - 1), minlength=size)
        if v.max(initial=0) < 256:
            return v.astype(np.uint8)
        size *= 2


def fold(v: np.ndarray, size: int) -> np.ndarray:
    """The same counts over fewer groups (a divisor of the present number)."""
    return v.reshape(-1, size).sum(0, dtype=np.int32)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of the overlap: summed coordinate minima."""
    size = min(len(a), len(b))
    return int(np.minimum(fold(a, size), fold(b, size)).sum())


def levels(docs: DataFrame) -> np.ndarray:
    """How common each counter's shingles are: 0 near chance, then steps of doubling above it."""
    block = 4096

    def run(it):
        sets, n = Sets(), np.zeros(ORDER, np.int64)
        for b in it:
            for t in b.column(0).to_pylist():
                s = sets.of(t)
                if len(s):
                    np.add.at(n, slot(s), 1)
        parts = n.astype("<u4").reshape(-1, block)
        i = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array([p.tobytes() for p in parts[i]], pa.binary())], names=["i", "c"])

    def add(key, rows):
        import pandas as pd

        s = sum(np.frombuffer(c, "<u4").astype(np.int64) for c in rows["c"])
        return pd.DataFrame({"i": [int(key[0])], "c": [s.astype("<i8").tobytes()]})

    n = np.zeros(ORDER, np.int64)
    for r in docs.select("text").mapInArrow(run, "i int, c binary").groupBy("i").applyInPandas(add, "i int, c binary").collect():
        n[r["i"] * block : (r["i"] + 1) * block] = np.frombuffer(bytes(r["c"]), "<i8")
    mid = float(np.median(n))
    over = (n - mid) / (6 * np.sqrt(mid) + 6)
    return np.where(over > 1, np.floor(np.log2(np.maximum(over, 1))) + 1, 0).astype(np.uint8)


def shingle_sets(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """``doc_id, key, n, node, front, vec`` per row (key: hash of id and text); the last two only where the task has not seen the node yet."""

    def run(it):
        sets, seen = Sets(), set()
        for b in it:
            out = [], [], [], []
            for t in b.column(2).to_pylist():
                s = sets.of(t)
                node, lead, vec = node_of(s), None, None
                if len(s) and node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    lead = signed(s[np.lexsort((s, level[slot(s)]))[: front(len(s))]])
                    vec = vector(s).tobytes()
                for o, x in zip(out, (len(s), node, lead, vec)):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())))], names=["doc_id", "key", "n", "node", "front", "vec"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, n long, node long, front array<long>, vec binary")


def _blocks(sets: DataFrame) -> DataFrame:
    """``anchor, node``: nodes that share a front shingle, under the least node that has it."""

    def run(it):
        shingle, anchor, last = None, None, None
        for b in it:
            g, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh = np.ones(len(g), bool)  # a row that differs from the one before
            fresh[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
            fresh[0] = g[0] != shingle or node[0] != last
            head = np.ones(len(g), bool)
            head[1:] = g[1:] != g[:-1]
            head[0] = g[0] != shingle
            first = np.maximum.accumulate(np.where(head, np.arange(len(g)), -1))
            a = np.where(first < 0, anchor if anchor is not None else 0, node[first])
            keep = np.flatnonzero(fresh & ~head)
            shingle, anchor, last = g[-1], a[-1], node[-1]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(node[keep])], names=["anchor", "node"])

    rows = sets.where("front is not null").select(F.explode("front").alias("g"), "node")
    pairs = rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "anchor long, node long").distinct()
    return pairs.unionByName(pairs.select("anchor", F.col("anchor").alias("node")).distinct())


def _centre_pairs(members: DataFrame) -> DataFrame:
    """Each node of a block with the first of a few centres that its bound allows."""

    def run(it):
        block, centres = None, []
        for b in it:
            out = []
            for anchor, node, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != block:
                    block, centres = anchor, []
                v = np.frombuffer(raw, np.uint8)
                for k, m, u in centres:
                    if 10 * min(m, n) >= 8 * max(m, n) and bound(u, v) >= needed(n + m):
                        out.append((k, node))
                        break
                else:
                    if len(centres) < CENTRES:
                        centres.append((node, n, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names=["a", "b"])

    dealt = members.select("anchor", "node", "n", "vec").repartition("anchor").sortWithinPartitions("anchor", "n", "node")
    return dealt.mapInArrow(run, "a long, b long")


class Tree:
    """A packed R-tree over points in order of set size: FAN entries a node, corners of maxima."""

    def __init__(self, n: np.ndarray, vecs: list[np.ndarray]):
        self.n, self.vecs, self.levels = n, vecs, []
        entries = [(i, i + 1, v) for i, v in enumerate(vecs)]
        while not self.levels or len(self.levels[-1]) > 1:
            level, up = [], []
            for i in range(0, len(entries), FAN):
                part = entries[i : i + FAN]
                size = min(len(v) for _, _, v in part)
                corners = np.array([fold(v, size) for _, _, v in part])
                lo, hi = np.array([e[0] for e in part]), np.array([e[1] for e in part])
                level.append((size, corners, lo, hi, n[lo]))
                up.append((part[0][0], part[-1][1], corners.max(0)))
            self.levels.append(level)
            entries = up

    def after(self, i: int) -> list[int]:
        """Points behind i, of allowed size, whose bound with i reaches what a link needs."""
        n, v = int(self.n[i]), self.vecs[i]
        stop = int(np.searchsorted(self.n, n * 10 // 8, "right"))
        folded: dict[int, np.ndarray] = {}
        todo, hits = [(len(self.levels) - 1, 0)], []
        while todo:
            depth, k = todo.pop()
            size, corners, lo, hi, least = self.levels[depth][k]
            if len(v) < size:
                corners, size = corners.reshape(len(corners), -1, len(v)).sum(1), len(v)
            if size not in folded:
                folded[size] = fold(v, size)
            over = np.minimum(corners, folded[size]).sum(1) >= needed(n + np.maximum(least, n))
            for c in np.flatnonzero(over & (hi > i + 1) & (lo < stop)):
                if depth:
                    todo.append((depth - 1, k * FAN + int(c)))
                else:
                    hits.append(int(lo[c]))
        return hits


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sets of sorted hashes link."""
    if len(s) > len(t):
        s, t = t, s
    common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * common >= 80 * (len(s) + len(t) - common)


def candidates(rows: list[tuple[int, int, int, bytes]], crossing: bool) -> list[int]:
    """Nodes among ``(node, comp, part, vector)`` whose bound allows a link to one of another component;
    with ``crossing`` only pairs of different parts are this tile's."""
    if len({r[1] for r in rows}) < 2:
        return []
    vecs = [np.frombuffer(r[3], np.uint8) for r in rows]
    tree, hits = Tree(np.array([int(v.sum(dtype=np.int64)) for v in vecs]), vecs), set()
    for i, (node, comp, part, _) in enumerate(rows):
        for j in tree.after(i):
            other, comp2, part2, _ = rows[j]
            if comp != comp2 and not (crossing and part == part2):
                hits.update((node, other))
    return sorted(hits)


def tile_links(rows: list[tuple[int, int, int, bytes]], crossing: bool) -> list[tuple[int, int]]:
    """Links between different components among ``(node, comp, part, set)``, as few as join them; with
    ``crossing`` only pairs of different parts are this tile's."""
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    tree = Tree(np.array([len(s) for s in sets]), [vector(s) for s in sets])
    up: dict[int, int] = {}

    def root(c):
        while c in up:
            up[c] = up.get(up[c], up[c])
            c = up[c]
        return c

    out = []
    for i, (node, comp, part, _) in enumerate(rows):
        for j in tree.after(i):
            other, comp2, part2, _ = rows[j]
            a, b = root(comp), root(comp2)
            if a != b and not (crossing and part == part2) and linked(sets[i], sets[j]):
                up[max(a, b)] = min(a, b)
                out.append((node, other))
    return out


def _by_tile(tiled: DataFrame, load: str, schema: str, work) -> DataFrame:
    """``work(rows, crossing)`` on each tile (anchor, i, j), rows ``(node, comp, part, load)`` in order of size."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it):
        tile, rows, out = None, [], []

        def close():
            if rows:
                out.extend((*tile, x) if len(names) > 2 else x for x in work(rows, tile[1] != tile[2]))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names=names)

        for b in it:
            for anchor, i, j, node, comp, part, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (anchor, i, j) != tile:
                    close()
                    tile, rows = (anchor, i, j), []
                rows.append((node, comp, part, raw))
            if out:
                yield batch()
                out = []
        close()
        if out:
            yield batch()

    dealt = tiled.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "n", "node")
    return dealt.select("anchor", "i", "j", "node", "comp", "part", load).mapInArrow(run, schema)


def _tiles(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of blocks with several components, once per tile: anchor, i, j, node, comp, part."""
    labelled = members.join(comp, "node", "left").select("anchor", "node", F.coalesce("comp", "node").alias("comp"))
    labelled = cut(labelled, "jaccard-labelled")
    mixed = labelled.groupBy("anchor").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where("lo <> hi")
    tiled = labelled.join(mixed.select("anchor", F.ceil(F.col("k") / TILE).cast("long").alias("parts")), "anchor")
    tiled = tiled.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    tiled = tiled.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return tiled.select("anchor", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "node", "comp", "part")


def _tile_search(docs: DataFrame, sets: DataFrame, members: DataFrame, points: DataFrame, comp: DataFrame) -> DataFrame:
    """``a, b``: links that join different components of a block. The index on vectors says which nodes
    need their sets; only these are fetched and verified."""
    tiled = cut(_tiles(members, comp), "jaccard-tiles")
    where = ["anchor", "i", "j", "node"]
    found = cut(_by_tile(tiled.join(points, "node"), "vec", "anchor long, i long, j long, node long", candidates), "jaccard-candidates")
    release(docs.sparkSession)
    full = _full_sets(docs, sets, found.select("node").distinct())
    release(docs.sparkSession)
    wanted = tiled.join(found, where).join(full.withColumn("n", F.octet_length("s")), "node")
    return _ordered(_by_tile(wanted, "s", "a long, b long", tile_links))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def among(ids: DataFrame):
    """A test ``column -> boolean column``: true for every id in ``ids`` (column d), and for few others.

    A bit table of fixed size (two bits per id) travels to the tasks; more ids only let more rows
    through, so an exact join must follow.
    """
    place = lambda c: (F.pmod(F.xxhash64(c), F.lit(BITS)), F.pmod(F.xxhash64(c, F.lit(1)), F.lit(BITS)))
    words = ids.select(F.explode(F.array(*place(F.col("d")))).alias("bit")).groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("m"))
    table = np.zeros(BITS // 64, np.int64)
    got = words.toArrow()
    table[got["w"].to_numpy()] = got["m"].to_numpy()

    @F.pandas_udf("boolean")
    def maybe(a, b):
        import pandas as pd

        x, y = a.to_numpy(), b.to_numpy()
        return pd.Series((table[x >> 6] >> (x & 63) & table[y >> 6] >> (y & 63) & 1).astype(bool))

    return lambda c: maybe(*place(c))


def _full_sets(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, s``: the whole set of every node in ``nodes``, from the text of one of its rows.

    Rows are found by (id, hash of id and text), so equal ones are dropped as they meet in that join: texts move once, sets do not.
    """
    least = sets.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(LOW))).alias("d"), F.min_by("key", F.coalesce("doc_id", F.lit(LOW))).alias("key"))
    where = cut(least.join(nodes, "node", "left_semi"), "jaccard-where")
    keyed = docs.select(F.coalesce("doc_id", F.lit(LOW)).alias("d"), F.xxhash64("doc_id", "text").alias("key"), "text")
    keyed = keyed.where(among(where.select(F.col("key").alias("d")))(F.col("key")))

    def read(it):
        sets_ = Sets()
        for b in it:
            node, out = [], []
            for want, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = sets_.of(t)
                if node_of(s) == want:
                    node.append(want)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], names=["node", "s"])

    rows = keyed.join(where, ["d", "key"]).dropDuplicates(["d", "key"])
    return rows.select("node", "text").mapInArrow(read, "node long, s binary")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets link. The second nodes' sets meet the first one's in stars of about TILE members, so each set moves once or twice."""

    def test(it):
        star, centre = None, None
        for b in it:
            out = []
            for a, part, node, raw in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(raw, np.uint64)
                if node == a:
                    star, centre = (a, part), s
                elif star == (a, part) and linked(centre, s):
                    out.append((a, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names=["a", "b"])

    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE).cast("long").alias("parts"))
    members = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("node"))
    centres = stars.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    rows = cut(members.unionByName(centres), "jaccard-stars")
    full = _full_sets(docs, sets, rows.select("node").distinct())
    release(docs.sparkSession)
    dealt = rows.join(full, "node").repartition("a", "part").sortWithinPartitions("a", "part", F.col("node") != F.col("a"))
    return dealt.select("a", "part", "node", "s").mapInArrow(test, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_shingles, node, component_id`` per row (``key``: hash of id and text; ``node``: rows with equal sets share it)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = cut(shingle_sets(docs, levels(docs)), "jaccard-sets")
    points = cut(sets.where("vec is not null").dropDuplicates(["node"]).select("node", "n", "vec"), "jaccard-points")
    release(docs.sparkSession)
    members = cut(_blocks(sets), "jaccard-members")
    release(docs.sparkSession)
    tried = cut(_centre_pairs(members.join(points, "node")).groupBy("b").agg(F.min("a").alias("a")), "jaccard-tried")
    release(docs.sparkSession)
    links = cut(_verified(docs, sets, tried), "jaccard-links")
    release(docs.sparkSession)
    comp = cut(components(links), "jaccard-comp")
    release(docs.sparkSession)
    more = cut(_tile_search(docs, sets, members, points, comp), "jaccard-more")
    if not more.isEmpty():
        comp = cut(components(links.unionByName(more)), "jaccard-comp")
    release(docs.sparkSession)
    least = sets.groupBy("node").agg(F.min("doc_id").alias("d"), F.first("n").alias("n"))
    linked = least.join(comp, "node")
    ids = linked.groupBy("comp").agg(F.min("d").alias("c")).join(linked, "comp").select("node", "c")
    ids = least.where("n > 0").join(ids, "node", "left").select("node", F.coalesce("c", "d").alias("c"))
    return sets.join(ids, "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), "node", F.coalesce("c", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component (the least id, then key); rows without words all stay.

    Only rows whose key may be dropped or repeated are moved; the others pass where they are.
    """
    rows = cut(join(docs.select("doc_id", "text")), "jaccard-rows").where("n_shingles > 0")
    release(docs.sparkSession)
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(LOW)), "key"))
    group = F.struct(F.col("component_id").alias("c"), F.when(F.col("component_id").isNull(), F.col("node")).alias("node"))
    kept = rows.groupBy(group.alias("g")).agg(best["key"].alias("key"))
    per_key = rows.groupBy("key").agg(F.count("*").alias("m"))
    other = per_key.join(kept.select("key", F.lit(True).alias("keep")), "key", "left").where("keep is null or m > 1")
    other = cut(other.select("key", F.coalesce("keep", F.lit(False)).alias("keep")), "jaccard-other")
    release(docs.sparkSession)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own_"), F.xxhash64("doc_id", "text").alias("key"))
    keyed = keyed.withColumn("maybe", among(other.select(F.col("key").alias("d")))(F.col("key")))
    some = keyed.where("maybe").join(other, "key", "left")
    once = some.where("keep is null").select("own_").unionByName(some.where("keep").dropDuplicates(["key"]).select("own_"))
    return keyed.where("not maybe").select("own_").unionByName(once).select("own_.*")
