import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import SF, documents, prose
from wardflow.llm import packing, queries, sharding
from wardflow.llm.common import table


def test_histogram_sort_on_whole_table(spark):
    rows = queries.op1_sharding(spark, SF).toPandas()
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert sorted(rows["doc_id"]) == sorted(docs)
    for r in rows.itertuples():
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes"
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert set(rows["shard"]) <= set(range(24))


def test_shards_are_even_and_copies_lie_together(spark):
    texts = [(i, prose(30 + i % 7, i)) for i in range(600)] + [(1000 + i, "same text " * 20) for i in range(300)]
    rows = sharding.shard(documents(spark, texts), shards=6, bucket_bytes=1 << 12).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 6 and size.max() - size.min() <= 2 * rows["size"].max()
    order = rows.sort_values(["shard", "slot"])["text"].str.startswith("same").to_numpy()
    assert np.ptp(np.flatnonzero(order)) == 299


def test_shard_edge_cases(spark):
    rows = sharding.shard(documents(spark, [(1, None), (None, "a"), (2, ""), (3, "x"), (3, "x"), (3, "x")])).toPandas()
    assert len(rows) == 6 and sorted(rows["size"]) == [8, 8, 9, 9, 9, 9]
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.shard(documents(spark, [])).count() == 0


def test_pack_histogram_places_every_piece():
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 2049, 300), rng.integers(1, 50, 300))} | {700: 40_000}
    patterns = packing.pack_histogram(counts)
    got = {}
    for copies, content in patterns:
        assert sum(k * t for k, t in content) <= 2048
        for k, t in content:
            got[k] = got.get(k, 0) + copies * t
    assert got == counts
    small = {int(k): 100 for k in rng.integers(1, 1025, 200)}
    used = sum(c for c, _ in packing.pack_histogram(small))
    assert used <= 1.02 * (sum(k * v for k, v in small.items()) / 2048)  # the method's worst-fit order, not best fit


def test_packing_ids_and_places(spark):
    rows = [(1, "Hello <|endoftext|> wörld"), (2, None), (3, ""), (4, prose(4000, 4)), (5, "x"), (5, "x"), (None, "y z")]
    index, pieces = packing.pack(documents(spark, rows))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_paths()[1])
    want = sorted((i or -1, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in rows)
    got = {}
    for p in pieces.collect():
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(ids) == p["length"]
        got.setdefault((p["doc_id"] or -1, p["start"]), []).append(ids.tolist())
    flat = sorted((d, sum((x[0] for (e, _), x in sorted(got.items()) if e == d), [])) for d in {d for d, _ in got})
    assert flat == sorted({d: ids for d, ids in want}.items())
    placed = index.toPandas()
    assert len(placed) == pieces.count()
    for _, s in placed.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 2048
    assert placed.groupby(["doc_id", "start"], dropna=False).size().max() == 2
    full = packing.sequences(index, pieces).select("sequence_id", F.explode("parts").alias("p")).select("sequence_id", "p.offset", F.length("p.ids").alias("b"))
    assert {tuple(r) for r in full.collect()} == {(r.sequence_id, r.offset, 4 * r.length) for r in placed.itertuples()}
    assert packing.pack(documents(spark, []))[0].count() == 0


def test_fast_encoder_agrees_with_the_tokenizers_file():
    from tokenizers import Tokenizer

    paths = packing.tokenizer_paths()
    t, encode = Tokenizer.from_file(paths[1]), packing.encoder(*paths)
    for text in ("", " ", "a  b\t\n\n c", "it's 1234 +1 (555)", "Éé 日本語 🙂🙂 ​", "<|endoftext|>x<|endoftext|>", "a" * 5000, " " * 3000 + "x"):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids
