import hashlib
from collections import Counter

import pytest

from tests.llm.helpers import documents, prose
from wardflow.llm import alignment


def byte_alphabet():
    """The printable stand-ins of byte-level vocabularies, character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def brute(rows):
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    alphabet, docs = byte_alphabet(), []
    for d, text in rows:
        spans = None
        if text:
            whole = (" " + text).encode()
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids[1])]
            if all(b"".join(r) == whole for r in raw):
                spans = []
                for side, pieces in zip(ids, raw):
                    at, out = 0, []
                    for i, p in zip(side, pieces):
                        out.append((i, at, at + len(p)))
                        at += len(p)
                    spans.append(out)
        docs.append((d, spans))
    links = [[(x, y) for x, s, e in sp[0] for y, s2, e2 in sp[1] if s < e2 and s2 < e] if sp else [] for _, sp in docs]
    count = Counter(p for ls in links for p in ls)
    most = {}
    for (x, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (d, sp), ls in zip(docs, links):
        if not sp:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in sp[0]} & {e for _, _, e in sp[1]})
        text, low = [], 0
        for c in cuts:
            text.append("|".join(",".join(str(i) for i, _, e in side if low < e <= c) for side in sp))
            low = c
        digest = hashlib.sha256(";".join(text).encode()).hexdigest()
        out.append((d, len(sp[0]), len(sp[1]), len(cuts), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), digest))
    return sorted(out, key=repr)


def corpus():
    texts = [prose(60, k) for k in range(12)] + [
        None, "", " ", "\n\t x", "a", "The quick brown fox can't stop; it's 12345 o'clock.", "<|endoftext|> </s> <s> <unk> <0x41>", "ein ▁ Zeichen", "naïve café — 東京都 \U0001f600\U0001f468‍\U0001f469", "  two  spaces   three\n\n\nlines\r\n",
        "internationalization antidisestablishmentarianism", "x" * 700, "½ Ⅷ ﬁ", "\x00\x01 nul",
    ]
    return [(100 - k, t) for k, t in enumerate(texts)] + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, "no id")]


@pytest.mark.parametrize("limit", [0, 40, 1 << 18])
def test_report_equals_plain_alignment(spark, limit):
    got = sorted((tuple(r) for r in alignment.report(documents(spark, corpus()).repartition(3), limit).collect()), key=repr)
    assert got == brute(corpus())


def test_empty_table_and_very_long_text(spark):
    assert alignment.report(documents(spark, [])).collect() == []
    ((_, n_a, n_b, n_groups, n_links, n_best, total, digest),) = alignment.report(documents(spark, [(1, prose(60_000, 2, 3000))])).collect()
    assert min(n_a, n_b) > 60_000 and n_links == n_a + n_b - n_groups and n_best <= n_links <= total and len(digest) == 64


def test_frequent_pairs_are_bounded(spark):
    counts = spark.createDataFrame([(i, 1 << (i % 5)) for i in range(50)], "pair long, count long")
    for limit in (0, 9, 10, 25, 50, 99):
        least = alignment.frequent_from(counts, limit)
        assert counts.where(f"count >= {least}").count() == min(limit // 10 * 10, 50)


def test_segments_give_the_ids_of_the_whole_text():
    import random

    rng, signs = random.Random(1), ["a", "the", "ing", " ", "  ", "\n", "\t", " ", "　", "\x1c", "'s", "12", "é", "东", ".", "<0x0A>", "́", "\U0001f600", "-"]
    files = alignment.paths()
    encode_a, _, encode_b, _ = alignment.encoders(files)
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30)))
        segments = alignment.SPACE.split(text)
        assert [i for s in segments for i in encode_a(" " + s)] == encode_a(" " + text), repr(text)
        assert [i for ids in encode_b(segments) for i in ids] == encode_b([text])[0], repr(text)
