import math
import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.helpers import SF, documents, prose
from wardflow.llm import decontaminate, language, lm, queries, toxicity
from wardflow.llm.common import WordHash, table, words_of


def infix_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


def test_myers_equals_the_table():
    rng = random.Random(2)
    for _ in range(400):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 60))]
        want = infix_distance(p, t)
        assert decontaminate.myers(p, t, len(p)) == want
        assert decontaminate.myers(p, t, want[0] - 1) is None


def test_matches_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(rng.choice([3, 7, 15, 40]), 50 + k, 60)) for k in range(12)] + [(20, ""), (21, None), (22, "..."), (3, prose(15, 53, 60))]
    rows = []
    for i in range(60):
        body = prose(rng.randrange(0, 120), 300 + i, 60).split()
        if i % 3:
            w = list(decontaminate.words(items[rng.randrange(12)][1]))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice([[], ["zz"], ["Yy", "zz"]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        rows.append((i, ", ".join(body)))
    rows += [(70, None), (71, ""), (71, items[5][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    want = Counter()
    for d, t in rows:
        for k, x in items:
            p = decontaminate.words(x)
            if p:
                n, end = infix_distance(p, decontaminate.words(t))
                if n <= decontaminate.budget(len(p)):
                    want[d, k, n, len(p)] += 1
    for size in (1 << 20, 200):
        got = Counter((r["doc_id"], r["item_id"], r["distance"], r["item_words"]) for r in decontaminate.matches(docs, bench, block_bytes=size).collect())
        assert got == want and len(want) > 15
    bad = {d for d, *_ in want}
    kept = decontaminate.clean(docs, bench, block_bytes=200)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect() if r["doc_id"] != 71) == sorted((d, t or "") for d, t in rows if d not in bad and d != 71)
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.clean(documents(spark, []), bench).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 5, 7, 12, 40):
        code = language.codewords(n).astype(int)
        far = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert far >= (1 if n == 2 else 2 ** (n - 2) if n <= 7 else 8)


def test_language_held_out_accuracy(spark):
    got = queries.op7_language(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").toPandas()
    held = [r for r in docs.itertuples() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert got["held_out"].sum() == len(held)
    assert np.mean([got.loc[r.doc_id, "lang_pred"] == r.lang for r in held]) > 0.98
    assert got["score"].between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [(i, "the and of with that") for i in range(30)] + [(30 + i, "der und die nicht ist") for i in range(30)] + [(70, None), (71, ""), (72, "123 !!"), (None, "und die der"), (73, "日本")]
    schema = "doc_id long, text string, lang string, score string, held_out string"
    docs = spark.createDataFrame([(i, t, None if t is None else "de" if t and "der" in t else "en", "x", "x") for i, t in rows], schema)
    got = {(r["doc_id"]): r for r in language.identify(docs).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (70, 71, 72))
    assert got[None]["lang_pred"] == "de" and got[0]["lang_pred"] == "en"
    none = docs.withColumn("lang", docs["source"] if "source" in docs.columns else docs["lang"].substr(5, 0)).where("false")
    assert language.identify(none).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_network_gradients():
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters(np.random.default_rng(0)).items()}
    words, at, first = toxicity.lay_out([b"a bb ccc dd e bb a".split(), [], (b"x y z " * 40).split()])
    inputs, y = toxicity.Inputs(words, WordHash()), np.arange(len(at)) % 2

    def loss():
        z = toxicity.forward(p, inputs.matrix(p).astype(np.float64), at)
        return (np.logaddexp(0, z) - y * z).sum()

    z, saved = toxicity.forward(p, inputs.matrix(p), at, True)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    inputs.back(toxicity.backward(p, saved, toxicity._sigmoid(z) - y, g), g)
    for k, v in p.items():
        i = int(np.argmax(np.abs(g[k])))
        old = v.flat[i]
        v.flat[i] = old + 1e-3
        up = loss()
        v.flat[i] = old - 1e-3
        down = loss()
        v.flat[i] = old
        assert abs((up - down) / 2e-3 - g[k].flat[i]) < 1e-3 * max(1, abs(g[k].flat[i]))


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 200, 1001):
        s = toxicity.windows(n)
        assert {j for a in s for j in range(a, min(a + toxicity.WINDOW, n))} == set(range(n))


def test_toxicity_learns_and_defines_edges(spark):
    bad = ["fool", "scum", "idiot"]
    rows = [(i, prose(40 + i % 60, i) + (f" {bad[i // 2 % 3]}!! {prose(5, i)}" if i % 2 else "")) for i in range(800)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 5000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)] + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(documents(spark, rows), labels).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"] and i < 800} == set(held)
    assert np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.85
    assert got[1000]["score"] == got[1001]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    one = toxicity.detect(documents(spark, rows), labels.where("toxic = 1")).collect()
    assert {r["score"] for r in one} == {1.0}
    assert {r["score"] for r in toxicity.detect(documents(spark, rows), labels.limit(0)).collect()} == {0.0}
    assert toxicity.detect(documents(spark, []), labels).count() == 0


def brute_base(rows):
    held = {i for i, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2}
    c = Counter(w for i, t in rows if i not in held for w in [*words_of(t), b"\n"])
    n, v = sum(c.values()), len(c)
    return {i: (len(words_of(t)) + 1, sum(c[w] > 0 for w in [*words_of(t), b"\n"]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words_of(t), b"\n"])) for i, t in rows}


def test_lm_base_score_and_model(spark):
    rows = [(i, prose(60, i, 90) + f" Rare{i} rare{i % 7}") for i in range(120)] + [(500, None), (501, ""), (None, "w1 W1")]
    for frequent in (lm.FREQUENT, 20):  # all words broadcast, or most joined
        got = {r["doc_id"]: r for r in lm.score(documents(spark, rows), frequent=frequent).collect()}
        for i, (n, known, total, base) in brute_base(rows).items():
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
            assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    assert lm.score(documents(spark, [])).count() == 0


def test_lm_class_probabilities_sum_to_one(spark):
    pairs = spark.createDataFrame([(u, w, 1 + (u * w) % 5) for u in range(30) for w in range(30) if (u + w) % 3], "u int, w int, n long")
    model = lm.fit_classes(pairs, 40)
    u, w = (x.ravel() for x in np.meshgrid(np.arange(33), np.arange(40), indexing="ij"))
    p = (10.0 ** model.of(u, w)).reshape(33, 40)
    assert np.allclose(p.sum(1), 1, atol=1e-4) and (np.diff(model.row)[:30] == 20).all()
    assert (p[30:] == p[30]).all()  # contexts without customers are the parent
    assert len(model.dish) == 600 and model.value.nbytes + model.dish.nbytes == 6 * 600


def test_draws_depend_on_the_row_alone_and_are_binomial():
    key = np.arange(40_000).astype(np.int64)
    at = np.arange(len(key))
    for n, p in ((1, 0.3), (12, 0.02), (40, 0.9), (5000, 0.4)):
        x = lm.Draws(key, 7).binomial(np.full(len(key), n), np.full(len(key), p), at)
        assert abs(x.mean() - n * p) < 0.05 * math.sqrt(n * p * (1 - p)) and abs(x.std() / math.sqrt(n * p * (1 - p)) - 1) < 0.03 and x.min() >= 0 and x.max() <= n
        part = lm.Draws(key[::3].copy(), 7).binomial(np.full(len(key[::3]), n), np.full(len(key[::3]), p), np.arange(len(key[::3])))
        assert (part == x[::3]).all()


def test_seating_keeps_its_bounds():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 10, 1000, 10**7])
    t = lm.seat(c, np.full(6, 5.0), 0.5, rng)
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[1:] >= 1).all() and t[5] > t[3]


def test_lm_query_beats_the_base_on_held_out_rows(spark):
    got = queries.op10_lm_score(spark, SF).toPandas()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_lm_keeps_pairs_of_rare_words(spark):
    """Words beyond the classes of their own, alike in their last letters: only word pairs tell the two texts apart."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(lm.CLASSES)]
    rare = [f"r{i}x" for i in range(120)]
    follows = dict(zip(rare, rng.sample(rare, len(rare))))
    rows = [(i, " ".join(common[j : j + 400] * 2)) for i, j in enumerate(range(0, len(common), 400))]
    rows += [(100 + i, f"{w} {follows[w]}") for i, w in enumerate(rare)]
    ids = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    seen, other = rare[:40], rare[40:80]
    rows += [(ids[0], " ".join(f"{w} {follows[w]}" for w in seen)), (ids[1], " ".join(f"{w} {follows[x]}" for w, x in zip(seen, other)))]
    scores = []
    for frequent, pairs, parts in ((lm.FREQUENT, lm.FREQUENT_PAIRS, 1), (20, 20, 7)):
        docs = documents(spark, rows).repartition(parts)
        got = {r["doc_id"]: r["score"] for r in lm.score(docs, frequent=frequent, frequent_pairs=pairs).collect()}
        assert got[ids[0]] > got[ids[1]] + 10
        scores.append(got)
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 * abs(scores[0][i]) + 1e-9 for i in scores[0])


def test_every_passage_of_25_words_lies_whole_in_a_window():
    for n in (49, 73, 200, 1001):
        starts = toxicity.windows(n)
        assert all(any(s <= a and a + 25 <= s + toxicity.WINDOW for s in starts) for a in range(n - 24))
