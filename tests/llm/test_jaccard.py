import itertools
import random

import numpy as np

from tests.llm.helpers import documents, prose
from wardflow.llm import jaccard
from wardflow.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Component (least id) of each row's set by testing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            up[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def corpus():
    rng = random.Random(3)
    rows, passage = [], prose(60, 99)
    for k in range(40):
        base = prose(rng.choice([12, 60, 200, 900]), k).split()
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + max(2, len(base) // 60))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [passage + " " + prose(30, 500 + i) for i in range(30)]  # a passage many share
    rows += [rows[0].upper(), rows[0], "one two", "One two", "a b c d e", ""]
    chain = prose(100, 7).split()  # neighbours link, ends do not
    for i in range(8):
        rows.append(" ".join(f"c{j}" if j < 2 * i else w for j, w in enumerate(chain)))
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)] + [(5, None), (None, "lonely words stand here now"), (7, "same id"), (7, "other text")]


def test_join_equals_brute_force(spark):
    rows = corpus()
    got = jaccard.join(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    want = [(d, n, c if n else d) for d, n, c in brute(rows)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_join_of_an_empty_table(spark):
    assert jaccard.join(documents(spark, [])).count() == 0
    assert jaccard.deduplicate(documents(spark, [])).count() == 0


def test_deduplicate_keeps_one_row_of_each_group(spark):
    rows = corpus() + [(7, "same id")]
    docs = documents(spark, rows)
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in kept.collect())
    comps = brute(rows)
    groups = {c if c is not None else ("null", t) for (_, n, c), (_, t) in zip(comps, rows) if n}
    empty = sum(1 for _, n, _ in comps if not n)
    assert len(got) == len(groups) + empty
    assert {d for d, t in got if t.strip() and d >= 0} == {g for g in groups if not isinstance(g, tuple)}


def test_bounds_and_tree_search():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(30, 400), dtype=np.uint64)
        for _ in range(rng.integers(1, 4)):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 2**63, len(base), dtype=np.uint64), base)))
    sets.sort(key=len)
    vecs = [jaccard.vector(s) for s in sets]
    tree = jaccard.Tree(np.array([len(s) for s in sets]), vecs)
    links = 0
    for i, a in enumerate(sets):
        hits = set(tree.after(i))
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(a, sets[j]))
            assert jaccard.bound(vecs[i], vecs[j]) >= common
            if 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                links += 1
                assert j in hits
                assert len(np.intersect1d(a[: jaccard.front(len(a))], sets[j][: jaccard.front(len(sets[j]))]))
                assert jaccard.linked(a, sets[j])
    assert links > 20


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 299), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 299: 299, 300: 299}


def test_sets_move_at_most_twice_to_be_verified(spark):
    passage = prose(80, 1).split()
    rows = [(i, " ".join(passage[:70] + [f"x{i}"])) for i in range(6)] * 2 + [(9, prose(80, 2)), (None, " ".join(passage))]
    docs = documents(spark, rows).selectExpr("cast(doc_id AS long) AS doc_id", "text")
    sets = jaccard.cut(jaccard.shingle_sets(docs, jaccard.levels(docs)), "test-sets")
    node = {r["doc_id"]: r["node"] for r in sets.collect()}
    pairs = spark.createDataFrame([(node[0], node[i]) for i in (1, 2, 3, 9, None)], "a long, b long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = jaccard._verified(docs, sets, pairs)
        assert sorted(map(tuple, links.collect())) == sorted((node[0], node[i]) for i in (1, 2, 3, None))
        lines = jaccard._verified(docs, sets, pairs)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    read = next(i for i, x in enumerate(lines) if "MapInArrow read(" in x)
    above, least = [], depth(lines[read])
    for x in reversed(lines[:read]):
        if depth(x) < least:
            least = depth(x)
            above.append(x)
    assert sum("Exchange" in x for x in above) == 2, lines  # by node, then by star
