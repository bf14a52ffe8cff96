import hashlib
import math
import random

import numpy as np
import pytest

from wardflow.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, q string"


def brute(rows, dims=4, k=3, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(64 * float(np.float32(x))) for x in v)))
    least = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    cents = [q for _, q in least[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        mine = [[] for _ in cents]
        for _, q in kept:
            mine[near(q)[1]].append(q)
        cents = [tuple(sum(x) // len(m) for x in zip(*m)) if m else c for m, c in zip(mine, cents)]
    out = [(i, near(q)[1], near(q)[0]) for i, q in kept]
    total = {c: sum(d for _, g, d in out if g == c) for c in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for i, c, d in out), key=repr)


def rows_of():
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, -0.01, 0.0, 0.3]) + rng.randrange(3) / 64 for _ in range(4)]) for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [0.1]), (902, [0.1, None, 0.0, 0.0]), (903, [0.1, math.inf, 0.0, 0.0]), (904, [math.nan, 0.1, 0.0, 0.0]), (905, [0.25] * 5)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width,chunk,parts", [(1, 16, 3), (2, 1000, 1), (3, 7, 5)])
def test_report_equals_plain_clustering(spark, width, chunk, parts):
    df = frame(spark, rows_of()).repartition(parts)
    assert got(clustering.report(df, dims=4, k=3, width=width, chunk=chunk)) == brute(rows_of())


def test_empty_few_and_equal_vectors(spark):
    assert got(clustering.report(frame(spark, []), dims=4)) == []
    few = [(1, [0.5, 0.5, 0.0, 0.0]), (2, [-0.5, 0.5, 0.0, 0.0])]
    assert got(clustering.report(frame(spark, few), dims=4, k=16)) == brute(few, k=16)
    same = [(i, [0.25, 0.0, 0.0, 0.0]) for i in range(40)]  # all centroids equal: the least number takes all
    assert got(clustering.report(frame(spark, same), dims=4, k=3)) == brute(same)


def test_dictionaries_hold_distinct_subvectors_without_loss():
    q = np.array([[1, 2, 3], [1, 2, -4], [5, 2, 3], [1, 2, 3]], np.int64)
    words, codes = clustering.encode(q, 2)
    assert [len(w) for w in words] == [2, 2]
    assert (np.concatenate([w[c] for w, c in zip(words, codes.T)], 1) == q).all()


def test_integers_that_may_overflow_are_refused(spark):
    with pytest.raises(Exception, match="reaches"):
        clustering.report(frame(spark, [(1, [3e30, 0.0, 0.0, 0.0])]), dims=4).collect()
