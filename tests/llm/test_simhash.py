import itertools
import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import documents, prose
from wardflow.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= radius:
            up[root(a)] = root(b)
    return {f: root(f) for f in fps}


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp, least = brute_components(fps), {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    return sorted(((d, f"{f:016x}", least.get(comp[f])) for (d, _), f in zip(rows, fps)), key=repr)


def corpus():
    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = prose(rng.choice([5, 40, 300, 2500]), k).split()
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edited"
            rows.append(" ".join(copy))
    rows += [None, "", " \n", "one", "One two", rows[0].upper(), rows[0], "Ä ä café x"]
    return [(500 - 2 * i, t) for i, t in enumerate(rows)] + [(3, rows[5]), (3, "another text of id three"), (None, "no id here at all"), (None, rows[9])]


def test_equals_brute_force(spark):
    got = sorted((tuple(r) for r in simhash.detect(documents(spark, corpus())).collect()), key=repr)
    assert got == brute(corpus())


def test_empty_table_and_very_long_text(spark):
    assert simhash.detect(documents(spark, [])).collect() == []
    long = [(1, prose(90_000, 1, 5000)), (2, "a" * 300_000)]
    assert sorted(tuple(r) for r in simhash.detect(documents(spark, long)).collect()) == brute(long)


def cluster(seed, centres, per, flips):
    """Fingerprints close to a few centres."""
    rng, out = random.Random(seed), set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(per):
            f = c
            for _ in range(rng.randrange(flips + 1)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
    return sorted(out)


@pytest.mark.parametrize("tile", [2, 30, 1024])
def test_links_lose_nothing_at_any_tile_size(spark, tile):
    fps = cluster(4, 6, 60, 4) + [0, 1, (1 << 64) - 1]
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = simhash.links(nodes, tile=tile).collect()
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in got]
    want, up = brute_components(fps), {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in pairs:
        assert want[a] == want[b]
        up[root(a)] = root(b)
    assert len({root(f) for f in fps}) == len(set(want.values()))


def test_masks_cover_every_small_difference():
    for level in (1, 2, 3):
        made = simhash.masks(level)
        assert len(made) == 15**level and max(64 - m.bit_count() for _, _, m in made) <= (36, 20, 9)[level - 1]
    table = np.array([m for _, _, m in simhash.masks(1)], np.uint64)
    for some in itertools.combinations(range(64), 3):
        assert ((table & np.uint64(sum(1 << p for p in some))) == 0).any()
    below = simhash.masks(2)
    for t, (_, _, above) in enumerate(simhash.masks(1)):
        free = [p for p in range(64) if not above >> p & 1]
        own = np.array([m for p, _, m in below if p == t], np.uint64)
        assert len(own) == 15 and all(int(m) & above == above for m in own)
        for some in itertools.combinations(free[:18], 3):
            assert ((own & np.uint64(sum(1 << p for p in some))) == 0).any()
