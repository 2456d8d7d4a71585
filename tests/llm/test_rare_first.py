"""The closing round's candidates against all pairs of sets."""

import numpy as np

from skyloom.llm.minhash import meetings, rare_first_pairs


def test_no_similar_pair_is_lost(spark):
    rng = np.random.default_rng(3)
    base = np.arange(60)
    sets = []
    for _ in range(120):
        s = base.copy()
        at = rng.choice(60, rng.integers(2, 14), replace=False)
        s[at] = rng.integers(100, 160, len(at))
        sets.append(np.unique(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    top = 0
    members = spark.createDataFrame([(1, i, i if i % 3 else top, top) for i in range(120)], "key int, rep long, component long, top long")
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, s binary")
    got = {tuple(sorted(r)) for r in rare_first_pairs(members, table, 4, 5).collect()}
    comp = [i if i % 3 else top for i in range(120)]
    want = set()
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if comp[i] != comp[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                want.add((j, i))
    assert len(want) > 50 and want <= got


def test_near_misses_seldom_meet(spark):
    """60 large sets at similarity 0.67 to each other: their parity sketches are full, and they met in thousands of shingles."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 63, 2000).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(2000, 210, replace=False)] = rng.integers(1, 1 << 63, 210).astype(np.uint64)
        sets.append(np.unique(s))
    members = spark.createDataFrame([(1, i, i, 0) for i in range(60)], "key int, rep long, component long, top long")
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, s binary")
    assert meetings(members, table, 4, 5).count() < 5 * 60 * 59 / 2
