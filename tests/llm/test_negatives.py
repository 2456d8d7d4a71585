"""Hard negatives against all pairs, and what the index leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import negatives
from skyloom.llm.negatives import Part, fit_codes, hard_negatives, nearest

SCHEMA = "vec_id long, label int, vector array<bigint>, score long, anchor string"


def want(rows, step, positives=5, k=5, low=80, high=100):
    one: dict = {}
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and None not in v:
            one[i] = min(one.get(i, (label, v)), (label, v))
    dim = max((len(v) for _, v in one.values()), default=0)
    full = {i: (label, v + [0] * (dim - len(v))) for i, (label, v) in one.items()}
    out = []
    for a in (i for i in full if i % step == 0):
        dots = {i: sum(x * y for x, y in zip(full[a][1], v)) for i, (_, v) in full.items() if i != a}
        order = sorted(dots, key=lambda i: (-dots[i], i))
        for p in [i for i in order if full[i][0] == full[a][0]][:positives]:
            fits = [i for i in order if full[i][0] != full[a][0] and low * dots[p] <= 100 * dots[i] <= high * dots[p]][:k]
            out += [(a, p, r + 1, i, dots[p], dots[i]) for r, i in enumerate(fits)]
    return sorted(out)


def table_of(rng, n, dim, spread, copies=0):
    centres = rng.normal(0, 200, (12, dim))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, dim))).astype(int)
    x[: copies or 0] = x[0]
    return [(int(i), int(g), v.tolist(), 1, "x") for i, g, v in zip(rng.permutation(n * 2)[:n], rng.integers(0, 4, n), x)]


@pytest.mark.parametrize(("dim", "spread", "copies"), [(8, 30, 0), (5, 150, 0), (6, 1, 120), (1, 5, 10)])
def test_all_pairs(spark, dim, spread, copies):
    rows = table_of(np.random.default_rng(dim), 400, dim, spread, copies)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 9 == 0, block=40)
    assert sorted(map(tuple, got.collect())) == want(rows, 9)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = table_of(rng, 60, 4, 50)
    rows += rows[:5]  # repeated rows
    rows += [(None, 1, [1, 2, 3, 4], 1, ""), (7000, None, [1, 2, 3, 4], 1, ""), (7001, 1, None, 1, ""), (7002, 1, [1, None, 3, 4], None, None)]
    rows += [(7010, 1, [], 1, ""), (7020, 2, [5, 6], 1, ""), (7030, 1, [0, 0, 0, 0], 1, ""), (7030, 1, [9, 9, 9, 9], 1, ""), (7040, 3, [-400, 3, 2, 1], 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == want(rows, 10)
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0, positives=2, negatives=3, low=50, high=90).collect())) == want(rows, 10, 2, 3, 50, 90)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0


def test_large_components(spark):
    """Products beyond what floats hold are exact."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [int(x) for x in rng.integers(-(2**29), 2**29, 4)], 1, "") for i in range(80)]
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 8 == 0).collect())) == want(rows, 8)


def test_heap_order_bounds_and_early_end(monkeypatch):
    """Cells come by falling bounds, no row lies beyond its cell's bounds, and far cells are not scored."""
    rng = np.random.default_rng(9)
    x = (rng.normal(0, 300, (20, 8))[rng.integers(0, 20, 3000)] + rng.normal(0, 5, (3000, 8))).astype(np.int64)
    books = fit_codes(x[:, :4]), fit_codes(x[:, 4:])
    (a, ra), (b, rb) = nearest(x[:, :4].astype(float), books[0]), nearest(x[:, 4:].astype(float), books[1])
    part = Part(np.arange(3000), np.zeros(3000, np.int64), x, a, b, ra, rb, books, 4)
    scored = []
    real = negatives.products
    monkeypatch.setattr(negatives, "products", lambda x, q: scored.append(len(x)) or real(x, q))
    monkeypatch.setattr(negatives, "SCORED", 64)
    for q in x[:20]:
        cells = list(part.cells(q))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True) and len({c[2] for c in cells}) == len(part.starts) - 1
        for up, low, c in cells:
            s = part.x[part.starts[c] : part.starts[c + 1]] @ q
            assert not len(s) or low <= s.min() and s.max() <= up
        found = part.search(q, -1, 0, True, [(-np.inf, np.inf)], 5)[0]
        s = x @ q
        assert found == sorted(zip(s.tolist(), range(3000)), key=lambda t: (-t[0], t[1]))[:5]
    assert sum(scored) < 20 * 3000 / 3
