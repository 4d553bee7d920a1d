"""Hard negatives: exact products by residues, brute force, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    """The same by Python's whole numbers, one anchor at a time."""
    ok = [(i, [int(np.floor(256 * float(c))) for c in v], l) for i, v, l in rows if None not in (i, v, l) and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, v, l in ok:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in ok if j != i), key=lambda t: t[:2])
        for s, j, _ in [t for t in scored if t[2] == l][:positives]:
            window = [t for t in scored if t[2] != l and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(i, j, k, t[1], -s, -t[0]) for k, t in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, N.mined(df, "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0, **kw).collect()))


def vectors(n, width, seed=0, spread=1.0):
    g = np.random.default_rng(seed)
    centre = g.standard_normal((4, width))
    return [(int(i), [float(c) for c in np.float32(centre[i % 4] * 0.5 + spread * g.standard_normal(width))], int(g.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("bound", [1, 10**3, 10**6, 10**12, 10**17])
def test_signed_numbers_come_back(bound):
    primes = N.primes_for(bound)
    v = np.array([0, 1, -1, bound, -bound, bound // 3, -(bound // 7)], np.int64)
    assert (N.rebuilt([v % p for p in primes], primes) == v).all()


@pytest.mark.parametrize("width", [1, 63, 64, 65, 300])
def test_products_are_exact(width):
    g = np.random.default_rng(width)
    a, b = g.integers(-40_000, 40_000, (7, width)), g.integers(-40_000, 40_000, (9, width))
    primes = N.primes_for(width * 40_000**2)
    assert (N.scores(N.residues(a, primes), N.residues(b, primes), primes) == a @ b.T).all()
    assert max(N.RUN * (p // 2) ** 2 for p in primes) < 1 << 24


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "ANCHORS", 3)
    monkeypatch.setattr(N, "ROWS", 37)
    rows = vectors(401, 20)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_long_vectors_and_large_entries(spark):
    rows = [(i, [float(np.float32(c * 300)) for c in v], l) for i, v, l in vectors(120, 130, seed=3)]
    assert mined(spark, rows) == brute(rows) != []


def test_ties_and_repeated_rows(spark):
    rows = vectors(60, 6, seed=1)
    rows += [(i + 200, v, l) for i, v, l in rows] + [(i + 400, v, (l + 1) % 4) for i, v, l in rows]
    assert mined(spark, rows) == brute(rows)
    twice = rows + [r for r in rows if r[0] == 50]
    assert mined(spark, twice) == brute(twice)


def test_rows_that_take_no_part(spark):
    rows = vectors(150, 5, seed=2)
    bad = [(None, rows[0][1], 1), (300, None, 1), (350, rows[0][1], None), (400, [None, *rows[0][1][1:]], 1), (450, [float("nan")] * 5, 1), (501, [float("inf")] * 5, 2)]
    assert mined(spark, rows + bad) == brute(rows)
    assert mined(spark, rows + [(550, [1.0], 1), (600, [], 2)]) == brute(rows)


def test_nothing_to_find(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [], 1), (1, [], 2)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(0, [None], 1), (50, None, 1)]) == []


def test_other_columns_are_not_read(spark):
    rows = vectors(120, 4, seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("ids", "labels", "x", "g", "block", "rank", "score", "asks", "anchor_id"):
        df = df.withColumn(c, F.lit("?"))
    got = N.mined(df, "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_too_large(spark):
    with pytest.raises(OverflowError):
        mined(spark, [(0, [1e7] * 3, 1), (1, [1e7] * 3, 1)], scale=1e3)
