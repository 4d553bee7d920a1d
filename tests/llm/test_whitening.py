"""Whitening: bidiagonalisation against a dense decomposition, brute force, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(m):
    return [(i, [float(c) for c in r]) for i, r in enumerate(np.float32(m))]


def brute(rows, want=32):
    """Integers, covariance and eigenvectors of one array."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    dev = [int(d) for d in ((n * x - s).astype(object) ** 2).sum(axis=1)]
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:want], v[:, ::-1][:, :want]
    keep = e > 1e-12 * e[0]
    return n, dev, c @ v[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(c.T @ c / n)


def check(got, rows, want=32):
    n, dev, white, explained = brute(rows, want)
    k = white.shape[1]
    assert len(got) == n * k and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    mine = np.array([[by[i, j + 1].whitened for j in range(k)] for i, _ in rows])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-7
    assert [by[i, 1].deviation for i, _ in rows] == dev
    assert np.allclose([by[rows[0][0], j + 1].explained for j in range(k)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_brute_force(spark):
    g = np.random.default_rng(0)
    rows = rows_of(g.standard_normal((700, 40)) @ np.diag(np.linspace(0.3, 3, 40)) @ g.standard_normal((40, 40)) + 2)
    check(W.whitened(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect(), rows)


def test_fewer_dimensions_than_components(spark):
    rows = rows_of(np.random.default_rng(1).standard_normal((90, 5)) * [1, 2, 3, 4, 5])
    check(W.whitened(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect(), rows)


def test_dimensions_without_spread_or_repeated(spark):
    m = np.random.default_rng(2).standard_normal((200, 6))
    m[:, 1], m[:, 2] = 4.0, m[:, 0]
    rows = rows_of(m)
    got = W.whitened(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()
    check(got, rows)
    assert max(r.component for r in got) == 4


def test_repeated_eigenvalues_are_all_found():
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((9, 9)))
    e = np.array([5.0, 5, 5, 2, 2, 1, 0.5, 0, 0])
    a = q @ np.diag(e) @ q.T
    x = np.sqrt(e)[:, None] * q.T
    values, vectors, _ = W.bidiagonalised(lambda v: (x.T @ (x @ v), float((x @ v) @ (x @ v))), 9, 9, float(np.sqrt(e.sum())))
    assert np.allclose(values**2, e, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(9), atol=1e-13)
    assert np.allclose(a @ vectors[:, :7], vectors[:, :7] * e[:7], atol=1e-11)


def test_ends_early_where_few_components_stand_out():
    g = np.random.default_rng(4)
    q, _ = np.linalg.qr(g.standard_normal((200, 200)))
    e = np.concatenate([[1e6, 3e5, 1e5], np.full(197, 1e-6)])
    x = np.sqrt(e)[:, None] * q.T
    values, _, steps = W.bidiagonalised(lambda v: (x.T @ (x @ v), float((x @ v) @ (x @ v))), 200, 3, float(np.sqrt(e.sum())))
    assert steps < 20 and np.allclose(values[:3] ** 2, e[:3], rtol=1e-12)


def test_rows_left_out_and_odd_tables(spark):
    rows = rows_of(np.random.default_rng(5).standard_normal((60, 4)))
    bad = [(100, None), (101, [None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 4), (103, [float("-inf")] * 4), (104, []), (105, [1.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    check(W.whitened(df, "vec_id", "embedding").collect(), rows)
    for some in ([], bad[:1], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        assert W.whitened(spark.createDataFrame(some, SCHEMA), "vec_id", "embedding").collect() == []


def test_null_keys_and_repeated_rows_are_returned(spark):
    rows = [(None, [1.0, 0.0]), (7, [0.0, 3.0]), (7, [0.0, 3.0]), (8, [2.0, -1.0])]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == [(-1, 1), (-1, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]


def test_other_columns_and_other_keys(spark):
    rows = rows_of(np.random.default_rng(6).standard_normal((30, 3)))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    for c in ("key", "x", "top", "component", "n"):
        df = df.withColumn(c, F.lit(0))
    got = W.whitened(df, "vec_id", "embedding").collect()
    assert len(got) == 90 and got[0].vec_id[0] == "v"


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1e9]), (2, [-1e9]), (3, [0.0])]
    got = {r.vec_id: r.deviation for r in W.whitened(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()}
    assert got[1] is None and got[2] is None and got[3] == 0
