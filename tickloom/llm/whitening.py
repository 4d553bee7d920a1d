"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, vectors v_1, v_2, ... of one entry a dimension and
u_1, u_2, ... of one entry a row are built in turn so that X V = U B, where B is
upper bidiagonal; the singular values of the small B are those of X, and V
times its right vectors are the components.

Every step is one pass over the blocks: a task works out its rows of X q, then
their part of Xᵀ (X q), and the parts are summed on Spark.  A u is never stored:
it is X c for a c of one entry a dimension, so its products with other u follow
from Xᵀ u, and both sides are reorthogonalised fully without a column of the
size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import written
from tickloom.llm.vectors import longest, matrix, packed

ROWS = 1024
#: A step this small against the Frobenius norm is rounding: the direction adds nothing.
BREAKDOWN = 1e-10
CONVERGED = 1e-15
#: Where X q has more than this share in the earlier u, it is cleared and multiplied once more.
AGAIN = 1e-12
#: Eigenvalues below this share of the largest are those of a dimension that doesn't vary.
FLAT = 1e-12
LONG = float(1 << 63)


@dataclass
class Basis:
    """Components as columns, falling eigenvalues, and the trace of the covariance."""

    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int, want: int, norm: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right singular vectors as columns, steps) of X, given q -> (Xᵀ X q, |X q|²).

    ``norm`` is the Frobenius norm of X.  Ends when the ``want`` largest triplets
    have converged to double precision, or at ``width`` steps.  Where a step breaks
    down (X has fewer independent or repeated directions), it goes on with a new
    vector orthogonal to all earlier ones, so repeated values are all found.
    """
    draw = np.random.default_rng(seed)
    right, coef, images = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((width, 0))
    alphas, betas = [], []

    def cleared(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    def unit() -> np.ndarray:
        w = cleared(draw.standard_normal(width))
        return w / np.linalg.norm(w)

    v, beta = unit(), 0.0
    while True:
        right = np.column_stack([right, v])
        q = v - (beta * coef[:, -1] if alphas else 0)
        z, square = product(q)
        h = coef.T @ z  # products of X q with the earlier u
        if h @ h > AGAIN * square:
            q = q - coef @ h
            z, square = product(q)
            h = coef.T @ z
        q, z = q - coef @ h, z - images @ h
        alpha = float(np.sqrt(max(0.0, square - h @ h)))
        if alpha <= BREAKDOWN * norm:
            alpha, q, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            q, z = q / alpha, z / alpha
        coef, images = np.column_stack([coef, q]), np.column_stack([images, z])
        alphas.append(alpha)
        k = len(alphas)
        w = cleared(z)
        beta = float(np.linalg.norm(w)) if k < width else 0.0
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, rows = np.linalg.svd(small)
        if k == width or k >= want and np.all(beta * np.abs(left[-1, :want]) <= CONVERGED * values[0]):
            return values, right @ rows.T, k
        if beta <= BREAKDOWN * norm:
            beta, v = 0.0, unit()
        else:
            v = w / beta
        betas.append(beta)


def _totals(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, kind: T.DataType) -> np.ndarray:
    """Sum over all blocks of an array each gives; tasks add up their own first, Spark the rest."""
    whole = isinstance(kind, T.LongType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0):
                got = part(matrix(cell, width))
                total = got if total is None else total + got
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.int64() if whole else pa.float64())], ["i", "value"])

    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("value", kind)])
    rows = blocks.select("x").mapInArrow(run, schema).groupBy("i").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(rows)], np.int64 if whole else np.float64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def basis(blocks: DataFrame, width: int, n: int, sums: np.ndarray, want: int) -> Basis:
    """Components of the covariance (divisor n) of all rows of the blocks."""
    squares = _totals(blocks, lambda x: (_centred(x, n, sums) ** 2).sum(axis=0), width, T.DoubleType())
    norm = float(np.sqrt(squares.sum()))
    if norm == 0:
        return Basis(np.zeros((width, 0)), np.zeros(0), 0.0, 0)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            u = c @ q
            return np.append(u @ c, u @ u)

        got = _totals(blocks, part, width, T.DoubleType())
        return got[:-1], float(got[-1])

    values, vectors, steps = bidiagonalised(product, width, min(want, width), norm)
    e = values[:want] ** 2 / n
    keep = e > FLAT * e[0]
    return Basis(vectors[:, : len(e)][:, keep], e[keep], float(squares.sum()) / n, steps)


def _projected(x: np.ndarray, n: int, sums: np.ndarray, b: Basis) -> np.ndarray:
    return _centred(x, n, sums) @ b.vectors / np.sqrt(b.eigenvalues)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums of (n * x - sums) squared, exact; null beyond 64 bits."""
    d = n * x - sums
    rough = (d.astype(np.float64) ** 2).sum(axis=1)
    exact = (d**2).sum(axis=1)
    near = np.flatnonzero(rough >= 0.999 * LONG)
    values = exact.astype(object)
    for i in near:
        true = sum(int(v) ** 2 for v in d[i])
        values[i] = true if true < 1 << 63 else None
    return pa.array(values, pa.int64()) if len(near) else pa.array(exact, pa.int64())


def whitened(df: DataFrame, key: str, vec: str, components: int = 32, scale: float = 64, shift: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Entries become floor(scale * entry) + shift.  A vector that is null, shorter
    than the longest one, or holds a null or an entry that isn't finite is left
    out of the fit and of the result.  Repeated rows and null keys count and are
    returned as they stand; a tie of eigenvalues has some orthonormal pair of its
    plane.  Directions without spread have no component, so the result may have
    fewer components than asked for, and none (no rows) if all rows are equal or
    the table is empty.  ``deviation`` is null where it needs over 64 bits.
    Columns other than the two named are not read, so their names may be any.
    Component signs are arbitrary but the same for all rows.

    The vectors are written once in packed form and read once a step.  The driver
    holds a few matrices of one entry for each pair of dimensions.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    nothing = df.sparkSession.createDataFrame([], schema)
    width = longest(df, vec)
    if not width:
        return nothing
    blocks = written(packed(df.select(F.col(key).alias("key"), vec), vec, ["key"], width, ROWS, scale, shift), "whitening")
    first = _totals(blocks, lambda x: np.append(x.sum(axis=0), len(x)), width, T.LongType())
    if not len(first):
        return nothing
    sums, n = first[:-1], int(first[-1])
    b = basis(blocks, width, n, sums, components)
    k = len(b.eigenvalues)
    if not k:
        return nothing

    def moments(x: np.ndarray) -> np.ndarray:
        w = _projected(x, n, sums, b)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    m = _totals(blocks, moments, width, T.DoubleType()).reshape(k + 1, k)
    mean = m[-1] / n
    error = float(np.abs(m[:-1] / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = b.eigenvalues / b.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, keys = matrix(batch.column(1)[i], width), batch.column(0)[i].values
                rows = len(x)
                at = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    keys.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                    _deviations(x, n, sums).take(at), pa.array(_projected(x, n, sums, b).ravel()),
                    pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ], [f.name for f in schema])

    return blocks.select("key", "x").mapInArrow(run, schema)
