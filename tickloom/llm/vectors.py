"""Vectors packed into blocks: rows of a table as matrices of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST = float(1 << 62)


def longest(df: DataFrame, vec: str) -> int:
    """Entries of the longest vector; 0 if there is none."""
    return max(0, df.agg(F.max(F.size(vec))).first()[0] or 0)


def whole_numbers(column: pa.Array, width: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and floor(scale * entry) + shift of those that do.

    A vector that is null, shorter than ``width`` or holds a null or an entry
    that isn't finite takes no part.
    """
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    m = flat.reshape(len(rows), width)
    good = np.isfinite(m).all(axis=1)
    scaled = np.floor(scale * m[good])
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise OverflowError("an entry is too large for a whole number of 64 bits")
    return rows[good], scaled.astype(np.int64) + shift


def packed(df: DataFrame, vec: str, keep: list[str], width: int, rows: int, scale: float, shift: int = 0) -> DataFrame:
    """(the columns ``keep`` as lists, x, top): a row for each run of at most ``rows`` vectors.

    ``x`` holds the matrix as 64-bit numbers, row after row, and ``top`` its
    largest magnitude.  Runs stay inside a partition, so nothing is shuffled.
    """
    df = df.select(*keep, F.col(vec).alias("__vector"))
    kinds = [df.schema[c].dataType for c in keep]
    schema = T.StructType(
        [T.StructField(c, T.ArrayType(t)) for c, t in zip(keep, kinds, strict=True)]
        + [T.StructField("x", T.BinaryType()), T.StructField("top", T.LongType())]
    )

    def block(held: list[tuple[pa.RecordBatch, np.ndarray]]) -> pa.RecordBatch:
        x = np.concatenate([m for _, m in held])
        t = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), t.column(i).combine_chunks()) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary()), pa.array([int(np.abs(x).max())], pa.int64())], [f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at, x = whole_numbers(batch.column(len(keep)), width, scale, shift)
            done = 0
            while done < len(at):
                m = min(rows - n, len(at) - done)
                part = batch.take(pa.array(at[done : done + m])).select(range(len(keep)))
                held.append((part, x[done : done + m]))
                done, n = done + m, n + m
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return df.mapInArrow(run, schema)


def matrix(cell: pa.Scalar, width: int) -> np.ndarray:
    """The matrix of a block's ``x``."""
    return np.frombuffer(cell.as_buffer(), np.int64).reshape(-1, width)
