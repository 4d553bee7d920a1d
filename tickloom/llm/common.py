"""Helpers the operators share: Arrow columns, text batches, span keys, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import shared_folder

SLICE_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes; one row at least."""
    n = batch.num_rows
    rows = max(1, int(n * most / max(most, batch.nbytes)))
    for i in range(0, n, rows):
        yield batch.slice(i, rows)


def append_arrow(
    df: DataFrame,
    inputs: list[str],
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., Iterable[pa.Array]]],
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Append columns computed in tasks, slice by slice; all other columns pass through.

    Where a column of a new one's name (in any case) is there already, the new one gets
    underscores behind its name.  ``make`` runs once in each task and returns the function of the input
    arrays.  No shuffle; memory is one slice.
    """
    at = [df.columns.index(c) for c in inputs]
    taken = {c.lower() for c in df.columns}
    schema = T.StructType(df.schema.fields)
    for name, kind in fields:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        schema = T.StructType([*schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, names = make(), [f.name for f in schema.fields]
        for batch in batches:
            for part in slices(batch, most):
                yield pa.RecordBatch.from_arrays([*part.columns, *fn(*(part.column(i) for i in at))], names)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def int_lists(chunks: list[bytes], counts: list[int]) -> pa.Array:
    """An array<int> column from each row's ids as packed 32-bit values."""
    ends = [0]
    for n in counts:
        ends.append(ends[-1] + n)
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(chunks))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder under the shared one and read back: cuts lineage,
    and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root), root the least node.

    Alternates large-star and small-star steps until nothing changes; each
    round's edges are written to the shared folder.  Every step is a grouped
    minimum (combined before the shuffle) joined back to the edges, so a node
    with very many edges is split by the skew join, never gathered in a task.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = _content(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u points to u's least neighbour.
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        e = written(large.join(least, "u").select(to.alias("u"), F.col("m").alias("v")).distinct(), "edges")
        was, state = state, _content(e)
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _content(e: DataFrame) -> tuple:
    """What a set of distinct edges holds, as a count and two hash sums."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
