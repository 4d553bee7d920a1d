"""Runs that process every bar exactly once.

A job keeps, per symbol, the last bar it has processed.  A run takes what is
newer, and commits its output and the moved marks as one version: if it dies
before, the next run takes the same bars again, and if it repeats, there is
nothing left to take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources import versions


def marks(spark: SparkSession, root: str, job: str, ts: T.DataType | None = None) -> DataFrame:
    """(symbol, done): the last processed bar of each symbol; ``ts`` is the type of ``done`` before the first run."""
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("done", ts or T.DateType())])
    folder = versions.latest(spark, root).notes.get(f"marks/{job}")
    return spark.read.parquet(f"{root}/{folder}") if folder else spark.createDataFrame([], schema)


def due(spark: SparkSession, root: str, job: str, bars: DataFrame, until: Column | None = None) -> DataFrame:
    """Bars that the job hasn't processed, up to ``until`` (included)."""
    done = marks(spark, root, job, bars.schema["ts"].dataType)
    fresh = bars if until is None else bars.filter(F.col("ts") <= until)
    return fresh.join(done, "symbol", "left").filter(F.col("done").isNull() | (F.col("ts") > F.col("done"))).drop("done")


def prepare(
    spark: SparkSession, root: str, job: str, bars: DataFrame, each: Callable[[DataFrame], DataFrame], until: Column | None = None
) -> Callable[[], versions.Version]:
    """Do a run's work and stage it; the returned function commits it.

    ``each`` turns the due bars into output rows.  Without due bars nothing is
    staged and the commit is the version there is.
    """
    base = versions.latest(spark, root)
    fresh = due(spark, root, job, bars, until)
    if fresh.isEmpty():
        return lambda: base
    out = each(fresh).withColumn("run", F.lit(base.number + 1))
    parts = {f"job={job}/{k}": v for k, v in versions.stage(spark, root, out, ["run"]).items()}
    done = marks(spark, root, job, bars.schema["ts"].dataType)
    moved = done.unionByName(fresh.select("symbol", F.col("ts").alias("done"))).groupBy("symbol").agg(F.max("done").alias("done"))
    folder = versions.stage_table(spark, root, moved)
    return lambda: versions.commit(spark, root, base, parts, {f"marks/{job}": folder})


def process(
    spark: SparkSession, root: str, job: str, bars: DataFrame, each: Callable[[DataFrame], DataFrame], until: Column | None = None
) -> versions.Version:
    """One run: everything due, once."""
    return prepare(spark, root, job, bars, each, until)()


def outputs(spark: SparkSession, root: str, job: str, schema: T.StructType | str) -> DataFrame:
    """All rows the job's committed runs have put out."""
    return versions.read(spark, root, schema, versions.latest(spark, root), lambda k: k.get("job") == job)


def next_start(spark: SparkSession, root: str, job: str, *, data_start: str, overlap_days: int) -> DataFrame:
    """(stalest, start): where the next fetch starts, from the job's own marks; ``data_start`` before the first run."""
    last = marks(spark, root, job).agg(F.min(F.to_date("done")).alias("stalest"))
    first = F.lit(data_start).cast("date")
    return last.select("stalest", F.coalesce(F.greatest(first, F.date_sub("stalest", overlap_days)), first).alias("start"))


def once_sink(root: str, job: str, each: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A streaming sink: a batch's output and its number are one commit, and a batch that was committed is left alone."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = versions.latest(spark, root)
        if int(base.notes.get(f"batch/{job}", -1)) >= batch_id:
            return
        out = each(batch).withColumn("run", F.lit(batch_id))
        parts = {f"job={job}/{k}": v for k, v in versions.stage(spark, root, out, ["run"]).items()}
        versions.commit(spark, root, base, parts, {f"batch/{job}": str(batch_id)})

    return put
