"""Exact quantiles of groups without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def group_quantile(df: DataFrame, keys: list[str], value: Column, p: float, out: str, *, rounds: int = 1) -> DataFrame:
    """(keys, out): the ``p`` quantile of each group, interpolated between neighbours.

    Equal values are counted together before the shuffle.  A round cuts a group's
    range into ``BINS``, counts, and keeps only the bins that hold the wanted ranks,
    so what is sorted at the end is about 1/BINS of a group for each round.  The
    result doesn't depend on the rounds.  Nulls don't count; a group without values
    has no row.  NaN is above all numbers.
    """
    live = df.select(*keys, value.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # Ranks are from 0; _below counts what lies under the rows that are left.
    at = p * (F.sum("_n") - 1)
    ranks = live.groupBy(*keys).agg(F.floor(at).alias("_lo"), F.ceil(at).alias("_hi"), at.alias("_at"), F.lit(0).cast("long").alias("_below"))
    for _ in range(rounds):
        ends = live.groupBy(*keys).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        width = F.col("_max") - F.col("_min")
        inner = F.least(F.floor((F.col("_v") - F.col("_min")) / width * BINS), F.lit(BINS - 1))
        # A width that isn't finite (or NaN values) leaves two bins: the largest value and the rest.
        odd = F.isnan("_max") | (F.abs(width) == F.lit(float("inf")))
        bin_ = F.when(F.col("_v") == F.col("_max"), BINS).when(odd, 0).otherwise(inner)
        binned = live.join(ends, keys).withColumn("_bin", bin_.cast("int")).drop("_min", "_max")
        counts = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))
        upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        c = counts.withColumn("_upto", upto).join(ranks, keys).withColumn("_upto", F.col("_upto") + F.col("_below"))
        holds = lambda r: (F.col("_upto") > F.col(r)) & (F.col("_upto") - F.col("_m") <= F.col(r))
        kept = c.filter(holds("_lo") | holds("_hi"))
        # Between the two wanted bins there are no rows, so those under the first are all that are under.
        ranks = kept.groupBy(*keys).agg(*[F.max(x).alias(x) for x in ("_lo", "_hi", "_at")], F.min(F.col("_upto") - F.col("_m")).alias("_below"))
        live = binned.join(kept.select(*keys, "_bin"), [*keys, "_bin"]).drop("_bin")
    run = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    d = live.withColumn("_run", run).join(ranks, keys).withColumn("_run", F.col("_run") + F.col("_below"))
    low, high = (F.min(F.when(F.col("_run") > F.col(r), F.col("_v"))) for r in ("_lo", "_hi"))
    g = d.groupBy(*keys).agg(low.alias("_l"), high.alias("_h"), F.max(F.col("_at") - F.col("_lo")).alias("_f"))
    return g.select(*keys, F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise(F.col("_l") * (1 - F.col("_f")) + F.col("_h") * F.col("_f")).alias(out))
