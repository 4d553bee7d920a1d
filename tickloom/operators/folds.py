"""Time folds: walk-forward, purged k-fold, combinatorial purged paths.

Dates are numbered once; folds and paths are small tables of index bounds, and
membership is an equi-join on the fold or group a row falls in.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.evaluate import rank_ic
from tickloom.operators.series import RN, index_series, calendar_chunk


def date_index(panel: DataFrame) -> DataFrame:
    """Distinct dates with their 0-based position."""
    return index_series(panel.select("ts").distinct(), [], ["ts"], calendar_chunk("ts", 512))


def fold_table(
    panel: DataFrame, *, horizon: int = 20, refit_every: int = 21, min_train: int = 252, embargo: int = 5
) -> DataFrame:
    """The walk-forward folds with their sizes, in one pass over the panel.

    Rows combine to two counts a date before the shuffle; all that follows works
    on one row a date, so its unpartitioned window is bounded by the calendar.
    """
    days = panel.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("labelled"))
    w = Window.orderBy("ts")
    upto = F.sum("labelled").over(w.rowsBetween(Window.unboundedPreceding, 0))
    days = days.select("ts", "n", (F.row_number().over(w) - 1).alias("rn"), upto.alias("upto"))
    first, gap = min_train + horizon + embargo, horizon + embargo + 1
    days = days.withColumns({"cut": F.lag("ts", gap).over(w), "known": F.lag("upto", gap).over(w)}).filter(F.col("rn") >= first)
    return days.groupBy(F.floor((F.col("rn") - first) / refit_every).alias("fold")).agg(
        F.min_by("cut", "rn").alias("train_end"), F.min("ts").alias("pred_start"), F.max("ts").alias("pred_end"),
        F.min_by("known", "rn").alias("n_train"), F.sum("n").alias("n_pred"),
    )


def group_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """First and last index of k contiguous groups, the first n % k one longer."""
    size, extra = divmod(n, k)
    out, lo = [], 0
    for i in range(k):
        hi = lo + size + (1 if i < extra else 0)
        out.append((lo, hi - 1))
        lo = hi
    return out


def group_of(rn: Column, n: int, k: int) -> Column:
    size, extra = divmod(n, k)
    cut = extra * (size + 1)
    return F.when(rn < cut, F.floor(rn / (size + 1))).otherwise(extra + F.floor((rn - cut) / max(size, 1)))


def purged_kfold(dates: DataFrame, n: int, *, k: int = 5, purge: int = 21, embargo: int = 21) -> DataFrame:
    """(rn, fold, role): the test fold, and train rows outside its purge zone."""
    if n < k * (purge + embargo + 2):
        raise ValueError(f"{n} samples are too few for {k} folds")
    roles = [
        F.struct(F.lit(i).alias("fold"), _role(F.col(RN), [b], purge, embargo, n).alias("role"))
        for i, b in enumerate(group_bounds(n, k))
    ]
    return dates.select(RN, F.inline(F.array(*roles))).filter("role IS NOT NULL")


def combinatorial_purged(dates: DataFrame, n: int, *, groups: int = 10, test: int = 2, purge: int = 21, embargo: int = 21) -> DataFrame:
    """(rn, path, role) for every choice of ``test`` groups."""
    bounds = group_bounds(n, groups)
    roles = [
        F.struct(F.lit(p).alias("path"), _role(F.col(RN), [bounds[g] for g in combo], purge, embargo, n).alias("role"))
        for p, combo in enumerate(combinations(range(groups), test))
    ]
    return dates.select(RN, F.inline(F.array(*roles))).filter("role IS NOT NULL")


def _role(rn: Column, tests: list[tuple[int, int]], purge: int, embargo: int, n: int) -> Column:
    is_test, near = F.lit(False), F.lit(False)
    for lo, hi in tests:
        is_test = is_test | rn.between(lo, hi)
        near = near | rn.between(max(0, lo - purge), min(n - 1, hi + purge + embargo))
    return F.when(is_test, "test").when(~near, "train")


def walk_forward_scores(
    spark: SparkSession, panel: DataFrame, features: list[str], folder: str, *, horizon: int = 20, refit_every: int = 21,
    min_train: int = 252, embargo: int = 5, max_iter: int = 50, seed: int = 7,
) -> DataFrame:
    """Out-of-sample scores of a boosted-tree model refit per fold.

    The panel is written once to ``folder``, partitioned by the fold that predicts
    a date, so a fit reads the earlier folds and a scoring its own; each fold's
    scores are appended there.  Each fit and each scoring is a distributed Spark
    job; only the fold bounds (one row per refit) reach the driver.  Trees have
    the original's depth, step and sampling; leaf growth differs between
    libraries, so scores agree in information, not in digits.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    folds = fold_table(panel, horizon=horizon, refit_every=refit_every, min_train=min_train, embargo=embargo)
    bounds = folds.orderBy("fold").collect()
    if not bounds:
        raise ValueError("not enough dates for one walk-forward fold")
    starts = F.array(*[F.lit(f.pred_start) for f in bounds])
    block = F.size(F.filter(starts, lambda s: s <= F.col("ts"))) - 1  # -1 before the first fold
    kept = panel.select("ts", "symbol", "target", *features).withColumn("_block", block)
    kept.repartition("_block").write.partitionBy("_block").parquet(folder + "/panel")
    vec = VectorAssembler(inputCols=features, outputCol="_x").transform(spark.read.schema(kept.schema).parquet(folder + "/panel"))
    gbt = GBTRegressor(
        featuresCol="_x", labelCol="target", predictionCol="score", maxDepth=5, stepSize=0.03, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", minInstancesPerNode=100, maxIter=max_iter, seed=seed,
    )
    for i, f in enumerate(bounds):
        train = vec.filter((F.col("_block") < i) & (F.col("ts") <= F.lit(f.train_end)) & F.col("target").isNotNull())
        s = gbt.fit(train).transform(vec.filter(F.col("_block") == i)).select("ts", "symbol", "score", "target")
        s.write.mode("append").parquet(folder + "/scores")
    return spark.read.parquet(folder + "/scores")


def write_ranker(folder: str, scores: DataFrame) -> None:
    """A ranker's outputs: ``scores`` (ts, symbol, score, target) by year, and ``rank_ic`` (ts, ic)."""
    kept = scores.select("ts", "symbol", "score", "target", F.year("ts").alias("year"))
    kept.repartition("year").sortWithinPartitions("ts", "symbol").write.mode("overwrite").partitionBy("year").parquet(f"{folder}/scores")
    rank_ic(scores.sparkSession.read.parquet(f"{folder}/scores")).write.mode("overwrite").parquet(f"{folder}/rank_ic")


def read_ranker(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(scores, rank_ic) of a run."""
    return spark.read.parquet(f"{folder}/scores").drop("year"), spark.read.parquet(f"{folder}/rank_ic")
