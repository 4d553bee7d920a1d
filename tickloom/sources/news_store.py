"""The article archive on disk and the published signal document."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.news import merge_archive
from tickloom.sources.bars import exists

SYMBOL = "STRUCT<score: DOUBLE, relative: DOUBLE, raw_score: DOUBLE, articles: BIGINT, weight: DOUBLE, top_headline: STRING>"
DOCUMENT = (
    "as_of STRING, macro DOUBLE, macro_articles BIGINT, total_articles BIGINT, mean_score DOUBLE, "
    f"sources MAP<STRING, BIGINT>, symbols MAP<STRING, {SYMBOL}>"
)


def _month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def append_articles(spark: SparkSession, root: str, fresh: DataFrame) -> int:
    """Merge ``fresh`` into the archive under ``root``; returns the number of new uids.

    ``fresh`` has collected_at.  The archive is partitioned by the month of the
    story.  Which uids are known is read from two columns of it; only months that
    get a new story or a new symbol are rewritten, each from a staged copy, so a
    batch that runs again changes nothing and old months are not touched.
    """
    path = f"{root}/articles"
    batch = merge_archive(fresh.limit(0), fresh)
    if not exists(spark, path):
        batch.withColumn("month", _month(F.col("ts"))).repartition("month").write.partitionBy("month").parquet(path)
        return spark.read.parquet(path).count()
    prior = spark.read.parquet(path)
    known = prior.select("uid", F.col("month").cast("string").alias("_month"), F.col("symbols").alias("_had"))
    d = batch.join(known, "uid", "left")
    more = F.size(F.array_except("symbols", F.coalesce("_had", F.array().cast("array<string>")))) > 0
    d = d.withColumn("_new", F.col("_month").isNull()).filter(F.col("_new") | more)
    d = d.withColumn("_month", F.coalesce("_month", _month(F.col("ts")))).drop("_had")
    stage = f"{root}/stage-{uuid.uuid4().hex}"
    d.write.parquet(stage)
    d = spark.read.parquet(stage)
    # Months are bounded by the calendar.
    sizes = d.groupBy("_month").agg(F.count_if("_new").alias("n")).collect()
    if not sizes:
        return 0
    old = prior.filter(F.col("month").isin(*[r["_month"] for r in sizes])).drop("month")
    out = merge_archive(old, d.select(*old.columns)).withColumn("month", _month(F.col("ts")))
    out.write.parquet(stage + "-out")
    done = spark.read.parquet(stage + "-out").repartition("month")
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return sum(r["n"] for r in sizes)


def articles_since(spark: SparkSession, root: str, since: datetime | str | None = None) -> DataFrame:
    """Archived articles from ``since`` on; earlier months are not read.  Without an archive there are none."""
    path = f"{root}/articles"
    if not exists(spark, path):
        t = "uid STRING, ts TIMESTAMP, source STRING, kind STRING, title STRING, summary STRING, url STRING, symbols ARRAY<STRING>, collected_at TIMESTAMP"
        return spark.createDataFrame([], t)
    d = spark.read.parquet(path)
    if since is not None:
        at = F.lit(since).cast("timestamp")
        d = d.filter((F.col("month").cast("string") >= _month(at)) & (F.col("ts") >= at))
    return d.drop("month")


def signal_document(symbols: DataFrame, macro: DataFrame) -> DataFrame:
    """One JSON document per instant: ``as_of`` and ``json``, numbers to six places, names sorted.

    An instant's symbols are at most the universe.  An instant without symbols
    has an empty map.
    """
    r = lambda c: F.round(c, 6).alias(c)
    v = F.struct(r("score"), r("relative"), r("raw_score"), "articles", r("weight"), "top_headline")
    per = symbols.groupBy("as_of").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", v.alias("v"))))).alias("symbols"), F.max("mean_score").alias("mean_score"),
    )
    d = macro.join(per, "as_of", "left")
    doc = F.struct(
        F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("as_of"), r("macro"), "macro_articles", "total_articles",
        F.round(F.coalesce("mean_score", F.lit(0.0)), 6).alias("mean_score"), "sources",
        F.coalesce("symbols", F.from_json(F.lit("{}"), f"MAP<STRING, {SYMBOL}>")).alias("symbols"),
    )
    return d.select("as_of", F.to_json(doc).alias("json"))


def publish_signal(documents: DataFrame, path: str) -> None:
    """Write documents as text, one a line; a publication replaces the one before."""
    documents.select("json").write.mode("overwrite").text(path)


def read_signal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(symbol rows, head rows) of what is published; absent or unreadable files are no news.

    Fields a document lacks have their defaults; a missing ``relative`` is the score.
    """
    text = spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")
    good = F.filter(F.array(F.from_json("value", DOCUMENT)), lambda x: x["as_of"].isNotNull())
    d = text.select(F.inline(good))
    zero = lambda c, k: F.coalesce(c, F.lit(0).cast(k)).alias(c)
    head = d.select("as_of", zero("macro", "double"), zero("macro_articles", "long"), zero("total_articles", "long"), zero("mean_score", "double"), "sources")
    s = d.select("as_of", F.explode("symbols").alias("symbol", "v")).filter("v.score IS NOT NULL")
    v = lambda c, other: F.coalesce(F.col(f"v.{c}"), other).alias(c)
    score = F.col("v.score")
    rows = s.select(
        "as_of", "symbol", score.alias("score"), v("relative", score), v("raw_score", score), v("articles", F.lit(0)),
        v("weight", F.lit(0.0)), v("top_headline", F.lit("")),
    )
    return rows, head
