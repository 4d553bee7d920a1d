"""The model's tables derived from a folder of star-schema Parquet tables.

``lineitem`` acts as the tape: a tick per line, symbol from the part, price
from extended price per unit.  The other tables give the benchmark, intraday
bars, fills, the ledger and articles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.bars import bars_from_ticks

TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_order() -> Column:
    """TICK_ORDER of a line as one number, so that a bar's first and last tick are
    found by a hash aggregate.  A key out of its range is an error."""
    fields = [("l_orderkey", 12), ("l_linenumber", 2), ("l_partkey", 8), ("l_suppkey", 7)]
    out, left = F.round(F.col("l_extendedprice") * 100).cast("decimal(9,0)").cast("decimal(38,0)"), 9
    for name, digits in reversed(fields):
        out = out + F.col(name).cast(f"decimal({digits},0)") * F.lit(Decimal(10**left))
        left += digits
    return out.cast("decimal(38,0)")


def ticks(spark: SparkSession, folder: str, symbol: str = "p_brand") -> DataFrame:
    """symbol, ts, price, size, factor and the tick's total order."""
    li = table(spark, folder, "lineitem")
    pt = table(spark, folder, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    return li.join(pt, li.l_partkey == pt.p_partkey).select(
        "symbol",
        F.to_date("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_discount").alias("discount"),
        line_order().alias("place"),
        *TICK_ORDER,
    )


def daily_bars(spark: SparkSession, folder: str, symbol: str = "p_brand") -> DataFrame:
    """Raw daily bars with an adjusted close below the close by the mean discount."""
    t = ticks(spark, folder, symbol)
    bars = bars_from_ticks(t, order=["place"], extra=[F.avg("discount").alias("_disc")])
    adj = (F.col("close") * (1 - F.col("_disc"))).alias("adj_close")
    return bars.select("symbol", "ts", "open", "high", "low", "close", adj, "volume")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """ts, close: volume-weighted mean price of all ticks of a day."""
    li = table(spark, folder, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("ts")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close")
    )


def intraday_bars(spark: SparkSession, folder: str, minutes: int = 30) -> DataFrame:
    """Bars of the event stream, labelled by their open."""
    ev = table(spark, folder, "events")
    ev = ev.select(
        F.col("event_type").alias("symbol"), "event_id", F.col("value").alias("price"),
        F.lit(1.0).alias("size"), "ts", bar_label(F.col("ts"), minutes).alias("label"),
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(19,0)")
    place = (micros * F.lit(Decimal(10**18)) + F.col("event_id").cast("decimal(18,0)")).cast("decimal(38,0)")
    return bars_from_ticks(ev.withColumn("place", place).withColumn("ts", F.col("label")), order=["place"])


def bar_label(ts: Column, minutes: int) -> Column:
    """Open label of the bar a naive timestamp falls in."""
    width = minutes * 60
    secs = F.floor(F.unix_seconds(ts.cast("timestamp")) / width) * width
    return F.timestamp_seconds(secs).cast("timestamp_ntz")


def fills(spark: SparkSession, folder: str, *, laid: bool = False) -> DataFrame:
    """account, symbol, ts, the total order, signed quantity and price.

    Lines returned are sells.  The reference price is the part's list price
    scaled to the tape.  ``laid``: rows of an account in one partition; the lines
    move as they are, since prices and costs derived of them hardly compress.
    """
    li = table(spark, folder, "lineitem").select(
        *TICK_ORDER, "l_quantity", "l_tax", "l_discount", F.to_date("l_shipdate").alias("_day"), (F.col("l_returnflag") == "R").alias("_sold"),
    )
    od = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    pt = table(spark, folder, "part").select("p_partkey", "p_brand")
    d = li.join(od, li.l_orderkey == od.o_orderkey).join(pt, li.l_partkey == pt.p_partkey)
    if laid:
        d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    q = F.when(F.col("_sold"), -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return d.select(
        F.col("o_custkey").alias("account"),
        F.col("p_brand").alias("symbol"),
        F.col("_day").alias("ts"),
        q.alias("quantity"),
        px.alias("price"),
        (px * F.lit(0.01) * F.col("l_tax")).alias("commission"),
        F.lit(0.0).alias("fees"),
        (px * (1 - F.col("l_discount") * 0.01)).alias("reference_price"),
        *TICK_ORDER,
    )


def line_bounds(spark: SparkSession, folder: str, buckets: int = 1 << 14) -> DataFrame:
    """account, n: an account has at most as many lines as it has orders, times the lines of the largest bucket of order keys.

    Neither needs the lines joined or moved.
    """
    key = F.pmod(F.xxhash64("l_orderkey"), F.lit(buckets))
    most = table(spark, folder, "lineitem").groupBy(key.alias("_key")).count().agg(F.max("count")).first()[0] or 0
    return table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("account")).agg((F.count(F.lit(1)) * most).alias("n"))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Order-value equity curves, one per order priority: strategy, ts, equity, turnover."""
    od = table(spark, folder, "orders")
    return od.groupBy(F.col("o_orderpriority").alias("strategy"), F.to_date("o_orderdate").alias("ts")).agg(
        F.round(F.avg("o_totalprice") + 1e-9, 4).alias("equity"),
        F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice") + 1e-9, 2).alias("notional"),
    )


ARTICLE_ORIGIN = "2024-01-01 00:00:00"


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: first line is the title, the rest the summary."""
    d = table(spark, folder, "documents")
    ts = F.timestamp_seconds(
        F.unix_seconds(F.lit(ARTICLE_ORIGIN).cast("timestamp")) + F.col("doc_id") * F.lit(1800)
    )
    parts = F.split("text", "\n", 2)
    kind = F.when(F.pmod(F.col("doc_id"), F.lit(5)) == 0, "macro").otherwise("company")
    syms = F.when(
        kind == "company",
        F.array(
            F.concat(F.lit("Brand#"), (1 + F.pmod(F.col("doc_id"), F.lit(25))).cast("string")),
            F.concat(F.lit("Brand#"), (1 + F.pmod(F.col("doc_id") * 7, F.lit(25))).cast("string")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return d.select(
        "doc_id",
        F.substring(F.sha1(F.lower(F.trim("text"))), 1, 16).alias("uid"),
        ts.alias("ts"),
        "source",
        kind.alias("kind"),
        parts[0].alias("title"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("summary"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.array_sort(F.array_distinct(syms)).alias("symbols"),
    )
