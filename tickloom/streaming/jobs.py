"""Structured Streaming forms of the incremental operators.

One trigger of a job equals one scheduled run: it takes what is new, and a
second run over the same input changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickloom.functions.text import Lexicon, NameBook, label_articles, score_articles
from tickloom.operators.positions import executed
from tickloom.settings import QTY_EPS
from tickloom.sources import versions
from tickloom.sources.bars import upsert
from tickloom.sources.news_store import append_articles

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# -------------------------------------------------------------- aggregates


def tick_bars(ticks: DataFrame, *, minutes: int = 30, lateness: str = "5 minutes") -> DataFrame:
    """Bars of a tick stream, each emitted once, when it is complete."""
    w = F.window("ts", f"{minutes} minutes")
    o = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy(w.alias("_w"), "symbol")
        .agg(
            F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", o).alias("close"), F.sum("size").alias("volume"),
        )
        .select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sessions(events: DataFrame, *, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions per symbol: runs of events without a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", lateness).groupBy(w.alias("_w"), "symbol").agg(F.count(F.lit(1)).alias("n")).select(
        "symbol", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n"
    )


def unique_articles(articles: DataFrame, *, lateness: str = "2 days") -> DataFrame:
    """Each uid once within the watermark; the archive merge removes the rest."""
    return articles.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["uid"])


def scored_articles(
    articles: DataFrame, *, lex: Lexicon | None = None, book: NameBook | None = None, universe: list[str] | None = None
) -> DataFrame:
    """Labelled and scored articles; the dictionaries are literals of the plan."""
    return score_articles(label_articles(articles, book, universe), lex)


def before(articles: DataFrame, as_of: str) -> DataFrame:
    """Strict event-time exclusion of what is not yet known at ``as_of``."""
    return articles.filter(F.col("ts") < F.lit(as_of).cast("timestamp"))


# ------------------------------------------------------------------- sinks


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything new exactly once, then stop."""
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there, into files under ``folder``, and read them back.

    The last trigger carries no data: it lets the watermark reach the end of what
    was read, so timers up to it fire.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def replayed(df: DataFrame, folder: str) -> DataFrame:
    """A stream of the rows of a batch table, by way of files under ``folder``."""
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def idempotent_append(path: str) -> Callable[[DataFrame, int], None]:
    """Write a batch to its own partition: a repeated batch replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


def bar_store_sink(root: str, *, seq: str, validate_quality: bool = False) -> Callable[[DataFrame, int], None]:
    """Late and corrected bars: upsert the batch, newest row wins.

    The batch's number is committed with its bars; a batch that comes again is skipped.
    With ``validate_quality`` a batch that breaks a rule stops the stream.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if int(versions.latest(spark, root).notes.get("batch", -1)) < batch_id:
            upsert(spark, root, batch, seq=seq, validate_quality=validate_quality, notes={"batch": str(batch_id)})

    return each


def archive_sink(root: str, *, name: str = "articles") -> Callable[[DataFrame, int], None]:
    """Append a batch to the article archive, once.

    The number of the last batch that went in is kept beside the archive.  A batch
    that comes again is skipped, and one that died half-way is appended anew,
    which adds only what is missing; months without new stories aren't touched.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, ledger = batch.sparkSession, f"{root}/batches"
        done = versions.latest(spark, ledger)
        if int(done.notes.get(name, -1)) >= batch_id:
            return
        append_articles(spark, root, batch)
        versions.commit(spark, ledger, done, {}, {name: str(batch_id)})

    return each


# --------------------------------------------------------------- positions

POSITION_OUT = "account STRING, symbol STRING, ts TIMESTAMP, seq BIGINT, quantity DOUBLE, avg_price DOUBLE, realized_pnl DOUBLE"


class PositionKeeper(StatefulProcessor):
    """Average-cost position per (account, symbol) with bounded buffering.

    Fills wait in list state until the watermark has passed them, are then
    applied in (ts, seq) order, and leave the buffer; what is kept per key is
    three numbers and the fills still inside the watermark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("position", "quantity DOUBLE, avg DOUBLE, realized DOUBLE")
        self.wait = handle.getListState("waiting", "us BIGINT, seq BIGINT, quantity DOUBLE, price DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            self.wait.appendList(list(zip(us.tolist(), pdf["seq"].tolist(), pdf["quantity"].tolist(), pdf["price"].tolist())))
            due |= {u // 1000 + 1 for u in us.tolist()}
        # One timer a batch; when it fires, all that is due goes, in order.
        if due:
            self.handle.registerTimer(max(due))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cut = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(self.wait.get()) if self.wait.exists() else []
        ready, later = [r for r in waiting if r[0] < cut], [r for r in waiting if r[0] >= cut]
        if not ready:
            return
        q, avg, realized = self.state.get() if self.state.exists() else (0.0, 0.0, 0.0)
        out = []
        for us, seq, dq, px in ready:
            q, avg, gain = apply_fill(q, avg, dq, px)
            realized += gain
            out.append((key[0], key[1], pd.Timestamp(us, unit="us"), seq, q, avg, realized))
        self.state.update((q, avg, realized))
        if later:
            self.wait.put(later)
        else:
            self.wait.clear()
        yield pd.DataFrame(out, columns=["account", "symbol", "ts", "seq", "quantity", "avg_price", "realized_pnl"])

    def close(self) -> None:
        pass


def apply_fill(q: float, avg: float, dq: float, px: float) -> tuple[float, float, float]:
    """Quantity, average price and realised profit after one fill."""
    if abs(dq) < QTY_EPS:
        return q, avg, 0.0
    new = q + dq
    if abs(q) < QTY_EPS or (q > 0) == (dq > 0):
        return new, (avg * abs(q) + px * abs(dq)) / abs(new), 0.0
    closed = min(abs(dq), abs(q))
    gain = closed * (px - avg) * (1.0 if q > 0 else -1.0)
    if abs(new) < QTY_EPS:
        return 0.0, 0.0, gain
    return new, (px if abs(dq) > abs(q) else avg), gain


def streaming_positions(fills: DataFrame, *, lateness: str = "1 day") -> DataFrame:
    """Position after every fill, in event-time order; needs the RocksDB
    state store provider."""
    d = executed(fills).withWatermark("ts", lateness).groupBy("account", "symbol")
    return d.transformWithStateInPandas(
        statefulProcessor=PositionKeeper(), outputStructType=POSITION_OUT, outputMode="Append", timeMode="eventTime"
    )
