"""Streams equal their batch operators on the same files."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators.positions import running_positions
from tickloom.sources.bars import read_store
from tickloom.streaming import jobs

T0 = dt.datetime(2026, 3, 2, 9, 30)


def drain(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_bars_come_once_and_complete(spark, tmp_path):
    schema = "symbol string, ts timestamp, seq bigint, price double, size double"
    rows = [("A", T0 + dt.timedelta(minutes=m), m, 100.0 + m, 1.0) for m in range(0, 120, 5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(jobs.tick_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "bars_t", tmp_path)
    got = spark.table("bars_t").orderBy("ts").collect()
    assert [r.open for r in got] == [100.0, 130.0, 160.0]
    assert all(r.volume == 6 for r in got)


def test_positions_equal_batch(spark, tmp_path):
    rnd = random.Random(2)
    schema = "account string, symbol string, ts timestamp, seq bigint, quantity double, price double"
    rows = [("a", rnd.choice("XY"), T0 + dt.timedelta(hours=i), i, float(rnd.choice([-20, 10, 30])), rnd.uniform(5, 20)) for i in range(40)]
    mixed = rows[:20], rows[20:] + [("z", "Z", T0 + dt.timedelta(days=400), 99, 1.0, 1.0)]
    for part in mixed:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(jobs.streaming_positions(stream, lateness="10 days"), "pos_t", tmp_path)
    got = spark.table("pos_t").filter("account = 'a'").toPandas().sort_values("seq").reset_index(drop=True)
    batch = spark.createDataFrame(rows, schema).withColumns({"commission": F.lit(0.0), "fees": F.lit(0.0)})
    want = running_positions(batch.withColumnRenamed("seq", "s"), ["ts", "s"]).toPandas().sort_values("s").reset_index(drop=True)
    assert len(got) == 40
    for a, b in (("quantity", "qty_after"), ("avg_price", "avg_price"), ("realized_pnl", "realized_pnl")):
        pd.testing.assert_series_equal(got[a], want[b], check_names=False, rtol=1e-9)


def test_rerun_of_the_store_sink_changes_nothing(spark, tmp_path):
    cols = "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume double, seq int"
    rows = [("A", dt.date(2024, 1, d), 1.0, 2.0, 0.5, float(d), float(d), 10.0, 0) for d in range(1, 6)]
    late = [("A", dt.date(2024, 1, 3), 1.0, 2.0, 0.5, 33.0, 33.0, 10.0, 1)]
    for part in (rows, late):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
        jobs.run_once(s, jobs.bar_store_sink(str(tmp_path / "store"), seq="seq"), str(tmp_path / "ck")).awaitTermination()
    got = read_store(spark, str(tmp_path / "store")).orderBy("ts").collect()
    assert [r.close for r in got] == [1.0, 2.0, 33.0, 4.0, 5.0]
