"""Keyed-state streams equal their batch operators, over days, late rows and expiries."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import decisions as D
from tickloom.operators import news as N
from tickloom.settings import BookSettings, NewsSettings
from tickloom.streaming import jobs as J
from tickloom.streaming import keepers as K

DAY0 = dt.date(2026, 3, 2)
BARS = "symbol string, ts date, open double"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def stamp(d, hours=0):
    return dt.datetime(d.year, d.month, d.day) + dt.timedelta(hours=hours)


def batches(spark, parts, schema, path):
    """A stream that reads the parts one after the other."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/p{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def state_rows(spark, checkpoint, name):
    d = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return d.count()


# ------------------------------------------------------------------- orders


def test_order_states_batch(spark):
    cfg = BookSettings()
    cal = spark.createDataFrame([("Z", day(n), 1.0) for n in range(0, 21) if n % 7 < 5], BARS)
    bars = spark.createDataFrame([("A", day(1), 10.0), ("B", day(7), 20.0), ("C", day(8), 30.0), ("A", day(15), 11.0)], BARS)
    orders = spark.createDataFrame([("A", day(0)), ("B", day(0)), ("C", day(0)), ("D", day(0)), ("A", day(14)), ("A", day(15)), ("D", day(17))], "symbol string, ts date")
    everything = cal.unionByName(bars)
    filled = D.next_bar_fill(orders, bars)
    got = {(r.symbol, (r.ts - DAY0).days): r.state for r in D.expire(filled, cfg, calendar=everything).collect()}
    # Over five days from day 0, the first processed day is day 7: B's bar comes that day, C's a day too late.
    assert got == {("A", 0): "filled", ("B", 0): "filled", ("C", 0): "cancelled", ("D", 0): "cancelled", ("A", 14): "filled", ("A", 15): "pending", ("D", 17): "pending"}
    early = {(r.symbol, (r.ts - DAY0).days): r.state for r in D.expire(filled, cfg, calendar=everything, as_of=str(day(4))).filter("ts = '2026-03-02'").collect()}
    assert early == {("A", 0): "filled", ("B", 0): "pending", ("C", 0): "pending", ("D", 0): "pending"}


@pytest.mark.parametrize("seed", [1, 2])
def test_order_stream_equals_batch(spark, tmp_path, seed):
    rnd = random.Random(seed)
    days = [n for n in range(80) if n % 7 < 5]
    bars = [(s, day(n), round(rnd.uniform(1, 9), 3)) for s in "ABCD" for n in days if rnd.random() < {"A": 0.9, "B": 0.4, "C": 0.1, "D": 0.05}[s]]
    bars += [("Z", day(n), 1.0) for n in days]
    orders = [(s, day(rnd.choice(days))) for s in "ABCDE" for _ in range(12)]
    b, o = spark.createDataFrame(bars, BARS), spark.createDataFrame(sorted(set(orders)), "symbol string, ts date").withColumn("id", F.col("ts").cast("string"))
    want = D.expire(D.next_bar_fill(o, b, price="open"), BookSettings(), calendar=b).filter("state != 'pending'")
    want = {(r.symbol, str(r.ts), r.state, str(r.fill_ts) if r.state == "filled" else None, r.fill_price if r.state == "filled" else None) for r in want.collect()}
    # Bars come in three parts, late ones among them, and a far row at the end.
    late = [x for x in bars if rnd.random() < 0.2]
    rest = sorted((x for x in bars if x not in late), key=lambda x: x[1])
    parts = [rest[: len(rest) // 2], rest[len(rest) // 2 :] + late, [("~", day(900), 1.0)]]
    stream = batches(spark, parts, BARS, tmp_path / "bars")
    orders_in = J.replayed(D.with_deadline(o, b, BookSettings()), str(tmp_path / "orders"))
    got = J.drained(K.order_states(orders_in, stream, lateness="200 days"), str(tmp_path / "run")).collect()
    assert {(r.symbol, r.id, r.state, r.fill_ts and str(r.fill_ts.date()), r.fill_price) for r in got} == want
    assert len(got) == len(want) > 20 and {r.state for r in got} == {"filled", "cancelled"}


def test_open_orders_stay_in_state_only(spark, tmp_path):
    schema = "symbol string, ts date, id string, deadline date"
    o = spark.createDataFrame([("A", day(0), "x", None), ("B", day(0), "y", day(7))], schema)
    b = batches(spark, [[("~", day(900), 1.0)]], BARS, tmp_path / "bars")
    got = J.drained(K.order_states(J.replayed(o, str(tmp_path / "o")), b, lateness="1 day"), str(tmp_path / "run")).collect()
    assert [(r.symbol, r.state) for r in got] == [("B", "cancelled")]
    assert state_rows(spark, str(tmp_path / "run/checkpoint"), "open") == 1


# ------------------------------------------------------------------ lock-out


@pytest.mark.parametrize("cfg", [BookSettings(), BookSettings(stop_cooldown_bars=6)])
def test_lockout_stream_equals_batch(spark, tmp_path, cfg):
    rnd = random.Random(3)
    ask = sorted({(s, stamp(day(0), rnd.randrange(24 * 40) / 2)) for s in "AB" for _ in range(120)})
    hit = sorted({(s, stamp(day(0), rnd.randrange(24 * 40) / 2)) for s in "A" for _ in range(6)} | {("B", stamp(day(1), 23.5)), ("C", stamp(day(2)))})
    rows = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(ask)], "symbol string, ts timestamp, id string")
    stops = spark.createDataFrame(hit, "symbol string, ts timestamp")
    want = {(r.id, r.cooling) for r in D.cooldown(rows, stops, cfg).collect()}
    beat = spark.createDataFrame([("~", stamp(day(900)), "end")], rows.schema)
    out = K.lockouts(J.replayed(rows.unionByName(beat), str(tmp_path / "r")), J.replayed(stops, str(tmp_path / "s")), cfg, lateness="100 days")
    got = J.drained(out, str(tmp_path / "run")).collect()
    assert {(r.id, r.cooling) for r in got if r.symbol != "~"} == want and {c for _, c in want} == {True, False}
    assert state_rows(spark, str(tmp_path / "run/checkpoint"), "last") == 0  # gone after the span


# -------------------------------------------------------------------- signal


def test_rolling_signal_equals_batch_at_every_instant(spark, tmp_path):
    rnd = random.Random(5)
    schema = "ts timestamp, uid string, title string, symbols array<string>, polarity double, matched int"
    times = [stamp(day(0), rnd.randrange(24 * 60 * 30) / 60) for _ in range(300)] + [stamp(day(3)), stamp(day(17)), stamp(day(45), 5)]
    rows = [(t, f"u{i:03d}", f"t{i}", sorted(rnd.sample("ABCD", rnd.randint(0, 3))), rnd.choice([-1.0, -0.3, 0.0, 0.5, 1.0]), rnd.randrange(9)) for i, t in enumerate(times)]
    arts = spark.createDataFrame(rows, schema)
    cfg = NewsSettings()
    ev = N.evidence(N.at_grid(arts, "2026-03-01 00:00:00", 1, "2026-06-30 00:00:00", cfg.max_age_days), cfg)
    want = {(r.as_of, r.symbol): r for r in N.symbol_signal(ev, cfg).collect()}
    rows.sort(key=lambda r: r[0])
    parts = [rows[:150], rows[150:], [(stamp(day(900)), "z", "z", ["~"], 1.0, 1)]]
    stream = batches(spark, parts, schema, tmp_path / "in")
    out = J.drained(K.rolling_signal(stream, start="2026-03-01", cfg=cfg, lateness="60 days"), str(tmp_path / "run"))
    got = {(r.as_of, r.symbol): r for r in K.complete_signal(out.filter("symbol != '~'"), cfg).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for k, w in want.items():
        g = got[k]
        assert (g.articles, g.top_headline) == (w.articles, w.top_headline)
        assert [g.score, g.relative, g.raw_score, g.weight, g.mean_score] == pytest.approx([w.score, w.relative, w.raw_score, w.weight, w.mean_score], rel=1e-9, abs=1e-12)


def test_look_back_must_be_whole_steps(spark):
    with pytest.raises(ValueError):
        K.rolling_signal(spark.createDataFrame([], "ts timestamp"), start="2026-03-01", step_days=4)


# --------------------------------------------------------------------- sinks


def test_archive_sink_skips_known_batches_and_old_months(spark, tmp_path):
    schema = "uid string, ts timestamp, source string, kind string, title string, summary string, url string, symbols array<string>, collected_at timestamp"
    row = lambda u, d, t: (u, stamp(d), "s", "company", t, "", "u/" + u, ["X"], stamp(day(60)))
    one, two = [row("a", day(0), "first"), row("b", day(40), "second")], [row("a", day(0), "again"), row("c", day(41), "third")]
    root = str(tmp_path / "archive")
    sink = J.archive_sink(root)
    put = lambda rows, n: sink(spark.createDataFrame(rows, schema), n)
    put(one, 0)
    old = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "archive/articles/month=2026-03").iterdir()}
    put(two, 1)
    assert old == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "archive/articles/month=2026-03").iterdir()}
    every = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "archive").rglob("*")}
    put(two, 1)
    put([row("zz", day(0), "not read")], 0)
    assert every == {str(p): p.stat().st_mtime_ns for p in (tmp_path / "archive").rglob("*")}
    assert sorted((r.uid, r.title) for r in spark.read.parquet(root + "/articles").collect()) == [("a", "first"), ("b", "second"), ("c", "third")]


def test_archive_stream(spark, tmp_path):
    schema = "uid string, ts timestamp, source string, kind string, title string, summary string, url string, symbols array<string>, collected_at timestamp"
    parts = [[(u, stamp(day(n)), "s", "macro", u, "", u, [], stamp(day(99)))] for n, u in enumerate("abca")]
    for _ in range(2):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")) if _ else batches(spark, parts, schema, tmp_path / "in")
        J.run_once(s, J.archive_sink(str(tmp_path / "archive")), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.uid for r in spark.read.parquet(str(tmp_path / "archive/articles")).collect()) == ["a", "b", "c"]


def test_sessions_stream_equals_batch(spark, tmp_path):
    from tickloom.operators.report import session_ids

    rnd = random.Random(11)
    rows = sorted((stamp(day(0)) + dt.timedelta(minutes=rnd.randrange(6000)), rnd.choice("AB")) for _ in range(150))
    df = spark.createDataFrame([(s, t) for t, s in rows], "symbol string, ts timestamp").distinct()
    batch = session_ids(df, keys=["symbol"], gap_minutes=30).groupBy("symbol", "session").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).collect()
    parts = [sorted(((r.symbol, r.ts) for r in df.collect()), key=lambda r: r[1]), [("~", stamp(day(900)))]]
    out = J.drained(J.sessions(batches(spark, parts, df.schema, tmp_path / "in"), lateness="2 days"), str(tmp_path / "run"))
    assert {(r.symbol, r.start, r.n) for r in out.collect()} == {(r.symbol, r.start, r.n) for r in batch}


def test_unique_articles_in_a_stream(spark, tmp_path):
    schema = "uid string, ts timestamp, title string"
    parts = [[("a", stamp(day(0)), "1"), ("b", stamp(day(0)), "2"), ("a", stamp(day(0), 1), "3")], [("a", stamp(day(1)), "4"), ("c", stamp(day(1)), "5")]]
    out = J.drained(J.unique_articles(batches(spark, parts, schema, tmp_path / "in"), lateness="10 days"), str(tmp_path / "run"))
    assert sorted(r.uid for r in out.collect()) == ["a", "b", "c"]


def test_signal_calls_the_state_once_a_batch():
    """Neither rows nor cells cost a call each: one read and one write, however many there are."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, []

        def get(self):
            calls.append((self.name, "get"))
            return iter(self.held) if self.name == "cells" else self.held

        def put(self, rows):
            calls.append((self.name, "put"))
            self.held = rows

        update = put

        def clear(self):
            self.held = []

        def exists(self):
            return bool(self.held)

    class Handle:
        getListState = getValueState = lambda self, name, schema: State(name)

        def registerTimer(self, ms):
            pass

    class Now:
        getCurrentWatermarkInMs = lambda self: 99 * K.DAY_US // 1000

    keeper = K.SignalKeeper(0, K.DAY_US, 14 * K.DAY_US, 2.0 * K.DAY_US)
    keeper.init(Handle())
    cells = [d * K.DAY_US for d in (*range(1, 41), *range(1, 41))]
    rows = pd.DataFrame({"cell": cells, "num": 1.0, "den": 2.0, "n": 1, "top": 1.0, "uid": "u", "title": "t"})
    list(keeper.handleInputRows(("s",), iter([rows]), None))
    assert [c for c in calls if c[0] == "cells"] == [("cells", "get"), ("cells", "put")]
    out = pd.concat(keeper.handleExpiredTimer(("s",), Now(), None))
    assert len(out) == 53 and out.articles.tolist() == [2 * min(i, 14, 54 - i) for i in range(1, 54)]
    assert out.weight.iloc[0] == pytest.approx(4.0) and out.weight.iloc[1] == pytest.approx(4.0 + 4.0 * 0.5**0.5)
    assert not keeper.cells.exists() and not keeper.next.exists()
