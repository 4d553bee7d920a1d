"""Operators on small fixtures: accounting, sizing, text, look-ahead."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.text import NameBook, match_symbols, score_articles
from tickloom.operators import alpha, decisions, features, news, panel, positions, quality, report, sizing
from tickloom.settings import AlphaSettings, BookSettings, FeatureSettings, SizingSettings
from tickloom.sources import bars as B
from tickloom.sources import tables
from tickloom.streaming.jobs import apply_fill

DAY0 = dt.date(2020, 1, 1)


def make_bars(spark, n=420, symbols=8, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(symbols):
        c = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.02, n)))
        out += [(f"S{s}", DAY0 + dt.timedelta(days=i), c[i] * 0.999, c[i] * 1.01, c[i] * 0.98, c[i], c[i], float(rng.integers(1e6, 5e6))) for i in range(n)]
    return spark.createDataFrame(pd.DataFrame(out, columns=["symbol", "ts", "open", "high", "low", "close", "adj_close", "volume"]))


def corrupted(bars, cut):
    late = F.col("ts") > F.lit(cut)
    return bars.withColumns({c: F.when(late, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "adj_close")})


@pytest.mark.parametrize("what", ["features", "alpha"])
def test_no_look_ahead(spark, what):
    bars = make_bars(spark, n=320, symbols=4)
    cut = DAY0 + dt.timedelta(days=290)
    cfg = FeatureSettings(fracdiff_threshold=1e-2, zscore_window=100)
    run = (lambda b: features.compute_features(b, cfg)) if what == "features" else (lambda b: alpha.score_cross_section(b, AlphaSettings(bars_per_day=1)))
    a, b = (run(x).filter(F.col("ts") <= F.lit(cut)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (bars, corrupted(bars, cut)))
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_ffd_identities():
    assert features.ffd_weights(0.0) == [1.0]
    assert features.ffd_weights(1.0) == [-1.0, 1.0]
    assert len(features.ffd_weights(0.4, 1e-2)) == 11


def test_panel_target_unknown_at_the_edge(spark):
    bars = make_bars(spark, n=300, symbols=6)
    bench = bars.groupBy("ts").agg(F.avg("close").alias("close"))
    p = panel.build_panel(bars, bench, horizon=20).toPandas()
    last = p[p["ts"] > DAY0 + dt.timedelta(days=279)]
    assert len(last) and last["target"].isna().all()
    assert p["cross_sectional_rank"].between(0, 1).all()


def test_positions_equal_fill_by_fill(spark):
    rnd = random.Random(4)
    rows = []
    for acct, sym, n in (("a", "HOT", 700), ("a", "X", 30), ("b", "HOT", 5)):
        for i in range(n):
            rows.append((acct, sym, DAY0 + dt.timedelta(days=i // 3), i, float(rnd.choice([-30, -20, -10, 10, 20, 40])), rnd.uniform(5, 50), 0.1, 0.0))
    pdf = pd.DataFrame(rows, columns=["account", "symbol", "ts", "i", "quantity", "price", "commission", "fees"])
    got = positions.running_positions(spark.createDataFrame(pdf), ["ts", "i"], chunk_days=7).toPandas().sort_values(["account", "symbol", "i"])
    want = []
    for _, g in pdf.groupby(["account", "symbol"]):
        q = avg = real = 0.0
        for dq, px in zip(g["quantity"], g["price"]):
            q, avg, gain = apply_fill(q, avg, dq, px)
            real += gain
            want.append((q, avg, real))
    np.testing.assert_allclose(got[["qty_after", "avg_price", "realized_pnl"]].to_numpy(), np.array(want), rtol=1e-8, atol=1e-6)


def test_flip_realises_and_rebases():
    q, avg, gain = apply_fill(100, 10.0, -150, 12.0)
    assert (q, avg, gain) == (-50, 12.0, 200.0)


def scores(spark):
    rows = [(DAY0, f"N{i:02d}", (i - 19.5) / 40, 0.01 + 0.0005 * i) for i in range(40)]
    return spark.createDataFrame(rows, "ts date, symbol string, score double, vol double").withColumn("net_tilt", F.lit(0.1))


def test_gross_and_net_land_exactly(spark):
    w = sizing.target_weights(scores(spark), SizingSettings(target_gross=1.5)).toPandas()
    assert w["weight"].abs().sum() == pytest.approx(1.5, abs=1e-9)
    assert w["weight"].sum() == pytest.approx(0.1, abs=1e-9)


def test_caps_hold_last(spark):
    w = sizing.target_weights(scores(spark), SizingSettings(target_gross=1.5, max_position_weight=0.2)).toPandas()
    assert w["weight"].abs().max() <= 0.2 + 1e-12
    assert w["weight"].abs().sum() == pytest.approx(1.5, abs=1e-6)


def test_vol_target_is_hit(spark):
    cfg = SizingSettings()
    # Equal volatilities: gross is solved before the sides are scaled.
    even = scores(spark).withColumns({"net_tilt": F.lit(0.0), "vol": F.lit(0.01)})
    v = sizing.book_vol(sizing.target_weights(even, cfg), cfg).first()["predicted_vol"]
    assert v * cfg.bars_per_year**0.5 == pytest.approx(0.35, rel=1e-9)


TEXTS = [
    ("Shares surge after earnings beat", 1), ("Stock plunges on fraud probe", -1), ("Company not expected to beat estimates", -1),
    ("Quarterly meeting held on Tuesday", 0), ("Firm avoids bankruptcy", 1),
]


def test_polarity_direction_and_negation(spark):
    d = spark.createDataFrame([(t, "", s) for t, s in TEXTS], "title string, summary string, want int")
    got = score_articles(d).select(F.signum("polarity").cast("int").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_title_counts_double(spark):
    d = spark.createDataFrame([("profits surge", "shares plunge")], "title string, summary string")
    assert score_articles(d).first()["polarity"] > 0


MENTIONS = [
    ("Apple's sales and $NVDA rose", ["AAPL", "NVDA"]), ("Applebee's opened", []), ("analysts raise price Target again", []),
    ("Target Corp beats", ["TGT"]), ("Shares of Foo (nasdaq: abcd) and NYSE:BRK-B", ["ABCD", "BRK-B"]), ("JP Morgan Stanley note", ["JPM", "MS"]),
]


def test_symbol_matching(spark):
    d = spark.createDataFrame(MENTIONS, "t string, want array<string>")
    for r in d.select("want", match_symbols(F.col("t"), NameBook()).alias("got")).collect():
        assert sorted(r.got) == sorted(r.want)


def test_labels_are_confirmed(spark):
    from tickloom.functions.text import label_articles

    rows = [("LASR beats", "", ["ADI"]), ("Nvidia and (AMD) rise", "", ["AMD"]), ("ALL is well", "", ["ALL"])]
    d = label_articles(spark.createDataFrame(rows, "title string, summary string, symbols array<string>"))
    got = {r.title: r.symbols for r in d.collect()}
    assert got == {"LASR beats": [], "Nvidia and (AMD) rise": ["AMD", "NVDA"], "ALL is well": []}


def test_feeds_drop_what_cannot_be_dated(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>http://x/1</link><pubDate>Sat, 08 Aug 2026 10:00:00 GMT</pubDate></item><item><title>no date</title></item></channel></rss>"
    atom = "<feed><entry><title>C</title><link href='http://x/2'/><updated>2026-08-08T11:00:00Z</updated></entry></feed>"
    raw = spark.createDataFrame([("s", "macro", b) for b in (rss, atom, "<rss><chan")], "source string, kind string, body string")
    got = {(r.title, r.url) for r in news.parse_feeds(raw).collect()}
    assert got == {("A & B", "http://x/1"), ("C", "http://x/2")}


def test_archive_merge_is_idempotent(spark):
    t = dt.datetime(2026, 8, 8)
    cols = "uid string, ts timestamp, title string, url string, symbols array<string>, collected_at timestamp"
    a = spark.createDataFrame([("u", t, "old", "x", ["A"], t)], cols)
    b = spark.createDataFrame([("u", t, "new", "x", ["B"], t + dt.timedelta(days=1))], cols)
    once = news.merge_archive(a, b)
    twice = news.merge_archive(once, b)
    assert once.collect() == twice.collect()
    assert once.first()["title"] == "old" and once.first()["symbols"] == ["A", "B"]


def test_quality_rules_count_and_quarantine(spark):
    bars = make_bars(spark, n=30, symbols=3)
    bad = bars.withColumn("close", F.when((F.col("symbol") == "S1") & (F.dayofmonth("ts") == 4), -1.0).otherwise(F.col("close")))
    rep = {r.rule: r.n_bad for r in quality.quality_report(bad).collect()}
    assert rep["non_positive_close"] == 1 and rep["duplicate_key"] == 0
    good, held = quality.quarantine(bad)
    assert {r.symbol for r in held.select("symbol").distinct().collect()} == {"S1"}
    assert good.count() == 60


def test_stops_fire_on_long_names_only(spark):
    cfg = BookSettings(stop_loss_sigma=None, stop_loss_pct=0.1)
    rows = [("long down", 10.0, 80.0), ("short down", -10.0, 80.0), ("long up", 10.0, 120.0), ("short up", -10.0, 120.0), ("none", 0.0, 50.0)]
    df = spark.createDataFrame(rows, "symbol string, quantity double, price double").selectExpr(
        "*", "100D avg_price", "0.01D daily_vol", "0.5D conviction", "false cooling", "false is_flatten", "true entries_ok")
    got = {r.symbol: r.action for r in decisions.book_actions(df, cfg).collect()}
    assert got == {"long down": "stop_loss", "short down": "rebalance", "long up": "rebalance", "short up": "rebalance", "none": "entry"}


def test_recent_stops_by_bars(spark):
    at = lambda h, m: dt.datetime(2026, 3, 2, h, m)
    calendar = spark.createDataFrame([(at(10, 0),), (at(10, 30),), (at(11, 0),), (at(11, 30),)], "ts timestamp")
    stops = spark.createDataFrame([("a", at(10, 0)), ("b", at(10, 30))], "symbol string, ts timestamp")
    got = decisions.recent_stops(calendar, stops, BookSettings(stop_cooldown_bars=2)).orderBy("ts").collect()
    assert [r.recent for r in got] == [1, 2, 1, 0]


def test_turnover_counts_names_that_leave(spark):
    d = [dt.date(2026, 1, i) for i in (1, 2, 3, 4)]
    w = spark.createDataFrame([(d[0], "a", 0.5), (d[0], "b", -0.5), (d[1], "a", 0.25), (d[3], "a", 0.25)], "ts date, symbol string, weight double")
    w = w.unionByName(spark.createDataFrame([(d[2], "c", 0.1)], "ts date, symbol string, weight double"))
    rets = spark.createDataFrame([(x, s, 0.0) for x in d for s in "abc"], "ts date, symbol string, fwd double")
    got = report.cost_sweep(w, rets, [10.0]).first()
    # entries 1.0; 0.25 and b's exit 0.5; c's entry 0.1 and a's exit 0.25; a's entry 0.25 and c's exit 0.1
    assert got.turnover == pytest.approx((1.0 + 0.75 + 0.35 + 0.35) / 4) and got.n_days == 4


def test_cash_and_positions_round_alike_and_charges_drain(spark):
    t = lambda i: dt.date(2026, 1, i)
    rows = [("x", "s", t(1), 1, 10.4, 5.0, 1.0, 0.0), ("x", "s", t(3), 2, -4.6, 6.0, 1.0, 0.5), ("x", "s", t(4), 3, 0.3, 7.0, 1.0, 0.0)]
    fills = spark.createDataFrame(rows, "account string, symbol string, ts date, seq long, quantity double, price double, commission double, fees double")
    charges = spark.createDataFrame([("x", t(2), 2.0), ("x", t(2), 0.0)], "account string, ts date, amount double")
    cash = [r.cash for r in positions.cash_ledger(fills, ["ts", "seq"], capital=100.0, charges=charges).orderBy("seq_no").collect()]
    assert cash == [49.0, 47.0, 75.5]
    last = positions.final_positions(positions.running_positions(fills, ["ts", "seq"])).first()
    assert last.quantity == 5.0 and cash[-1] + 2.0 + last.quantity * last.avg_price == pytest.approx(100.0 + last.realized_pnl - last.total_costs)


def test_bars_held_and_drawdown(spark):
    t = lambda i: dt.date(2026, 1, i)
    bars = spark.createDataFrame([("s", t(i), 10.0) for i in (2, 5, 6, 7, 9)], "symbol string, ts date, close double")
    marked = spark.createDataFrame([("x", "s", t(6), 5.0, t(2), 40.0, 0.0), ("x", "s", t(9), 5.0, t(2), 50.0, 10.0)],
                                   "account string, symbol string, mark_ts date, quantity double, entry_ts date, value double, unrealized_pnl double")
    cash = spark.createDataFrame([("x", t(2), 1, 50.0)], "account string, ts date, seq_no long, cash double")
    got = positions.lifecycle_features(marked, cash, bars, capital=100.0).orderBy("mark_ts").collect()
    assert [round(r.held_scaled * 21) for r in got] == [2, 4]
    assert [r.drawdown for r in got] == pytest.approx([0.1, 0.0])


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "BRK.B.csv").write_text("Date,Open,High,Low,Close,Volume\n2026-01-02,1,3,0.5,2,10\nbroken,1,2\n")
    (tmp_path / "x.csv").write_text('Close,Date,"Adj Close",Volume\n4,2026-01-02,3.5,20\n')
    got = {(r.symbol, str(r.ts)): r for r in B.read_csv_bars(spark, str(tmp_path)).collect()}
    a, b, bad = got["BRK.B", "2026-01-02"], got["X", "2026-01-02"], got["BRK.B", "None"]
    assert (a.open, a.high, a.low, a.close, a.adj_close, a.volume) == (1, 3, 0.5, 2, 2, 10)
    assert (b.open, b.close, b.adj_close, b.volume) == (None, 4, 3.5, 20) and bad._corrupt == "broken,1,2"


def test_jumps_among_duplicates_are_repeatable(spark):
    rows = [("s", dt.date(2026, 1, i), p, p, p, p, p, 1.0) for i in (1, 2) for p in (10.0, 30.0, 11.0)]
    schema = "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume double"
    runs = [sorted(r._ret or 0 for r in quality.flag_rows(spark.createDataFrame(rows, schema).repartition(k)).collect()) for k in (1, 3)]
    assert runs[0] == runs[1]


def test_weights_beyond_the_width_are_an_error():
    with pytest.raises(ValueError):
        features.ffd_weights(0.4, 1e-4, max_width=5)


@pytest.fixture(scope="module")
def two_accounts(spark):
    """Fills of a long account and a short one, some on the first of a month, some stamps on one day."""
    rnd = random.Random(9)
    rows = [(a, s, dt.date(2026, 1, 1) + dt.timedelta(days=i // 2), i, float(rnd.choice([-30, -20, -10, 10, 20, 40])), rnd.uniform(5, 50), 0.1, 0.0)
            for a, s, n in (("a", "HOT", 300), ("a", "X", 30), ("b", "HOT", 5)) for i in range(n)]
    return spark.createDataFrame(rows, "account string, symbol string, ts date, i long, quantity double, price double, commission double, fees double")


def test_long_accounts_are_cut_and_short_ones_scanned_whole(spark, two_accounts):
    order = ["ts", "symbol", "i"]
    runs = [[f(most) for most in (0, 100, 1000)] for f in (
        lambda m: positions.running_positions(two_accounts, order, chunk_days=7, most=m).toPandas().sort_values(["account", "symbol", "i"]),
        lambda m: positions.cash_ledger(two_accounts, order, capital=100.0, chunk_days=7, most=m).toPandas().sort_values(["account", "symbol", "i"]))]
    for cut, mixed, whole in runs:
        for got in (cut, mixed):
            pd.testing.assert_frame_equal(got.reset_index(drop=True), whole.reset_index(drop=True)[got.columns], rtol=1e-9, atol=1e-7, check_dtype=False)


def test_short_accounts_have_no_carries(spark, two_accounts):
    """One exchange of the fills by account and none for chunks or final states."""
    last = positions.final_positions(positions.running_positions(two_accounts, ["ts", "i"]))
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_month_states_stand_until_the_next(spark):
    t = dt.date
    rows = [("k", t(2026, 1, 1), 1, 1.0), ("k", t(2026, 1, 9), 2, 2.0), ("k", t(2026, 3, 1), 3, 3.0), ("k", t(2026, 3, 2), 4, 4.0), ("n", t(2026, 5, 2), 1, 9.0)]
    d = spark.createDataFrame(rows, "k string, ts date, i long, v double")
    got = lambda every: [(r.mark_ts.month, r.v) for r in positions.month_states(d, ["k"], "i", ["v"], "2026-05-20", every=every).orderBy("mark_ts").collect()]
    assert got(1) == [(2, 2.0), (3, 3.0), (4, 4.0), (5, 4.0)]
    assert got(3) == [(2, 2.0), (5, 4.0)]


def test_final_books_move_the_fills_once(spark, two_accounts):
    """Positions and cash come from one layout, and a bound that settles the matter spares the count."""
    order = ["ts", "symbol", "i"]
    few, many = (spark.createDataFrame([("a", n), ("b", n)], "account string, n long") for n in (900, 2000))
    runs = [positions.final_books(positions.running_positions(two_accounts, order, chunk_days=7, most=m, bounds=b), capital=100.0)
            for m, b in ((1000, few), (1000, many), (100, many))]
    plan = runs[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    ledger = positions.cash_ledger(two_accounts, order, capital=100.0).groupBy("account").agg(F.max_by("cash", "seq_no").alias("cash")).collect()
    for d in runs:
        got = d.collect()
        assert len(got) == 3
        for r in ledger:
            assert {round(x.cash, 6) for x in got if x.account == r.account} == {round(r.cash, 6)}


def test_laid_fills_move_lines_and_bounds_hold(spark):
    sf = "/root/testdata/sf0.001"
    fills = tables.fills(spark, sf, laid=True)
    plan = positions.running_positions(fills, ["ts", *tables.TICK_ORDER, "quantity"], laid=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    n = fills.groupBy("account").count().join(tables.line_bounds(spark, sf, 64), "account", "left")
    assert n.filter("n IS NULL OR n < count").count() == 0
    assert sorted(map(str, fills.collect())) == sorted(map(str, tables.fills(spark, sf).collect()))


def plain_snapshots(fills, bars, marks, capital):
    """Row by row: {(account, mark): (cash, net, gross, unrealized, realized, costs, long, short, holdings)}."""
    out = {}
    for account in sorted({f.account for f in fills if f.account is not None}):
        own = sorted((f for f in fills if f.account == account), key=lambda f: (f.ts, f.i))
        for mark in marks:
            book, cash, held = {}, capital, False
            for f in own:
                if f.ts <= mark:
                    cash -= f.quantity * f.price + f.commission
                    b = book.setdefault(f.symbol, {"first": f.ts, "q": 0.0, "avg": 0.0, "gain": 0.0, "paid": 0.0})
                    after = b["q"] + f.quantity
                    if b["q"] == 0 or (b["q"] > 0) == (f.quantity > 0):
                        b["avg"] = (b["avg"] * abs(b["q"]) + f.price * abs(f.quantity)) / abs(after)
                    else:
                        b["gain"] += min(abs(f.quantity), abs(b["q"])) * (f.price - b["avg"]) * (1 if b["q"] > 0 else -1)
                        b["avg"] = 0.0 if after == 0 else f.price if abs(f.quantity) > abs(b["q"]) else b["avg"]
                    b["q"], b["paid"] = after, b["paid"] + f.commission
            rows = []
            for s, b in book.items():
                if s is not None and (b["first"].year, b["first"].month) < (mark.year, mark.month):
                    px = max(((x.ts, x.close) for x in bars if x.symbol == s and x.ts <= mark), default=(None, b["avg"]))[1]
                    rows.append((s, b, b["q"] * px, b["q"] * (px - b["avg"]) if b["q"] else 0.0))
            if rows:
                out[account, mark] = (
                    cash, sum(r[2] for r in rows), sum(abs(r[2]) for r in rows), sum(r[3] for r in rows), sum(r[1]["gain"] for r in rows),
                    sum(r[1]["paid"] for r in rows), sum(r[1]["q"] > 0 for r in rows), sum(r[1]["q"] < 0 for r in rows), {r[0]: r[1]["q"] for r in rows if r[1]["q"]})
    return out


@pytest.mark.parametrize("rows", ["1", "4", "10000"])
def test_snapshots_equal_a_plain_loop(spark, rows):
    """Also without symbols, accounts, closes or marks, and with accounts that go over several Arrow batches."""
    rnd = random.Random(12)
    made, day0 = [], dt.date(2025, 11, 1)
    for account, symbols, n, first in (("a", "XYZW", 60, 0), ("b", "X", 4, 100), ("c", "YV", 9, 61), ("d", "X", 2, 210), (None, "X", 3, 0)):
        for i in range(n):
            s = rnd.choice([*symbols, None]) if account == "a" else rnd.choice(symbols)
            made.append((account, s, day0 + dt.timedelta(days=first + rnd.randrange(150) if account != "d" else first), i, float(rnd.choice([-20, -10, 10, 20])), rnd.uniform(5, 50), 0.1, 0.0))
    fills = spark.createDataFrame(made, "account string, symbol string, ts date, i long, quantity double, price double, commission double, fees double")
    closes = [(s, day0 + dt.timedelta(days=d), rnd.uniform(5, 50)) for s, first in (("X", 0), ("Y", 0), ("Z", 90), ("V", 75)) for d in range(first, 210, 11)]
    bars = spark.createDataFrame(closes, "symbol string, ts date, close double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        run = positions.running_positions(fills, ["ts", "i"])
        got = {(r.account, r.mark_ts): r for r in positions.snapshots(run, bars, "2026-05-30", capital=100.0).collect()}
        text = F.concat("symbol", F.lit(":"), F.col("quantity").cast("int").cast("string"))
        texts = {(r.account, r.mark_ts): r.positions for r in positions.snapshots(run, bars, "2026-05-30", capital=100.0, text=text).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plain_snapshots(fills.collect(), bars.collect(), [dt.date(2025 + m // 12, m % 12 + 1, 1) for m in range(10, 17)], 100.0)
    assert got.keys() == want.keys() == texts.keys() and len({k[0] for k in want}) == 3
    for k, (*numbers, held) in want.items():
        r = got[k]
        assert [r.cash, r.net, r.gross, r.unrealized_pnl, r.realized_pnl, r.cumulative_costs, r.n_long, r.n_short] == pytest.approx(numbers)
        assert r.positions == held and r.equity == pytest.approx(r.cash + r.net)
        assert texts[k] == ",".join(f"{s}:{int(q)}" for s, q in sorted(held.items()))


def test_snapshots_sort_no_holdings(spark, two_accounts):
    """Fills are laid out once; nothing is exploded to a row a holding and mark, collected and joined with a second pass for the cash."""
    bars = spark.createDataFrame([("HOT", dt.date(2026, 1, 5), 7.0)], "symbol string, ts date, close double")
    d = positions.snapshots(positions.running_positions(two_accounts, ["ts", "symbol", "i"]), bars, "2026-06-30", capital=100.0)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == 1
    assert "Generate" not in plan and "ObjectHashAggregate" not in plan


def test_charges_drain_the_cash_of_snapshots(spark, two_accounts):
    charges = spark.createDataFrame([("b", dt.date(2026, 1, 20), 3.0), ("b", dt.date(2026, 2, 1), 2.0), ("b", dt.date(2026, 2, 2), 5.0), ("b", dt.date(2026, 1, 3), -4.0)],
                                    "account string, ts date, amount double")
    run, bars = positions.running_positions(two_accounts, ["ts", "symbol", "i"]), spark.createDataFrame([], "symbol string, ts date, close double")
    cash = lambda c: {r.mark_ts.month: r.cash for r in positions.snapshots(run, bars, "2026-04-02", capital=100.0, charges=c).filter("account = 'b'").collect()}
    bare, drained = cash(None), cash(charges)
    assert {m: round(bare[m] - drained[m], 9) for m in bare} == {2: 5.0, 3: 10.0, 4: 10.0}
