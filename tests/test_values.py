"""Exact quantiles, draws, capped weights, decision ladder, ordered lists, identities, the fold model."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.catalog import REGISTRY
from tickloom.catalog.base import tidy
from tickloom.functions.text import WHITE, article_uid
from tickloom.operators import decisions as D
from tickloom.operators import evaluate as E
from tickloom.operators import folds as K
from tickloom.operators import panel as P
from tickloom.operators import report as R
from tickloom.operators import sizing as S
from tickloom.operators.quantiles import group_quantile
from tickloom.settings import BookSettings
from tickloom.sources import bars, state, tables


@pytest.mark.parametrize("rounds", [0, 1, 2])
@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.999, 1.0])
def test_quantiles_are_exact(spark, rounds, p):
    rnd = random.Random(4)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "ties": [0.0] * 500 + [1.0] * 3, "spread": [rnd.gauss(0, 1) * 10 ** rnd.randint(-9, 9) for _ in range(700)],
        "same": [7.0] * 40, "ends": [float("-inf"), 1.0, 2.0, 3.0, float("inf")], "near": [1.0 + k * 2**-52 for k in range(50)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("ties", None)]
    rnd.shuffle(rows)
    got = {r.g: r.q for r in group_quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), p, "q", rounds=rounds).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s, at = sorted(vs), p * (len(vs) - 1)
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        want = lo if lo == hi else lo * (1 - at % 1) + hi * (at % 1)
        assert got[g] == pytest.approx(want, rel=1e-12) or math.isnan(want) and math.isnan(got[g])


def test_quantile_of_all_rows(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    want = np.quantile([i * 7919 % 20_011 for i in range(20_000)], 0.31)
    assert group_quantile(df, ["g"], F.col("v"), 0.31, "q").first().q == pytest.approx(want)


def test_a_shuffle_moves_rows_and_keeps_dates(spark):
    rows = [(dt.date(2024, 1, 1 + d), f"S{i:02d}", float(i + 100 * d)) for d in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "ts date, symbol string, target double")
    got = {(r.ts, r.symbol): r.target for r in P.shuffle_targets(df).collect()}
    assert sorted(got.values()) == sorted(t for *_, t in rows) and all(v // 100 == k[0].day - 1 for k, v in got.items())
    assert sum(got[d, s] == t for d, s, t in rows) < 20  # the identity would keep all 200
    again = {(r.ts, r.symbol): r.target for r in P.shuffle_targets(df.repartition(7)).collect()}
    assert again == got


def test_capped_weights_equal_a_plain_loop(spark):
    rnd = random.Random(8)
    days = [(dt.date(2024, 1, 1 + d), rnd.uniform(0.2, 2.0), rnd.uniform(-0.4, 0.4), [rnd.gauss(0, 0.4) if d else abs(rnd.gauss(0, 1)) for _ in range(1 + d)]) for d in range(20)]
    rows = [(t, f"S{i:02d}", 0.0, 0.0, g, n, w) for t, g, n, ws in days for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "ts date, symbol string, score double, vol double, gross double, net_target double, weight double")
    got = {(r.ts, r.symbol): r.weight for r in S.capped(df, 0.15, 16).collect()}
    for t, gross, net, ws in days:
        w, aim = np.array(ws), max(-gross, min(gross, net))
        for _ in range(16):
            w = np.clip(w, -0.15, 0.15)
            lng, sht = w[w > 0].sum(), -w[w < 0].sum()
            if lng + sht <= 0 or abs(lng + sht - gross) < 1e-9 and abs(lng - sht - net) < 1e-9:
                break
            up, down = ((gross + aim) / (2 * lng), (gross - aim) / (2 * sht)) if lng > 0 and sht > 0 else (gross / (lng + sht),) * 2
            w = np.where(w > 0, w * up, w * down)
        for i, v in enumerate(np.clip(w, -0.15, 0.15)):
            assert got[t, f"S{i:02d}"] == pytest.approx(v, abs=1e-12)


def test_decision_ladder(spark):
    cols = "ts date, symbol string, conviction double, quantity double, price double, avg_price double, daily_vol double, cooling boolean, is_flatten boolean, entries_ok boolean, gross_cap double, current double, equity double"
    t = dt.date(2024, 1, 2)
    row = lambda s, c, q=0.0, price=10.0, avg=10.0, cur=0.0, cool=False: (t, s, c, q, price, avg, 0.01, cool, False, True, 0.9, cur, 1000.0)
    book = [
        row("hold", 0.5, 9.0, cur=0.09), row("more", 0.5, 1.0, cur=0.01), row("exit", 0.01, 5.0), row("stop", 0.6, 5.0, price=8.0), row("new", 0.9), row("next", 0.8), row("third", 0.7),
        row("thin", -0.95, price=500.0), row("cool", 0.9, cool=True), row("weak", 0.1),
    ]
    got = {r.symbol: (r.action, r.outcome) for r in D.decide(spark.createDataFrame(book, cols), BookSettings(max_positions=5)).collect()}
    assert got == {
        "hold": ("rebalance", "hold"), "more": ("rebalance", "rebalance"), "exit": ("exit", "sell"), "stop": ("stop_loss", "sell"),
        "new": ("entry", "buy"), "next": ("entry", "buy"), "thin": ("entry", "skip"),
    }


def test_lists_keep_their_order_over_splits(spark, tmp_path):
    names = [f"T{i * 7919 % 3000:04d}" for i in range(3000)]
    (tmp_path / "a.txt").write_text("".join(f"  {n.lower()}  # note {n}\n" if i % 3 else f"{n}\n\n# only a note\n" for i, n in enumerate(names)))
    (tmp_path / "b.txt").write_text(names[0] + "\nZZZ\t\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        d = state.numbered_lines(spark, str(tmp_path / "a.txt"))
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 3
        text = (tmp_path / "a.txt").read_text().split("\n")[:-1]
        assert [(r.line_no, r.value) for r in d.orderBy("line_no").collect()] == list(enumerate(text, 1))
        got = [r.symbol for r in state.read_lines(spark, str(tmp_path)).collect()]
        assert got == [*names, "ZZZ"]
        assert [r.symbol for r in state.read_lines(spark, str(tmp_path), 5).collect()] == names[:5]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_identity_ignores_white_space_at_the_ends(spark):
    df = spark.createDataFrame([("http://a.com/x", "t"), *[(f"{w}http://A.com/x{w}\n", "t") for w in WHITE], ("", "http://a.com/x"), (None, "\thttp://a.com/x ")], "url string, title string")
    assert df.select(article_uid(F.col("url"), F.col("title")).alias("u")).distinct().count() == 1


def test_books_in_lines_and_refusals(spark, tmp_path):
    good = '{"version": 2, "simulated_capital": true, "account": "a", "cash": 1.0, "positions": {"X": {"quantity": 2, "avg_price": 3}}}'
    (tmp_path / "l.json").write_text(good + "\n" + good.replace('"a"', '"b"') + "\n")
    assert state.load_book(spark, str(tmp_path / "l.json"), version=2, lines=True).count() == 2
    for bad in (good.replace("true", "false"), good.replace('"version": 2', '"version": 1')):
        (tmp_path / "m.json").write_text(bad)
        with pytest.raises(Exception, match="not a simulated book"):
            state.load_book(spark, str(tmp_path / "m.json"), version=2).collect()


def test_fold_model_finds_what_is_planted_and_nothing_else(spark, tmp_path):
    g = np.random.default_rng(9)
    n_days, n_names = 260, 40
    x = g.standard_normal((n_days, n_names, 2))
    noise = g.standard_normal((n_days, n_names))
    start = dt.date(2020, 1, 1)

    def panel(target):
        rows = [(start + dt.timedelta(days=d), f"S{i:02d}", float(x[d, i, 0]), float(x[d, i, 1]), float(target[d, i])) for d in range(n_days) for i in range(n_names)]
        return spark.createDataFrame(rows, "ts date, symbol string, f1 double, f2 double, target double")

    def mean_ic(df, name):
        s = K.walk_forward_scores(spark, df, ["f1", "f2"], str(tmp_path / name / "fit"), horizon=5, refit_every=60, min_train=120, embargo=2, max_iter=4)
        K.write_ranker(str(tmp_path / name), s)
        scores, ic = K.read_ranker(spark, str(tmp_path / name))
        assert scores.count() == s.count() > 3000
        return E.ic_summary(ic).first().mean

    planted = panel(x[:, :, 0] + 0.5 * noise)
    assert mean_ic(planted, "planted") > 0.5
    assert abs(mean_ic(panel(noise), "noise")) < 0.1
    assert abs(mean_ic(P.shuffle_targets(planted), "shuffled")) < 0.1


def test_csv_files_of_any_width(spark, tmp_path):
    wide = [f"x{i}" for i in range(150)]
    head = ",".join(["Date", *wide[:100], '"Close"', *wide[100:], "Volume"])
    rows = [",".join([f"2024-01-0{d}", *['"a, ""b"""'] * 100, f' "{d}.5" ', *[""] * 50, f"{d}00"]) for d in range(1, 4)]
    (tmp_path / "wide.csv").write_text("\n".join([head, *rows, ",bad"]) + "\n")
    (tmp_path / "thin.csv").write_text("close,date\n7,2024-01-02\n,2024-01-03\n")
    got = bars.read_csv_bars(spark, str(tmp_path)).collect()
    assert sorted((r.symbol, str(r.ts), r.close, r.adj_close, r.volume) for r in got if r._corrupt is None) == [
        ("THIN", "2024-01-02", 7.0, 7.0, None), *[("WIDE", f"2024-01-0{d}", d + 0.5, d + 0.5, d * 100.0) for d in range(1, 4)]]
    assert sorted(r._corrupt for r in got if r._corrupt) == [",2024-01-03", ",bad"]
    lines = ["", ",", "a,,b", '"x,y",z', '"a""b"', '"open, z', " q , r "]
    d = spark.createDataFrame([(x,) for x in lines], "v string").select(bars.csv_cells(F.col("v")).alias("c"))
    assert [r.c for r in d.collect()] == [[""], ["", ""], ["a", "", "b"], ["x,y", "z"], ['a"b'], ['open', "z"], ["q", "r"]]


def test_best_path_equals_itself_when_means_vary(spark):
    """Means that a second reading computes anew: the in-sample best never ranks below itself."""
    anew = F.udf(lambda: random.random(), "double").asNondeterministic()
    rows = [(p, c, float(c)) for p in range(60) for c in (1, 2)]
    paths = spark.createDataFrame(rows, "path long, config int, is_perf double").withColumn("oos_perf", anew())
    assert tuple(R.overfitting_probability(paths).first()) == (0.0, 60)


def test_chart_payload_is_rounded_once(spark):
    """1.00004997 is 1.0 at four places; cut to six first it would be 1.00005 and then 1.0001."""
    rows = [("s", dt.date(2026, 1, i), v, 0.0, 0.0) for i, v in ((1, 1.0), (2, 1.00004997))]
    curve = spark.createDataFrame(rows, "strategy string, ts date, equity double, position double, turnover double")
    points = R.chart_points(R.chart_payload(curve, curve.select("ts", "equity"), digits=None)).orderBy("ts").collect()
    assert [p.equity for p in points] == [1.0, 1.00004997]
    assert [r.equity for r in tidy(spark.createDataFrame(points), 4).orderBy("ts").collect()] == [1.0, 1.0]


def test_benchmark_reads_every_day_and_carries_over_gaps(spark):
    """Ledger days with a close of their own take it, whatever the day of the month; the others take the last one before."""
    t = lambda i: dt.date(2026, 1, i)
    closes = spark.createDataFrame([(t(i), float(10 * i)) for i in (2, 4, 5, 7)], "ts date, close double")
    ledger = spark.createDataFrame([(s, t(i)) for s in "ab" for i in (1, 2, 4, 5, 6, 7)], "strategy string, ts date")
    got = {r.ts.day: r.equity for r in R.benchmark_equity(ledger, closes, capital=100.0).collect()}
    assert got == {1: 0.0, 2: 100.0, 4: 200.0, 5: 250.0, 6: 250.0, 7: 350.0}


def test_benchmark_query_reads_every_day_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    days = {str(r.ts): r.close for r in tables.benchmark(spark, sf).collect()}
    got = {r.ts: r.equity for r in REGISTRY["benchmark_as_of"].run(spark, sf).collect()}
    first = min(d for d in got if d in days)
    own = [d for d in got if d in days]
    assert len({d[-2:] for d in own}) == 31
    assert [got[d] for d in own] == pytest.approx([100_000 / days[first] * days[d] for d in own], abs=0.006)
