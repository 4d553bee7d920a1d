"""Primitives against pandas and brute force, with one key far larger than the rest."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.series import RN, Blocks, asof_backward, calendar_chunk, ewm_lookback, first_after, index_series, linear_scan, prefix_scan

DAY0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for key, n in (("hot", 900), ("b", 40), ("c", 3)):
        out += [(key, DAY0 + dt.timedelta(days=2 * i), i, rnd.uniform(1, 100)) for i in range(n)]
    return pd.DataFrame(out, columns=["k", "ts", "i", "x"])


def collected(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_two_level_index_equals_position(spark, rows):
    d = index_series(spark.createDataFrame(rows), ["k"], ["ts"], calendar_chunk("ts", 30))
    got = collected(d, "k", "ts")
    assert (got[RN] == got["i"]).all()


@pytest.mark.parametrize("n", [5, 100])
def test_block_windows_equal_pandas(spark, rows, n):
    b = Blocks.lay(spark.createDataFrame(rows), ["k"], ["ts"], lookback=120, lookahead=2, block_rows=64, chunk=calendar_chunk("ts", 30))
    x = F.col("x")
    b = b.add(m=b.mean(x, n), s=b.std(x, n), p=b.std_pop(x, n), nxt=b.lead(x, 2))
    got = collected(b.close(), "k", "ts")
    g = rows.sort_values(["k", "ts"]).groupby("k")["x"]
    assert len(got) == len(rows)
    for col, want in (("m", g.rolling(n).mean()), ("s", g.rolling(n).std()), ("p", g.rolling(n).std(ddof=0))):
        np.testing.assert_allclose(got[col].to_numpy(float), want.to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(got["nxt"].to_numpy(float), g.shift(-2).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("level,sd", [(1.0, 1.0), (1e3, 1e-3), (1e5, 0.01), (1e6, 0.05), (1e9, 0.5)])
def test_windows_keep_their_spread_at_any_level(spark, level, sd):
    rng = np.random.default_rng(3)
    x = level + sd * rng.standard_normal(700)
    x[150], x[250], x[350] = np.nan, np.inf, 1e3 * level
    pdf = pd.DataFrame({"k": "a", "ts": [DAY0 + dt.timedelta(days=i) for i in range(700)], "i": range(700), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("i") != 50, F.col("x")))
    b = Blocks.lay(df, ["k"], ["ts"], lookback=310, block_rows=200)
    widths = (63, 64, 65, 130, 252, 300)
    for w in widths:
        b = b.zscores({f"y{w}": F.col("x")}, w)
    b = b.add(**{f"{n}{w}": f(F.col("x"), w) for w in widths for n, f in (("m", b.mean), ("s", b.std), ("p", b.std_pop), ("z", b.zscore))})
    got = collected(b.close(), "ts")
    clean = pd.Series(np.where(np.isfinite(x) & (np.arange(700) != 50), x, np.nan))
    for w in widths:
        frames = np.lib.stride_tricks.sliding_window_view(clean.to_numpy(), w)
        pad = np.full(w - 1, np.nan)
        mean = np.append(pad, frames.mean(1))
        dev = (frames - frames.mean(1, keepdims=True)) ** 2
        std, pop = np.append(pad, np.sqrt(dev.sum(1) / (w - 1))), np.append(pad, np.sqrt(dev.mean(1)))
        np.testing.assert_allclose(got[f"m{w}"].to_numpy(float), mean, rtol=1e-12)
        np.testing.assert_allclose(got[f"s{w}"].to_numpy(float), std, rtol=1e-5)
        np.testing.assert_allclose(got[f"p{w}"].to_numpy(float), pop, rtol=1e-5)
        z = np.where(np.isnan(std), np.nan, (x - mean) / (std + 1e-12))
        np.testing.assert_allclose(got[f"z{w}"].to_numpy(float), z, rtol=1e-4, atol=1e-4)
        np.testing.assert_allclose(got[f"y{w}"].to_numpy(float), z, rtol=1e-4, atol=1e-4)
        assert np.isfinite(std).any()


def test_constant_window_has_no_spread(spark):
    pdf = pd.DataFrame({"k": "a", "ts": [DAY0 + dt.timedelta(days=i) for i in range(300)], "x": [float(i) for i in range(100)] + [7.3] * 200})
    b = Blocks.lay(spark.createDataFrame(pdf), ["k"], ["ts"], lookback=100)
    got = collected(b.add(s=b.std(F.col("x"), 90)).close(), "ts")
    assert (got["s"].iloc[200:] == 0).all()


def test_window_deeper_than_layout_is_refused(spark, rows):
    b = Blocks.lay(spark.createDataFrame(rows), ["k"], ["ts"], lookback=10)
    with pytest.raises(ValueError):
        b.mean(F.col("x"), 20)


@pytest.mark.parametrize("alpha", [2 / 13, 1 / 14, 0.5])
def test_ewm_equals_recursion(spark, rows, alpha):
    b = Blocks.lay(spark.createDataFrame(rows), ["k"], ["ts"], lookback=ewm_lookback(alpha), block_rows=100)
    got = collected(b.add(y=b.ewm(F.col("x"), alpha)).close(), "k", "ts")
    want = rows.sort_values(["k", "ts"]).groupby("k")["x"].transform(lambda v: v.ewm(alpha=alpha, adjust=False).mean())
    np.testing.assert_allclose(got["y"].to_numpy(float), want.to_numpy(), rtol=1e-11)


def test_prefix_scan_equals_cumulatives(spark, rows):
    sparse = F.when(F.col("i") % 7 == 3, F.col("x"))
    d = prefix_scan(spark.createDataFrame(rows), ["k"], ["ts"], calendar_chunk("ts", 30),
                    sums={"s": F.col("x")}, maxs={"m": F.col("x")}, lasts={"l": sparse})
    got = collected(d, "k", "ts")
    r = rows.sort_values(["k", "ts"])
    np.testing.assert_allclose(got["s"], r.groupby("k")["x"].cumsum(), rtol=1e-12)
    np.testing.assert_allclose(got["m"], r.groupby("k")["x"].cummax())
    want = r["x"].where(r["i"] % 7 == 3).groupby(r["k"]).ffill()
    np.testing.assert_allclose(got["l"].to_numpy(float), want.to_numpy())


def test_linear_scan_with_resets_and_deep_decay(spark, rows):
    rnd = random.Random(9)
    pdf = rows.assign(a=[rnd.choice([0.0, 1.0, 1.0, 0.5, 1e-6, 0.999]) if i % 50 == 0 else rnd.choice([1.0, 0.01, 0.7]) for i in range(len(rows))], b=rows["x"])
    d = linear_scan(spark.createDataFrame(pdf), ["k"], ["ts"], calendar_chunk("ts", 200), decay=F.col("a"), add=F.col("b"), out="y", before="y0")
    got = collected(d, "k", "ts")
    want, prev = [], []
    for _, g in pdf.sort_values(["k", "ts"]).groupby("k"):
        y = 0.0
        for a, b in zip(g["a"], g["b"]):
            prev.append(y)
            y = a * y + b
            want.append(y)
    np.testing.assert_allclose(got["y"], want, rtol=1e-9)
    np.testing.assert_allclose(got["y0"], prev, rtol=1e-9)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_backward_equals_merge_asof(spark, rows, strict):
    right = rows[rows["i"] % 9 == 0][["k", "ts", "x"]].rename(columns={"ts": "rts", "x": "v"})
    d = asof_backward(spark.createDataFrame(rows), spark.createDataFrame(right), keys=["k"], left_ts="ts", right_ts="rts", values=["v"], bucket=10, strict=strict)
    got = collected(d, "k", "ts")
    a = rows.assign(ts=pd.to_datetime(rows["ts"])).sort_values("ts")
    b = right.assign(rts=pd.to_datetime(right["rts"])).sort_values("rts")
    want = pd.merge_asof(a, b, left_on="ts", right_on="rts", by="k", allow_exact_matches=not strict).sort_values(["k", "ts"])
    np.testing.assert_allclose(got["v"].to_numpy(float), want["v"].to_numpy(float))


def test_first_after_is_strict(spark, rows):
    right = rows[rows["i"] % 5 == 0][["k", "ts", "x"]].rename(columns={"ts": "rts", "x": "v"})
    d = first_after(spark.createDataFrame(rows), spark.createDataFrame(right), keys=["k"], left_ts="ts", right_ts="rts", values=["v"], bucket=10)
    got = collected(d, "k", "ts")
    a = rows.assign(ts=pd.to_datetime(rows["ts"])).sort_values("ts")
    b = right.assign(rts=pd.to_datetime(right["rts"])).sort_values("rts")
    want = pd.merge_asof(a, b, left_on="ts", right_on="rts", by="k", direction="forward", allow_exact_matches=False).sort_values(["k", "ts"])
    np.testing.assert_allclose(got["v"].to_numpy(float), want["v"].to_numpy(float))
