"""The chains run end to end and keep their identities."""

import pytest
from pyspark.sql import functions as F

from test_operators import make_bars
from tickloom.plans import chains
from tickloom.settings import AlphaSettings, SizingSettings

A = AlphaSettings(bars_per_day=1)
S = SizingSettings(target_gross=1.0, min_dollar_volume=0.0)


def test_planted_signal_is_found(spark):
    bars = make_bars(spark, n=320, symbols=8)
    bench = bars.groupBy("ts").agg(F.avg("close").alias("close"))
    _ic, summary = chains.research(bars, bench, score=F.col("target") + 0.01 * F.col("mom_1m"))
    assert summary.first()["mean"] > 0.8


def test_weights_to_fills(spark):
    bars = make_bars(spark, n=40, symbols=24)
    w = chains.weights(bars, alpha_cfg=A, sizing_cfg=S)
    gross = {round(r.g, 9) for r in w.groupBy("ts").agg(F.sum(F.abs("weight")).alias("g")).collect()}
    assert gross == {1.0}
    flat = bars.select("ts", "symbol", F.lit(0.0).alias("weight"), F.lit(0.0).alias("quantity"))
    f = chains.fills(w, flat, bars, F.lit(1e6), sizing_cfg=S).toPandas()
    assert len(f) and (f["slippage"] > 0).all()
    assert f["quantity"].abs().min() >= 1
    assert f["notional"].to_numpy() == pytest.approx((f["quantity"].abs() * f["price"]).to_numpy())
