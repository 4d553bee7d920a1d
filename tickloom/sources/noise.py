"""Noise bars on a real grid: the null hypothesis for a strategy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import seeded_hash, uniform
from tickloom.operators.series import calendar_chunk, prefix_scan
from tickloom.settings import TRADING_DAYS


def noise_bars(
    grid: DataFrame, *, seed: int = 7, drift: float = 0.0, vol: float = 0.2, start: float = 100.0, regimes: bool = False
) -> DataFrame:
    """Random-walk bars for every (symbol, ts) of ``grid``.

    Each number is a hash of seed, symbol and time, so any task gives the same
    row.  With ``regimes`` volatility switches between calm and stress when a
    running count of rare flips turns odd.
    """
    g = grid.select("symbol", "ts")

    def u(k: int):
        return uniform(seeded_hash("symbol", "ts", seed=seed * 1000 + k))

    dt = 1.0 / TRADING_DAYS
    normal = F.sqrt(-2.0 * F.ln(u(1))) * F.cos(2.0 * math.pi * u(2))
    chunk = calendar_chunk("ts", 256)
    d = g.withColumn("_z", normal)
    scale = F.lit(1.0)
    if regimes:
        d = prefix_scan(d, ["symbol"], ["ts"], chunk, sums={"_flips": (u(3) < 0.02).cast("long")})
        scale = F.when(F.col("_flips") % 2 == 1, F.lit(2.0)).otherwise(F.lit(0.8))
    step = (drift - 0.5 * vol * vol) * dt + vol * math.sqrt(dt) * scale * F.col("_z")
    d = prefix_scan(d.withColumn("_step", step), ["symbol"], ["ts"], chunk, sums={"_log": F.col("_step")})
    close = start * F.exp("_log")
    open_ = close * F.exp(-F.col("_step") * u(4))
    wick = vol * math.sqrt(dt) * 0.5
    return d.select(
        "symbol", "ts", open_.alias("open"), (F.greatest(open_, close) * (1 + wick * u(5))).alias("high"),
        (F.least(open_, close) * (1 - wick * u(6))).alias("low"), close.alias("close"), close.alias("adj_close"),
        F.round(F.exp(13.0 + 0.5 * F.sqrt(-2.0 * F.ln(u(7))) * F.cos(2.0 * math.pi * u(8)))).alias("volume"),
    )
