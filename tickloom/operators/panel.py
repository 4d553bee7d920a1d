"""Cross-sectional panel: features per (ts, symbol), labels and ranks.

A window over one ``ts`` holds at most one row per symbol, so its size is the
size of the universe however long the history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, finite, seeded_hash
from tickloom.operators.series import Blocks

FEATURES = ["mom_1m", "mom_3m", "mom_12m", "vol_20d", "vol_60d", "adv_20d", "cross_sectional_rank"]
M1, M3, M12 = 21, 63, 252


def average_rank(c: Column, by: list[str]) -> Column:
    """Rank with ties averaged; NULL for NULL values."""
    asc = Window.partitionBy(*by).orderBy(c.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.when(c.isNotNull(), F.rank().over(asc) + (ties - 1) / F.lit(2.0))


def bounded_rank(c: Column, by: list[str]) -> Column:
    """Average rank scaled to [0, 1]."""
    n = F.count(c).over(Window.partitionBy(*by))
    return (average_rank(c, by) - 1.0) / F.greatest(n - 1, F.lit(1))


def cross_zscore(c: Column, by: list[str], clip_sigma: float) -> Column:
    """Winsorised z-score over a date: population sigma, non-finite gives 0."""
    x = Window.partitionBy(*by)
    v = finite(c)
    n, mu, sd = F.count(v).over(x), F.avg(v).over(x), F.stddev_pop(v).over(x)
    z = F.when((n >= 2) & (sd > 0), clip((v - mu) / sd, -clip_sigma, clip_sigma))
    return F.coalesce(z, F.lit(0.0))


def forward_return(bench: DataFrame, horizon: int) -> DataFrame:
    """ts and the benchmark's return over the next ``horizon`` rows."""
    b = Blocks.lay(bench.select("ts", "close"), [], ["ts"], lookback=0, lookahead=horizon)
    f = F.try_divide(b.lead(F.col("close"), horizon), F.col("close")) - 1.0
    return b.add(bench_fwd=f).close().select("ts", "bench_fwd")


def momentum_frame(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Per-symbol part of the panel with one forward return per horizon."""
    b = Blocks.lay(bars.select("symbol", "ts", "close", "volume"), ["symbol"], ["ts"], lookback=M12 + 1, lookahead=max(horizons))
    c = F.col("close")
    b = b.add(_ret=F.try_divide(c, b.lag(c, 1)) - 1.0, _dollar=c * F.col("volume"))
    b = b.add(
        mom_1m=F.try_divide(c, b.lag(c, M1)) - 1.0,
        mom_3m=F.try_divide(c, b.lag(c, M3)) - 1.0,
        mom_12m=F.try_divide(b.lag(c, M1), b.lag(c, M12)) - 1.0,
        vol_20d=b.std(F.col("_ret"), 20),
        vol_60d=b.std(F.col("_ret"), 60),
        adv_20d=b.mean(F.col("_dollar"), 20),
        **{f"_fwd_{h}": F.try_divide(b.lead(c, h), c) - 1.0 for h in horizons},
    )
    return b.close().drop("_ret", "_dollar", "volume")


def build_panel(bars: DataFrame, bench: DataFrame, *, horizon: int = 20) -> DataFrame:
    """(ts, symbol) features and the excess forward return as target.

    Rows appear once every feature exists; the target stays NULL for the last
    ``horizon`` rows of a symbol.
    """
    p = momentum_frame(bars, [horizon]).withColumnRenamed(f"_fwd_{horizon}", "_fwd")
    p = p.join(forward_return(bench, horizon), "ts", "left")
    # Both rank windows of a date share one exchange on ts.
    p = p.repartition("ts").withColumn("cross_sectional_rank", bounded_rank(F.col("mom_3m"), ["ts"]))
    p = p.withColumn("target", F.col("_fwd") - F.col("bench_fwd"))
    return p.dropna(subset=FEATURES).select("ts", "symbol", *FEATURES, "target")


def extended_panel(bars: DataFrame, bench: DataFrame, *, horizon: int = 20) -> DataFrame:
    """Research columns: 5-day reversal, 52-week-high proximity, vol-scaled
    momentum, log dollar volume, each with its within-date z-score."""
    b = Blocks.lay(bars.select("symbol", "ts", "close", "volume"), ["symbol"], ["ts"], lookback=M12 + 1)
    c = F.col("close")
    b = b.add(_ret=F.try_divide(c, b.lag(c, 1)) - 1.0, _dollar=c * F.col("volume"))
    b = b.add(
        reversal_5d=-(F.try_divide(c, b.lag(c, 5)) - 1.0),
        high_52w=c / b.full(M12, F.max(c).over(b.rows(M12)), c),
        mom_vol=F.try_divide(F.try_divide(c, b.lag(c, M3)) - 1.0, b.std(F.col("_ret"), 60)),
        log_adv=F.ln(b.mean(F.col("_dollar"), 20)),
    )
    cols = ["reversal_5d", "high_52w", "mom_vol", "log_adv"]
    p = b.close().dropna(subset=cols).select("ts", "symbol", *cols)
    return p.withColumns({f"{x}_z": cross_zscore(F.col(x), ["ts"], 3.0) for x in cols})


def horizon_panel(bars: DataFrame, bench: DataFrame, horizons: list[int]) -> DataFrame:
    """Long panel (h, ts, symbol, score, target): 3-month momentum against
    the excess return of every horizon, from one pass over the bars."""
    p = momentum_frame(bars, horizons).dropna(subset=["mom_3m"])
    wide = None
    b = Blocks.lay(bench.select("ts", "close"), [], ["ts"], lookback=0, lookahead=max(horizons))
    wide = b.add(**{f"_b{h}": F.try_divide(b.lead(F.col("close"), h), F.col("close")) - 1.0 for h in horizons}).close().drop("close")
    p = p.join(wide, "ts", "left")
    stack = F.array(*[F.struct(F.lit(h).alias("h"), (F.col(f"_fwd_{h}") - F.col(f"_b{h}")).alias("target")) for h in horizons])
    return p.select("ts", "symbol", F.col("mom_3m").alias("score"), F.inline(stack))


def shuffle_targets(panel: DataFrame, *, seed: int = 7, by: list[str] | None = None) -> DataFrame:
    """Permute targets across the symbols of each date, repeatably."""
    by = by or ["ts"]
    w = Window.partitionBy(*by)
    key = seeded_hash(*by, "symbol", seed=seed)
    rows = panel.withColumn("_slot", F.row_number().over(w.orderBy("symbol")))
    drawn = panel.select(*by, F.col("target").alias("_drawn"), F.row_number().over(w.orderBy(key, "symbol")).alias("_slot"))
    out = rows.join(drawn, [*by, "_slot"]).withColumn("target", F.col("_drawn"))
    return out.select(*panel.columns)
