"""Composite cross-sectional score and the news tilts on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, half_life_decay
from tickloom.operators.panel import cross_zscore
from tickloom.operators.series import RN, Blocks
from tickloom.settings import AlphaSettings, NewsSettings


def median_dollar_volume(b: Blocks, n: int) -> Column:
    """Exact median of close times volume over the last ``n`` full bars."""
    x = F.col("close") * F.col("volume")
    med = F.percentile(x, F.lit(0.5)).over(b.rows(n))
    return F.when(F.count(F.lit(1)).over(b.rows(n)) == n, med)


def alpha_inputs(bars: DataFrame, cfg: AlphaSettings) -> DataFrame:
    """Reversal, vol-scaled momentum, volatility and liquidity per bar.

    Rows without the full history, or without a positive volatility, are
    absent; nothing is filled back.
    """
    rev, mom, vol = (cfg.bars(x) for x in (cfg.reversal_days, cfg.momentum_days, cfg.vol_days))
    b = Blocks.lay(bars.select("symbol", "ts", "close", "volume"), ["symbol"], ["ts"], lookback=max(rev, mom, vol) + 1)
    c = F.col("close")
    price = F.when(c > 0, c)
    b = b.add(_lr=F.ln(price / b.lag(price, 1)))
    b = b.add(
        _rev=price_return(b, rev),
        _mom=price_return(b, mom),
        vol=b.std_pop(F.col("_lr"), vol),
        dollar_volume=median_dollar_volume(b, vol),
    )
    d = b.close(keep_rn=True)
    enough = (F.col(RN) + 1 >= cfg.warmup_bars) & (F.col("vol") > 0)
    d = d.filter(enough & F.col("_rev").isNotNull() & F.col("_mom").isNotNull())
    return d.select(
        "ts", "symbol", "close", "vol", "dollar_volume",
        F.col("_rev").alias("rev"),
        (F.col("_mom") / F.col("vol")).alias("mom"),
        F.when(F.col("dollar_volume") > 0, F.ln("dollar_volume")).alias("liq"),
    )


def price_return(b: Blocks, n: int) -> Column:
    """Return over ``n`` bars, NULL where the base price is not positive."""
    base = b.lag(F.col("close"), n)
    return F.col("close") / F.when(base > 0, base) - 1.0


def score_cross_section(bars: DataFrame, cfg: AlphaSettings | None = None, *, min_breadth: int = 2) -> DataFrame:
    """ts, symbol, score in cross-sectional sigmas, vol and dollar volume."""
    cfg = cfg or AlphaSettings()
    x = Window.partitionBy("ts")
    d = alpha_inputs(bars, cfg).repartition("ts").withColumn("_n", F.count(F.lit(1)).over(x))
    d = d.filter(F.col("_n") >= min_breadth)
    z = {k: cross_zscore(F.col(k), ["ts"], cfg.clip_sigma) for k in ("rev", "mom", "vol", "liq")}
    d = d.withColumns({f"_z_{k}": v for k, v in z.items()})
    raw = (
        -cfg.reversal_weight * F.col("_z_rev")
        + cfg.momentum_weight * F.col("_z_mom")
        - cfg.vol_weight * F.col("_z_vol")
        + cfg.liquidity_weight * F.col("_z_liq")
    )
    d = d.withColumn("_raw", raw)
    d = d.withColumn("_c", F.col("_raw") - F.avg("_raw").over(x))
    d = d.withColumn("_sd", F.stddev_pop("_c").over(x))
    score = F.when(F.col("_sd") > 0, F.col("_c") / F.col("_sd")).otherwise(F.col("_c"))
    return d.select("ts", "symbol", score.alias("score"), "vol", "dollar_volume")


def apply_news(scores: DataFrame, cfg: NewsSettings | None = None) -> DataFrame:
    """Additive tilt from columns ``relative``, ``macro`` and ``age_days``.

    The tilted scores are re-centred per date; ``net_tilt`` carries the macro
    part.  A missing or expired signal leaves scores as they are.
    """
    cfg = cfg or NewsSettings()
    live = F.col("age_days").isNotNull() & (F.col("age_days") < cfg.tilt_max_age_days)
    decay = half_life_decay(F.col("age_days"), cfg.tilt_half_life_days)
    tilt = cfg.company_weight * decay * F.coalesce(F.col("relative"), F.lit(0.0))
    d = scores.withColumn("_t", F.when(live, F.col("score") + tilt).otherwise(F.col("score")))
    centred = F.when(live, F.col("_t") - F.avg("_t").over(Window.partitionBy("ts"))).otherwise(F.col("_t"))
    net = F.when(live, cfg.net_weight * decay * F.coalesce(F.col("macro"), F.lit(0.0))).otherwise(F.lit(0.0))
    return d.withColumns({"score": centred, "net_tilt": net}).drop("_t")


def multiplicative_tilt(f: Column, news: Column, decay: Column, weight: float) -> Column:
    """Scale a conviction by news without ever changing its sign."""
    adj = F.greatest(F.lit(0.0), 1.0 + weight * news * decay * F.signum(f))
    return F.when((decay <= 0) | (f == 0) | (news == 0), f).otherwise(clip(f * adj, -1.0, 1.0))


def combined_view(own: Column, macro: Column, macro_weight: float) -> Column:
    """Own tone plus a share of the market's, in [-1, 1]."""
    return clip(F.coalesce(own, F.lit(0.0)) + macro_weight * macro, -1.0, 1.0)


def signal_decay(age: Column, half_life: float, max_age: float) -> Column:
    """Weight of a published signal: nothing from the future or too old."""
    return F.when((age < 0) | (age > max_age) | age.isNull(), F.lit(0.0)).otherwise(half_life_decay(age, half_life))
