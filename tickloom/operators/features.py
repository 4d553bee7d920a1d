"""Trailing-window features of one symbol's bars, laid out in blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.quality import drop_incomplete
from tickloom.operators.series import RN, Blocks, ewm_lookback
from tickloom.settings import TRADING_DAYS, FeatureSettings, ewm_alpha

ANNUAL = math.sqrt(TRADING_DAYS)


def ffd_weights(d: float, threshold: float = 1e-4, max_width: int = 10_000) -> list[float]:
    """Weights of fractional differencing of order ``d``, oldest first.

    Each weight is the previous one times ``-(d - k + 1) / k``; the list ends
    before the first one below the threshold.
    """
    if d < 0 or threshold <= 0:
        raise ValueError("order must be non-negative and threshold positive")
    w = [1.0]
    for k in range(1, max_width + 1):
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < threshold:
            return w[::-1]
        w.append(nxt)
    raise ValueError(f"more than {max_width} weights are above {threshold}")


def feature_layout(bars: DataFrame, cfg: FeatureSettings, *, chunk: Column | None = None) -> Blocks:
    """One layout deep enough for every feature of ``cfg``."""
    fast, slow, signal = cfg.macd
    ewm = max(
        ewm_lookback(1.0 / cfg.rsi_window) + 1,
        ewm_lookback(ewm_alpha(span=slow)) + ewm_lookback(ewm_alpha(span=signal)),
    )
    width = len(ffd_weights(cfg.fracdiff_d, cfg.fracdiff_threshold))
    deep = max(ewm, width + cfg.zscore_window, max(cfg.return_horizons) + cfg.zscore_window, max(cfg.ma_windows))
    return Blocks.lay(bars, ["symbol"], ["ts"], lookback=deep, block_rows=1536, chunk=chunk)


def log_returns(b: Blocks, horizons: tuple[int, ...]) -> dict[str, Column]:
    c = F.col("close")
    return {f"ret_{h}d": F.ln(F.try_divide(c, b.lag(c, h))) for h in horizons}


def volatilities(b: Blocks, windows: tuple[int, ...], log_ret: Column) -> dict[str, Column]:
    """Close-to-close and Garman-Klass volatility, annualised."""
    hl, co = F.ln(F.try_divide(F.col("high"), F.col("low"))), F.ln(F.try_divide(F.col("close"), F.col("open")))
    gk = 0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co
    out = {}
    for w in windows:
        out[f"vol_{w}d"] = b.std(log_ret, w) * ANNUAL
        out[f"gk_vol_{w}d"] = F.sqrt(F.greatest(b.mean(gk, w), F.lit(0.0))) * ANNUAL
    return out


def rsi_inputs(b: Blocks) -> dict[str, Column]:
    """Gain and loss per bar; the first bar counts as no change."""
    delta = F.col("close") - b.lag(F.col("close"), 1)
    return {
        "_gain": F.when(delta > 0, delta).otherwise(F.lit(0.0)),
        "_loss": F.when(delta < 0, -delta).otherwise(F.lit(0.0)),
    }


def rsi(b: Blocks, window: int) -> Column:
    """Relative strength index in [0, 1] from ``rsi_inputs`` columns."""
    up, down = b.ewm(F.col("_gain"), 1.0 / window), b.ewm(F.col("_loss"), 1.0 / window)
    rs = up / (down + F.lit(1e-12))
    return (100.0 - 100.0 / (1.0 + rs)) / 100.0


def macd_line(b: Blocks, fast: int, slow: int) -> Column:
    c = F.col("close")
    return b.ewm(c, ewm_alpha(span=fast)) - b.ewm(c, ewm_alpha(span=slow))


def bollinger(b: Blocks, window: int) -> Column:
    c = F.col("close")
    return (c - b.mean(c, window)) / (2.0 * b.std(c, window) + F.lit(1e-12))


def ma_distances(b: Blocks, windows: tuple[int, ...]) -> dict[str, Column]:
    c = F.col("close")
    return {f"dist_ma_{w}": F.try_divide(c, b.mean(c, w)) - 1.0 for w in windows}


def volume_features(b: Blocks, zwin: int, window: int) -> dict[str, Column]:
    v = F.col("volume")
    return {
        "volume_z": b.zscore(F.log1p(v), zwin),
        "volume_ratio": F.try_divide(v, b.mean(v, window)) - 1.0,
    }


def true_range(b: Blocks) -> Column:
    """Largest of the three ranges; the first bar has only its own."""
    h, lo, pc = F.col("high"), F.col("low"), b.lag(F.col("close"), 1)
    return F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc))


def frac_diff(b: Blocks, value: Column, d: float, threshold: float, out: str) -> Blocks:
    """Fractional differencing of order ``d``: a dot product per full window."""
    return frac_diffs(b, value, {out: d}, threshold)


def frac_diffs(b: Blocks, value: Column, orders: dict[str, float], threshold: float) -> Blocks:
    """Several orders of one series in one pass: a convolution per block and order."""
    kernels = [np.array(ffd_weights(d, threshold)) for d in orders.values()]
    b._check(max(map(len, kernels)) - 1)
    return b.blockwise([value], list(orders), lambda xs: [_dot(xs[0], k) for k in kernels])


def _dot(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= len(kernel):
        out[len(kernel) - 1 :] = np.convolve(x, kernel[::-1], mode="valid")
    return out


def compute_features(bars: DataFrame, cfg: FeatureSettings | None = None) -> DataFrame:
    """All features per bar; a value is NULL until its window is full.

    Two exchanges: one to number the bars, one to lay the blocks out; every
    window then shares one (symbol, block) partitioning and order.
    """
    return _features(bars, cfg or FeatureSettings()).close()


def _features(bars: DataFrame, cfg: FeatureSettings) -> Blocks:
    keep = [c for c in bars.columns]
    b = feature_layout(bars, cfg)
    b = frac_diff(b, F.ln("close"), cfg.fracdiff_d, cfg.fracdiff_threshold, "ffd_log_close")
    fast, slow, signal = cfg.macd
    c = F.col("close")
    b = b.add(
        **log_returns(b, cfg.return_horizons), **rsi_inputs(b), _lr=F.ln(F.try_divide(c, b.lag(c, 1))), _tr=true_range(b),
        _macd=macd_line(b, fast, slow),
    )
    b = b.add(
        **volatilities(b, cfg.vol_windows, F.col("_lr")),
        rsi=rsi(b, cfg.rsi_window),
        macd=F.try_divide(F.col("_macd"), c),
        macd_hist=F.try_divide(F.col("_macd") - b.ewm(F.col("_macd"), ewm_alpha(span=signal)), c),
        bb_position=bollinger(b, cfg.bollinger_window),
        **ma_distances(b, cfg.ma_windows),
        volume_ratio=F.try_divide(F.col("volume"), b.mean(F.col("volume"), cfg.volume_window)) - 1.0,
        atr_pct=F.try_divide(b.mean(F.col("_tr"), cfg.atr_window), c),
    )
    wide = {"volume_z": F.log1p("volume"), "ffd_z": F.col("ffd_log_close")}
    b = b.zscores(wide | {f"ret_{h}d_z": F.col(f"ret_{h}d") for h in cfg.return_horizons}, cfg.zscore_window)
    layout = [RN, "_home", *b.part]
    made = [f"ret_{h}d" for h in cfg.return_horizons] + ["ffd_log_close"]
    cols = dict.fromkeys([*layout, *keep, *made, *cfg.columns()])
    return b._with(b.frame.select(*cols))


def build_dataset(bars: DataFrame, cfg: FeatureSettings | None = None) -> DataFrame:
    """Complete feature rows after the warm-up (short symbols keep all rows)."""
    cfg = cfg or FeatureSettings()
    own = _features(bars, cfg).close(keep_rn=True)
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= cfg.warmup)
    short = own.join(n, "symbol", "left").withColumn("_short", F.col("_n").isNotNull())
    warm = short.filter((F.col(RN) >= cfg.warmup) | F.col("_short")).drop("_n", "_short", RN)
    return drop_incomplete(warm, cfg.columns())


def min_ffd_order(
    series: DataFrame, *, keys: list[str], order: str, value: str, threshold: float, candidates: list[float],
    min_points: int = 100,
) -> DataFrame:
    """Smallest order per key whose halves have a variance ratio in (0.5, 2).

    Where no candidate passes, the last one is given.
    """
    width = max(len(ffd_weights(d, threshold)) for d in candidates)
    b = Blocks.lay(series.select(*keys, order, value), keys, [order], lookback=width)
    b = frac_diffs(b, F.col(value), {f"_d{i}": d for i, d in enumerate(candidates)}, threshold)
    own = b.close(keep_rn=True)
    names = [f"_d{i}" for i in range(len(candidates))]
    long = own.select(*keys, RN, *names).unpivot([*keys, RN], names, "_name", "_y").dropna(subset=["_y"])
    # Position among the valid points: those miss only the first width-1 rows.
    per = long.groupBy(*keys, "_name").agg(F.count(F.lit(1)).alias("_n"), F.min(RN).alias("_lo"))
    half = long.join(per, [*keys, "_name"]).withColumn("_second", (F.col(RN) - F.col("_lo")) >= F.floor(F.col("_n") / 2))
    var = half.groupBy(*keys, "_name", "_n").agg(
        F.var_pop(F.when(~F.col("_second"), F.col("_y"))).alias("_v1"),
        F.var_pop(F.when(F.col("_second"), F.col("_y"))).alias("_v2"),
    )
    orders = F.create_map(*[x for i, d in enumerate(candidates) for x in (F.lit(f"_d{i}"), F.lit(float(d)))])
    ratio = F.col("_v2") / F.greatest(F.col("_v1"), F.lit(1e-12))
    ok = (F.col("_n") >= min_points) & (ratio > 0.5) & (ratio < 2.0)
    best = F.coalesce(F.min(F.when(ok, orders[F.col("_name")])), F.lit(float(candidates[-1])))
    return var.groupBy(*keys).agg(best.alias("d"))
