"""Parameters of the operators, as frozen dataclasses.

Fixed values: the defaults decide results and are the ones users expect.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

TRADING_DAYS = 252
BARS_PER_DAY = 13
BARS_PER_YEAR = BARS_PER_DAY * TRADING_DAYS
EXCHANGE_TZ = "America/New_York"
QTY_EPS = 1e-9
BPS = 1e-4


@dataclass(frozen=True)
class FeatureSettings:
    """Look-backs of the per-symbol feature set, in bars."""

    return_horizons: tuple[int, ...] = (1, 5, 10, 21, 63)
    vol_windows: tuple[int, ...] = (21, 63)
    rsi_window: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    bollinger_window: int = 20
    ma_windows: tuple[int, ...] = (21, 63, 200)
    zscore_window: int = 252
    volume_window: int = 21
    atr_window: int = 14
    fracdiff_d: float = 0.4
    fracdiff_threshold: float = 1e-4
    warmup: int = 300

    def columns(self) -> list[str]:
        """Model columns in their contractual order."""
        cols = [f"ret_{h}d_z" for h in self.return_horizons]
        cols += [f"vol_{w}d" for w in self.vol_windows]
        cols += [f"gk_vol_{w}d" for w in self.vol_windows]
        cols += ["rsi", "macd", "macd_hist", "bb_position"]
        cols += [f"dist_ma_{w}" for w in self.ma_windows]
        return cols + ["volume_z", "volume_ratio", "atr_pct", "ffd_z"]


@dataclass(frozen=True)
class AlphaSettings:
    """Composite score: look-backs in days and the weight of each term."""

    reversal_days: float = 3.0
    reversal_weight: float = 1.0
    momentum_days: float = 20.0
    momentum_weight: float = 0.6
    vol_days: float = 10.0
    vol_weight: float = 0.3
    liquidity_weight: float = 0.15
    clip_sigma: float = 3.0
    bars_per_day: int = BARS_PER_DAY

    def bars(self, days: float) -> int:
        return max(2, int(round(days * self.bars_per_day)))

    @property
    def warmup_bars(self) -> int:
        return max(self.bars(self.momentum_days), self.bars(self.vol_days)) + 2


@dataclass(frozen=True)
class SizingSettings:
    """How a score becomes a weight; every ``None`` limit is off."""

    target_gross: float | None = None
    vol_target_annual: float = 0.35
    correlation_rho: float = 0.25
    residual_factor_vol: float = 0.21
    max_gross: float | None = None
    max_position_weight: float | None = None
    max_net_exposure: float | None = None
    rebalance_band: float = 0.25
    selection_fraction: float = 0.25
    min_dollar_volume: float = 250_000.0
    cap_passes: int = 16
    bars_per_year: int = BARS_PER_YEAR


@dataclass(frozen=True)
class NewsSettings:
    """Aggregation of articles and the two ways a signal tilts a score."""

    half_life_days: float = 2.0
    prior_count: float = 3.0
    max_age_days: float = 14.0
    company_weight: float = 0.35
    net_weight: float = 0.20
    tilt_half_life_days: float = 2.0
    tilt_max_age_days: float = 10.0
    score_macro_weight: float = 0.5
    multiplicative_weight: float = 0.30


@dataclass(frozen=True)
class CostSettings:
    """Transaction-cost constants in basis points, per share and caps."""

    half_spread_bps: float = 1.0
    slippage_bps: float = 0.5
    use_sqrt_impact: bool = True
    impact_coef: float = 0.1
    commission_per_share: float = 0.0
    commission_bps: float = 0.0
    min_commission: float = 0.0
    sec_fee_bps: float = 0.278
    taf_per_share: float = 0.000166
    taf_cap_per_trade: float = 8.30
    short_borrow_annual_bps: float = 30.0
    default_sigma: float = 0.02


@dataclass(frozen=True)
class BookSettings:
    """Conviction book: thresholds, stops, caps and the cooldown clock."""

    min_conviction: float = 0.15
    exit_conviction: float = 0.05
    max_positions: int | None = None
    max_position_weight: float = 0.20
    max_gross_exposure: float = 0.90
    min_gross_exposure: float = 0.30
    rebalance_band_frac: float = 0.25
    stop_loss_sigma: float | None = 2.0
    stop_horizon_days: float = 20.0
    stop_loss_pct: float | None = 0.10
    stop_degross_fraction: float = 1.0
    stop_cooldown_days: int = 10
    stop_cooldown_bars: int | None = None
    bar_minutes: int = 30
    cancel_after_days: int = 5


def ewm_alpha(*, span: float | None = None, half_life: float | None = None) -> float:
    """Smoothing factor from a span or a half-life."""
    if span is not None:
        return 2.0 / (span + 1.0)
    return 1.0 - math.exp(-math.log(2.0) / half_life)
