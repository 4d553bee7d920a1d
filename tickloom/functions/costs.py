"""Transaction-cost columns: impact, fill price, commission, fees, borrow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.settings import BPS, CostSettings


def impact_fraction(qty: Column, sigma: Column, volume: Column, c: CostSettings) -> Column:
    """Square-root impact as a fraction of price; zero for unknown volume."""
    if not c.use_sqrt_impact:
        return F.lit(0.0)
    frac = c.impact_coef * sigma * F.sqrt(F.abs(qty) / F.when(volume > 0, volume))
    return F.coalesce(frac, F.lit(0.0))


def fill_price(qty: Column, ref: Column, sigma: Column, volume: Column, c: CostSettings) -> Column:
    """Reference price worsened by half-spread, slippage and impact."""
    adverse = (c.half_spread_bps + c.slippage_bps) * BPS + impact_fraction(qty, sigma, volume, c)
    return F.when(qty == 0, ref).otherwise(F.greatest(ref * (1.0 + F.signum(qty) * adverse), F.lit(1e-8)))


def commission(qty: Column, price: Column, c: CostSettings, *, floor_always: bool = True) -> Column:
    """Per-share and bps commission with a minimum.

    ``floor_always`` applies the minimum to every fill, otherwise only where
    the commission is not zero.
    """
    raw = F.abs(qty) * c.commission_per_share + F.abs(qty) * price * c.commission_bps * BPS
    out = F.greatest(raw, F.lit(c.min_commission))
    if not floor_always:
        out = F.when(raw > 0, out).otherwise(F.lit(0.0))
    return F.when(qty == 0, F.lit(0.0)).otherwise(out)


def sell_fees(qty: Column, price: Column, c: CostSettings) -> Column:
    """Regulatory fees, charged on sells only: bps of notional plus a capped
    per-share fee."""
    shares = F.abs(qty)
    fee = shares * price * c.sec_fee_bps * BPS + F.least(shares * c.taf_per_share, F.lit(c.taf_cap_per_trade))
    return F.when(qty < 0, fee).otherwise(F.lit(0.0))


def borrow_cost(market_value: Column, days: Column, c: CostSettings) -> Column:
    """Borrow on short value over elapsed days, 360-day basis."""
    owed = F.abs(market_value) * c.short_borrow_annual_bps * BPS * days / 360.0
    return F.when((market_value < 0) & (days > 0), owed).otherwise(F.lit(0.0))


def slippage_cost(qty: Column, price: Column, ref: Column) -> Column:
    return F.coalesce(qty * (price - ref), F.lit(0.0))


def round_trip_bps(qty: Column, sigma: Column, volume: Column, c: CostSettings) -> Column:
    """Estimated cost of entry and exit in bps of notional."""
    one_way = c.half_spread_bps + c.slippage_bps + impact_fraction(qty, sigma, volume, c) / BPS + c.commission_bps
    return 2.0 * one_way
