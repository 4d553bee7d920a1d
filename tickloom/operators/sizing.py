"""Scores to target weights: selection, inverse volatility, gross and net."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clip
from tickloom.settings import BookSettings, SizingSettings

X = ["ts"]


def _x() -> Window:
    return Window.partitionBy(*X)


def predicted_vol(risk: Column, rho: float, residual: float, total) -> Column:
    """Book volatility per bar from per-name risks ``w * sigma``.

    ``total`` turns a column into its sum over the book (an aggregate or a
    window sum).
    """
    sq, signed, gross = total(risk * risk), total(risk), total(F.abs(risk))
    var = (1.0 - rho) * sq + rho * signed * signed + (residual * gross) * (residual * gross)
    return F.sqrt(F.greatest(var, F.lit(0.0)))


def book_vol(weights: DataFrame, cfg: SizingSettings | None = None) -> DataFrame:
    """Predicted volatility per ts of weights with a ``vol`` column."""
    cfg = cfg or SizingSettings()
    r = F.col("weight") * F.col("vol")
    return weights.groupBy("ts").agg(
        predicted_vol(r, cfg.correlation_rho, cfg.residual_factor_vol, F.sum).alias("predicted_vol")
    )


def select_names(scores: DataFrame, cfg: SizingSettings) -> DataFrame:
    """Liquid names, then the strongest fraction of each side, at least one."""
    ok = F.col("vol") > 0
    if "dollar_volume" in scores.columns:
        ok = ok & (F.coalesce(F.col("dollar_volume"), F.lit(0.0)) >= cfg.min_dollar_volume)
    d = scores.filter(ok & (F.col("score") != 0)).withColumn("_side", F.signum("score"))
    side = Window.partitionBy("ts", "_side")
    d = d.withColumns(
        {
            "_k": F.row_number().over(side.orderBy(F.desc(F.abs("score")), "symbol")),
            "_n": F.count(F.lit(1)).over(side),
        }
    )
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * cfg.selection_fraction))
    return d.filter(F.col("_k") <= keep).drop("_k", "_n", "_side")


def unit_weights(selected: DataFrame) -> DataFrame:
    """score / vol, scaled so that absolute weights sum to one."""
    raw = F.col("score") / F.col("vol")
    d = selected.withColumn("_raw", raw)
    return d.withColumn("unit", F.try_divide(F.col("_raw"), F.sum(F.abs("_raw")).over(_x()))).drop("_raw")


def with_gross(unit: DataFrame, cfg: SizingSettings) -> DataFrame:
    """Add the book's gross: pinned, or the one that hits the vol target."""
    if cfg.target_gross is not None:
        g = F.lit(float(cfg.target_gross))
    else:
        def over(c: Column) -> Column:
            return F.sum(c).over(_x())

        pred = predicted_vol(F.col("unit") * F.col("vol"), cfg.correlation_rho, cfg.residual_factor_vol, over)
        annual = pred * math.sqrt(cfg.bars_per_year)
        g = F.when(annual > 0, cfg.vol_target_annual / annual).otherwise(F.lit(1.0))
    if cfg.max_gross is not None:
        # A riskless book is fully invested whatever the limit is.
        capped = F.least(g, F.lit(float(cfg.max_gross)))
        g = capped if cfg.target_gross is not None else F.when(annual > 0, capped).otherwise(F.lit(1.0))
    return unit.withColumn("gross", F.greatest(F.lit(0.0), g))


def scale_sides(d: DataFrame, net: Column) -> DataFrame:
    """Scale longs and shorts so that gross and net are met exactly.

    A one-sided book is only scaled to gross.
    """
    u = F.col("unit")
    d = d.withColumns(
        {
            "_L": F.sum(F.when(u > 0, u).otherwise(F.lit(0.0))).over(_x()),
            "_S": F.sum(F.when(u < 0, -u).otherwise(F.lit(0.0))).over(_x()),
            "_net": net,
        }
    )
    g, L, S = F.col("gross"), F.col("_L"), F.col("_S")
    n = F.greatest(-g, F.least(g, F.col("_net")))
    both = F.when(u > 0, u * (g + n) / (2.0 * L)).otherwise(u * (g - n) / (2.0 * S))
    w = F.when((L > 0) & (S > 0), both).otherwise(F.try_divide(u, L + S) * g)
    return d.withColumn("weight", w).drop("_L", "_S", "_net")


def target_weights(scores: DataFrame, cfg: SizingSettings | None = None) -> DataFrame:
    """Signed target weights per ts from score, vol, net_tilt (optional).

    Without a per-name cap this is window sums over one date.  With a cap the
    clamp-and-rescale passes fold over a date's array of weights.
    """
    cfg = cfg or SizingSettings()
    if "net_tilt" not in scores.columns:
        scores = scores.withColumn("net_tilt", F.lit(0.0))
    d = with_gross(unit_weights(select_names(scores, cfg)), cfg)
    net = F.col("net_tilt")
    if cfg.max_net_exposure is not None:
        net = clip(net, -cfg.max_net_exposure, cfg.max_net_exposure)
    d = scale_sides(d.filter("gross > 0"), net).withColumn("net_target", net)
    cols = ["ts", "symbol", "score", "vol", "gross", "net_target", "weight"]
    d = d.select(*cols)
    return capped(d, cfg.max_position_weight, cfg.cap_passes) if cfg.max_position_weight is not None else d


def capped(d: DataFrame, cap: float, passes: int) -> DataFrame:
    """Clamp names to the cap and re-solve the sides until both hold, at most ``passes`` times.

    A date's weights are one array (a universe at most), and a pass is an array
    function of it, so all passes of all dates are one fold without a further shuffle.
    """
    row = F.struct("symbol", *[c for c in d.columns if c not in ("ts", "symbol")])
    g = d.groupBy("ts").agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max("gross").alias("_gross"), F.max("net_target").alias("_net"))
    gross, net, zero = F.col("_gross"), F.col("_net"), F.lit(0.0)
    aim = F.greatest(-gross, F.least(gross, net))

    def total(w: Column, sign: int) -> Column:
        return F.aggregate(w, zero, lambda s, x: s + F.greatest(sign * x, zero))

    def one(state: Column, _: Column) -> Column:
        w = F.transform(state["w"], lambda x: clip(x, -cap, cap))
        lng, sht = total(w, 1), total(w, -1)
        g = lng + sht
        done = (g <= 0) | ((F.abs(g - gross) < 1e-9) & (F.abs(lng - sht - net) < 1e-9))
        two = (lng > 0) & (sht > 0)
        up = F.when(two, F.try_divide(gross + aim, 2 * lng)).otherwise(F.try_divide(gross, g))
        down = F.when(two, F.try_divide(gross - aim, 2 * sht)).otherwise(F.try_divide(gross, g))
        moved = F.when(done, w).otherwise(F.transform(w, lambda x: x * F.when(x > 0, up).otherwise(down)))
        return F.when(state["open"], F.struct(moved.alias("w"), (~done).alias("open"))).otherwise(state)

    start = F.struct(F.transform("_rows", lambda r: r["weight"]).alias("w"), F.lit(True).alias("open"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, one, lambda s: s["w"])
    pairs = F.zip_with("_rows", last, lambda r, w: F.struct(r.alias("r"), clip(w, -cap, cap).alias("w")))
    out = g.select("ts", F.inline(pairs))
    return out.select(*[F.col("w").alias(c) if c == "weight" else F.col("ts") if c == "ts" else F.col(f"r.{c}").alias(c) for c in d.columns])


def dollar_neutral_weights(scores: DataFrame) -> DataFrame:
    """De-meaned scores scaled to one unit of gross per date."""
    c = F.col("score") - F.avg("score").over(_x())
    d = scores.withColumn("_c", c)
    return d.withColumn("weight", F.try_divide(F.col("_c"), F.sum(F.abs("_c")).over(_x()))).drop("_c")


def vol_targeted(target: Column, sigma: Column, *, vol_target: float, cap: float, kelly: float) -> Column:
    """Single-name weight scaled to a volatility target."""
    scaled = clip(target * F.least(vol_target / F.greatest(sigma, F.lit(1e-6)), F.lit(cap)) * kelly, -1.0, 1.0)
    return F.when(sigma > 1e-6, scaled).otherwise(target)


def rebalance_needed(target: Column, current: Column, band: float) -> Column:
    """Relative no-trade band; a full exit always passes."""
    scale = F.greatest(F.abs(target), F.abs(current))
    return F.coalesce(F.try_divide(F.abs(target - current), F.when(scale > 0, scale)) >= band, F.lit(False))


def rebalance_needed_absolute(target: Column, current: Column, threshold: float = 0.05) -> Column:
    return F.abs(target - current) >= threshold


def conviction_targets(book: DataFrame, cfg: BookSettings | None = None) -> DataFrame:
    """Conviction-proportional targets under a gross cap (``gross_cap`` column)."""
    cfg = cfg or BookSettings()
    m = cfg.max_position_weight
    d = book.withColumn("_t", F.col("conviction") * m)
    gross = F.sum(F.abs("_t")).over(_x())
    scale = F.when(gross > 0, F.least(F.col("gross_cap") / gross, F.lit(1.0))).otherwise(F.lit(1.0))
    return d.withColumn("target", clip(F.col("_t") * scale, -m, m)).drop("_t")


def gross_cap(recent: Column, n_open: Column, cfg: BookSettings) -> Column:
    """Cap after stop-outs, cut by the share of the book that stopped."""
    breadth = F.greatest(recent + n_open, F.lit(1))
    cut = cfg.max_gross_exposure * (1.0 - cfg.stop_degross_fraction * recent / breadth)
    return F.when(recent == 0, F.lit(cfg.max_gross_exposure)).otherwise(F.greatest(F.lit(cfg.min_gross_exposure), cut))
