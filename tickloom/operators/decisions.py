"""Orders and decisions: classification, stops, cooldown, delays, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import Blocks, asof_backward, calendar_chunk, first_after, prefix_scan
from tickloom.operators.sizing import conviction_targets, rebalance_needed
from tickloom.settings import QTY_EPS, BookSettings, SizingSettings


def align_targets(targets: DataFrame, current: DataFrame) -> DataFrame:
    """Targets and current weights per (ts, symbol); a missing side is zero."""
    j = targets.select("ts", "symbol", F.col("weight").alias("target")).join(
        current.select("ts", "symbol", F.col("weight").alias("current")), ["ts", "symbol"], "full"
    )
    return j.select("ts", "symbol", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("target", "current")])


def classify(aligned: DataFrame, cfg: SizingSettings | None = None) -> DataFrame:
    """Action and reason of each target against the current weight."""
    cfg = cfg or SizingSettings()
    t, c = F.col("target"), F.col("current")
    held, wanted = F.abs(c) > QTY_EPS, F.abs(t) > QTY_EPS
    reason = (
        F.when(~held & ~wanted, "none").when(held & ~wanted, "exit").when(~held & wanted, "entry").otherwise("rebalance")
    )
    d = aligned.withColumn("reason", reason)
    act = F.when(F.col("reason") == "none", F.lit(False)).otherwise(rebalance_needed(t, c, cfg.rebalance_band))
    return d.withColumn("trade", act)


def book_actions(book: DataFrame, cfg: BookSettings | None = None) -> DataFrame:
    """Exit, keep, enter or ignore, per name of a conviction book.

    Needs conviction, quantity (signed), price, avg_price, daily_vol, cooling,
    is_flatten, entries_ok.  A flatten bar sells every holding.
    """
    cfg = cfg or BookSettings()
    f = F.abs("conviction")
    stop = stop_touched(F.col("quantity"), F.col("price"), F.col("avg_price"), F.col("daily_vol"), cfg)
    held = F.abs("quantity") > QTY_EPS
    action = (
        F.when(held & F.col("is_flatten"), "eod_flat")
        .when(F.col("is_flatten"), "none")
        .when(held & F.coalesce(stop, F.lit(False)), "stop_loss")
        .when(held & (f < cfg.exit_conviction), "exit")
        .when(held, "rebalance")
        .when(F.col("entries_ok") & ~F.col("cooling") & (f >= cfg.min_conviction), "entry")
        .otherwise("none")
    )
    return book.withColumn("action", action)


def decide(book: DataFrame, cfg: BookSettings | None = None) -> DataFrame:
    """The whole ladder of a conviction book: ``outcome`` and ``target`` of every name with something to decide.

    Takes what ``book_actions`` takes, and the current weight, equity and ``gross_cap``.
    Exits and stops sell.  Kept names and the strongest new ones (up to the free
    places, if the book has a limit) share the gross cap by conviction; a kept name
    within the relative band is held, an entry too thin for one share is skipped.
    """
    cfg = cfg or BookSettings()
    b = book_actions(book, cfg)
    new, kept = F.col("action") == "entry", F.col("action") == "rebalance"
    if cfg.max_positions is not None:
        w = Window.partitionBy("ts")
        free = F.greatest(cfg.max_positions - F.count_if(kept).over(w), F.lit(0))
        place = F.row_number().over(Window.partitionBy("ts", "action").orderBy(F.desc(F.abs("conviction")), "symbol"))
        b = b.withColumns({"_free": free, "_place": place}).filter(~new | (F.col("_place") <= F.col("_free"))).drop("_free", "_place")
    gone = b.filter(F.col("action").isin("eod_flat", "stop_loss", "exit")).withColumns({"target": F.lit(0.0), "outcome": F.lit("sell")})
    sized = conviction_targets(b.filter(new | kept), cfg)
    t, c = F.col("target"), F.col("current")
    inside = kept & (F.abs(t - c) < cfg.rebalance_band_frac * F.greatest(F.abs(t), F.abs(c)))
    thin = new & ((F.col("price") <= 0) | (F.abs(t) * F.col("equity") < F.col("price")))
    outcome = F.when(inside, "hold").when(thin, "skip").when(new, "buy").otherwise("rebalance")
    out = sized.withColumn("outcome", outcome).unionByName(gone)
    return out.withColumn("expected_reward", F.col("conviction") * F.col("daily_vol"))


def stop_touched(quantity: Column, price: Column, avg_price: Column, daily_vol: Column, cfg: BookSettings) -> Column:
    """A long name's price at or below the barrier, scaled by its own volatility."""
    if cfg.stop_loss_sigma is not None:
        frac = cfg.stop_loss_sigma * daily_vol * (cfg.stop_horizon_days**0.5)
    elif cfg.stop_loss_pct is not None:
        frac = F.lit(cfg.stop_loss_pct)
    else:
        return F.lit(False)
    return (quantity > QTY_EPS) & (price <= avg_price * (1.0 - frac))


def range_touch(entry: Column, is_long: Column, *, stop_pct: float, take_pct: float) -> Column:
    """Stop or take-profit touched by the bar's range; the stop goes first."""
    lo, hi = F.col("low"), F.col("high")
    long_side = F.when(lo <= entry * (1 - stop_pct), "stop_loss").when(hi >= entry * (1 + take_pct), "take_profit")
    short_side = F.when(hi >= entry * (1 + stop_pct), "stop_loss").when(lo <= entry * (1 - take_pct), "take_profit")
    return F.when(is_long, long_side).otherwise(short_side)


def top_entries(candidates: DataFrame, *, slots: Column) -> DataFrame:
    """Strongest convictions per ts, then symbol, up to the free slots."""
    w = Window.partitionBy("ts").orderBy(F.desc(F.abs("conviction")), "symbol")
    return candidates.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= slots).drop("_k")


def fillable(targets: DataFrame) -> DataFrame:
    """Entries too thin for one share are dropped; exits never are."""
    thin = F.abs(F.col("target")) * F.col("equity") < F.col("price")
    return targets.filter(~((F.col("reason") == "entry") & ((F.col("price") <= 0) | thin)))


def execution_order(orders: DataFrame) -> DataFrame:
    """Sequence per ts: sells by symbol, then buys by conviction and symbol."""
    sell = F.col("target") < F.col("current")
    w = Window.partitionBy("ts").orderBy(
        F.when(sell, 0).otherwise(1), F.when(sell, F.lit(0.0)).otherwise(-F.abs("conviction")), "symbol"
    )
    return orders.withColumn("seq", F.row_number().over(w))


def cooldown(rows: DataFrame, stops: DataFrame, cfg: BookSettings, *, ts: str = "ts") -> DataFrame:
    """Flag rows whose symbol stopped out within the cooldown span."""
    s = stops.select("symbol", F.col(ts).alias("stop_ts"))
    d = asof_backward(rows, s, keys=["symbol"], left_ts=ts, right_ts="stop_ts", values=[])
    return d.withColumn("cooling", F.coalesce(within_span(F.col(ts), F.col("stop_ts"), cfg), F.lit(False)))


def within_span(now: Column, then: Column, cfg: BookSettings) -> Column:
    if cfg.stop_cooldown_bars is None:
        return F.datediff(now, then) < cfg.stop_cooldown_days
    us = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return us < cfg.stop_cooldown_bars * cfg.bar_minutes * 60_000_000


def recent_stops(calendar: DataFrame, stops: DataFrame, cfg: BookSettings) -> DataFrame:
    """Names whose last stop-out lies within the cooldown, per ts.

    A stop counts from its own day until the cooldown ends or the name stops
    again; both ends become +1/-1 steps, so the count is a running sum and no
    pair of (ts, stop) is formed.
    """
    b = Blocks.lay(stops.select("symbol", "ts").distinct(), ["symbol"], ["ts"], lookback=0, lookahead=1)
    s = b.add(_next=b.lead(F.col("ts"), 1)).close()
    if cfg.stop_cooldown_bars is None:
        over = F.date_add("ts", cfg.stop_cooldown_days).cast(stops.schema["ts"].dataType)
    else:
        over = F.col("ts") + F.make_dt_interval(mins=F.lit(cfg.stop_cooldown_bars * cfg.bar_minutes))
    end = F.least(over, F.col("_next"))
    steps = s.select(F.inline(F.array(
        F.struct(F.col("ts").alias("ts"), F.lit(1).alias("_step")), F.struct(end.alias("ts"), F.lit(-1).alias("_step"))
    )))
    marks = calendar.select("ts").distinct().withColumn("_step", F.lit(0))
    per = steps.unionByName(marks).groupBy("ts").agg(F.sum("_step").alias("_step"), F.max((F.col("_step") == 0).cast("int")).alias("_mark"))
    run = prefix_scan(per, [], ["ts"], calendar_chunk("ts", 512), sums={"recent": F.col("_step")})
    return run.filter("_mark = 1").select("ts", "recent")


def next_bar_fill(decisions: DataFrame, bars: DataFrame, *, price: str = "open") -> DataFrame:
    """Each decision with the first bar strictly after it and its price."""
    r = bars.select("symbol", F.col("ts").alias("fill_ts"), F.col(price).alias("fill_price"))
    return first_after(decisions, r, keys=["symbol"], left_ts="ts", right_ts="fill_ts", values=["fill_price"])


def with_deadline(orders: DataFrame, calendar: DataFrame, cfg: BookSettings) -> DataFrame:
    """Append ``deadline``: the first processed day more than ``cancel_after_days`` after the order.

    A bar of that day still fills.  ``calendar`` has the processed days as ``ts``;
    past its end there is no deadline yet (null).  Every calendar day's answer is
    worked out once, from at most a row a day, and joined.
    """
    days = calendar.select(F.to_date("ts").alias("deadline")).filter("deadline IS NOT NULL").distinct()
    prev = F.lag("deadline", 1, "1900-01-01").over(Window.orderBy("deadline"))
    reach = days.withColumn("_past", prev.cast("date")).select("deadline", F.explode(F.sequence("_past", F.date_sub("deadline", 1))).alias("_limit"))
    d = orders.withColumn("_limit", F.date_add(F.to_date("ts"), cfg.cancel_after_days))
    return d.join(reach, "_limit", "left").drop("_limit")


def expire(orders: DataFrame, cfg: BookSettings, *, calendar: DataFrame, as_of: str | None = None) -> DataFrame:
    """Order state as of a day (else the calendar's last): filled, cancelled or pending.

    Orders have the first bar after them as ``fill_ts``.  An order waits while its
    symbol has no bar; on the first processed day over ``cancel_after_days`` without
    one it is cancelled.  A fill after ``as_of`` hasn't happened yet.
    """
    if as_of is not None:
        calendar = calendar.filter(F.to_date("ts") <= F.lit(as_of).cast("date"))
    d = with_deadline(orders, calendar, cfg)
    filled = F.to_date("fill_ts") <= F.col("deadline")
    if as_of is None:
        filled |= F.col("fill_ts").isNotNull() & F.col("deadline").isNull()
    else:
        filled = (filled | F.col("deadline").isNull()) & (F.to_date("fill_ts") <= F.lit(as_of).cast("date"))
    state = F.when(filled, "filled").when(F.col("deadline").isNotNull(), "cancelled").otherwise("pending")
    return d.withColumn("state", state)


def supersede(pending: DataFrame, fresh: DataFrame) -> DataFrame:
    """New decisions replace pending ones of the same symbol."""
    return fresh.unionByName(pending.join(fresh.select("symbol").distinct(), "symbol", "left_anti"), allowMissingColumns=True)


def backfill_results(decisions: DataFrame, realized: DataFrame) -> DataFrame:
    """Write realised returns onto decisions; unmatched keep the old value."""
    new = realized.select("ts", "symbol", F.col("result").alias("_new"))
    d = decisions.join(new, ["ts", "symbol"], "left")
    return d.withColumn("result", F.coalesce("_new", "result")).drop("_new")


def share_delta(target: Column, equity: Column, price: Column, held: Column) -> Column:
    """Whole-share order: target shares truncated to zero, less the holding;
    below one share there is no order."""
    shares = F.signum(target) * F.floor(F.abs(target) * equity / price)
    delta = F.when(F.abs(target) < QTY_EPS, -held).otherwise(shares - held)
    return F.when(F.abs(delta) >= 1, delta).otherwise(F.lit(0.0))


def pending_fills(orders: DataFrame, quotes: DataFrame, *, today: Column) -> DataFrame:
    """Provisional fills of pending orders at today's quotes."""
    q = quotes.filter(F.col("ts") == today).select("symbol", F.col("price").alias("quote"))
    return orders.filter(F.col("decided_ts") < today).join(q, "symbol")


def baseline_positions(features: DataFrame, *, allow_short: bool = True) -> DataFrame:
    """Baseline signals: always long, flat, and moving-average cross."""
    short = -1.0 if allow_short else 0.0
    cross = F.when(F.col("dist_ma_21") > F.col("dist_ma_63"), F.lit(1.0)).otherwise(F.lit(short))
    sig = F.array(
        F.struct(F.lit("buy_and_hold").alias("strategy"), F.lit(1.0).alias("position")),
        F.struct(F.lit("flat").alias("strategy"), F.lit(0.0).alias("position")),
        F.struct(F.lit("ma_cross").alias("strategy"), cross.alias("position")),
    )
    return features.select("*", F.inline(sig))
