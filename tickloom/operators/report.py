"""Performance, drawdown, overfitting statistics and ledger reports.

An equity curve has one row per strategy and timestamp; running maxima and
sums go through ``prefix_scan``, the metrics are grouped aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import norm_cdf, norm_ppf, safe_div
from tickloom.operators.quantiles import group_quantile
from tickloom.operators.series import Blocks, asof_backward, calendar_chunk, index_series, prefix_scan
from tickloom.settings import TRADING_DAYS

EULER_GAMMA = 0.5772156649015329
INF = float("inf")
TINY = 1e-12


def chunk() -> Column:
    return calendar_chunk("ts", 512)


# ------------------------------------------------------------------ series


def drawdowns(curve: DataFrame, *, keys: list[str] | None = None, value: str = "equity") -> DataFrame:
    """Running peak and drawdown fraction (NULL while the peak is not positive)."""
    keys = ["strategy"] if keys is None else keys
    d = prefix_scan(curve, keys, ["ts"], chunk(), maxs={"peak": F.col(value)})
    p = F.col("peak")
    return d.withColumn("drawdown", (p - F.col(value)) / F.when(p > 0, p))


def returns(curve: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """Bar return and change of position; the first bar has neither."""
    keys = ["strategy"] if keys is None else keys
    b = Blocks.lay(curve, keys, ["ts"], lookback=1)
    e = F.col("equity")
    cols = {"ret": F.try_divide(e, b.lag(e, 1)) - 1.0, "pnl": e - b.lag(e, 1)}
    if "position" in curve.columns:
        cols["dpos"] = F.abs(F.col("position") - b.lag(F.col("position"), 1))
    return b.add(**cols).close()


def penalised_returns(rets: DataFrame, *, keys: list[str], penalty: float = 1.0) -> DataFrame:
    """Log return less a multiple of the depth below its own running peak."""
    r = F.ln(F.greatest(1.0 + F.col("ret"), F.lit(1e-8)))
    d = prefix_scan(rets.withColumn("_lr", r), keys, ["ts"], chunk(), sums={"_cum": F.col("_lr")})
    d = prefix_scan(d, keys, ["ts"], chunk(), maxs={"_top": F.col("_cum")})
    depth = F.greatest(F.col("_top"), F.lit(0.0)) - F.col("_cum")
    return d.withColumn("penalised", F.col("_lr") - penalty * depth).drop("_lr", "_cum", "_top")


def forward_fill(df: DataFrame, cols: list[str], *, keys: list[str]) -> DataFrame:
    return prefix_scan(df, keys, ["ts"], chunk(), lasts={f"_f_{c}": F.col(c) for c in cols}).drop(*cols).withColumnsRenamed(
        {f"_f_{c}": c for c in cols}
    )


def rebase(curve: DataFrame, *, keys: list[str], value: str, base: float = 100.0) -> DataFrame:
    """Series scaled to ``base`` at its first point."""
    first = curve.groupBy(*keys).agg(F.min_by(value, "ts").alias("_v0"))
    d = curve.join(first, keys)
    return d.withColumn("rebased", base * F.try_divide(F.col(value), F.col("_v0"))).drop("_v0")


def thin(curve: DataFrame, *, keys: list[str], max_points: int = 900) -> DataFrame:
    """Every k-th point so that at most ``max_points`` remain, plus the last."""
    n = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = Blocks.lay(curve, keys, ["ts"], lookback=0).close(keep_rn=True).join(n, keys)
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_points))
    keep = (F.col("_rn") % step == 0) | (F.col("_rn") == F.col("_n") - 1)
    return b.filter(keep).drop("_n", "_rn")


def limit_breaches(curve: DataFrame, *, max_drawdown: float = 0.25, max_daily_loss: float = 0.05) -> DataFrame:
    """First bar per strategy that breaks a limit, with its reason."""
    d = drawdowns(returns(curve))
    reason = F.when(F.col("drawdown") >= max_drawdown, "max_drawdown").when(F.col("ret") <= -max_daily_loss, "daily_loss")
    d = d.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return d.groupBy("strategy").agg(
        F.min("ts").alias("ts"), F.min_by("reason", "ts").alias("reason"),
        F.min_by("drawdown", "ts").alias("drawdown"), F.min_by("ret", "ts").alias("ret"),
    )


# ----------------------------------------------------------------- metrics


def sharpe_of(mean: Column, sd: Column, n: Column, ppy: int = TRADING_DAYS) -> Column:
    ok = (n >= 2) & (sd > TINY)
    return F.when(ok, mean / F.when(sd > TINY, sd) * math.sqrt(ppy)).otherwise(F.lit(0.0))


def underwater(curve: DataFrame) -> DataFrame:
    """Longest run of bars below the running peak, per strategy.

    A run is the bars between two bars at the peak: its id is the number of
    peaks so far, so runs are counted by a grouped aggregate.
    """
    d = drawdowns(curve).withColumn("_wet", F.col("equity") < F.col("peak"))
    d = prefix_scan(d, ["strategy"], ["ts"], chunk(), sums={"_run": (~F.col("_wet")).cast("long")})
    runs = d.groupBy("strategy", "_run").agg(F.count_if("_wet").alias("_len"))
    return runs.groupBy("strategy").agg(F.max("_len").alias("max_drawdown_bars"))


def report(
    curve: DataFrame, *, n_trials: DataFrame | int = 1, costs: DataFrame | None = None, ppy: int = TRADING_DAYS
) -> DataFrame:
    """One row per strategy with the full metric set.

    ``curve`` has strategy, ts, equity and position.  ``costs`` optionally
    gives strategy and total_costs.
    """
    k = ["strategy"]
    r = returns(curve)
    d = drawdowns(r)
    ret, pnl = F.col("ret"), F.col("pnl")
    agg = d.groupBy(*k).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(ret).alias("_m"),
        F.min_by("equity", "ts").alias("starting_capital"),
        F.max_by("equity", "ts").alias("ending_equity"),
        F.avg(ret).alias("_mean"),
        F.stddev_samp(ret).alias("_sd"),
        F.skewness(ret).alias("_skew"),
        (F.kurtosis(ret) + 3.0).alias("_kurt"),
        F.sqrt(F.avg(F.when(ret < 0, ret * ret))).alias("_down"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg((pnl > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(pnl > 0, pnl).otherwise(F.lit(0.0))).alias("_wins"),
        F.sum(F.when(pnl < 0, -pnl).otherwise(F.lit(0.0))).alias("_losses"),
        F.count_if(F.col("dpos") > 0.01).alias("n_trades"),
        F.sum("dpos").alias("_dpos"),
    )
    var = group_quantile(r, k, ret, 0.05, "var_95")
    agg = agg.join(var, k, "left")
    tail = (
        r.join(var, k)
        .filter(F.col("ret") <= F.col("var_95"))
        .groupBy(*k).agg(F.avg("ret").alias("cvar_95"))
    )
    a = agg.join(tail, k, "left").join(underwater(curve), k, "left")
    if costs is not None:
        a = a.join(costs, k, "left").withColumn("total_costs", F.coalesce("total_costs", F.lit(0.0)))
    else:
        a = a.withColumn("total_costs", F.lit(0.0))
    trials = n_trials.select("n_trials").scalar() if isinstance(n_trials, DataFrame) else F.lit(n_trials)
    return _finish(a.withColumn("_trials", trials.cast("long")), ppy)


def _finish(a: DataFrame, ppy: int) -> DataFrame:
    s, e, n, m = (F.col(x) for x in ("starting_capital", "ending_equity", "_n", "_m"))
    zero = F.lit(0.0)
    a = a.withColumns(
        {
            "total_return": F.when((n >= 2) & (s > 0), F.try_divide(e, s) - 1).otherwise(zero),
            "cagr": F.when((n >= 2) & (s > 0) & (e > 0), F.pow(F.try_divide(e, s), ppy / (n - 1)) - 1).otherwise(zero),
            "annual_volatility": F.coalesce(F.col("_sd") * math.sqrt(ppy), zero),
            "sharpe": sharpe_of(F.col("_mean"), F.col("_sd"), m, ppy),
        }
    )
    mean, down = F.col("_mean"), F.col("_down")
    sortino = F.when(m < 2, zero).when(down.isNull(), F.when(mean > 0, F.lit(INF)).otherwise(zero))
    a = a.withColumns(
        {
            "sortino": sortino.when(down <= TINY, zero).otherwise(mean / F.when(down > 0, down) * math.sqrt(ppy)),
            "calmar": F.when(F.col("max_drawdown") > TINY, F.col("cagr") / F.col("max_drawdown")).otherwise(zero),
            "cvar_95": F.coalesce("cvar_95", "var_95"),
            "profit_factor": profit_factor(F.col("_wins"), F.col("_losses")),
            "turnover": F.when(n >= 2, F.coalesce(F.col("_dpos"), zero) / n * ppy).otherwise(zero),
            "cost_drag": F.when(s > 0, F.try_divide(F.col("total_costs"), s)).otherwise(zero),
        }
    )
    a = overfitting(a, n=m, skew=F.col("_skew"), kurt=F.col("_kurt"), sharpe=F.col("sharpe"), trials=F.col("_trials"), ppy=ppy)
    return a.drop(*[c for c in a.columns if c.startswith("_")])


def profit_factor(wins: Column, losses: Column) -> Column:
    none = F.when(wins > 0, F.lit(INF)).otherwise(F.lit(0.0))
    return F.when(losses <= TINY, none).otherwise(wins / F.when(losses > 0, losses))


def overfitting(
    a: DataFrame, *, n: Column, skew: Column, kurt: Column, sharpe: Column, trials: Column, ppy: int,
    trial_variance: Column | None = None, confidence: float = 0.95,
) -> DataFrame:
    """Probabilistic and deflated Sharpe ratios and the needed track record.

    ``trial_variance`` is the variance of the trials' Sharpe ratios; without it
    the estimator's own sampling variance is used.
    """
    root = math.sqrt(ppy)
    a = a.withColumn("_sr", sharpe / root)
    sr = F.col("_sr")
    spread = 1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr
    var = trial_variance / ppy if trial_variance is not None else 1.0 / F.greatest(n - 1, F.lit(1))
    a = a.withColumns({"_spread": spread, "_sr0": expected_max_sharpe(trials, var)})
    ok = (n >= 3) & (F.col("_spread") > TINY)

    def psr(bench: Column) -> Column:
        z = (sr - bench) * F.sqrt(n - 1) / F.sqrt(F.when(F.col("_spread") > TINY, F.col("_spread")))
        return F.when(ok, norm_cdf(z)).otherwise(F.lit(0.0))

    q = norm_ppf(F.lit(confidence))
    need = 1.0 + F.col("_spread") * F.pow(q / F.when(sr > 0, sr), F.lit(2.0))
    track = F.when((n < 3) | (sr <= 0) | (sr * sr <= TINY), F.lit(INF)).otherwise(need)
    a = a.withColumns({"psr": psr(F.lit(0.0)), "dsr": psr(F.col("_sr0")), "min_track_record": track})
    return a.drop("_sr", "_spread", "_sr0")


def expected_max_sharpe(trials: Column, variance: Column) -> Column:
    """Expected best Sharpe of ``trials`` skill-less attempts."""
    t = trials.cast("double")
    q1, q2 = norm_ppf(1.0 - 1.0 / t), norm_ppf(1.0 - 1.0 / (t * math.e))
    best = F.sqrt(variance) * ((1.0 - EULER_GAMMA) * q1 + EULER_GAMMA * q2)
    return F.when(t < 2, F.lit(0.0)).otherwise(best)


def excess_sharpe(curve: DataFrame, bench: DataFrame, *, ppy: int = TRADING_DAYS) -> DataFrame:
    """Sharpe of strategy minus benchmark returns on their common dates."""
    j = curve.join(bench.select("ts", F.col("equity").alias("_b")), "ts")
    b = Blocks.lay(j, ["strategy"], ["ts"], lookback=1)
    e, q = F.col("equity"), F.col("_b")
    d = b.add(_x=F.try_divide(e, b.lag(e, 1)) - F.try_divide(q, b.lag(q, 1)), _bad=(b.lag(e, 1) <= 0) | (b.lag(q, 1) <= 0)).close()
    a = d.groupBy("strategy").agg(
        F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"), F.count("_x").alias("_n"),
        F.max(F.coalesce(F.col("_bad"), F.lit(False)).cast("int")).alias("_bad"),
    )
    v = sharpe_of(F.col("_m"), F.col("_s"), F.col("_n"), ppy)
    return a.select("strategy", F.when(F.col("_bad") == 1, F.lit(0.0)).otherwise(v).alias("excess_sharpe"))


def window_stats(
    curve: DataFrame, *, trades: DataFrame | None = None, bench: DataFrame | None = None, ppy: int = TRADING_DAYS
) -> DataFrame:
    """Return against the prior base, Sharpe, drawdown (base point included)
    and volatility, per year and overall.

    With ``trades`` (strategy, ts) the fills of each window are counted.  With
    ``bench`` (ts, equity) its return from the same base bar to the same last bar
    and the excess over it are added; its price is carried to bars it lacks.
    """
    r = returns(curve).withColumn("year", F.year("ts").cast("string"))
    b = F.col("equity") - F.coalesce(F.col("pnl"), F.lit(0.0))
    wins = F.explode(F.array("year", F.lit("all"))).alias("window")
    both = r.select("strategy", "ts", "equity", "ret", b.alias("_prev"), wins)
    # The window's first base competes for the peak, too.
    first = both.groupBy("strategy", "window").agg(F.min_by("_prev", "ts").alias("_base"))
    d = prefix_scan(both, ["strategy", "window"], ["ts"], chunk(), maxs={"_peak": F.col("equity")}).join(first, ["strategy", "window"])
    peak = F.greatest("_peak", "_base")
    d = d.withColumn("_dd", (peak - F.col("equity")) / F.when(peak > 0, peak))
    a = d.groupBy("strategy", "window").agg(
        F.max("_base").alias("_base"), F.max_by("equity", "ts").alias("_end"), F.avg("ret").alias("_m"),
        F.stddev_samp("ret").alias("_s"), F.count("ret").alias("_n"), F.max("_dd").alias("max_drawdown"),
        F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("_from"), F.max("ts").alias("_to"),
    )
    total = F.try_divide("_end", "_base") - 1
    cols = [
        "strategy", "window", "n_bars", total.alias("total_return"),
        sharpe_of(F.col("_m"), F.col("_s"), F.col("_n"), ppy).alias("sharpe"),
        F.coalesce(F.col("_s") * math.sqrt(ppy), F.lit(0.0)).alias("volatility"), "max_drawdown",
    ]
    if trades is not None:
        n = trades.select("strategy", F.explode(F.array(F.year("ts").cast("string"), F.lit("all"))).alias("window"))
        a = a.join(n.groupBy("strategy", "window").agg(F.count(F.lit(1)).alias("_trades")), ["strategy", "window"], "left")
        cols.append(F.coalesce("_trades", F.lit(0)).alias("n_trades"))
    if bench is not None:
        # A window starts at the bar before its first one, which only an earlier window has.
        q = bench.select(F.col("ts").alias("_bts"), F.col("equity").alias("_b"))
        before = curve.select("strategy", F.col("ts").alias("_pts"))
        a = asof_backward(a, before, keys=["strategy"], left_ts="_from", right_ts="_pts", values=[], strict=True)
        a = a.withColumn("_pts", F.coalesce("_pts", "_from"))
        for at, out in (("_pts", "_b0"), ("_to", "_b1")):
            a = asof_backward(a, q, keys=[], left_ts=at, right_ts="_bts", values=["_b"]).drop("_bts").withColumnRenamed("_b", out)
        gain = F.try_divide("_b1", "_b0") - 1
        cols += [gain.alias("bench_return"), (total - gain).alias("excess")]
    return a.select(*cols)


def extremes(windows: DataFrame) -> DataFrame:
    """Best and worst year of each strategy by total return; ties go to the earlier year."""
    y = windows.filter("window <> 'all'")
    pick = lambda f, sign: f(F.struct((sign * F.col("total_return")).alias("k"), "window", "total_return"))
    g = y.groupBy("strategy").agg(pick(F.min, -1).alias("_b"), pick(F.min, 1).alias("_w"))
    return g.select("strategy", F.col("_b.window").alias("best_year"), F.col("_b.total_return").alias("best_return"),
                    F.col("_w.window").alias("worst_year"), F.col("_w.total_return").alias("worst_return"))


def chart_payload(curve: DataFrame, bench: DataFrame, *, max_points: int = 900, digits: int | None = 2) -> DataFrame:
    """(strategy, json): equity, drawdown, profit and the benchmark on the same bars, for a chart.

    The benchmark (ts, equity) is carried forward and scaled to the strategy's first
    bar.  Series are thinned to ``max_points`` and the last, so a document is bounded;
    drawdown and profit are those of the whole curve.  Without ``digits`` nothing is rounded.
    """
    d = drawdowns(returns(curve))
    q = bench.select(F.col("ts").alias("_bts"), F.col("equity").alias("_b"))
    d = asof_backward(d.select("strategy", "ts", "equity", "pnl", "drawdown"), q, keys=[], left_ts="ts", right_ts="_bts", values=["_b"]).drop("_bts")
    base = d.filter("_b IS NOT NULL").groupBy("strategy").agg(F.min_by(F.struct("equity", "_b"), "ts").alias("_at"))
    d = d.join(base, "strategy", "left").withColumn("bench", F.try_divide(F.col("_at.equity") * F.col("_b"), F.col("_at._b")))
    t = thin(d.drop("_at", "_b"), keys=["strategy"], max_points=max_points)
    cut = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    values = {"equity": F.col("equity"), "drawdown": F.col("drawdown") * 100, "pnl": F.col("pnl"), "bench": F.col("bench")}
    point = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("ts"), *[cut(c).alias(n) for n, c in values.items()])
    g = t.groupBy("strategy").agg(F.array_sort(F.collect_list(point)).alias("_p"))
    doc = F.struct(*[F.col("_p")[c].alias(c) for c in ("ts", "equity", "drawdown", "pnl", "bench")])
    return g.select("strategy", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


PAYLOAD = "ts ARRAY<STRING>, equity ARRAY<DOUBLE>, drawdown ARRAY<DOUBLE>, pnl ARRAY<DOUBLE>, bench ARRAY<DOUBLE>"


def chart_points(payload: DataFrame) -> DataFrame:
    """A payload's points as rows again."""
    d = payload.select("strategy", F.from_json("json", PAYLOAD).alias("j"))
    return d.select("strategy", F.inline(F.arrays_zip("j.ts", "j.equity", "j.drawdown", "j.pnl", "j.bench")))


def decision_log(bars: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every bar with its decision, those without one too: outcome ``none``, target and conviction as of the bar unknown."""
    d = decisions.select("ts", "symbol", "action", "outcome", "target", "conviction")
    j = bars.select("ts", "symbol", "close").join(d, ["ts", "symbol"], "left")
    return j.withColumns({c: F.coalesce(c, F.lit("none")) for c in ("action", "outcome")})


def monthly_returns(rets: DataFrame) -> DataFrame:
    """Compounded return per strategy and month."""
    return rets.groupBy("strategy", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        (F.product(1.0 + F.col("ret")) - 1.0).alias("ret")
    )


def lifetime_stats(ledger: DataFrame, *, bars_per_year: int) -> DataFrame:
    """Bars, sessions, signed worst drawdown, population Sharpe, turnover, breadth."""
    d = drawdowns(returns(ledger))
    a = d.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_bars"), F.count_distinct(F.to_date("ts")).alias("sessions"),
        F.max("drawdown").alias("_dd"), F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s"),
        F.sum("turnover").alias("total_turnover"), F.max("n_positions").alias("peak_positions"),
    )
    sharpe = F.when(F.col("_s") > 0, F.col("_m") / F.when(F.col("_s") > 0, F.col("_s")) * math.sqrt(bars_per_year)).otherwise(F.lit(0.0))
    return a.select("strategy", "n_bars", "sessions", (-F.col("_dd")).alias("max_drawdown"), sharpe.alias("sharpe"),
                    "total_turnover", "peak_positions")


def benchmark_metrics(curves: DataFrame, *, ppy: int = TRADING_DAYS) -> DataFrame:
    """Total return, CAGR, Sharpe and drawdown over positive points."""
    d = drawdowns(returns(curves.filter("equity > 0")))
    a = d.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("equity", "ts").alias("_s"), F.max_by("equity", "ts").alias("_e"),
        F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_sd"), F.count("ret").alias("_k"), F.max("drawdown").alias("max_drawdown"),
    )
    ratio = F.try_divide("_e", "_s")
    return a.select(
        "strategy", (ratio - 1).alias("total_return"),
        F.when(F.col("_n") >= 2, F.pow(ratio, ppy / (F.col("_n") - 1)) - 1).otherwise(F.lit(0.0)).alias("cagr"),
        sharpe_of(F.col("_m"), F.col("_sd"), F.col("_k"), ppy).alias("sharpe"), "max_drawdown",
    )


def headline(trades: DataFrame, *, keys: list[str]) -> DataFrame:
    """Win rate, average gain and loss, profit factor (capped at 99), costs."""
    p = F.when(F.col("quantity") < 0, F.col("realized_pnl"))
    wins = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0))
    losses = F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0))
    pf = F.least(F.lit(99.0), F.coalesce(F.try_divide(wins, losses), F.when(wins > 0, F.lit(99.0)).otherwise(F.lit(0.0))))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.coalesce(F.avg((p > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_gain"),
        F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("avg_loss"),
        pf.alias("profit_factor"), F.sum(F.col("commission") + F.col("fees")).alias("explicit_costs"),
    )


def strategy_verdict(reports: DataFrame, *, benchmark: str) -> DataFrame:
    """Best strategy by total return and whether any beat the benchmark."""
    base = F.max(F.when(F.col("strategy") == benchmark, F.col("total_return")))
    others = F.max(F.when(F.col("strategy") != benchmark, F.col("total_return")))
    return reports.agg(
        F.max_by("strategy", F.struct("total_return", "strategy")).alias("best"),
        F.max("total_return").alias("best_return"), (others > base).alias("beat_benchmark"),
    )


# ------------------------------------------------------------- evaluation


def evaluate_signals(positions: DataFrame, *, cost: float, capital: float = 100_000.0) -> DataFrame:
    """Equity of a position series: last position times return less costs.

    Needs strategy, ts, ret and position.  Compounding is a running sum of
    logs, so a strategy's curve is a prefix scan.
    """
    b = Blocks.lay(positions, ["strategy"], ["ts"], lookback=1)
    held = F.coalesce(b.lag(F.col("position"), 1), F.lit(0.0))
    before = F.coalesce(b.lag(F.col("position"), 1), F.lit(0.0))
    net = held * F.coalesce(F.col("ret"), F.lit(0.0)) - cost * F.abs(F.col("position") - before)
    d = b.add(net=net).close()
    d = prefix_scan(d, ["strategy"], ["ts"], chunk(), sums={"_log": F.ln(F.greatest(1.0 + F.col("net"), F.lit(1e-8)))})
    return d.withColumn("equity", capital * F.exp("_log")).drop("_log")


def cost_sweep(weights: DataFrame, rets: DataFrame, costs_bp: list[float], *, ppy: int = TRADING_DAYS) -> DataFrame:
    """Net daily return and Sharpe of a rebalanced book per cost level.

    Weights of (ts, symbol) earn the symbol's next return.  Turnover of a date is
    the change of every name's weight since the date before, a name without a
    weight counting as zero: one that leaves the book trades its whole weight on
    the next date.
    """
    w = weights.select("ts", "symbol", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    dates = index_series(w.select("ts").distinct(), [], ["ts"], calendar_chunk("ts", 512), rn="_day")
    w = w.join(dates, "ts")
    b = Blocks.lay(w, ["symbol"], ["_day"], lookback=1, lookahead=1)
    x, day_ = F.col("weight"), F.col("_day")
    went = F.abs(x - F.when(b.lag(day_, 1) == day_ - 1, b.lag(x, 1)).otherwise(F.lit(0.0)))
    left = F.when(F.coalesce(b.lead(day_, 1), F.lit(-1)) != day_ + 1, F.abs(x))
    d = b.add(_in=went, _out=left).close()
    steps = d.select(F.inline(F.array(F.struct(day_.alias("_day"), F.col("_in").alias("_dw")), F.struct((day_ + 1).alias("_day"), F.col("_out").alias("_dw")))))
    moved = steps.groupBy("_day").agg(F.coalesce(F.sum("_dw"), F.lit(0.0)).alias("turnover"))
    gain = w.join(rets.select("ts", "symbol", "fwd"), ["ts", "symbol"], "left").groupBy("ts", "_day").agg(F.coalesce(F.sum(x * F.col("fwd")), F.lit(0.0)).alias("gross_ret"))
    day = gain.join(moved, "_day").drop("_day")
    grid = F.array(*[F.lit(float(c)) for c in costs_bp])
    x = day.select("*", F.explode(grid).alias("cost_bp"))
    net = F.col("gross_ret") - F.col("turnover") * F.col("cost_bp") * 1e-4
    a = x.groupBy("cost_bp").agg(
        F.count(F.lit(1)).alias("n_days"), (F.avg(net) * 1e4).alias("net_bp"), F.avg("turnover").alias("turnover"),
        F.avg(net).alias("_m"), F.stddev_samp(net).alias("_s"),
    )
    return a.select("cost_bp", "n_days", "net_bp", "turnover", sharpe_of(F.col("_m"), F.col("_s"), F.col("n_days"), ppy).alias("sharpe"))


def overfitting_probability(paths: DataFrame) -> DataFrame:
    """Share of paths whose in-sample best ranks below the median out of sample.

    Needs path, config, is_perf, oos_perf; ties go to the lowest config.  The paths are
    read once: a mean computed a second time may differ in its last bit, and
    the best would no longer equal itself.
    """
    best = F.max_by("oos_perf", F.struct("is_perf", -F.col("config"))).over(Window.partitionBy("path"))
    j = paths.withColumn("_best", best).groupBy("path").agg(
        F.avg((F.col("oos_perf") <= F.col("_best")).cast("double")).alias("_rank"), F.count(F.lit(1)).alias("_n")
    )
    fail = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise((F.col("_rank") < 0.5).cast("double"))
    return j.agg(F.coalesce(F.avg(fail), F.lit(0.0)).alias("pbo"), F.count(F.lit(1)).alias("n_paths"))


# ------------------------------------------------------------- benchmarks


def benchmark_equity(ledger_ts: DataFrame, closes: DataFrame, *, capital: float) -> DataFrame:
    """Buy-and-hold value at each ledger stamp, price carried forward.

    Units are bought at the first stamp that has a price.
    """
    j = asof_backward(
        ledger_ts.select("ts").distinct(), closes.select(F.col("ts").alias("_cts"), "close"),
        keys=[], left_ts="ts", right_ts="_cts", values=["close"],
    )
    base = j.filter(F.col("close").isNotNull()).agg(F.min_by("close", "ts")).scalar()
    return j.select("ts", F.coalesce(capital / base * F.col("close"), F.lit(0.0)).alias("equity"))


def equal_weight_benchmark(ledger_ts: DataFrame, bars: DataFrame, *, base_ts: str, capital: float) -> DataFrame:
    """Mean over symbols of price relative to the base date, times capital.

    Each symbol's price is carried forward between its bars.  Bars become
    steps of the relative, so the mean at any stamp is a running sum over
    stamps and no (stamp x symbol) grid is formed.
    """
    t = F.lit(base_ts).cast(bars.schema["ts"].dataType)
    base = bars.filter(F.col("ts") <= t).groupBy("symbol").agg(F.max_by("close", "ts").alias("_p0")).filter("_p0 > 0")
    b = Blocks.lay(bars.join(base, "symbol").select("symbol", "ts", (F.col("close") / F.col("_p0")).alias("_rel")), ["symbol"], ["ts"], lookback=1)
    step = F.col("_rel") - F.coalesce(b.lag(F.col("_rel"), 1), F.lit(0.0))
    d = b.add(_step=step, _new=b.lag(F.col("_rel"), 1).isNull().cast("long")).close()
    steps = d.groupBy("ts").agg(F.sum("_step").alias("_step"), F.sum("_new").alias("_new"))
    marks = ledger_ts.select("ts").distinct()
    u = steps.join(marks.withColumn("_mark", F.lit(1)), "ts", "full")
    run = prefix_scan(u, [], ["ts"], chunk(), sums={"_s": F.coalesce("_step", F.lit(0.0)), "_k": F.coalesce("_new", F.lit(0))})
    v = capital * safe_div(F.col("_s"), F.col("_k"))
    return run.filter("_mark = 1").select("ts", F.coalesce(v, F.lit(0.0)).alias("equity"))


def day_pnl_base(ledger: DataFrame, today: str) -> DataFrame:
    """Equity of the last ledger row before today."""
    return ledger.filter(F.to_date("ts") < F.lit(today).cast("date")).groupBy("strategy").agg(
        F.max_by("equity", "ts").alias("base_equity")
    )


def session_ids(df: DataFrame, *, keys: list[str], gap_minutes: int) -> DataFrame:
    """Session number per key: a new one after a gap longer than allowed.

    A key's events are numbered in chunks of days, so a hot key is many tasks.
    """
    b = Blocks.lay(df, keys, ["ts"], lookback=1, chunk=calendar_chunk("ts", 8))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce(us - b.lag(us, 1) > gap_minutes * 60_000_000, F.lit(True)).cast("long")
    d = b.add(_new=new).close()
    return prefix_scan(d, keys, ["ts"], calendar_chunk("ts", 8), sums={"session": F.col("_new")}).drop("_new")

