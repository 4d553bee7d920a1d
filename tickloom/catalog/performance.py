"""Equity curves, performance metrics, overfitting statistics, benchmarks."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tickloom.catalog.base import query, tidy
from tickloom.catalog.features import W, ledger_returns
from tickloom.catalog.panel import SCORES, scores
from tickloom.catalog.sqlbits import BARS, BENCH, LEDGER, day
from tickloom.operators import decisions as D
from tickloom.operators import features as X
from tickloom.operators import report as R
from tickloom.operators import sizing as S
from tickloom.operators.series import Blocks
from tickloom.sources import tables as T

PPF = NormalDist().inv_cdf
CURVE = f"""{LEDGER}, curve AS (SELECT strategy, ts, equity, least(n_orders, 5) / 5.0 AS position, notional / 1e6 AS turnover, n_orders AS n_positions FROM ledger)"""
WS = "WINDOW w AS (PARTITION BY strategy ORDER BY ts)"
RETS = f"""{CURVE}, rets AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity - lag(equity) OVER w AS pnl, abs(position - lag(position) OVER w) AS dpos,
    max(equity) OVER w AS peak, (max(equity) OVER w - equity) / max(equity) OVER w AS drawdown FROM curve {WS})"""


def curve(spark, d):
    return T.ledger(spark, d).select(
        "strategy", "ts", "equity", (F.least(F.col("n_orders"), F.lit(5)) / 5.0).alias("position"),
        (F.col("notional") / 1e6).alias("turnover"), F.col("n_orders").alias("n_positions"))


def phi(z: str) -> str:
    """Normal distribution function by its series around zero; flat past 6.5."""
    z = f"greatest(-6.5, least(6.5, {z}))"
    term = f"exp((2*k+1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2*k+3) - (k+1)*ln(2.0) - lgamma(k+2)))"
    return f"(0.5 + sign({z}) * exp(-({z})*({z})/2) / sqrt(2*pi()) * list_sum(list_transform(range(0, 200), lambda k: {term})))"


@query(
    "ledger_curves", "D13 D15 W23 W31 S14",
    f"WITH {RETS} SELECT strategy, {day('ts')} AS ts, round(equity, 4) AS equity, round(ret, 6) AS ret, round(peak, 4) AS peak, round(drawdown, 6) AS drawdown, round(position, 6) AS position FROM rets",
)
def _(spark, d):
    r = R.drawdowns(R.returns(curve(spark, d)))
    return tidy(r.select("strategy", "ts", "equity", "ret", "peak", "drawdown", "position"), equity=4, peak=4)


@query(
    "drawdown_penalised_return", "W29",
    f"""WITH {RETS}, l AS (SELECT strategy, ts, ln(greatest(1 + coalesce(ret, 0) / 10, 1e-8)) AS lr FROM rets), c AS (SELECT *, sum(lr) OVER w AS cum FROM l {WS})
    SELECT strategy, {day('ts')} AS ts, round(lr - (greatest(max(cum) OVER w, 0) - cum), 6) AS penalised FROM c {WS}""",
)
def _(spark, d):
    return tidy(R.penalised_returns(ledger_returns(spark, d), keys=["strategy"]).select("strategy", "ts", "penalised"))


@query(
    "forward_filled_ledger", "W26",
    f"""WITH {CURVE}, h AS (SELECT strategy, ts, CASE WHEN day(ts) % 4 = 0 THEN equity END AS mark FROM curve)
    SELECT strategy, {day('ts')} AS ts, round(last_value(mark IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS mark FROM h""",
)
def _(spark, d):
    c = curve(spark, d).select("strategy", "ts", F.when(F.dayofmonth("ts") % 4 == 0, F.col("equity")).alias("mark"))
    return tidy(R.forward_fill(c, ["mark"], keys=["strategy"]).select("strategy", "ts", "mark"), mark=4)


@query(
    "rebased_and_thinned", "W32 W33",
    f"""WITH {CURVE}, r AS (SELECT strategy, ts, 100 * equity / first_value(equity) OVER w AS rebased, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY strategy) AS n FROM curve {WS})
    SELECT strategy, {day('ts')} AS ts, round(rebased, 6) AS rebased FROM r WHERE rn % greatest(1, ceil(n / 900.0)) = 0 OR rn = n - 1""",
)
def _(spark, d):
    t = R.thin(R.rebase(curve(spark, d), keys=["strategy"], value="equity"), keys=["strategy"])
    return tidy(t.select("strategy", "ts", "rebased"))


@query(
    "limit_breaches", "P24",
    f"""WITH {RETS}, b AS (SELECT *, CASE WHEN drawdown >= 0.9 THEN 'max_drawdown' WHEN ret <= -0.6 THEN 'daily_loss' END AS reason FROM rets)
    SELECT strategy, {day('min(ts)')} AS ts, arg_min(reason, ts) AS reason, round(arg_min(drawdown, ts), 6) AS drawdown, round(arg_min(ret, ts), 6) AS ret FROM b WHERE reason IS NOT NULL GROUP BY strategy""",
)
def _(spark, d):
    return tidy(R.limit_breaches(curve(spark, d), max_drawdown=0.9, max_daily_loss=0.6))


_N = 8
_EG = 0.5772156649015329
_Q = (1 - _EG) * PPF(1 - 1 / _N) + _EG * PPF(1 - 1 / (_N * math.e))
METRICS = f"""{RETS}, m AS (SELECT strategy, count(*) AS n, count(ret) AS m, arg_min(equity, ts) AS s, arg_max(equity, ts) AS e, avg(ret) AS mean, stddev_samp(ret) AS sd,
    avg(ret) AS mu, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) AS down, max(drawdown) AS mdd, quantile_cont(ret, 0.05) AS v, avg(CAST(pnl > 0 AS DOUBLE)) FILTER (pnl IS NOT NULL) AS wr,
    sum(pnl) FILTER (pnl > 0) AS wins, -sum(pnl) FILTER (pnl < 0) AS losses, count(*) FILTER (dpos > 0.01) AS nt, sum(dpos) AS dp FROM rets GROUP BY strategy),
  mo AS (SELECT strategy, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS sk, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) AS ku FROM rets JOIN m USING (strategy) WHERE ret IS NOT NULL GROUP BY strategy),
  cv AS (SELECT strategy, avg(ret) AS cvar FROM rets JOIN m USING (strategy) WHERE ret <= v GROUP BY strategy),
  rn AS (SELECT strategy, equity < peak AS wet, sum(CAST(equity >= peak AS INT)) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM rets),
  uw AS (SELECT strategy, max(k) AS bars FROM (SELECT strategy, run, count(*) FILTER (wet) AS k FROM rn GROUP BY 1, 2) GROUP BY strategy),
  f AS (SELECT *, mean / sd AS sr, 1 - sk * (mean / sd) + (ku - 1) / 4 * (mean / sd) * (mean / sd) AS spread, sqrt(1.0 / (m - 1)) * {_Q!r} AS sr0 FROM m JOIN mo USING (strategy) JOIN cv USING (strategy) JOIN uw USING (strategy)),
  zz AS (SELECT *, sr * sqrt(m - 1) / sqrt(spread) AS z1, (sr - sr0) * sqrt(m - 1) / sqrt(spread) AS z2 FROM f)"""


@query(
    "performance_report", "D16 A7 A8 A9 A10 A12 A13 A14 A15 A16 A17 A18 A19 A20 A21 A22 A23 A24 A25 F6 F4",
    f"""WITH {METRICS} SELECT strategy, round(s, 4) AS starting_capital, round(e, 4) AS ending_equity, round(e / s - 1, 6) AS total_return,
      round(pow(e / s, 252.0 / (n - 1)) - 1, 6) AS cagr, round(sd * sqrt(252.0), 6) AS annual_volatility, round(mean / sd * sqrt(252.0), 6) AS sharpe,
      round(mean / down * sqrt(252.0), 6) AS sortino, round((pow(e / s, 252.0 / (n - 1)) - 1) / mdd, 6) AS calmar, round(mdd, 6) AS max_drawdown, bars AS max_drawdown_bars,
      round(v, 6) AS var_95, round(cvar, 6) AS cvar_95, round(wr, 6) AS win_rate, round(wins / losses, 6) AS profit_factor, nt AS n_trades, round(dp / n * 252, 5) AS turnover,
      round(0, 6) AS total_costs, round(0, 6) AS cost_drag, round({phi('z1')}, 6) AS psr, round({phi('z2')}, 6) AS dsr,
      round(1 + spread * pow({PPF(0.95)!r} / sr, 2), 4) AS min_track_record FROM zz""",
)
def _(spark, d):
    r = R.report(curve(spark, d), n_trials=_N)
    return tidy(r, starting_capital=4, ending_equity=4, turnover=5, min_track_record=4)


@query(
    "deflated_sharpe_by_trial_variance", "A22 A23 D17",
    f"""WITH {METRICS}, tv AS (SELECT var_samp(mean / sd * sqrt(252.0)) / 252 AS v, count(*) AS k FROM m),
    y AS (SELECT strategy, (sr - sqrt(tv.v) * ((1 - {_EG}) * {PPF(1 - 1 / 5)!r} + {_EG} * {PPF(1 - 1 / (5 * math.e))!r})) * sqrt(m - 1) / sqrt(spread) AS z FROM f, tv)
    SELECT strategy, round({phi('z')}, 6) AS dsr FROM y""",
)
def _(spark, d):
    r = R.returns(curve(spark, d))
    a = r.groupBy("strategy").agg(
        F.count("ret").alias("n"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"),
        R.sharpe_of(F.avg("ret"), F.stddev_samp("ret"), F.count("ret")).alias("sharpe"))
    stats = a.agg(F.var_samp("sharpe").alias("v"), F.count(F.lit(1)).alias("k"))
    a = a.withColumns({"_v": stats.select("v").scalar(), "_k": stats.select("k").scalar()})
    o = R.overfitting(a, n=F.col("n"), skew=F.col("skew"), kurt=F.col("kurt"), sharpe=F.col("sharpe"),
                      trials=F.col("_k"), ppy=252, trial_variance=F.col("_v"))
    return tidy(o.select("strategy", "dsr"))


BENCHC = f"{BENCH}, bcurve AS (SELECT ts, close AS equity FROM bench)"


@query(
    "excess_sharpe", "A11 J17",
    f"""WITH {CURVE}, {BENCHC}, j AS (SELECT strategy, c.ts, c.equity AS e, b.equity AS q FROM curve c JOIN bcurve b USING (ts)),
    x AS (SELECT strategy, e / lag(e) OVER w - q / lag(q) OVER w AS x FROM j {WS})
    SELECT strategy, round(avg(x) / stddev_samp(x) * sqrt(252.0), 6) AS excess_sharpe FROM x GROUP BY strategy""",
)
def _(spark, d):
    return tidy(R.excess_sharpe(curve(spark, d), T.benchmark(spark, d).withColumnRenamed("close", "equity")))


@query(
    "window_statistics", "A26",
    f"""WITH {RETS}, b AS (SELECT strategy, ts, equity, ret, equity - coalesce(pnl, 0) AS prev, unnest([CAST(year(ts) AS VARCHAR), 'all']) AS win FROM rets),
    f AS (SELECT strategy, win, arg_min(prev, ts) AS base FROM b GROUP BY 1, 2),
    p AS (SELECT b.*, base, greatest(max(equity) OVER (PARTITION BY strategy, win ORDER BY ts), base) AS pk FROM b JOIN f USING (strategy, win))
    SELECT strategy, win AS "window", count(*) AS n_bars, round(arg_max(equity, ts) / max(base) - 1, 6) AS total_return, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 6) AS sharpe,
      round(stddev_samp(ret) * sqrt(252.0), 6) AS volatility, round(max((pk - equity) / pk), 6) AS max_drawdown FROM p GROUP BY 1, 2""",
)
def _(spark, d):
    return tidy(R.window_stats(curve(spark, d)))


_WINDOWS = f"""{RETS}, {BENCH}, b AS (SELECT strategy, ts, equity, ret, lag(ts) OVER (PARTITION BY strategy ORDER BY ts) AS pts, equity - coalesce(pnl, 0) AS prev, unnest([CAST(year(ts) AS VARCHAR), 'all']) AS win FROM rets),
    f AS (SELECT strategy, win, arg_min(prev, ts) AS base, arg_max(equity, ts) AS fin, coalesce(min(pts) FILTER (pts IS NOT NULL AND ts = t0), min(ts)) AS a0, max(ts) AS a1
      FROM (SELECT *, min(ts) OVER (PARTITION BY strategy, win) AS t0 FROM b) GROUP BY 1, 2),
    g AS (SELECT f.*, x.close AS b0, y.close AS b1 FROM f ASOF LEFT JOIN bench x ON f.a0 >= x.ts ASOF LEFT JOIN bench y ON f.a1 >= y.ts),
    n AS (SELECT o_orderpriority AS strategy, win, count(*) AS n_trades FROM (SELECT o_orderpriority, unnest([CAST(year(o_orderdate) AS VARCHAR), 'all']) AS win FROM orders) GROUP BY 1, 2),
    fw AS (SELECT strategy, win, fin / base - 1 AS total, n_trades, b1 / b0 - 1 AS br FROM g JOIN n USING (strategy, win))"""


def findings(spark, d):
    trades = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("strategy"), F.to_date("o_orderdate").alias("ts"))
    return R.window_stats(curve(spark, d), trades=trades, bench=T.benchmark(spark, d).withColumnRenamed("close", "equity"))


@query(
    "model_findings", "A26 C27",
    f"""WITH {_WINDOWS} SELECT strategy, win AS "window", round(total, 6) AS total_return, n_trades, round(br, 6) AS bench_return, round(total - br, 6) AS excess FROM fw""",
)
def _(spark, d):
    return tidy(findings(spark, d).select("strategy", "window", "total_return", "n_trades", "bench_return", "excess"))


@query(
    "best_and_worst_years", "C27",
    f"""WITH {_WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY total DESC, win) AS k, row_number() OVER (PARTITION BY strategy ORDER BY total, win) AS j FROM fw WHERE win <> 'all')
    SELECT strategy, max(win) FILTER (k = 1) AS best_year, round(max(total) FILTER (k = 1), 6) AS best_return, max(win) FILTER (j = 1) AS worst_year, round(max(total) FILTER (j = 1), 6) AS worst_return FROM r GROUP BY strategy""",
)
def _(spark, d):
    return tidy(R.extremes(R.window_stats(curve(spark, d))))


@query(
    "chart_payload", "C28 W32 W33",
    f"""WITH {RETS}, {BENCH}, j AS (SELECT r.strategy, r.ts, r.equity, r.pnl, r.drawdown, b.close FROM rets r ASOF LEFT JOIN bench b ON r.ts >= b.ts),
    z AS (SELECT strategy, arg_min(equity / close, ts) FILTER (close IS NOT NULL) AS k FROM j GROUP BY 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY strategy) AS n FROM j)
    SELECT strategy, {day('ts')} AS ts, round(equity, 4) AS equity, round(drawdown * 100, 4) AS drawdown, round(pnl, 4) AS pnl, round(close * k, 4) AS bench FROM t JOIN z USING (strategy)
    WHERE rn % greatest(1, CAST(ceil(n / 900.0) AS BIGINT)) = 0 OR rn = n - 1""",
)
def _(spark, d):
    payload = R.chart_payload(curve(spark, d), T.benchmark(spark, d).withColumnRenamed("close", "equity"), digits=None)
    return tidy(R.chart_points(payload), 4)


@query(
    "monthly_returns", "A6 F14",
    f"WITH {RETS} SELECT strategy, strftime(ts, '%Y-%m') AS month, round(product(1 + coalesce(ret, 0) / 10) - 1, 6) AS ret FROM rets GROUP BY 1, 2",
)
def _(spark, d):
    return tidy(R.monthly_returns(ledger_returns(spark, d)))


@query(
    "lifetime_ledger_stats", "A28",
    f"""WITH {RETS} SELECT strategy, count(*) AS n_bars, count(DISTINCT ts) AS sessions, round(-max(drawdown), 6) AS max_drawdown, round(avg(ret) / stddev_pop(ret) * sqrt(3276.0), 6) AS sharpe,
      round(sum(turnover), 3) AS total_turnover, max(n_positions) AS peak_positions FROM rets GROUP BY strategy""",
)
def _(spark, d):
    return tidy(R.lifetime_stats(curve(spark, d), bars_per_year=3276), total_turnover=3)


@query(
    "benchmark_metrics", "A43",
    f"""WITH {RETS} SELECT strategy, round(arg_max(equity, ts) / arg_min(equity, ts) - 1, 6) AS total_return, round(pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / (count(*) - 1)) - 1, 6) AS cagr,
      round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 6) AS sharpe, round(max(drawdown), 6) AS max_drawdown FROM rets GROUP BY strategy""",
)
def _(spark, d):
    return tidy(R.benchmark_metrics(curve(spark, d)))


_SIG = f"""{BARS}, sg AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret, close / avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING) - 1 AS d21,
    close / avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 62 PRECEDING) - 1 AS d63, row_number() OVER w AS rn FROM bars {W}),
  px AS (SELECT ts, avg(ret) AS ret, avg(d21) AS d21, avg(d63) AS d63 FROM sg WHERE rn >= 63 GROUP BY ts),
  pos AS (SELECT 'buy_and_hold' AS strategy, ts, ret / 10 AS ret, 1.0 AS position FROM px UNION ALL SELECT 'flat', ts, ret / 10, 0.0 FROM px
    UNION ALL SELECT 'ma_cross', ts, ret / 10, CASE WHEN d21 > d63 THEN 1.0 ELSE 0.0 END FROM px),
  net AS (SELECT *, coalesce(lag(position) OVER w, 0) * coalesce(ret, 0) - 0.00015 * abs(position - coalesce(lag(position) OVER w, 0)) AS net FROM pos WINDOW w AS (PARTITION BY strategy ORDER BY ts)),
  sim AS (SELECT *, 100000 * exp(sum(ln(greatest(1 + net, 1e-8))) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM net)"""


def simulated(spark, d):
    b = Blocks.lay(T.daily_bars(spark, d), ["symbol"], ["ts"], lookback=63)
    c = F.col("close")
    x = b.add(ret=c / b.lag(c, 1) - 1, **X.ma_distances(b, (21, 63))).close().dropna(subset=["dist_ma_63"])
    px = x.groupBy("ts").agg((F.avg("ret") / 10).alias("ret"), F.avg("dist_ma_21").alias("dist_ma_21"), F.avg("dist_ma_63").alias("dist_ma_63"))
    return R.evaluate_signals(D.baseline_positions(px, allow_short=False), cost=0.00015)


@query(
    "baseline_signal_equity", "C13 C14",
    f"WITH {_SIG} SELECT strategy, {day('ts')} AS ts, round(position, 6) AS position, round(net, 6) AS net, round(ln(greatest(equity, 1e-300)), 6) AS log_equity FROM sim",
)
def _(spark, d):
    s = simulated(spark, d).withColumn("log_equity", F.ln(F.greatest("equity", F.lit(1e-300))))
    return tidy(s.select("strategy", "ts", "position", "net", "log_equity"))


@query(
    "strategy_verdict", "A46",
    f"""WITH {_SIG}, t AS (SELECT strategy, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS r FROM sim GROUP BY strategy)
    SELECT arg_max(strategy, row(r, strategy)) AS best, round(max(r), 5) AS best_return, CAST(max(r) FILTER (strategy <> 'buy_and_hold') > max(r) FILTER (strategy = 'buy_and_hold') AS BIGINT) AS beat_benchmark FROM t""",
)
def _(spark, d):
    m = R.benchmark_metrics(simulated(spark, d))
    return tidy(R.strategy_verdict(m, benchmark="buy_and_hold"), best_return=5)


@query(
    "cost_sweep", "C15 J18",
    f"""WITH {SCORES}, w0 AS (SELECT ts, symbol, score - avg(score) OVER (PARTITION BY ts) AS c FROM scores),
    w1 AS (SELECT ts, symbol, c / nullif(sum(abs(c)) OVER (PARTITION BY ts), 0) AS weight FROM w0),
    fw AS (SELECT symbol, ts, lead(close) OVER w / close - 1 AS fwd FROM bars {W}),
    dt AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nx FROM (SELECT DISTINCT ts FROM w1)),
    pv AS (SELECT nx AS ts, symbol, weight AS pw FROM w1 JOIN dt USING (ts) WHERE nx IS NOT NULL),
    tu AS (SELECT ts, sum(abs(coalesce(weight, 0) - coalesce(pw, 0))) AS t FROM w1 FULL JOIN pv USING (ts, symbol) GROUP BY ts),
    dd AS (SELECT ts, coalesce(sum(weight * fwd), 0) AS g, any_value(t) AS t FROM w1 LEFT JOIN fw USING (ts, symbol) JOIN tu USING (ts) GROUP BY ts),
    x AS (SELECT cost_bp, g - t * cost_bp * 1e-4 AS net, t FROM dd, (SELECT unnest([0.0, 1.0, 2.0, 3.0, 5.0]) AS cost_bp))
    SELECT round(cost_bp, 6) AS cost_bp, count(*) AS n_days, round(avg(net) * 1e4, 4) AS net_bp, round(avg(t), 6) AS turnover, round(avg(net) / stddev_samp(net) * sqrt(252.0), 6) AS sharpe FROM x GROUP BY cost_bp""",
)
def _(spark, d):
    w = S.dollar_neutral_weights(scores(spark, d))
    b = Blocks.lay(T.daily_bars(spark, d).select("symbol", "ts", "close"), ["symbol"], ["ts"], lookback=0, lookahead=1)
    fwd = b.add(fwd=b.lead(F.col("close"), 1) / F.col("close") - 1).close()
    return tidy(R.cost_sweep(w, fwd, [0.0, 1.0, 2.0, 3.0, 5.0]), net_bp=4)


@query(
    "benchmark_as_of", "J3 J5",
    f"""WITH {CURVE}, {BENCH}, c AS (SELECT DISTINCT ts FROM curve),
    j AS (SELECT c.ts, bench.close FROM c ASOF LEFT JOIN bench ON c.ts >= bench.ts)
    SELECT {day('ts')} AS ts, round(coalesce(100000 / (SELECT arg_min(close, ts) FROM j WHERE close IS NOT NULL) * close, 0), 2) AS equity FROM j""",
)
def _(spark, d):
    return tidy(R.benchmark_equity(curve(spark, d), T.benchmark(spark, d), capital=100_000.0), equity=2)


@query(
    "equal_weight_benchmark", "J4",
    f"""WITH {CURVE}, {BARS}, c AS (SELECT DISTINCT ts FROM curve), s AS (SELECT symbol, arg_max(close, ts) AS p0 FROM bars WHERE ts <= DATE '1995-03-01' GROUP BY symbol),
    g AS (SELECT c.ts, s.symbol, p0 FROM c, s), j AS (SELECT g.ts, g.symbol, close / p0 AS rel FROM g ASOF JOIN bars b ON g.symbol = b.symbol AND g.ts >= b.ts)
    SELECT {day('c.ts')} AS ts, round(coalesce(100000 * avg(rel), 0), 2) AS equity FROM c LEFT JOIN j ON c.ts = j.ts GROUP BY c.ts""",
)
def _(spark, d):
    return tidy(R.equal_weight_benchmark(curve(spark, d), T.daily_bars(spark, d), base_ts="1995-03-01", capital=100_000.0), equity=2)


@query(
    "day_pnl_base", "W37",
    f"WITH {CURVE} SELECT strategy, round(arg_max(equity, ts), 4) AS base_equity FROM curve WHERE ts < DATE '1999-06-15' GROUP BY strategy",
)
def _(spark, d):
    return tidy(R.day_pnl_base(curve(spark, d), "1999-06-15"), base_equity=4)


@query(
    "backtest_overfitting", "A39",
    """WITH p AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS path, ascii(substr(o_orderpriority, 1, 1)) AS config, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS is_perf, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS oos_perf FROM orders GROUP BY 1, 2),
    b AS (SELECT path, arg_max(oos_perf, row(is_perf, -config)) AS best FROM p GROUP BY path),
    r AS (SELECT p.path, avg(CAST(oos_perf <= best AS DOUBLE)) AS rk FROM p JOIN b USING (path) GROUP BY p.path)
    SELECT round(avg(CAST(rk < 0.5 AS DOUBLE)), 6) AS pbo, count(*) AS n_paths FROM r""",
)
def _(spark, d):
    o = T.table(spark, d, "orders")
    p = o.groupBy((F.col("o_custkey") % 40).alias("path"), F.ascii(F.substring("o_orderpriority", 1, 1)).alias("config")).agg(
        F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("is_perf"),
        F.avg(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice"))).alias("oos_perf"))
    return tidy(R.overfitting_probability(p))


@query(
    "trading_sessions", "ST10",
    """WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER w AS prev FROM (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events FROM s GROUP BY 1, 2""",
)
def _(spark, d):
    e = T.table(spark, d, "events").select("user_id", "ts").distinct()
    s = R.session_ids(e, keys=["user_id"], gap_minutes=360)
    return tidy(s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events")))


@query(
    "trades_per_year", "A27",
    f"WITH {CURVE} SELECT strategy, CAST(year(ts) AS BIGINT) AS year, CAST(sum(n_positions) AS BIGINT) AS n_trades FROM curve GROUP BY 1, 2",
)
def _(spark, d):
    return tidy(curve(spark, d).groupBy("strategy", F.year("ts").alias("year")).agg(F.sum("n_positions").alias("n_trades")))


