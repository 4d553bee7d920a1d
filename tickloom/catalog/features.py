"""Per-symbol window features."""

from pyspark.sql import functions as F

from tickloom.catalog.base import query, tidy
from tickloom.catalog.sqlbits import BARS, LEDGER, day, with_
from tickloom.operators import evaluate as E
from tickloom.operators import features as X
from tickloom.operators.series import Blocks, ewm_lookback
from tickloom.settings import FeatureSettings, ewm_alpha
from tickloom.sources import tables as T

CFG = FeatureSettings()
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def full(expr_: str, of: str, n: int) -> str:
    """SQL for a trailing aggregate that is NULL until ``n`` values exist."""
    fr = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) {fr} = {n} THEN {expr_} {fr} END"


def cols(**kw: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in kw.items())


def bars_layout(spark, d, lookback):
    return Blocks.lay(T.daily_bars(spark, d), ["symbol"], ["ts"], lookback=lookback)


def out(b, *names, dp=6, **places):
    return tidy(b.close().select("symbol", "ts", *names), dp, **places)


@query(
    "log_return_horizons", "W1 F1",
    f"{with_(BARS)} SELECT symbol, {day('ts')} AS ts, "
    + ", ".join(f"round(ln(close / lag(close, {h}) OVER w), 6) AS ret_{h}d" for h in CFG.return_horizons)
    + f" FROM bars {W}",
)
def _(spark, d):
    b = bars_layout(spark, d, 63)
    r = X.log_returns(b, CFG.return_horizons)
    return out(b.add(**r), *r)


_LR = "lr AS (SELECT *, ln(close / lag(close) OVER w) AS lr, 0.5*ln(high/low)*ln(high/low) - (2*ln(2.0)-1)*ln(close/open)*ln(close/open) AS gk FROM bars " + W + ")"


@query(
    "rolling_volatility", "W2 W3 F3",
    f"{with_(BARS, _LR)} SELECT symbol, {day('ts')} AS ts, "
    + cols(**{f"vol_{w}d": full("stddev_samp(lr)", "lr", w) + " * sqrt(252.0)" for w in (21, 63)},
           **{f"gk_vol_{w}d": f"sqrt(greatest({full('avg(gk)', 'gk', w)}, 0)) * sqrt(252.0)" for w in (21, 63)}).replace("sqrt(greatest(CASE", "sqrt(greatest(CASE")
    + " FROM lr",
)
def _(spark, d):
    b = bars_layout(spark, d, 64)
    c = F.col("close")
    b = b.add(_lr=F.ln(c / b.lag(c, 1)))
    v = X.volatilities(b, CFG.vol_windows, F.col("_lr"))
    # An incomplete window stays NULL: greatest() alone would give zero.
    return out(b.add(**v), *v)


def ewm_sql(src: str, specs: dict[str, tuple[str, float]]) -> str:
    """Recursive-CTE steps: specs maps output to (input column, alpha)."""
    first = ", ".join(f"{c} AS {o}" for o, (c, _) in specs.items())
    nxt = ", ".join(f"(1 - {a!r}) * e.{o} + {a!r} * s.{c}" for o, (c, a) in specs.items())
    return f"""{src}_ewm AS (
      SELECT symbol, rn, {first} FROM {src} WHERE rn = 1
      UNION ALL SELECT s.symbol, s.rn, {nxt} FROM {src}_ewm e JOIN {src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"""


_N = f"n AS (SELECT *, row_number() OVER w AS rn FROM bars {W})"
_GL = f"""gl AS (SELECT symbol, ts, rn, greatest(coalesce(close - lag(close) OVER w, 0), 0) AS g,
      greatest(coalesce(lag(close) OVER w - close, 0), 0) AS l FROM n {W})"""


@query(
    "rsi", "W4 W34",
    f"""{with_(BARS, _N, _GL, ewm_sql('gl', {'ag': ('g', 1 / 14), 'al': ('l', 1 / 14)}), recursive=True)}
    SELECT gl.symbol, {day('gl.ts')} AS ts, round((100 - 100 / (1 + ag / (al + 1e-12))) / 100, 6) AS rsi
    FROM gl JOIN gl_ewm e ON e.symbol = gl.symbol AND e.rn = gl.rn""",
)
def _(spark, d):
    b = bars_layout(spark, d, ewm_lookback(1 / 14) + 1)
    b = b.add(**X.rsi_inputs(b))
    return out(b.add(rsi=X.rsi(b, 14)), "rsi")


_F, _S, _G = (ewm_alpha(span=s) for s in (12, 26, 9))


@query(
    "macd", "W5 W34",
    f"""{with_(BARS, _N, ewm_sql('n', {'ef': ('close', _F), 'es': ('close', _S)}),
               "m AS (SELECT n.symbol, n.ts, n.rn, n.close, ef - es AS line FROM n JOIN n_ewm e ON e.symbol = n.symbol AND e.rn = n.rn)",
               ewm_sql('m', {'sig': ('line', _G)}), recursive=True)}
    SELECT m.symbol, {day('m.ts')} AS ts, round(line / close, 6) AS macd, round((line - sig) / close, 6) AS macd_hist
    FROM m JOIN m_ewm e ON e.symbol = m.symbol AND e.rn = m.rn""",
)
def _(spark, d):
    b = Blocks.lay(T.daily_bars(spark, d), ["symbol"], ["ts"], lookback=ewm_lookback(_S) + ewm_lookback(_G), block_rows=1536)
    b = b.add(_m=X.macd_line(b, 12, 26))
    c = F.col("close")
    b = b.add(macd=F.col("_m") / c, macd_hist=(F.col("_m") - b.ewm(F.col("_m"), _G)) / c)
    return out(b, "macd", "macd_hist")


@query(
    "bollinger_and_ma_distance", "W6 W7",
    f"{with_(BARS)} SELECT symbol, {day('ts')} AS ts, "
    + cols(bb_position=f"(close - ({full('avg(close)', 'close', 20)})) / (2 * ({full('stddev_samp(close)', 'close', 20)}) + 1e-12)",
           **{f"dist_ma_{w}": f"close / ({full('avg(close)', 'close', w)}) - 1" for w in (21, 63, 200)})
    + " FROM bars",
)
def _(spark, d):
    b = bars_layout(spark, d, 200)
    m = X.ma_distances(b, CFG.ma_windows)
    return out(b.add(bb_position=X.bollinger(b, 20), **m), "bb_position", *m)


@query(
    "volume_features", "W8 W9 W10",
    f"{with_(BARS, 'v AS (SELECT *, ln(1 + volume) AS lv FROM bars)')} SELECT symbol, {day('ts')} AS ts, "
    + cols(volume_z=f"(lv - ({full('avg(lv)', 'lv', 252)})) / (({full('stddev_samp(lv)', 'lv', 252)}) + 1e-12)",
           volume_ratio=f"volume / ({full('avg(volume)', 'volume', 21)}) - 1")
    + " FROM v",
)
def _(spark, d):
    b = bars_layout(spark, d, 252)
    v = X.volume_features(b, 252, 21)
    return out(b.add(**v), *v)


@query(
    "atr_pct", "W11 F3",
    f"""{with_(BARS, f"t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W})")}
    SELECT symbol, {day('ts')} AS ts, round(({full('avg(tr)', 'tr', 14)}) / close, 6) AS atr_pct FROM t""",
)
def _(spark, d):
    b = bars_layout(spark, d, 15)
    b = b.add(_tr=X.true_range(b))
    return out(b.add(atr_pct=b.mean(F.col("_tr"), 14) / F.col("close")), "atr_pct")


def ffd_sql(width: int) -> str:
    """Weights by the recurrence, then a row-offset join."""
    return f"""ffdw AS (SELECT 0 AS k, CAST(1.0 AS DOUBLE) AS w UNION ALL
        SELECT k + 1, -w * (0.4 - (k + 1) + 1) / (k + 1) FROM ffdw WHERE k + 1 < {width}),
      nl AS (SELECT symbol, ts, ln(close) AS x, row_number() OVER w AS rn FROM bars {W}),
      ffd AS (SELECT a.symbol, a.ts, a.rn, sum(b.x * f.w) AS y FROM nl a JOIN ffdw f ON true
              JOIN nl b ON b.symbol = a.symbol AND b.rn = a.rn - f.k WHERE a.rn >= {width} GROUP BY 1, 2, 3)"""


_WIDTH = len(X.ffd_weights(0.4, 1e-4))


@query(
    "fractional_difference", "W12 F39",
    f"""{with_(BARS, ffd_sql(_WIDTH), recursive=True)}
    SELECT nl.symbol, {day('nl.ts')} AS ts, round(y, 6) AS ffd_log_close FROM nl LEFT JOIN ffd USING (symbol, rn)""",
)
def _(spark, d):
    b = bars_layout(spark, d, _WIDTH)
    return out(X.frac_diff(b, F.ln("close"), 0.4, 1e-4, "ffd_log_close"), "ffd_log_close")


@query(
    "return_and_ffd_zscore", "W13",
    f"""{with_(BARS, ffd_sql(_WIDTH), recursive=True)},
    r AS (SELECT nl.symbol, nl.ts, y, x - lag(x, 5) OVER (PARTITION BY nl.symbol ORDER BY nl.ts) AS r5 FROM nl LEFT JOIN ffd USING (symbol, rn))
    SELECT symbol, {day('ts')} AS ts,
      round((y - ({full('avg(y)', 'y', 252)})) / (({full('stddev_samp(y)', 'y', 252)}) + 1e-12), 6) AS ffd_z,
      round((r5 - ({full('avg(r5)', 'r5', 252)})) / (({full('stddev_samp(r5)', 'r5', 252)}) + 1e-12), 6) AS ret_5d_z FROM r""",
)
def _(spark, d):
    b = bars_layout(spark, d, _WIDTH + 252)
    b = X.frac_diff(b, F.ln("close"), 0.4, 1e-4, "_ffd")
    c = F.col("close")
    b = b.add(_r5=F.ln(c / b.lag(c, 5)))
    return out(b.add(ffd_z=b.zscore(F.col("_ffd"), 252), ret_5d_z=b.zscore(F.col("_r5"), 252)), "ffd_z", "ret_5d_z")


def _dataset_sql() -> str:
    """The whole feature set of C21 as one statement."""
    z = lambda c: f"({c} - ({full(f'avg({c})', c, 252)})) / (({full(f'stddev_samp({c})', c, 252)}) + 1e-12)"
    rets = ", ".join(f"ln(close / lag(close, {h}) OVER w) AS ret_{h}d" for h in CFG.return_horizons)
    base = f"""base AS (SELECT *, {rets}, ln(close / lag(close) OVER w) AS lr, ln(1 + volume) AS lv,
        0.5*ln(high/low)*ln(high/low) - (2*ln(2.0)-1)*ln(close/open)*ln(close/open) AS gk,
        greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
        row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS cnt FROM bars {W})"""
    feats = {f"ret_{h}d_z": z(f"ret_{h}d") for h in CFG.return_horizons}
    feats |= {f"vol_{w}d": f"({full('stddev_samp(lr)', 'lr', w)}) * sqrt(252.0)" for w in (21, 63)}
    feats |= {f"gk_vol_{w}d": f"sqrt(greatest({full('avg(gk)', 'gk', w)}, 0)) * sqrt(252.0)" for w in (21, 63)}
    feats |= {"bb_position": f"(close - ({full('avg(close)', 'close', 20)})) / (2 * ({full('stddev_samp(close)', 'close', 20)}) + 1e-12)"}
    feats |= {f"dist_ma_{w}": f"close / ({full('avg(close)', 'close', w)}) - 1" for w in (21, 63, 200)}
    feats |= {"volume_z": z("lv"), "volume_ratio": f"volume / ({full('avg(volume)', 'volume', 21)}) - 1",
              "atr_pct": f"({full('avg(tr)', 'tr', 14)}) / close"}
    sel = ", ".join(f"{v} AS {k}" for k, v in feats.items())
    outc = ", ".join(f"round({c}, 6) AS {c}" for c in CFG.columns())
    return f"""{with_(BARS, ffd_sql(_WIDTH), _N, _GL,
                      ewm_sql('gl', {'ag': ('g', 1 / 14), 'al': ('l', 1 / 14)}),
                      ewm_sql('n', {'ef': ('close', _F), 'es': ('close', _S)}),
                      "m AS (SELECT n.symbol, n.ts, n.rn, n.close, ef - es AS line FROM n JOIN n_ewm e ON e.symbol = n.symbol AND e.rn = n.rn)",
                      ewm_sql('m', {'sig': ('line', _G)}),
                      base,
                      f"fz AS (SELECT symbol, rn, {z('y')} AS ffd_z FROM ffd)",
                      f"feat AS (SELECT symbol, ts, rn, cnt, {sel} FROM base)", recursive=True)}
    SELECT feat.symbol, {day('feat.ts')} AS ts, {outc} FROM feat JOIN fz USING (symbol, rn)
      JOIN (SELECT symbol, rn, (100 - 100 / (1 + ag / (al + 1e-12))) / 100 AS rsi FROM gl_ewm) USING (symbol, rn)
      JOIN (SELECT m.symbol, m.rn, line / close AS macd, (line - sig) / close AS macd_hist FROM m JOIN m_ewm e ON e.symbol = m.symbol AND e.rn = m.rn) USING (symbol, rn)
    WHERE (rn > 300 OR cnt <= 300) AND {' AND '.join(f'{c} IS NOT NULL' for c in CFG.columns())}"""


@query("feature_dataset", "C21 P10 P11 F5 D3 W1 W2 W3 W4 W5 W6 W7 W8 W9 W10 W11 W12 W13", _dataset_sql())
def _(spark, d):
    return tidy(X.build_dataset(T.daily_bars(spark, d)).select("symbol", "ts", *CFG.columns()))


_CAND = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
_ORDER_SQL = f"""{with_(
    BARS,
    "d AS (SELECT unnest([0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]::DOUBLE[]) AS d)",
    "fw AS (SELECT d, 0 AS k, CAST(1.0 AS DOUBLE) AS w FROM d UNION ALL SELECT d, k + 1, -w * (d - (k + 1) + 1) / (k + 1) FROM fw WHERE abs(-w * (d - (k + 1) + 1) / (k + 1)) >= 0.01)",
    f"nl AS (SELECT symbol, ln(close) AS x, row_number() OVER w AS rn FROM bars {W})",
    "wd AS (SELECT d, max(k) + 1 AS width FROM fw GROUP BY d)",
    "y AS (SELECT f.d, a.symbol, a.rn, sum(b.x * f.w) AS y FROM nl a JOIN fw f ON true JOIN wd ON wd.d = f.d JOIN nl b ON b.symbol = a.symbol AND b.rn = a.rn - f.k WHERE a.rn >= width GROUP BY 1, 2, 3)",
    "h AS (SELECT d, symbol, y, rn - min(rn) OVER (PARTITION BY d, symbol) >= floor(count(*) OVER (PARTITION BY d, symbol) / 2) AS second, count(*) OVER (PARTITION BY d, symbol) AS n FROM y)",
    "v AS (SELECT d, symbol, n, var_pop(y) FILTER (second) / greatest(var_pop(y) FILTER (NOT second), 1e-12) AS ratio FROM h GROUP BY 1, 2, 3)",
    recursive=True)}
  SELECT symbol, round(coalesce(min(d) FILTER (n >= 100 AND ratio > 0.5 AND ratio < 2.0), 1.0), 6) AS d FROM v GROUP BY symbol"""


@query("fractional_order_search", "C20 J18", _ORDER_SQL)
def _(spark, d):
    s = T.daily_bars(spark, d).select("symbol", "ts", F.ln("close").alias("x"))
    return tidy(X.min_ffd_order(s, keys=["symbol"], order="ts", value="x", threshold=0.01, candidates=_CAND))


_RET = f"""{LEDGER}, r AS (SELECT strategy AS symbol, ts, row_number() OVER w AS rn,
    coalesce(equity / lag(equity) OVER w - 1, 0) / 10 AS ret FROM ledger WINDOW w AS (PARTITION BY strategy ORDER BY ts)),
  z AS (SELECT symbol, 0 AS rn, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM r WHERE rn = 1
    UNION ALL SELECT r.symbol, r.rn, z.a, z.b, z.a + 0.01 * (ret - z.a), z.b + 0.01 * (ret * ret - z.b) FROM z JOIN r ON r.symbol = z.symbol AND r.rn = z.rn + 1)"""


def ledger_returns(spark, d):
    led = T.ledger(spark, d).select(F.col("strategy"), "ts", "equity")
    b = Blocks.lay(led, ["strategy"], ["ts"], lookback=1)
    e = F.col("equity")
    return b.add(ret=F.coalesce(F.try_divide(e, b.lag(e, 1)) - 1, F.lit(0.0)) / 10).close().drop("equity")


@query(
    "differential_sharpe", "W28 W34",
    f"""WITH RECURSIVE {_RET} SELECT symbol AS strategy, {day('r.ts')} AS ts,
    round(CASE WHEN rn = 1 OR b0 - a0 * a0 <= 1e-12 THEN 0 ELSE
      greatest(-1e6, least(1e6, (b0 * (ret - a0) - 0.5 * a0 * (ret * ret - b0)) / pow(b0 - a0 * a0, 1.5))) END, 6) AS dsr,
    round(CASE WHEN b - a * a > 1e-12 THEN a / sqrt(b - a * a) ELSE 0 END, 6) AS ew_sharpe
    FROM r JOIN z USING (symbol, rn)""",
)
def _(spark, d):
    x = E.differential_sharpe(ledger_returns(spark, d), keys=["strategy"])
    return tidy(x.select("strategy", "ts", "dsr", "ew_sharpe"))
