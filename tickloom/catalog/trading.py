"""Composite score, sizing, decisions and their joins."""

from pyspark.sql import functions as F

from tickloom.catalog.base import query, tidy
from tickloom.catalog.features import W, full
from tickloom.catalog.panel import zsql
from tickloom.catalog.sqlbits import BARS, INTRADAY, day, stamp, with_
from tickloom.operators import alpha as A
from tickloom.operators import decisions as D
from tickloom.operators import report as R
from tickloom.operators import sizing as S
from tickloom.operators.series import Blocks, asof_backward
from tickloom.settings import AlphaSettings, BookSettings, NewsSettings, SizingSettings
from tickloom.sources import tables as T

CFG = AlphaSettings(bars_per_day=1)
SIZE = SizingSettings(bars_per_year=252, min_dollar_volume=30_000.0)

def alpha_sql(source, table, rev, mom, vol):
    """Composite score over ``table`` with look-backs in bars."""
    return f"""{source}, a0 AS (SELECT *, ln(close / lag(close) OVER w) AS lr, close * volume AS dv, row_number() OVER w AS rn FROM {table} {W}),
  a1 AS (SELECT ts, symbol, close, rn, close / lag(close, {rev}) OVER w - 1 AS rev, close / lag(close, {mom}) OVER w - 1 AS mom0,
    {full('stddev_pop(lr)', 'lr', vol)} AS vol, {full('median(dv)', 'dv', vol)} AS dollar_volume FROM a0 {W}),
  a2 AS (SELECT ts, symbol, close, rev, mom0 / vol AS mom, vol, dollar_volume, ln(dollar_volume) AS liq FROM a1 WHERE rn >= {max(mom, vol) + 2} AND vol > 0),
  a3 AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM a2),
  a4 AS (SELECT *, -1.0 * ({zsql('rev')}) + 0.6 * ({zsql('mom')}) - 0.3 * ({zsql('vol')}) + 0.15 * ({zsql('liq')}) AS raw FROM a3 WHERE n >= 2),
  a5 AS (SELECT *, raw - avg(raw) OVER (PARTITION BY ts) AS c FROM a4),
  alpha AS (SELECT ts, symbol, close, vol, dollar_volume, CASE WHEN stddev_pop(c) OVER (PARTITION BY ts) > 0 THEN c / stddev_pop(c) OVER (PARTITION BY ts) ELSE c END AS score FROM a5)"""


ALPHA = alpha_sql(BARS, "bars", 3, 20, 10)

SIZED = f"""{ALPHA},
  s0 AS (SELECT ts, symbol, score, vol, row_number() OVER (PARTITION BY ts, sign(score) ORDER BY abs(score) DESC, symbol) AS k,
    count(*) OVER (PARTITION BY ts, sign(score)) AS m FROM alpha WHERE vol > 0 AND dollar_volume >= 30000 AND score <> 0),
  s1 AS (SELECT ts, symbol, score, vol, (score / vol) / sum(abs(score / vol)) OVER (PARTITION BY ts) AS unit FROM s0 WHERE k <= greatest(1, floor(m * 0.25))),
  s2 AS (SELECT *, sqrt(greatest(0.75 * sum((unit*vol)*(unit*vol)) OVER x + 0.25 * sum(unit*vol) OVER x * sum(unit*vol) OVER x
      + 0.21 * 0.21 * sum(abs(unit*vol)) OVER x * sum(abs(unit*vol)) OVER x, 0)) * sqrt(252.0) AS annual,
    sum(greatest(unit, 0)) OVER x AS lsum, sum(greatest(-unit, 0)) OVER x AS ssum FROM s1 WINDOW x AS (PARTITION BY ts)),
  s3 AS (SELECT *, CASE WHEN annual > 0 THEN 0.35 / annual ELSE 1 END AS gross FROM s2),
  sized AS (SELECT ts, symbol, score, vol, gross, 0.0 AS net_target, CASE WHEN lsum > 0 AND ssum > 0 THEN
      CASE WHEN unit > 0 THEN unit * gross / (2 * lsum) ELSE unit * gross / (2 * ssum) END ELSE unit / (lsum + ssum) * gross END AS weight FROM s3)"""


def bars(spark, d):
    return T.daily_bars(spark, d)


def alpha(spark, d):
    return A.score_cross_section(bars(spark, d), CFG)


@query(
    "composite_score", "W19 W20 W21 W22 A29 P12 P13 F40 D5",
    f"WITH {ALPHA} SELECT {day('ts')} AS ts, symbol, round(score, 5) AS score, round(vol, 6) AS vol, round(dollar_volume, 3) AS dollar_volume FROM alpha",
)
def _(spark, d):
    return tidy(alpha(spark, d), score=5, dollar_volume=3)


@query(
    "composite_score_intraday", "W21 W22 A29 F40 P12",
    f"WITH {alpha_sql(INTRADAY, 'ibars', 39, 260, 130)} SELECT {stamp('ts')} AS ts, symbol, round(score, 5) AS score, round(vol, 6) AS vol, round(dollar_volume, 3) AS dollar_volume FROM alpha",
)
def _(spark, d):
    """The score at its default of 13 bars a day, on half-hour bars."""
    return tidy(A.score_cross_section(T.intraday_bars(spark, d), AlphaSettings()), score=5, dollar_volume=3)


@query(
    "price_level_zscore", "W8",
    f"""{with_(BARS)} SELECT symbol, {day('ts')} AS ts, round((x - ({full('avg(x)', 'x', 252)})) / (({full('stddev_samp(x)', 'x', 252)}) + 1e-12), 4) AS z
    FROM (SELECT symbol, ts, 1e6 + close / 1e4 AS x FROM bars)""",
)
def _(spark, d):
    """A small spread on a high level keeps its z-score at a wide window."""
    b = Blocks.lay(bars(spark, d).select("symbol", "ts", "close"), ["symbol"], ["ts"], lookback=252)
    return tidy(b.add(z=b.zscore(1e6 + F.col("close") / 1e4, 252)).close().select("symbol", "ts", "z"), z=4)


@query(
    "decision_breadth", "P13",
    f"WITH {ALPHA} SELECT {day('ts')} AS ts, count(*) AS n_names, round(sum(score), 4) AS total FROM alpha GROUP BY ts HAVING count(*) >= 20",
)
def _(spark, d):
    a = A.score_cross_section(bars(spark, d), CFG, min_breadth=20)
    return tidy(a.groupBy("ts").agg(F.count(F.lit(1)).alias("n_names"), F.sum("score").alias("total")), total=4)


@query(
    "target_weights", "C1 C2 C3 C4 O2 P14",
    f"WITH {SIZED} SELECT {day('ts')} AS ts, symbol, round(score, 5) AS score, round(vol, 6) AS vol, round(gross, 5) AS gross, round(net_target, 6) AS net_target, round(weight, 5) AS weight FROM sized",
)
def _(spark, d):
    return tidy(S.target_weights(alpha(spark, d), SIZE), score=5, gross=5, weight=5)


# Sixteen passes of clamp and rescale, each over a date's weights.
_CAPPED = SIZED.replace("0.35 / annual ELSE 1 END AS gross", "least(0.35 / annual, 1.5) ELSE 1 END AS gross") + """,
  it AS (SELECT ts, symbol, gross, 0 AS k, weight AS w, true AS open FROM sized WHERE gross > 0
    UNION ALL
    SELECT ts, symbol, gross, k + 1, CASE WHEN NOT open OR done THEN c WHEN c > 0 THEN c * up ELSE c * down END, open AND NOT done FROM (
      SELECT *, l + s <= 0 OR abs(l + s - gross) < 1e-9 AND abs(l - s) < 1e-9 AS done, CASE WHEN l > 0 AND s > 0 THEN gross / (2 * l) ELSE gross / (l + s) END AS up,
        CASE WHEN l > 0 AND s > 0 THEN gross / (2 * s) ELSE gross / (l + s) END AS down FROM (
        SELECT *, sum(greatest(c, 0)) OVER x AS l, sum(greatest(-c, 0)) OVER x AS s FROM (
          SELECT ts, symbol, gross, k, open, CASE WHEN open THEN greatest(-0.1, least(0.1, w)) ELSE w END AS c FROM it WHERE k < 16) WINDOW x AS (PARTITION BY ts))))"""


@query(
    "target_weights_capped", "C4",
    f"""WITH RECURSIVE {_CAPPED} SELECT {day('ts')} AS ts, symbol, round(score, 5) AS score, round(vol, 6) AS vol, round(it.gross, 5) AS gross, round(net_target, 6) AS net_target,
      round(greatest(-0.1, least(0.1, w)), 5) AS weight FROM it JOIN sized USING (ts, symbol) WHERE k = 16""",
)
def _(spark, d):
    cfg = SizingSettings(bars_per_year=252, min_dollar_volume=30_000.0, max_position_weight=0.1, max_gross=1.5, max_net_exposure=0.2)
    return tidy(S.target_weights(alpha(spark, d), cfg), score=5, gross=5, weight=5)


@query(
    "predicted_book_vol", "A38",
    f"""WITH {SIZED} SELECT {day('ts')} AS ts, round(sqrt(0.75 * sum(weight*vol*weight*vol) + 0.25 * sum(weight*vol) * sum(weight*vol)
      + 0.0441 * sum(abs(weight*vol)) * sum(abs(weight*vol))), 6) AS predicted_vol FROM sized GROUP BY ts""",
)
def _(spark, d):
    return tidy(S.book_vol(S.target_weights(alpha(spark, d), SIZE), SIZE))


_COMPANY = "co AS (SELECT 'Brand#' || CAST(g AS VARCHAR) AS symbol, sin(g) AS relative FROM (SELECT unnest(range(1, 26)) AS g))"


def signal_of(spark, d):
    """A company tone per symbol from the part table: one row per brand."""
    p = T.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    n = F.substring_index("symbol", "#", -1).cast("double")
    return p.select("symbol", F.sin(n).alias("relative"))


@query(
    "news_additive_tilt", "F25 F15",
    f"""WITH {ALPHA}, {_COMPANY}, t AS (SELECT a.ts, a.symbol, a.score, date_diff('day', date_trunc('month', a.ts), a.ts) AS age, coalesce(relative, 0) AS rel FROM alpha a LEFT JOIN co USING (symbol)),
    u AS (SELECT *, age < 10 AS live, CASE WHEN age < 10 THEN score + 0.35 * pow(0.5, age / 2.0) * rel ELSE score END AS tl FROM t)
    SELECT {day('ts')} AS ts, symbol, round(CASE WHEN live THEN tl - avg(tl) OVER (PARTITION BY ts) ELSE tl END, 5) AS score,
      round(CASE WHEN live THEN 0.2 * pow(0.5, age / 2.0) * 0.4 ELSE 0 END, 6) AS net_tilt FROM u""",
)
def _(spark, d):
    a = alpha(spark, d).join(signal_of(spark, d), "symbol", "left")
    a = a.withColumns({"macro": F.lit(0.4), "age_days": F.datediff("ts", F.trunc("ts", "month")).cast("double")})
    return tidy(A.apply_news(a, NewsSettings()).select("ts", "symbol", "score", "net_tilt"), score=5)


@query(
    "news_multiplicative_tilt", "F26 F24 F15 F2",
    f"""WITH {ALPHA}, {_COMPANY}, t AS (SELECT ts, symbol, greatest(-1, least(1, score / 2)) AS f,
        greatest(-1, least(1, coalesce(relative, 0) + 0.5 * 0.4)) AS news,
        pow(0.5, date_diff('day', date_trunc('month', ts), ts) / 2.0) AS decay FROM alpha LEFT JOIN co USING (symbol))
    SELECT {day('ts')} AS ts, symbol, round(news, 6) AS news, round(CASE WHEN f = 0 OR news = 0 THEN f ELSE
      greatest(-1, least(1, f * greatest(0, 1 + 0.3 * news * decay * sign(f)))) END, 5) AS conviction FROM t""",
)
def _(spark, d):
    a = alpha(spark, d).join(signal_of(spark, d), "symbol", "left")
    f = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score") / 2))
    news = A.combined_view(F.col("relative"), F.lit(0.4), 0.5)
    decay = A.signal_decay(F.datediff("ts", F.trunc("ts", "month")).cast("double"), 2.0, 100.0)
    return tidy(a.select("ts", "symbol", news.alias("news"), A.multiplicative_tilt(f, news, decay, 0.3).alias("conviction")), conviction=5)


# current weights: the target of the previous rebalance month end
_CUR = """cur AS (SELECT ts, symbol, weight FROM (SELECT CAST(ts + 1 AS DATE) AS ts, symbol, weight FROM sized) )"""


def current_weights(w):
    return w.select(F.date_add("ts", 1).alias("ts"), "symbol", "weight")


@query(
    "decision_classification", "J10 P21 F35 D10",
    f"""WITH {SIZED}, {_CUR}, al AS (SELECT coalesce(s.ts, c.ts) AS ts, coalesce(s.symbol, c.symbol) AS symbol, coalesce(s.weight, 0) AS target, coalesce(c.weight, 0) AS current
      FROM sized s FULL JOIN cur c ON s.ts = c.ts AND s.symbol = c.symbol)
    SELECT {day('ts')} AS ts, symbol, round(target, 5) AS target, round(current, 5) AS current,
      CASE WHEN current = 0 AND target = 0 THEN 'none' WHEN target = 0 THEN 'exit' WHEN current = 0 THEN 'entry' ELSE 'rebalance' END AS reason,
      CAST(coalesce(abs(target - current) / nullif(greatest(abs(target), abs(current)), 0) >= 0.25, false) AS BIGINT) AS trade FROM al""",
)
def _(spark, d):
    w = S.target_weights(alpha(spark, d), SIZE)
    return tidy(D.classify(D.align_targets(w, current_weights(w)), SIZE), target=5, current=5)


_BOOK = f"""{ALPHA}, bk AS (SELECT a.ts, a.symbol, greatest(-1, least(1, score / 3)) AS conviction, CASE WHEN day(a.ts) % 3 = 0 THEN CASE WHEN day(a.ts) % 2 = 0 THEN 10 ELSE -10 END ELSE 0 END AS quantity, day(a.ts) % 3 = 0 AS held, a.close AS price,
    b.high * 1.2 AS avg_price, a.vol AS daily_vol, day(a.ts) % 7 = 0 AS cooling, day(a.ts) = 28 AS is_flatten, day(a.ts) <= 25 AS entries_ok
  FROM alpha a JOIN bars b ON a.ts = b.ts AND a.symbol = b.symbol),
  acts AS (SELECT *, CASE WHEN held AND is_flatten THEN 'eod_flat' WHEN is_flatten THEN 'none'
     WHEN quantity > 0 AND price <= avg_price * (1 - 2.0 * daily_vol * sqrt(20.0)) THEN 'stop_loss'
     WHEN held AND abs(conviction) < 0.05 THEN 'exit' WHEN held THEN 'rebalance'
     WHEN entries_ok AND NOT cooling AND abs(conviction) >= 0.15 THEN 'entry' ELSE 'none' END AS action FROM bk)"""


def book(spark, d):
    b = bars(spark, d).select("ts", "symbol", F.col("close").alias("price"), (F.col("high") * 1.2).alias("avg_price"))
    dom = F.dayofmonth("ts")
    k = alpha(spark, d).join(b, ["ts", "symbol"]).withColumns({
        "conviction": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score") / 3)), "quantity": F.when(dom % 3 == 0, F.when(dom % 2 == 0, 10.0).otherwise(-10.0)).otherwise(0.0), "held": dom % 3 == 0,
        "daily_vol": F.col("vol"), "cooling": dom % 7 == 0, "is_flatten": dom == 28, "entries_ok": dom <= 25})
    return D.book_actions(k, BookSettings())


@query(
    "book_actions", "P20 P21 P22 F41",
    f"WITH {_BOOK} SELECT {day('ts')} AS ts, symbol, action, round(conviction * daily_vol, 6) AS expected_reward FROM acts",
)
def _(spark, d):
    b = book(spark, d)
    return tidy(b.select("ts", "symbol", "action", (F.col("conviction") * F.col("daily_vol")).alias("expected_reward")))


@query(
    "conviction_sizing", "C5 C6",
    f"""WITH {_BOOK}, st AS (SELECT symbol, ts FROM acts WHERE action = 'stop_loss'),
    rs AS (SELECT d.ts, count(DISTINCT st.symbol) AS recent FROM (SELECT DISTINCT ts FROM acts) d LEFT JOIN st ON st.ts <= d.ts AND d.ts - st.ts < 10 GROUP BY d.ts),
    g AS (SELECT ts, symbol, conviction, recent, count(*) FILTER (action = 'rebalance') OVER x AS n_open, action FROM acts JOIN rs USING (ts) WINDOW x AS (PARTITION BY ts)),
    h AS (SELECT *, CASE WHEN recent = 0 THEN 0.9 ELSE greatest(0.3, 0.9 * (1 - recent / greatest(recent + n_open, 1))) END AS cap FROM g WHERE action IN ('entry', 'rebalance')),
    t AS (SELECT *, conviction * 0.2 AS t FROM h)
    SELECT {day('ts')} AS ts, symbol, round(cap, 6) AS gross_cap, round(greatest(-0.2, least(0.2, t * CASE WHEN sum(abs(t)) OVER x > 0 THEN least(cap / sum(abs(t)) OVER x, 1) ELSE 1 END)), 6) AS target
    FROM t WINDOW x AS (PARTITION BY ts)""",
)
def _(spark, d):
    cfg = BookSettings()
    b = book(spark, d)
    held = b.groupBy("ts").agg(F.count_if(F.col("action") == "rebalance").alias("n_open"))
    stopped = D.recent_stops(b, b.filter("action = 'stop_loss'").select("symbol", "ts"), cfg)
    k = b.filter(F.col("action").isin("entry", "rebalance")).join(held, "ts").join(stopped, "ts")
    k = k.withColumn("gross_cap", S.gross_cap(F.col("recent"), F.col("n_open"), cfg))
    return tidy(S.conviction_targets(k, cfg).select("ts", "symbol", "gross_cap", "target"))


_DECIDED = """st AS (SELECT symbol, ts FROM acts WHERE action = 'stop_loss'),
    rs AS (SELECT d.ts, count(DISTINCT st.symbol) AS recent FROM (SELECT DISTINCT ts FROM acts) d LEFT JOIN st ON st.ts <= d.ts AND d.ts - st.ts < 10 GROUP BY d.ts),
    g AS (SELECT acts.*, recent, count(*) FILTER (action = 'rebalance') OVER x AS n_open, row_number() OVER (PARTITION BY ts, action ORDER BY abs(conviction) DESC, symbol) AS place FROM acts JOIN rs USING (ts) WINDOW x AS (PARTITION BY ts)),
    h AS (SELECT *, CASE WHEN recent = 0 THEN 0.9 ELSE greatest(0.3, 0.9 * (1 - recent / greatest(recent + n_open, 1))) END AS cap, conviction * 0.2 AS t0
      FROM g WHERE action = 'rebalance' OR action = 'entry' AND place <= greatest(12 - n_open, 0)),
    i AS (SELECT *, greatest(-0.2, least(0.2, t0 * CASE WHEN sum(abs(t0)) OVER x > 0 THEN least(cap / sum(abs(t0)) OVER x, 1) ELSE 1 END)) AS target, quantity * 0.004 AS cur FROM h WINDOW x AS (PARTITION BY ts)),
    decided AS (SELECT ts, symbol, action, conviction, daily_vol, target, CASE WHEN action = 'rebalance' AND abs(target - cur) < 0.25 * greatest(abs(target), abs(cur)) THEN 'hold'
        WHEN action = 'entry' AND (price <= 0 OR abs(target) * 50000.0 < price) THEN 'skip' WHEN action = 'entry' THEN 'buy' ELSE 'rebalance' END AS outcome FROM i
      UNION ALL SELECT ts, symbol, action, conviction, daily_vol, 0.0, 'sell' FROM acts WHERE action IN ('eod_flat', 'stop_loss', 'exit'))"""


def decided(spark, d):
    """Decisions of the test book with twelve places, 50,000 of equity and 0.4 % of it a share held."""
    cfg = BookSettings(max_positions=12)
    b = book(spark, d)
    held = b.groupBy("ts").agg(F.count_if(F.col("action") == "rebalance").alias("n_open"))
    stopped = D.recent_stops(b, b.filter("action = 'stop_loss'").select("symbol", "ts"), cfg)
    k = b.drop("action").join(held, "ts").join(stopped, "ts").withColumns({
        "gross_cap": S.gross_cap(F.col("recent"), F.col("n_open"), cfg), "current": F.col("quantity") * 0.004, "equity": F.lit(50_000.0)})
    return D.decide(k, cfg)


@query(
    "decision_ladder", "P21 C5 F41",
    f"WITH {_BOOK}, {_DECIDED} SELECT {day('ts')} AS ts, symbol, action, outcome, round(target, 6) AS target, round(conviction * daily_vol, 6) AS expected_reward FROM decided",
)
def _(spark, d):
    return tidy(decided(spark, d).select("ts", "symbol", "action", "outcome", "target", "expected_reward"))


@query(
    "decision_log", "S14",
    f"""WITH {_BOOK}, {_DECIDED} SELECT {day('b.ts')} AS ts, b.symbol, round(b.close, 6) AS close, coalesce(action, 'none') AS action, coalesce(outcome, 'none') AS outcome, round(target, 6) AS target,
      round(conviction, 5) AS conviction FROM bars b LEFT JOIN decided d ON b.ts = d.ts AND b.symbol = d.symbol""",
)
def _(spark, d):
    return tidy(R.decision_log(bars(spark, d), decided(spark, d)), conviction=5)


@query(
    "entry_slots", "O3",
    f"""WITH {_BOOK} SELECT {day('ts')} AS ts, symbol, round(conviction, 5) AS conviction FROM (
      SELECT *, row_number() OVER (PARTITION BY ts ORDER BY abs(conviction) DESC, symbol) AS k FROM acts WHERE action = 'entry') WHERE k <= 5""",
)
def _(spark, d):
    b = book(spark, d).filter("action = 'entry'")
    return tidy(D.top_entries(b, slots=F.lit(5)).select("ts", "symbol", "conviction"), conviction=5)


_ORD = f"""{_BOOK}, o AS (SELECT ts, symbol, conviction, price, conviction * 0.2 AS target, CASE WHEN held THEN 0.05 ELSE 0 END AS current,
    CASE WHEN action = 'entry' THEN 'entry' ELSE 'rebalance' END AS reason, 20000.0 AS equity FROM acts WHERE action IN ('entry', 'rebalance'))"""


def orders(spark, d):
    b = book(spark, d).filter(F.col("action").isin("entry", "rebalance"))
    return b.select("ts", "symbol", "conviction", "price", (F.col("conviction") * 0.2).alias("target"),
                    F.when(F.col("held"), 0.05).otherwise(0.0).alias("current"),
                    F.when(F.col("action") == "entry", "entry").otherwise("rebalance").alias("reason"), F.lit(20000.0).alias("equity"))


@query(
    "unfillable_entries", "P23",
    f"WITH {_ORD} SELECT {day('ts')} AS ts, symbol, reason FROM o WHERE NOT (reason = 'entry' AND (price <= 0 OR abs(target) * equity < price))",
)
def _(spark, d):
    return tidy(D.fillable(orders(spark, d)).select("ts", "symbol", "reason"))


@query(
    "execution_order", "O7",
    f"""WITH {_ORD} SELECT {day('ts')} AS ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY CASE WHEN target < current THEN 0 ELSE 1 END,
      CASE WHEN target < current THEN 0 ELSE -abs(conviction) END, symbol) AS seq FROM o""",
)
def _(spark, d):
    return tidy(D.execution_order(orders(spark, d)).select("ts", "symbol", "seq"))


@query(
    "share_deltas", "F34",
    f"""WITH {_ORD}, q AS (SELECT *, CASE WHEN current <> 0 THEN 3 ELSE 0 END AS heldq FROM o),
    r AS (SELECT ts, symbol, CASE WHEN abs(target) < 1e-9 THEN -heldq ELSE sign(target) * floor(abs(target) * equity / price) - heldq END AS delta FROM q)
    SELECT {day('ts')} AS ts, symbol, round(CASE WHEN abs(delta) >= 1 THEN delta ELSE 0 END, 6) AS delta FROM r""",
)
def _(spark, d):
    o = orders(spark, d)
    held = F.when(F.col("current") != 0, 3.0).otherwise(0.0)
    return tidy(o.select("ts", "symbol", D.share_delta(F.col("target"), F.col("equity"), F.col("price"), held).alias("delta")))


STOPS = "stops AS (SELECT symbol, ts FROM bars WHERE close < open * 0.1)"


def stops(spark, d):
    return bars(spark, d).filter(F.col("close") < F.col("open") * 0.1).select("symbol", "ts")


@query(
    "stop_cooldown", "P17 ST8",
    f"""{with_(BARS, STOPS)} SELECT b.symbol, {day('b.ts')} AS ts, CAST(coalesce(b.ts - s.ts < 10, false) AS BIGINT) AS cooling
    FROM bars b ASOF LEFT JOIN stops s ON b.symbol = s.symbol AND b.ts >= s.ts""",
)
def _(spark, d):
    c = D.cooldown(bars(spark, d).select("symbol", "ts"), stops(spark, d), BookSettings())
    return tidy(c.select("symbol", "ts", "cooling"))


@query(
    "recent_stop_count", "C6 P17",
    f"""{with_(BARS, STOPS)}, cal AS (SELECT DISTINCT ts FROM bars), l AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM (SELECT DISTINCT symbol, ts FROM stops))
    SELECT {day('c.ts')} AS ts, count(l.symbol) AS recent FROM cal c LEFT JOIN l ON l.ts <= c.ts AND c.ts - l.ts < 10 AND (l.nxt IS NULL OR l.nxt > c.ts) GROUP BY c.ts""",
)
def _(spark, d):
    return tidy(D.recent_stops(bars(spark, d), stops(spark, d), BookSettings()))


# Orders on stop days, each with the first later bar and the first processed day over five days after it.
ORDER_STATES = f"""cal AS (SELECT DISTINCT ts FROM bars), nx AS (SELECT symbol, ts, lead(ts) OVER w AS fill_ts, lead(open) OVER w AS fill_price FROM bars {W}),
    od AS (SELECT s.symbol, s.ts, c.ts AS deadline FROM stops s ASOF LEFT JOIN cal c ON s.ts + 5 < c.ts),
    states AS (SELECT symbol, ts, fill_ts, fill_price, CASE WHEN fill_ts <= coalesce(deadline, fill_ts) THEN 'filled'
      WHEN deadline IS NOT NULL THEN 'cancelled' ELSE 'pending' END AS state FROM od JOIN nx USING (symbol, ts))"""


@query(
    "decision_to_fill", "J9 ST7",
    f"{with_(BARS, STOPS, ORDER_STATES)} SELECT symbol, {day('ts')} AS ts, {day('fill_ts')} AS fill_ts, round(fill_price, 6) AS fill_price, state FROM states",
)
def _(spark, d):
    b = bars(spark, d)
    f = D.next_bar_fill(stops(spark, d), b)
    return tidy(D.expire(f, BookSettings(), calendar=b).select("symbol", "ts", "fill_ts", "fill_price", "state"))


@query(
    "pending_superseded", "J7 U6",
    f"""{with_(BARS, STOPS)}, p AS (SELECT symbol || '/' || strftime(ts, '%Y-%m') AS symbol, ts FROM stops WHERE day(ts) <= 15), f AS (SELECT symbol || '/' || strftime(ts, '%Y-%m') AS symbol, ts FROM stops WHERE day(ts) > 15)
    SELECT symbol, {day('ts')} AS ts FROM f UNION ALL SELECT symbol, {day('ts')} FROM p WHERE symbol NOT IN (SELECT symbol FROM f)""",
)
def _(spark, d):
    s = stops(spark, d)
    # A book a month: what it decides in the second half replaces its pending orders.
    s = s.select(F.concat("symbol", F.lit("/"), F.date_format("ts", "yyyy-MM")).alias("symbol"), "ts")
    return tidy(D.supersede(s.filter(F.dayofmonth("ts") <= 15), s.filter(F.dayofmonth("ts") > 15)))


@query(
    "decision_outcomes", "J15",
    f"""{with_(BARS, STOPS)}, nx AS (SELECT symbol, ts, lead(close) OVER w / close - 1 AS r FROM bars {W})
    SELECT s.symbol, {day('s.ts')} AS ts, round(coalesce(CASE WHEN s.symbol <> 'Brand#5' THEN r END, -9.0), 6) AS result FROM stops s LEFT JOIN nx USING (symbol, ts)""",
)
def _(spark, d):
    b = Blocks.lay(bars(spark, d).select("symbol", "ts", "close"), ["symbol"], ["ts"], lookback=0, lookahead=1)
    r = b.add(result=b.lead(F.col("close"), 1) / F.col("close") - 1).close().filter("symbol <> 'Brand#5' AND result IS NOT NULL")
    dec = stops(spark, d).withColumn("result", F.lit(-9.0))
    return tidy(D.backfill_results(dec, r).select("symbol", "ts", "result"))


@query(
    "range_touch", "P19",
    f"""{with_(BARS)}, e AS (SELECT symbol, ts, high, low, lag(close) OVER w AS entry, day(ts) % 2 = 0 AS lng FROM bars {W})
    SELECT symbol, {day('ts')} AS ts, CASE WHEN lng THEN CASE WHEN low <= entry * 0.92 THEN 'stop_loss' WHEN high >= entry * 1.5 THEN 'take_profit' END
      ELSE CASE WHEN high >= entry * 1.08 THEN 'stop_loss' WHEN low <= entry * 0.5 THEN 'take_profit' END END AS touched FROM e""",
)
def _(spark, d):
    b = Blocks.lay(bars(spark, d), ["symbol"], ["ts"], lookback=1)
    x = b.add(entry=b.lag(F.col("close"), 1)).close()
    t = D.range_touch(F.col("entry"), F.dayofmonth("ts") % 2 == 0, stop_pct=0.08, take_pct=0.5)
    return tidy(x.select("symbol", "ts", t.alias("touched")))


@query(
    "vol_targeted_weight", "F36 F35",
    f"""WITH {ALPHA}, v AS (SELECT ts, symbol, greatest(-1, least(1, score)) AS t, vol * sqrt(252.0) AS s FROM alpha),
    w AS (SELECT *, CASE WHEN s > 1e-6 THEN greatest(-1, least(1, t * least(0.15 / s, 2.0) * 0.5)) ELSE t END AS wt FROM v)
    SELECT {day('ts')} AS ts, symbol, round(wt, 6) AS weight, CAST(abs(wt - 0.01) >= 0.005 AS BIGINT) AS trade FROM w""",
)
def _(spark, d):
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))
    w = S.vol_targeted(t, F.col("vol") * 252**0.5, vol_target=0.15, cap=2.0, kelly=0.5)
    x = alpha(spark, d).select("ts", "symbol", w.alias("weight"))
    return tidy(x.withColumn("trade", S.rebalance_needed_absolute(F.col("weight"), F.lit(0.01), 0.005)))


@query(
    "signal_as_of_bar", "J8 F15",
    f"""{with_(BARS)}, sg AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 10 HOUR AS as_of, CAST(month(o_orderdate) AS DOUBLE) AS macro FROM orders),
    b AS (SELECT symbol, ts, CAST(ts AS TIMESTAMP) + INTERVAL 16 HOUR AS close_at FROM bars),
    j AS (SELECT b.symbol, b.ts, sg.macro, (epoch_us(close_at) - epoch_us(as_of)) / 86400000000.0 AS age FROM b ASOF LEFT JOIN sg ON b.close_at >= sg.as_of)
    SELECT symbol, {day('ts')} AS ts, round(macro, 6) AS macro, round(age, 6) AS age_days,
      round(CASE WHEN age IS NULL OR age < 0 OR age > 10 THEN 0 ELSE pow(0.5, age / 2.0) END, 6) AS decay FROM j""",
)
def _(spark, d):
    from tickloom.functions.columns import age_days

    o = T.table(spark, d, "orders")
    at = (F.date_trunc("month", F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL 10 HOURS")).alias("as_of")
    sig = o.select(at, F.month("o_orderdate").cast("double").alias("macro")).distinct()
    b = bars(spark, d).select("symbol", "ts", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 16 HOURS")).alias("close_at"))
    # The signal is per instant, not per symbol: join the distinct instants.
    inst = asof_backward(b.select("close_at").distinct(), sig, keys=[], left_ts="close_at", right_ts="as_of", values=["macro"])
    j = b.join(inst, "close_at").withColumn("age_days", age_days(F.col("close_at"), F.col("as_of")))
    return tidy(j.select("symbol", "ts", "macro", "age_days", A.signal_decay(F.col("age_days"), 2.0, 10.0).alias("decay")))
