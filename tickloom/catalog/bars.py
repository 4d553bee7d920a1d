"""Bar scans, quality rules, adjustment, timing filters, calendar."""

from pyspark.sql import functions as F

from tickloom.catalog.base import query, tidy
from tickloom.catalog.sqlbits import BARS, INTRADAY, day, stamp, with_
from tickloom.operators import quality as Q
from tickloom.sources import bars as B
from tickloom.sources import tables as T

BAR_OUT = "symbol, strftime(ts, '%Y-%m-%d') AS ts, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(adj_close,6) AS adj_close, volume"


@query("daily_bars", "D1 O1", f"{with_(BARS)} SELECT {BAR_OUT} FROM bars")
def _(spark, d):
    return tidy(T.daily_bars(spark, d))


@query(
    "intraday_bars", "D2",
    f"{with_(INTRADAY)} SELECT symbol, {stamp('ts')} AS ts, round(open,6) AS open, round(high,6) AS high, "
    "round(low,6) AS low, round(close,6) AS close, volume FROM ibars",
)
def _(spark, d):
    return tidy(T.intraday_bars(spark, d))


@query(
    "normalize_bars", "S1 U3 O1",
    f"""WITH raw AS (
      SELECT p_brand AS symbol, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS ts,
             CASE WHEN l_orderkey % 89 = 0 THEN 'bad' ELSE CAST(l_quantity AS VARCHAR) END AS volume,
             l_extendedprice / l_quantity AS px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
      FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT symbol, {day('ts')} AS ts, round(arg_max(px, k), 6) AS open, round(arg_max(px, k), 6) AS high,
      round(arg_max(px, k), 6) AS low, round(arg_max(px, k), 6) AS close, round(arg_max(px, k), 6) AS adj_close,
      CAST(nullif(arg_max(volume, k), 'bad') AS DOUBLE) AS volume
    FROM raw WHERE ts IS NOT NULL GROUP BY symbol, ts""",
)
def _(spark, d):
    t = T.ticks(spark, d)
    ts = F.when(F.col("l_orderkey") % 97 == 0, F.lit(None)).otherwise(F.col("ts").cast("string"))
    vol = F.when(F.col("l_orderkey") % 89 == 0, F.lit("bad")).otherwise(F.col("size").cast("string"))
    raw = t.select(
        "symbol", ts.alias("ts"), *[F.col("price").alias(c) for c in B.PRICE_COLUMNS], vol.alias("volume"),
        F.col("place").alias("seq"),
    )
    return tidy(B.normalize(raw, seq="seq"))


_FLAGS = """flags AS (
  SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM dirty)"""
_DIRTY = f"""dirty AS (
  SELECT symbol, ts, open, high, CASE WHEN day(ts) = 3 THEN high + 1 ELSE low END AS low, close,
         CASE WHEN day(ts) = 5 THEN -adj_close ELSE adj_close END AS adj_close,
         CASE WHEN day(ts) = 7 THEN -volume ELSE volume END AS volume FROM bars)"""


def dirty(spark, d, symbol="p_brand"):
    b = T.daily_bars(spark, d, symbol)
    dom = F.dayofmonth("ts")
    return b.withColumns({
        "low": F.when(dom == 3, F.col("high") + 1).otherwise(F.col("low")),
        "adj_close": F.when(dom == 5, -F.col("adj_close")).otherwise(F.col("adj_close")),
        "volume": F.when(dom == 7, -F.col("volume")).otherwise(F.col("volume")),
    })


_RULES = """
      SELECT {k} 'non_positive_open' AS rule, count(*) FILTER (open <= 0) AS n_bad FROM flags {g}
      UNION ALL SELECT {k} 'non_positive_high', count(*) FILTER (high <= 0) FROM flags {g}
      UNION ALL SELECT {k} 'non_positive_low', count(*) FILTER (low <= 0) FROM flags {g}
      UNION ALL SELECT {k} 'non_positive_close', count(*) FILTER (close <= 0) FROM flags {g}
      UNION ALL SELECT {k} 'non_positive_adj_close', count(*) FILTER (adj_close <= 0) FROM flags {g}
      UNION ALL SELECT {k} 'negative_volume', count(*) FILTER (volume < 0) FROM flags {g}
      UNION ALL SELECT {k} 'ohlc_order', count(*) FILTER (high < low OR high < open OR high < close OR low > open OR low > close) FROM flags {g}
      UNION ALL SELECT {k} 'duplicate_key', count(*) - count(DISTINCT (symbol, ts)) FROM flags {g}
      UNION ALL SELECT {k} 'jump', count(*) FILTER (abs(ret) > 0.75) FROM flags {g}"""


@query("quality_report", "P1", with_(BARS, _DIRTY, _FLAGS) + _RULES.format(k="", g=""))
def _(spark, d):
    return tidy(Q.quality_report(dirty(spark, d)))


@query(
    "quality_jump_samples", "P1 O8",
    with_(BARS, _DIRTY, _FLAGS)
    + f" SELECT symbol, {day('ts')} AS ts, round(ret, 6) AS ret FROM flags WHERE abs(ret) > 0.75 ORDER BY symbol, flags.ts LIMIT 3",
)
def _(spark, d):
    return tidy(Q.jump_samples(dirty(spark, d)))


@query(
    "quality_quarantine", "P2",
    with_(BARS, f"""flags AS (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars)""",
          "bad AS (SELECT symbol FROM flags WHERE abs(ret) > 500 OR high < low OR least(open, high, low, close, adj_close) <= 0 OR volume < 0 OR high < greatest(open, close) OR low > least(open, close))")
    + " SELECT b.symbol, CAST(b.symbol IN (SELECT symbol FROM bad) AS BIGINT) AS bad, count(*) AS n_bars FROM bars b GROUP BY 1, 2",
)
def _(spark, d):
    b = T.daily_bars(spark, d)
    good, held = Q.quarantine(b, max_abs_return=500.0)
    out = good.withColumn("bad", F.lit(0)).unionByName(held.withColumn("bad", F.lit(1)))
    return tidy(out.groupBy("symbol", "bad").agg(F.count(F.lit(1)).alias("n_bars")))


@query(
    "adjusted_bars", "P3",
    f"""{with_(BARS)} SELECT symbol, {day('ts')} AS ts, round(open*adj_close/close, 6) AS open,
      round(high*adj_close/close, 6) AS high, round(low*adj_close/close, 6) AS low, round(adj_close, 6) AS close,
      round(adj_close, 6) AS adj_close, round(volume/(adj_close/close), 4) AS volume FROM bars""",
)
def _(spark, d):
    return tidy(B.adjust(T.daily_bars(spark, d)), volume=4)


@query(
    "bars_in_range", "P4 S6",
    f"{with_(BARS)} SELECT {BAR_OUT} FROM bars WHERE ts BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' "
    "AND symbol IN ('Brand#3', 'Brand#7')",
)
def _(spark, d):
    b = T.daily_bars(spark, d).filter(F.col("symbol").isin("Brand#3", "Brand#7"))
    return tidy(B.in_range(b, "1997-03-01", "1997-06-30 12:00:00"[:10]))


@query(
    "completed_bars", "P5 ST2",
    f"""{with_(INTRADAY)}
    SELECT '30m' AS interval, symbol, count(*) AS n_bars, {stamp('max(ts)')} AS last_bar FROM ibars
      WHERE ts + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-17 15:45:00' GROUP BY symbol
    UNION ALL
    SELECT '60m', symbol, count(*), {stamp('max(ts)')} FROM ibars
      WHERE ts + CASE WHEN strftime(ts, '%H:%M') = '15:30' THEN INTERVAL 30 MINUTE ELSE INTERVAL 60 MINUTE END
            <= TIMESTAMP '2024-01-17 16:00:00' GROUP BY symbol""",
)
def _(spark, d):
    b = T.intraday_bars(spark, d)
    out = None
    for iv, cut in (("30m", "2024-01-17 15:45:00"), ("60m", "2024-01-17 16:00:00")):
        c = Q.completed(b, as_of=F.lit(cut).cast("timestamp_ntz"), interval=iv)
        c = c.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.max("ts").alias("last_bar"))
        c = c.withColumn("interval", F.lit(iv))
        out = c if out is None else out.unionByName(c)
    return tidy(out)


@query(
    "latest_completed_day", "P6 F13",
    f"""SELECT o_orderkey, {day("CASE WHEN strftime(loc, '%H:%M') >= '16:15' THEN CAST(loc AS DATE) ELSE CAST(loc AS DATE) - 1 END")} AS latest
    FROM (SELECT o_orderkey, timezone('America/New_York', timezone('UTC', o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)))) AS loc FROM orders)""",
)
def _(spark, d):
    o = T.table(spark, d, "orders")
    now = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1440 * 60)
    return tidy(o.select("o_orderkey", Q.latest_completed(now).alias("latest")))


@query(
    "bar_close_utc", "P7 F13",
    f"""SELECT o_orderkey, {stamp("timezone('UTC', timezone('America/New_York', lbl)) + INTERVAL 30 MINUTE")} AS close_utc
    FROM (SELECT o_orderkey, o_orderdate + to_minutes(570 + 30 * CAST(o_orderkey % 13 AS BIGINT)) AS lbl FROM orders)""",
)
def _(spark, d):
    o = T.table(spark, d, "orders")
    lbl = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (570 + 30 * (F.col("o_orderkey") % 13)).cast("int"), F.lit(0))
    return tidy(o.select("o_orderkey", Q.close_utc(lbl, 30).alias("close_utc")))


@query(
    "new_bar_grid", "P8 ST1",
    f"""{with_(INTRADAY)} SELECT {stamp('ts')} AS ts, count(*) AS n_symbols FROM ibars
    WHERE ts > TIMESTAMP '2024-01-20 10:00:00' AND ts >= TIMESTAMP '2024-01-21 00:00:00' GROUP BY ts""",
)
def _(spark, d):
    b = Q.new_bars(T.intraday_bars(spark, d), watermark=F.lit("2024-01-20 10:00:00").cast("timestamp_ntz"),
                   floor=F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    return tidy(b.groupBy("ts").agg(F.count(F.lit(1)).alias("n_symbols")))


@query(
    "replay_slice", "P9 J6",
    f"""{with_(INTRADAY)}, cal AS (SELECT DISTINCT ts FROM ibars WHERE ts <= TIMESTAMP '2024-01-20 10:00:00' ORDER BY ts DESC LIMIT 26)
    SELECT symbol, {stamp('ts')} AS ts, round(close, 6) AS close FROM ibars
    WHERE ts > TIMESTAMP '2024-01-20 10:00:00' OR ts >= (SELECT min(ts) FROM cal)""",
)
def _(spark, d):
    b = Q.replay_slice(T.intraday_bars(spark, d), watermark=F.lit("2024-01-20 10:00:00").cast("timestamp_ntz"), warmup=26)
    return tidy(b.select("symbol", "ts", "close"))


@query(
    "drop_warmup", "P10",
    f"""{with_(BARS)} SELECT symbol, {day('ts')} AS ts, round(close, 6) AS close FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
    WHERE rn > 300 OR n <= 300""",
)
def _(spark, d):
    return tidy(Q.drop_warmup(T.daily_bars(spark, d).select("symbol", "ts", "close"), 300))


@query(
    "universe_screen", "P15 A29",
    f"""{with_(BARS)} SELECT symbol, round(median(close * volume), 4) AS median_dollar, round(arg_max(close, ts), 6) AS last_price
    FROM bars GROUP BY symbol HAVING median(close * volume) >= 30000 AND arg_max(close, ts) >= 900""",
)
def _(spark, d):
    return tidy(Q.liquid_symbols(T.daily_bars(spark, d), min_median=30000, min_price=900), median_dollar=4)


@query(
    "session_landmarks", "P16 P22",
    f"""{with_(INTRADAY)}, t AS (SELECT DISTINCT strftime(ts, '%H:%M') AS m FROM ibars ORDER BY m DESC LIMIT 2),
    lm AS (SELECT min(m) AS f FROM t)
    SELECT symbol, count(*) FILTER (strftime(ts, '%H:%M') = f) AS n_flatten,
           count(*) FILTER (strftime(ts, '%H:%M') < f) AS n_entry_bars FROM ibars, lm GROUP BY symbol""",
)
def _(spark, d):
    b = Q.entries_allowed(T.intraday_bars(spark, d))
    return tidy(b.groupBy("symbol").agg(F.count_if("is_flatten").alias("n_flatten"), F.count_if("entries_ok").alias("n_entry_bars")))


@query(
    "date_split", "P25",
    f"""{with_(BARS)} SELECT CASE WHEN ts < DATE '1998-01-01' THEN 'in' ELSE 'out' END AS part, symbol, count(*) AS n_bars
    FROM bars GROUP BY 1, 2""",
)
def _(spark, d):
    a, b = Q.date_split(T.daily_bars(spark, d), "1998-01-01")
    u = a.withColumn("part", F.lit("in")).unionByName(b.withColumn("part", F.lit("out")))
    return tidy(u.groupBy("part", "symbol").agg(F.count(F.lit(1)).alias("n_bars")))


@query(
    "coverage", "A41",
    f"{with_(BARS)} SELECT symbol, count(*) AS bars, {day('min(ts)')} AS first, {day('max(ts)')} AS last FROM bars GROUP BY symbol",
)
def _(spark, d):
    return tidy(B.coverage(T.daily_bars(spark, d)))


@query("trading_calendar", "A42 U4", f"{with_(BARS)} SELECT DISTINCT {day('ts')} AS ts FROM bars")
def _(spark, d):
    return tidy(B.trading_calendar(T.daily_bars(spark, d)))


@query(
    "incremental_start", "A49 ST13",
    f"""{with_(BARS)}, l AS (SELECT symbol, max(ts) AS last FROM bars GROUP BY symbol)
    SELECT {day('min(last)')} AS stalest, {day("greatest(DATE '1995-01-01', min(last) - 5)")} AS start FROM l""",
)
def _(spark, d):
    return tidy(B.incremental_start(T.daily_bars(spark, d), data_start="1995-01-01", overlap_days=5))


@query(
    "latest_quotes", "W36",
    f"""{with_(BARS)}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars)
    SELECT symbol, {day('max(ts)')} AS ts, round(max(close) FILTER (rn = 1), 6) AS price,
      round(max(close) FILTER (rn = 2), 6) AS prev_close,
      round((max(close) FILTER (rn = 1) / max(close) FILTER (rn = 2) - 1) * 100, 6) AS day_change_pct
    FROM r WHERE rn <= 2 GROUP BY symbol""",
)
def _(spark, d):
    return tidy(Q.latest_two(T.daily_bars(spark, d)))


@query(
    "wide_to_long", "S4",
    f"""{with_(BARS)} SELECT symbol, {day('ts')} AS ts, round(close, 6) AS close, volume FROM bars""",
)
def _(spark, d):
    # A wide frame has a column a symbol, so its symbols are few.
    syms = sorted(r[0] for r in T.table(spark, d, "part").select("p_brand").distinct().collect())
    b = T.daily_bars(spark, d)
    wide = b.groupBy("ts").agg(
        *[F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{c.title()}|{s}") for s in syms for c in ("close", "volume")]
    )
    return tidy(B.wide_to_long(wide))
