"""Streams over the tables, each against the SQL of its batch form, and the versioned store."""

from pyspark.sql import functions as F

from tickloom.catalog.base import query, tidy
from tickloom.catalog.news import CFG, DEDUPED, LEX, articles, polarity_sql
from tickloom.catalog.sqlbits import BARS, BENCH, INTRADAY, day, stamp, with_
from tickloom.catalog.trading import ORDER_STATES, STOPS, bars, stops
from tickloom.functions import text as X
from tickloom.operators import decisions as D
from tickloom.operators import news as N
from tickloom.operators import quality as Q
from tickloom.session import fresh
from tickloom.settings import BookSettings
from tickloom.sources import bars as B
from tickloom.sources import runs as R
from tickloom.sources import tables as T
from tickloom.sources import versions as V
from tickloom.streaming import jobs as J
from tickloom.streaming import keepers as K

LONG_AGO = "3650 days"


def heartbeat(df, days):
    """One row of a symbol of its own ``days`` after the last: it moves the watermark past all others."""
    end = df.agg(F.date_add(F.max(F.to_date("ts")), days).alias("ts")).select(F.lit("~").alias("symbol"), F.col("ts").cast(df.schema["ts"].dataType).alias("ts"))
    return df.unionByName(end, allowMissingColumns=True)


@query(
    "order_life_cycle", "ST7 ST12",
    f"{with_(BARS, STOPS, ORDER_STATES)} SELECT symbol, {day('ts')} AS ts, state, {day('fill_ts')} AS fill_ts, round(fill_price, 6) AS fill_price FROM states WHERE state = 'filled'"
    f" UNION ALL SELECT symbol, {day('ts')}, state, NULL, NULL FROM states WHERE state = 'cancelled'",
)
def _(spark, d):
    """Orders and bars as two streams; orders still pending at the end stay in state."""
    root, b = fresh(spark, "orders"), bars(spark, d)
    tape = J.replayed(heartbeat(b, 4000), root + "/bars")
    orders = J.replayed(D.with_deadline(stops(spark, d), b, BookSettings()).withColumn("id", F.col("ts").cast("string")), root + "/orders")
    out = J.drained(K.order_states(orders, tape, lateness=LONG_AGO), root)
    return tidy(out.select("symbol", "ts", "state", "fill_ts", "fill_price").withColumns({c: F.to_date(c) for c in ("ts", "fill_ts")}))


@query(
    "stop_lockout_stream", "ST8",
    f"""{with_(BARS, STOPS)} SELECT b.symbol, {day('b.ts')} AS ts, CAST(coalesce(b.ts - s.ts < 10, false) AS BIGINT) AS cooling
    FROM bars b ASOF LEFT JOIN stops s ON b.symbol = s.symbol AND b.ts >= s.ts""",
)
def _(spark, d):
    root = fresh(spark, "lockout")
    ask = J.replayed(heartbeat(bars(spark, d).select("symbol", "ts"), 4000).withColumn("id", F.lit("")), root + "/rows")
    hit = J.replayed(stops(spark, d), root + "/stops")
    out = J.drained(K.lockouts(ask, hit, BookSettings(), lateness=LONG_AGO), root)
    return tidy(out.select("symbol", F.to_date("ts").alias("ts"), "cooling"))


@query(
    "rolling_signal_stream", "ST3 ST9 ST11",
    f"""WITH {DEDUPED}, {polarity_sql('dd')}, g AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', (SELECT max(ts) + INTERVAL 16 DAY FROM dd), INTERVAL 1 DAY)) AS TIMESTAMP) AS as_of),
    x AS (SELECT as_of, symbols, polarity, matched, (epoch_us(as_of) - epoch_us(ts)) / 86400000000.0 AS age FROM pol JOIN g ON ts < as_of AND ts >= as_of - INTERVAL 14 DAY WHERE matched > 0),
    y AS (SELECT as_of, unnest(symbols) AS symbol, polarity, pow(0.5, age / 2.0) * least(matched, 6) / 6.0 AS w FROM x WHERE age <= 14),
    z AS (SELECT as_of, symbol, greatest(-1, least(1, sum(w * polarity) / sum(w) * (count(*) / (count(*) + 3.0)))) AS score, count(*) AS articles FROM y GROUP BY 1, 2 HAVING sum(w) > 0)
    SELECT {stamp('as_of')} AS as_of, symbol, articles, round(score, 6) AS score, round(greatest(-1, least(1, score - avg(score) OVER (PARTITION BY as_of))), 6) AS relative FROM z""",
)
def _(spark, d):
    """Articles are scored in the stream; a signal for every day of every look-back."""
    root = fresh(spark, "signal")
    a = N.dedupe(articles(spark, d))
    # Copies may be later than their story, which only takes the watermark further and reads no text.
    last = articles(spark, d).agg((F.max("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"))
    # The last row's first word is in the lexicon, so it passes the filter and moves the watermark.
    beat = last.select("ts", F.lit("~").alias("uid"), F.lit("and").alias("title"), F.lit("").alias("summary"), F.array(F.lit("~")).alias("symbols"))
    stream = J.replayed(a.unionByName(beat, allowMissingColumns=True), root + "/articles")
    scored = X.score_articles(stream, LEX)
    out = J.drained(K.rolling_signal(scored, start="2024-01-01", cfg=CFG, lateness=LONG_AGO), root)
    return tidy(K.complete_signal(out, CFG).select("as_of", "symbol", "score", "relative", "articles"))


@query(
    "exactly_once_runs", "ST1 ST13",
    f"""{with_(BARS)} SELECT symbol, count(*) AS n_bars, count(*) AS n_keys, round(sum(close), 4) AS close_sum, {day('max(ts)')} AS done FROM bars GROUP BY symbol""",
)
def _(spark, d):
    """Three runs up to given days; one dies before its commit, one is repeated."""
    root, b = fresh(spark, "runs"), bars(spark, d)
    each = lambda x: x.select("symbol", "ts", "close")
    up_to = lambda s: F.lit(s).cast("date")
    R.process(spark, root, "closes", b, each, up_to("1994-06-30"))
    R.prepare(spark, root, "closes", b, each, up_to("1996-06-30"))  # dies here
    for _ in range(2):
        R.process(spark, root, "closes", b, each, up_to("1997-03-15"))
    R.process(spark, root, "closes", b, each)
    out = R.outputs(spark, root, "closes", "symbol STRING, ts DATE, close DOUBLE")
    per = out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.count_distinct("ts").alias("n_keys"), F.sum("close").alias("close_sum"))
    return tidy(per.join(R.marks(spark, root, "closes"), "symbol"), close_sum=4)


@query(
    "incremental_start_of_job", "ST13 A49",
    f"{with_(INTRADAY)}, m AS (SELECT symbol, max(ts) AS last FROM ibars GROUP BY symbol) SELECT {day('min(last)')} AS stalest, {day('greatest(DATE ' + chr(39) + '2020-01-01' + chr(39) + ', CAST(min(last) AS DATE) - 3)')} AS start FROM m",
)
def _(spark, d):
    root, b = fresh(spark, "runs"), T.intraday_bars(spark, d)
    R.process(spark, root, "intraday", b, lambda x: x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))
    return tidy(R.next_start(spark, root, "intraday", data_start="2020-01-01", overlap_days=3))


# Bars that the quality rules let pass: every brand trades at the market's mean price of the day on a high base, at a scale of its own.
CALM = f"""{BENCH}, calm AS (SELECT p_brand AS symbol, b.ts, b.c * k AS open, b.c * k * 1.01 AS high, b.c * k * 0.99 AS low, b.c * k AS close, b.c * k AS adj_close, 100.0 AS volume
    FROM (SELECT ts, 2000 + close AS c FROM bench) b, (SELECT DISTINCT p_brand, 1 + CAST(substr(p_brand, 7) AS INT) / 100.0 AS k FROM part))"""


def calm(spark, d):
    brands = T.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("k", 1 + F.substring("symbol", 7, 9).cast("int") / 100.0)
    p = F.col("c") * F.col("k")
    market = T.benchmark(spark, d).select("ts", (2000 + F.col("close")).alias("c"))
    out = market.join(F.broadcast(brands))  # at most the brands there are
    return out.select("symbol", "ts", p.alias("open"), (p * 1.01).alias("high"), (p * 0.99).alias("low"), p.alias("close"), p.alias("adj_close"), F.lit(100.0).alias("volume"))


@query(
    "quality_quarantine_at_limit", "P2",
    f"""WITH {CALM}, x AS (SELECT symbol, ts, CASE WHEN ts <> DATE '1995-05-05' THEN 0 WHEN symbol = 'Brand#1' THEN 1 WHEN symbol = 'Brand#2' THEN 2 WHEN symbol = 'Brand#3' THEN 3 WHEN symbol = 'Brand#4' THEN 4 ELSE 0 END AS broken,
      adj_close FROM calm), f AS (SELECT *, adj_close * CASE WHEN broken = 4 THEN 1.8 ELSE 1 END AS a FROM x), r AS (SELECT *, abs(a / lag(a) OVER (PARTITION BY symbol ORDER BY ts) - 1) > 0.75 AS jump FROM f),
    bad AS (SELECT DISTINCT symbol FROM r WHERE broken IN (1, 2, 3) OR jump)
    SELECT symbol, CAST(symbol IN (SELECT symbol FROM bad) AS BIGINT) AS bad, count(*) AS n_bars FROM calm GROUP BY 1, 2""",
)
def _(spark, d):
    """At the usual limit of 75 %: a price below zero, a volume below zero, a low above the high, and a jump of 80 %."""
    b, one = calm(spark, d), lambda n: (F.col("ts") == "1995-05-05") & (F.col("symbol") == f"Brand#{n}")
    b = b.withColumn("open", F.when(one(1), -1.0).otherwise(F.col("open"))).withColumn("volume", F.when(one(2), -1.0).otherwise(F.col("volume")))
    b = b.withColumn("low", F.when(one(3), F.col("high") * 2).otherwise(F.col("low"))).withColumn("adj_close", F.col("adj_close") * F.when(one(4), 1.8).otherwise(1.0))
    good, held = Q.quarantine(b)
    out = good.withColumn("bad", F.lit(0)).unionByName(held.withColumn("bad", F.lit(1)))
    return tidy(out.groupBy("symbol", "bad").agg(F.count(F.lit(1)).alias("n_bars")))


@query(
    "store_refused_and_broken_writes", "S5 S6 ST4",
    f"""WITH {CALM} SELECT symbol, CAST(year(ts) AS BIGINT) AS year, count(*) AS n_bars, round(sum(CASE WHEN ts = DATE '1996-07-01' THEN close * 1.1 ELSE close END), 4) AS close_sum, 1 AS refused,
      3 AS rewritten FROM calm WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3') AND ts BETWEEN DATE '1995-03-01' AND DATE '1997-09-30' GROUP BY 1, 2""",
)
def _(spark, d):
    """A clean write, one that the gate refuses, one that dies before its commit, and a late bar; then a read by symbols and range."""
    root, b = fresh(spark, "store"), calm(spark, d).withColumn("seq", F.lit(0))
    B.upsert(spark, root, b, seq="seq")
    refused = 0
    try:
        B.upsert(spark, root, b.filter("ts = '1996-07-01'").withColumn("low", F.col("high") * 2), seq="seq")
    except B.DataQualityError:
        refused = 1
    broken = b.withColumns({"close": F.lit(0.0), "bucket": B.bucket(F.col("symbol")), "year": F.year("ts")})
    V.stage(spark, root, broken, ["bucket", "year"])  # written, never committed
    before = V.latest(spark, root)
    late = b.filter("ts = '1996-07-01' AND symbol IN ('Brand#1', 'Brand#2', 'Brand#3')")
    rise = {c: F.col(c) * 1.1 for c in ("open", "high", "low", "close", "adj_close")}
    B.upsert(spark, root, late.withColumns(rise), seq="seq")
    now = V.latest(spark, root).parts
    # Which years were written again: one for each bucket of the late bars, and three if no two symbols share one.
    moved = {k for k in now if now[k] != before.parts.get(k)}
    buckets = {r[0] for r in late.select(B.bucket(F.col("symbol"))).distinct().collect()}
    ok = moved == {f"bucket={x}/year=1996" for x in buckets}
    r = B.read_store(spark, root, ["Brand#1", "Brand#2", "Brand#3"], start="1995-03-01", end="1997-09-30")
    out = r.groupBy("symbol", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n_bars"), F.sum("close").alias("close_sum"))
    return tidy(out.withColumn("refused", F.lit(refused)).withColumn("rewritten", F.lit(3 if ok else -1)), close_sum=4)
