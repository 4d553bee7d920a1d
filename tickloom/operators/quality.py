"""Data-quality rules, quarantine and row-level bar filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import finite
from tickloom.operators.quantiles import group_quantile
from tickloom.operators.series import RN, calendar_chunk, index_series
from tickloom.settings import EXCHANGE_TZ
from tickloom.sources.bars import PRICE_COLUMNS

RULES = [
    *[f"non_positive_{c}" for c in PRICE_COLUMNS],
    "negative_volume",
    "ohlc_order",
    "duplicate_key",
    "jump",
]


def flag_rows(bars: DataFrame, *, max_abs_return: float = 0.75) -> DataFrame:
    """Bars with one 0/1 column per row rule and the adjusted return."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    # Unclean bars may repeat keys without bound: each chunk of a symbol is read by itself, in a
    # total order, and takes the last row of the chunk before.
    total = ["ts", *PRICE_COLUMNS, "volume"]
    d = bars.withColumn("_chunk", calendar_chunk("ts"))
    w = Window.partitionBy("symbol", "_chunk").orderBy(*total)
    d = d.withColumns({"_prev": F.lag("adj_close").over(w), "_first": F.row_number().over(w) == 1, "_last": F.lead(F.lit(1)).over(w).isNull()})
    ends = d.filter("_last").select("symbol", "_chunk", "adj_close")
    carry = ends.select("symbol", "_chunk", F.lag("adj_close").over(Window.partitionBy("symbol").orderBy("_chunk")).alias("_carry"))
    d = d.join(carry, ["symbol", "_chunk"], "left")
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    order = (h < lo) | (h < o) | (h < c) | (lo > o) | (lo > c)
    cols = {f"non_positive_{p}": (F.col(p) <= 0) for p in PRICE_COLUMNS}
    cols |= {"negative_volume": F.col("volume") < 0, "ohlc_order": order}
    ret = F.try_divide(F.col("adj_close"), prev) - 1
    d = d.withColumn("_ret", ret).withColumn("jump", F.abs("_ret") > max_abs_return).drop("_prev", "_first", "_last", "_carry", "_chunk")
    d = d.withColumns(cols)
    return d.withColumns({r: F.coalesce(F.col(r).cast("int"), F.lit(0)) for r in [*cols, "jump"]})


def quality_report(bars: DataFrame, *, by: list[str] | None = None, max_abs_return: float = 0.75) -> DataFrame:
    """(rule, n_bad) over all bars or per ``by`` group.

    Keys are aggregated first, so duplicates count from the combined rows.
    """
    by = by or []
    flags = [r for r in RULES if r != "duplicate_key"]
    f = flag_rows(bars, max_abs_return=max_abs_return)
    per_key = f.groupBy("symbol", "ts").agg(
        *[F.sum(r).alias(r) for r in flags], (F.count(F.lit(1)) - 1).alias("duplicate_key")
    )
    tot = per_key.groupBy(*by).agg(*[F.sum(r).alias(r) for r in RULES])
    return tot.unpivot(by, RULES, "rule", "n_bad")


def jump_samples(bars: DataFrame, *, max_abs_return: float = 0.75, n: int = 3) -> DataFrame:
    """The first ``n`` offending bars of the jump rule, in key order."""
    f = flag_rows(bars, max_abs_return=max_abs_return).filter("jump = 1")
    return f.select("symbol", "ts", F.col("_ret").alias("ret")).orderBy("symbol", "ts").limit(n)


def quarantine(bars: DataFrame, *, max_abs_return: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(good, bad) bars: a symbol failing any rule is set aside whole."""
    bad = (
        quality_report(bars, by=["symbol"], max_abs_return=max_abs_return)
        .groupBy("symbol").agg(F.sum("n_bad").alias("n")).filter("n > 0").select("symbol")
    )
    return bars.join(bad, "symbol", "left_anti"), bars.join(bad, "symbol", "left_semi")


# ------------------------------------------------------------- bar timing


def bar_end(ts: Column, interval: str) -> Column:
    """Completion label of a bar; a 60-minute 15:30 bar is a half bar."""
    minutes = {"30m": 30, "60m": 60}[interval]
    if interval == "60m":
        length = F.when(F.date_format(ts, "HH:mm") == "15:30", F.lit(30)).otherwise(F.lit(60))
    else:
        length = F.lit(minutes)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), length, F.lit(0))


def completed(bars: DataFrame, *, as_of: Column, interval: str) -> DataFrame:
    """Bars complete at ``as_of``; daily bars at their own date."""
    if interval == "1d":
        return bars.filter(F.col("ts") <= as_of)
    return bars.filter(bar_end(F.col("ts"), interval) <= as_of)


def latest_completed(now_utc: Column, as_of: Column | None = None) -> Column:
    """Last date whose daily bar is complete: today only from 16:15 local on."""
    local = F.from_utc_timestamp(now_utc, EXCHANGE_TZ)
    today = F.to_date(local)
    closed = F.date_format(local, "HH:mm") >= "16:15"
    latest = F.when(closed, today).otherwise(F.date_sub(today, 1))
    if as_of is None:
        return latest
    return F.when(as_of < today, as_of).otherwise(latest)


def close_utc(ts: Column, minutes: int) -> Column:
    """UTC instant at which a bar labelled in exchange time closes."""
    utc = F.to_utc_timestamp(ts, EXCHANGE_TZ)
    return utc + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))


def new_bars(bars: DataFrame, *, watermark: Column, floor: Column) -> DataFrame:
    """Bars after the watermark and not before the book's inception."""
    return bars.filter((F.col("ts") > watermark) & (F.col("ts") >= floor))


def replay_slice(bars: DataFrame, *, watermark: Column, warmup: int) -> DataFrame:
    """New bars plus the ``warmup`` timestamps before the first new one.

    The first timestamp to keep is found on the calendar (distinct stamps),
    which is a top-k, and enters the filter as a scalar subquery.
    """
    cal = bars.select("ts").distinct()
    before = cal.filter(F.col("ts") <= watermark).orderBy(F.desc("ts")).limit(warmup)
    start = before.agg(F.min("ts")).scalar()
    return bars.filter((F.col("ts") > watermark) | (F.col("ts") >= start))


def drop_warmup(df: DataFrame, warmup: int) -> DataFrame:
    """Drop the first ``warmup`` rows of every symbol that has more than that."""
    n = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    d = index_series(df, ["symbol"], ["ts"]).join(n, "symbol")
    return d.filter((F.col(RN) >= warmup) | (F.col("_n") <= warmup)).drop("_n", RN)


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-finite model columns become NULL, then incomplete rows go."""
    return df.withColumns({c: finite(F.col(c)) for c in cols}).dropna(subset=cols)


def liquid_symbols(bars: DataFrame, *, min_median: float, min_price: float) -> DataFrame:
    """Symbols by median bar dollar volume and last price."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_price")).filter(F.col("last_price") >= min_price)
    median = group_quantile(bars, ["symbol"], F.col("close") * F.col("volume"), 0.5, "median_dollar")
    return median.filter(F.col("median_dollar") >= min_median).join(last, "symbol")


def session_landmarks(bars: DataFrame) -> DataFrame:
    """Flatten time: the second-to-last bar time over the whole calendar."""
    times = bars.select(F.date_format("ts", "HH:mm").alias("bar_time")).distinct()
    last2 = times.orderBy(F.desc("bar_time")).limit(2)
    return last2.agg(F.min("bar_time").alias("flatten_time"), F.max("bar_time").alias("final_time"))


def entries_allowed(bars: DataFrame) -> DataFrame:
    """Bars flagged as flatten bar, and whether entries are still allowed."""
    flatten = session_landmarks(bars).select("flatten_time").scalar()
    t = F.date_format("ts", "HH:mm")
    return bars.withColumns({"is_flatten": t == flatten, "entries_ok": t < flatten})


def date_split(df: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
    """In-sample rows before ``start`` and out-of-sample rows from it on."""
    s = F.lit(start).cast(df.schema["ts"].dataType)
    return df.filter(F.col("ts") < s), df.filter(F.col("ts") >= s)


def latest_two(bars: DataFrame) -> DataFrame:
    """Last close, previous close and day change per symbol.

    The two newest bars come from mergeable maxima, not from a sort of the
    symbol.
    """
    last = bars.groupBy("symbol").agg(F.max(F.struct("ts", "close")).alias("_l"))
    prev = (
        bars.join(last.select("symbol", F.col("_l.ts").alias("_t")), "symbol")
        .filter(F.col("ts") < F.col("_t"))
        .groupBy("symbol").agg(F.max(F.struct("ts", "close")).alias("_p"))
    )
    d = last.join(prev, "symbol", "left")
    chg = (F.try_divide(F.col("_l.close"), F.col("_p.close")) - 1) * 100
    return d.select(
        "symbol", F.col("_l.ts").alias("ts"), F.col("_l.close").alias("price"),
        F.col("_p.close").alias("prev_close"), chg.alias("day_change_pct"),
    )


