"""Keyed state of the trading streams: order life cycle, stop lock-out, rolling news signal.

Rows wait in state until the watermark has passed them and are then taken in
event-time order, so a stream gives what the batch operators give.  What is
kept per key is bounded: rows inside the watermark, orders still open, the
last stop of a lock-out that still runs, and the cells of a look-back.  All
need the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.news import finish_signal
from tickloom.settings import BookSettings, NewsSettings

DAY_US = 86_400_000_000


def _us(s: pd.Series) -> list[int | None]:
    """Microseconds of a timestamp column; missing ones are None."""
    u = s.astype("datetime64[us]")
    return [None if n else int(v) for v, n in zip(u.astype("int64"), u.isna(), strict=True)]


def _stamp(us: int | None):
    return None if us is None else pd.Timestamp(us, unit="us")


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them; subclasses take them in order."""

    WAITING = ""  # the fields after "us BIGINT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us BIGINT, " + self.WAITING)
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def rows(self, pdf: pd.DataFrame) -> tuple[list[tuple], set[int]]:
        """The rows to hold, and the instants (ms) at which something becomes due besides them."""
        raise NotImplementedError

    def take(self, key: tuple, ready: list[tuple], cut: int) -> pd.DataFrame | None:
        """Work on the rows before ``cut`` (us), in order."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due: set[int] = set()
        for pdf in rows:
            held, extra = self.rows(pdf)
            self.waiting.appendList(held)
            due |= extra | {max(r[0] for r in held) // 1000 + 1}
        for ms in due:
            self.handle.registerTimer(ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cut = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted(self.waiting.get(), key=lambda r: tuple((v is None, v) for v in r)) if self.waiting.exists() else []
        ready, later = [r for r in held if r[0] < cut], [r for r in held if r[0] >= cut]
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        out = self.take(key, ready, cut)
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


# ------------------------------------------------------------------ orders

ORDER_OUT = "symbol STRING, id STRING, ts TIMESTAMP, state STRING, fill_ts TIMESTAMP, fill_price DOUBLE"


class OrderKeeper(InOrder):
    """Open orders of a symbol: the first bar strictly after an order fills it, its deadline cancels it."""

    WAITING = "kind INT, id STRING, price DOUBLE, deadline BIGINT"

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "us BIGINT, id STRING, deadline BIGINT")

    def rows(self, pdf: pd.DataFrame) -> tuple[list[tuple], set[int]]:
        limit = _us(pdf["deadline"])
        held = list(zip(_us(pdf["ts"]), pdf["kind"].tolist(), pdf["id"].tolist(), pdf["price"].tolist(), limit, strict=True))
        return held, {d // 1000 + 1 for d in limit if d is not None}

    def take(self, key: tuple, ready: list[tuple], cut: int) -> pd.DataFrame | None:
        before = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        live, out = list(before), []

        def expire(now: int) -> None:
            nonlocal live
            out.extend((key[0], i, _stamp(us), "cancelled", None, None) for us, i, d in live if d is not None and d < now)
            live = [o for o in live if o[2] is None or o[2] >= now]

        for us, kind, order, price, deadline in ready:
            expire(us)
            if kind:
                live.append((us, order, deadline))
            else:
                out += [(key[0], i, _stamp(t), "filled", _stamp(us), price) for t, i, _ in live if t < us]
                live = [o for o in live if o[0] >= us]
        expire(cut)
        if live:
            self.open.put(live)
        elif before:
            self.open.clear()
        return pd.DataFrame(out, columns=["symbol", "id", "ts", "state", "fill_ts", "fill_price"])


def order_states(orders: DataFrame, bars: DataFrame, *, price: str = "open", lateness: str = "1 day") -> DataFrame:
    """One row for each order, when it is filled or cancelled.

    Orders need symbol, ts, id and ``deadline`` (a date: bars of that day still
    fill; null: it never expires), as ``with_deadline`` gives them.  Both streams have
    watermarks, and a bar that is later than ``lateness`` may be missed.
    """
    end = F.timestamp_micros(F.unix_micros(F.date_add("deadline", 1).cast("timestamp")) - 1)
    o = orders.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("kind"), F.col("id").cast("string").alias("id"),
                      F.lit(None).cast("double").alias("price"), end.alias("deadline"))
    b = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"),
                    F.col(price).alias("price"), F.lit(None).cast("timestamp").alias("deadline"))
    both = o.unionByName(b).withWatermark("ts", lateness).groupBy("symbol")
    return both.transformWithStateInPandas(statefulProcessor=OrderKeeper(), outputStructType=ORDER_OUT, outputMode="Append", timeMode="eventTime")


# ----------------------------------------------------------------- lock-out

LOCK_OUT = "symbol STRING, id STRING, ts TIMESTAMP, cooling BOOLEAN"


class LockoutKeeper(InOrder):
    """The last stop of a symbol, kept while its lock-out runs."""

    WAITING = "kind INT, id STRING"

    def __init__(self, cfg: BookSettings) -> None:
        self.cfg = cfg

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us BIGINT")

    def over(self, us: int) -> int:
        """First instant (us) at which a stop of ``us`` no longer counts."""
        if self.cfg.stop_cooldown_bars is None:
            return (us // DAY_US + self.cfg.stop_cooldown_days) * DAY_US
        return us + self.cfg.stop_cooldown_bars * self.cfg.bar_minutes * 60_000_000

    def rows(self, pdf: pd.DataFrame) -> tuple[list[tuple], set[int]]:
        held = list(zip(_us(pdf["ts"]), pdf["kind"].tolist(), pdf["id"].tolist(), strict=True))
        return held, {self.over(us) // 1000 + 1 for us, kind, _ in held if kind == 0}

    def take(self, key: tuple, ready: list[tuple], cut: int) -> pd.DataFrame | None:
        stop = self.last.get()[0] if self.last.exists() else None
        was, out = stop, []
        for us, kind, row in ready:
            if kind == 0:
                stop = us
            else:
                out.append((key[0], row, _stamp(us), stop is not None and us < self.over(stop)))
        if stop is not None and self.over(stop) <= cut:
            stop = None
        if stop is None:
            if was is not None:
                self.last.clear()
        elif stop != was:
            self.last.update((stop,))
        return pd.DataFrame(out, columns=["symbol", "id", "ts", "cooling"])


def lockouts(rows: DataFrame, stops: DataFrame, cfg: BookSettings | None = None, *, lateness: str = "1 day") -> DataFrame:
    """Each row (symbol, ts, id) with whether its symbol's last stop still locks it out."""
    cfg = cfg or BookSettings()
    ask = rows.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("kind"), F.col("id").cast("string").alias("id"))
    hit = stops.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"))
    both = ask.unionByName(hit).withWatermark("ts", lateness).groupBy("symbol")
    return both.transformWithStateInPandas(statefulProcessor=LockoutKeeper(cfg), outputStructType=LOCK_OUT, outputMode="Append", timeMode="eventTime")


# ------------------------------------------------------------------- signal

CELL = "symbol STRING, ts TIMESTAMP, cell BIGINT, num DOUBLE, den DOUBLE, n BIGINT, top DOUBLE, uid STRING, title STRING"
SIGNAL_OUT = "as_of TIMESTAMP, symbol STRING, _num DOUBLE, weight DOUBLE, articles BIGINT, top_headline STRING"


def _by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums per symbol and cell of what a task has, so a symbol in every article costs a few rows in the shuffle."""
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.sort_values(["symbol", "cell", "top", "uid"], kind="stable")
        g = pdf.groupby(["symbol", "cell"], sort=False)
        out = g.agg(ts=("ts", "max"), num=("num", "sum"), den=("den", "sum"), n=("den", "size"), top=("top", "last"), uid=("uid", "last"), title=("title", "last"))
        yield out.reset_index()[["symbol", "ts", "cell", "num", "den", "n", "top", "uid", "title"]]


class SignalKeeper(StatefulProcessor):
    """Decayed sums of a symbol's articles, a cell for each step of the grid inside the look-back.

    A cell's sums are as of its end; at a later instant they weigh by the time
    since, so nothing but the cells is kept, and a cell leaves when it is too old.
    The cells span the look-back and the lateness: they are read and written as one
    list, as a call to the state for each of them costs more than their sums.
    """

    def __init__(self, start_us: int, step_us: int, age_us: int, half_life_us: float) -> None:
        self.start, self.step, self.age, self.half_life = start_us, step_us, age_us, half_life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getListState("cells", "cell BIGINT, num DOUBLE, den DOUBLE, n BIGINT, top DOUBLE, uid STRING, title STRING")
        self.next = handle.getValueState("next", "us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held = None, {r[0]: tuple(r[1:]) for r in self.cells.get()}
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                cell, now = int(r.cell), (float(r.num), float(r.den), int(r.n), float(r.top), r.uid, r.title)
                if (old := held.get(cell)) is not None:
                    best = max(old[3:6], now[3:6], key=lambda t: t[:2])
                    now = (old[0] + now[0], old[1] + now[1], old[2] + now[2], *best)
                held[cell] = now
                first = cell if first is None else min(first, cell)
        if held:
            self.cells.put([(c, *held[c]) for c in sorted(held)])
        if first is not None and (not self.next.exists() or first < self.next.get()[0]):
            if not self.next.exists():
                self.next.update((first,))
            self.handle.registerTimer(first // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.next.exists():
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        at, out = self.next.get()[0], []
        held = sorted((r[0], tuple(r[1:])) for r in self.cells.get())
        lo = hi = 0  # those at an instant are held[lo:hi]
        while lo < len(held) and at <= now:
            while lo < len(held) and at - (held[lo][0] - self.step) > self.age:
                lo += 1
            while hi < len(held) and held[hi][0] <= at:
                hi += 1
            if seen := held[lo:hi]:
                decay = [0.5 ** ((at - c) / self.half_life) for c, _ in seen]
                num, den = (float(np.dot(decay, [v[i] for _, v in seen])) for i in (0, 1))
                top = max(((round(w * v[3], 9), v[4], v[5]) for w, (_, v) in zip(decay, seen, strict=True)), key=lambda t: t[:2])
                out.append((pd.Timestamp(at, unit="us"), key[0], num, den, sum(v[2] for _, v in seen), top[2]))
            at += self.step
        if left := [(c, *v) for c, v in held[lo:]]:
            self.cells.put(left)
            self.next.update((at,))
            self.handle.registerTimer(at // 1000)
        else:
            self.cells.clear()
            self.next.clear()
        if out:
            yield pd.DataFrame(out, columns=["as_of", "symbol", "_num", "weight", "articles", "top_headline"])

    def close(self) -> None:
        pass


def rolling_signal(
    scored: DataFrame, *, start: str, step_days: int = 1, cfg: NewsSettings | None = None, lateness: str = "1 day"
) -> DataFrame:
    """Sums per symbol at every instant of a grid, emitted when the watermark passes it; ``complete_signal`` finishes them.

    ``scored`` has ts, uid, title, symbols, polarity and matched.  The look-back is a
    whole number of steps, so that a cell enters and leaves it whole.
    """
    cfg = cfg or NewsSettings()
    if cfg.max_age_days % step_days or cfg.half_life_days <= 0:
        raise ValueError("the look-back must be a whole number of steps, and the half-life positive")
    step, half = step_days * DAY_US, cfg.half_life_days * DAY_US
    origin = int(pd.Timestamp(start).value // 1000)
    us = F.unix_micros("ts")
    cell = F.lit(origin) + (F.floor((us - origin) / step) + 1) * step
    weight = F.pow(F.lit(0.5), (F.col("cell") - us) / half) * F.least(F.col("matched"), F.lit(6)) / 6.0
    d = scored.filter("matched > 0").withColumn("symbol", F.explode("symbols")).withColumn("cell", cell.cast("long")).withColumn("den", weight)
    d = d.select("symbol", "ts", "cell", (F.col("den") * F.col("polarity")).alias("num"), "den", F.lit(1).cast("long").alias("n"),
                 (F.col("den") * F.abs("polarity")).alias("top"), "uid", "title")
    cells = d.mapInPandas(_by_cell, CELL).withWatermark("ts", lateness).groupBy("symbol")
    keeper = SignalKeeper(origin, step, int(cfg.max_age_days * DAY_US), half)
    return cells.transformWithStateInPandas(statefulProcessor=keeper, outputStructType=SIGNAL_OUT, outputMode="Append", timeMode="eventTime")


def complete_signal(rows: DataFrame, cfg: NewsSettings | None = None) -> DataFrame:
    """Scores against the mean of their instant.  All symbols of an instant come in one batch, so a sink may do this."""
    return finish_signal(rows, cfg or NewsSettings())
