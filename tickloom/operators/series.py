"""Series primitives: block layout, prefix scans, recurrences, as-of joins.

A *series* is the rows of one key in a total order.  One key may hold a large
share of all rows, so nothing here sorts a whole key in one task unless its
length is bounded by the calendar (bars: one row per key and timestamp).

* ``index_series`` numbers rows per key in two levels (chunk counts, then rows
  in a chunk), so an unbounded key is numbered by many tasks.
* ``Blocks`` cuts a series into fixed-length blocks and copies the rows a
  trailing or leading window needs from the neighbouring blocks.  Every row
  window of the library runs inside (key, block).
* ``prefix_scan`` and ``linear_scan`` run inside (key, chunk) and add what the
  earlier chunks carry in.
* ``asof_backward`` is a union and a "last value" window inside (key, bucket),
  with the same carry between buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

RN = "_rn"
# e^-41 < 2^-53: older terms cannot change a double.
NEGLIGIBLE = 41.0
# Largest exponent a running sum of scaled terms may span.
MAX_EXPONENT = 600.0


# --------------------------------------------------------------- numbering


def calendar_chunk(ts: str | Column, days: int = 32) -> Column:
    """Monotone bucket of a date or timestamp column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / F.lit(days))


def second_chunk(ts: str | Column, seconds: int) -> Column:
    """Monotone bucket of a timestamp column, ``seconds`` wide."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))


def index_series(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | None = None, rn: str = RN
) -> DataFrame:
    """Add the 0-based position of each row in its key's order.

    Without ``chunk`` the whole key is one window: only for series bounded by
    the calendar.  With ``chunk`` (monotone in ``order``) a key is numbered by
    as many tasks as it has chunks.
    """
    cols = [F.col(k) for k in order]
    if chunk is None:
        return df.withColumn(rn, F.row_number().over(_w(keys).orderBy(*cols)).cast("long") - 1)
    d = df.withColumn("_chunk", chunk)
    sizes = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = _w(keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    inner = _w([*keys, "_chunk"]).orderBy(*cols)
    out = d.withColumn("_pos", F.row_number().over(inner)).join(base, [*keys, "_chunk"])
    return out.withColumn(rn, F.col("_base") + F.col("_pos") - 1).drop("_chunk", "_pos", "_base")


def _w(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


# ------------------------------------------------------------------ blocks


@dataclass
class Blocks:
    """A series laid out in (key, block) with copied neighbours.

    ``frame`` holds every row once as its own (``_own``) plus the copies that
    ``lookback``/``lookahead`` rows of window need.  ``close`` drops the copies.
    A window of at most ``lookback`` rows back is exact on own rows.
    """

    frame: DataFrame
    keys: list[str]
    lookback: int
    lookahead: int = 0
    block_rows: int = 1024
    part: list[str] = field(default_factory=list)

    @classmethod
    def lay(
        cls,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        *,
        lookback: int,
        lookahead: int = 0,
        block_rows: int = 1024,
        chunk: Column | None = None,
    ) -> Blocks:
        if not keys and chunk is None:
            chunk = calendar_chunk(order[0], 512)
        d = df if RN in df.columns else index_series(df, keys, order, chunk)
        n = F.lit(block_rows)
        own = F.floor(F.col(RN) / n).cast("long")
        first = F.floor(F.greatest(F.col(RN) - F.lit(lookahead), F.lit(0)) / n).cast("long")
        last = F.floor((F.col(RN) + F.lit(lookback)) / n).cast("long")
        # A copy into a later block matters only where that block has own
        # rows; surplus copies sit in blocks of their own and are dropped.
        d = d.withColumn("_home", own).withColumn("_block", F.explode(F.sequence(first, last)))
        part = [*keys, "_block"]
        # The exchange every window of the layout needs, stated with a fixed
        # number of partitions: window work grows with rows times width, so
        # merging partitions because their bytes are few would serialise it.
        n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls(d.repartition(n_parts, *part), list(keys), lookback, lookahead, block_rows, part)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(RN)

    def rows(self, n: int) -> WindowSpec:
        """The last ``n`` rows, this one included."""
        self._check(n - 1)
        return self.w.rowsBetween(-(n - 1), 0)

    def _check(self, back: int) -> None:
        if back > self.lookback:
            raise ValueError(f"window reaches {back} rows back, layout copies {self.lookback}")

    def full(self, n: int, value: Column, of: Column) -> Column:
        """``value`` once the last ``n`` entries of ``of`` are all present."""
        return F.when(F.count(of).over(self.rows(n)) == n, value)

    def lag(self, c: Column, n: int) -> Column:
        self._check(n)
        return F.lag(c, n).over(self.w)

    def lead(self, c: Column, n: int) -> Column:
        if n > self.lookahead:
            raise ValueError(f"lead of {n} rows, layout copies {self.lookahead}")
        return F.lead(c, n).over(self.w)

    def mean(self, c: Column, n: int) -> Column:
        """Mean of the last ``n`` values.

        One rule for every width, here and in the spreads: a value that is NULL,
        NaN or infinite is missing, and a window with a missing value is NULL.
        The frame is summed afresh for each row, so a window far from zero keeps
        its spread and a value that has left it leaves no trace.
        """
        v = _clean(c)
        return self.full(n, F.avg(v).over(self.rows(n)), v)

    def std(self, c: Column, n: int) -> Column:
        v = _clean(c)
        return self.full(n, F.stddev_samp(v).over(self.rows(n)), v)

    def std_pop(self, c: Column, n: int) -> Column:
        v = _clean(c)
        return self.full(n, F.stddev_pop(v).over(self.rows(n)), v)

    def zscore(self, c: Column, n: int) -> Column:
        """Trailing z-score, this row included in its own statistics."""
        return (c - self.mean(c, n)) / (self.std(c, n) + F.lit(1e-12))

    def zscores(self, columns: dict[str, Column], n: int) -> Blocks:
        """``zscore`` of several columns over one wide window, as array operations on each block.

        The rule is that of ``mean`` and ``std``; many wide frames cost less this way.
        """
        self._check(n - 1)

        def fn(xs: list[np.ndarray]) -> list[np.ndarray]:
            out = []
            for x in xs:
                x = np.where(np.isfinite(x), x, np.nan)
                z = np.full(len(x), np.nan)
                if len(x) >= n:
                    w = np.lib.stride_tricks.sliding_window_view(x, n)
                    mean = w.mean(1)
                    dev = w - mean[:, None]
                    z[n - 1 :] = (x[n - 1 :] - mean) / (np.sqrt(np.einsum("ij,ij->i", dev, dev) / (n - 1)) + 1e-12)
                out.append(z)
            return out

        return self.blockwise(list(columns.values()), list(columns), fn)

    def blockwise(self, inputs: list[Column], outs: list[str], fn: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Blocks:
        """Append double columns that ``fn`` makes of a block's values in row order.

        NULL is NaN on the way in and NaN is NULL on the way out.  Blocks are
        read one after the other from the sorted layout, so the cost of a task's
        memory is one block and one Arrow batch; nothing is shuffled.
        """
        names = self.frame.columns
        given = [f"_in{i}" for i in range(len(inputs))]
        d = self.frame.withColumns({g: c.cast("double") for g, c in zip(given, inputs)} | {"_gid": F.xxhash64(*self.part)})
        d = d.sortWithinPartitions(*self.part, RN).select(*names, *given, "_gid")
        schema = T.StructType([*self.frame.schema.fields, *(T.StructField(o, T.DoubleType()) for o in outs)])
        n, labels = len(names), [*names, *outs]

        def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
            gid = t.column(n + len(given)).to_numpy()
            xs = [t.column(n + i).to_numpy() for i in range(len(given))]
            cuts = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1), len(gid)]
            parts = [fn([x[a:b] for x in xs]) for a, b in zip(cuts, cuts[1:])]
            cols = [np.concatenate([p[i] for p in parts]) for i in range(len(outs))]
            made_ = [pa.array(c, mask=np.isnan(c)) for c in cols]
            yield from pa.Table.from_arrays([*t.columns[:n], *made_], labels).combine_chunks().to_batches()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                gid = batch.column(n + len(given)).to_numpy()
                starts = np.flatnonzero(gid != gid[-1])
                cut = int(starts[-1]) + 1 if len(starts) else 0
                before = int(held[-1].column(n + len(given))[-1].as_py() != gid[0]) if held else 0
                if before or cut:
                    yield from made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = []
                held.append(batch.slice(cut))
            if held:
                yield from made(pa.Table.from_batches(held))

        return self._with(d.mapInArrow(run, schema))

    def ewm(self, x: Column, alpha: float, *, seed: str = "first") -> Column:
        """Recursive mean ``y = (1-alpha)*y + alpha*x`` as one running sum.

        ``seed='first'`` starts at the first value, ``'zero'`` at zero.  The
        layout must copy ``ewm_lookback(alpha)`` rows.  Documented limit: what lies
        further back weighs less than e^-41, below a double's precision for
        values of like size, and is left out.
        """
        self._check(min(ewm_lookback(alpha), self.lookback + 1) if alpha < 1 else 0)
        rate = -math.log1p(-alpha)
        if rate * (self.block_rows + self.lookback + self.lookahead) > MAX_EXPONENT:
            raise ValueError("block too long for this smoothing factor")
        start = F.greatest(F.col("_block") * self.block_rows - self.lookback, F.lit(0))
        age = (F.col(RN) - start).cast("double")
        coef = F.when(F.col(RN) == 0, F.lit(1.0)).otherwise(F.lit(alpha)) if seed == "first" else F.lit(alpha)
        run = self.w.rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(coef * x * F.exp(age * rate)).over(run) * F.exp(-age * rate)

    def add(self, **cols: Column) -> Blocks:
        return self._with(self.frame.withColumns(cols))

    def _with(self, frame: DataFrame) -> Blocks:
        return Blocks(frame, self.keys, self.lookback, self.lookahead, self.block_rows, self.part)

    def close(self, *, keep_rn: bool = False) -> DataFrame:
        own = self.frame.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")
        return own if keep_rn else own.drop(RN)


def _clean(c: Column) -> Column:
    """Non-finite values as NULL."""
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def ewm_lookback(alpha: float) -> int:
    """Rows after which an exponential weight is below double precision."""
    return math.ceil(NEGLIGIBLE / -math.log1p(-alpha))


# ------------------------------------------------------------- prefix scans


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    *,
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums, maxima and last non-null values over each key's order.

    Each (key, chunk) is scanned by itself; a join on (key, chunk) adds what
    the earlier chunks carry in.  A ``_chunk`` column already in the frame is
    used and kept, so that scans in a row share one exchange.
    """
    sums, maxs, lasts = sums or {}, maxs or {}, lasts or {}
    ins = {f"_in_{n}": c for n, c in {**sums, **maxs, **lasts}.items()}
    keep = "_chunk" in df.columns
    d = (df if keep else df.withColumn("_chunk", chunk)).withColumns(ins)
    tail = [F.sum(f"_in_{n}").alias(f"_c_{n}") for n in sums]
    tail += [F.max(f"_in_{n}").alias(f"_c_{n}") for n in maxs]
    key = F.struct(*order)
    tail += [
        F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), key)).alias(f"_c_{n}") for n in lasts
    ]
    before = _w(keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(*keys, "_chunk").agg(*tail)
    carry = carry.select(
        *keys,
        "_chunk",
        *[F.sum(f"_c_{n}").over(before).alias(f"_b_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(before).alias(f"_b_{n}") for n in maxs],
        *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts],
    )
    run = _w([*keys, "_chunk"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_l_{n}": F.sum(f"_in_{n}").over(run) for n in sums}
    local |= {f"_l_{n}": F.max(f"_in_{n}").over(run) for n in maxs}
    local |= {f"_l_{n}": F.last(f"_in_{n}", ignorenulls=True).over(run) for n in lasts}
    d = d.withColumns(local)
    on = [*keys, "_chunk"]
    d = d.join(carry, on)
    out = {n: F.coalesce(F.col(f"_l_{n}") + F.col(f"_b_{n}"), F.col(f"_l_{n}"), F.col(f"_b_{n}")) for n in sums}
    out |= {n: F.greatest(F.col(f"_l_{n}"), F.col(f"_b_{n}")) for n in maxs}
    out |= {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_b_{n}")) for n in lasts}
    drop = [c for n in (*sums, *maxs, *lasts) for c in (f"_in_{n}", f"_l_{n}", f"_b_{n}")]
    return d.withColumns(out).drop(*drop, *([] if keep else ["_chunk"]))


def linear_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    *,
    decay: Column,
    add: Column,
    out: str,
    before: str | None = None,
) -> DataFrame:
    """``y = decay*y_previous + add`` over each key's order, from zero.

    ``decay`` lies in [0, 1] and ``add`` is non-negative, as for an average
    cost.  A zero decay is a reset.  Each (key, chunk) is solved in closed form
    by running sums; chunks hand on one (decay, value) pair.  ``before`` names
    an optional column for the value ahead of the row.
    """
    keep = "_chunk" in df.columns
    d = (df if keep else df.withColumn("_chunk", chunk)).withColumns({"_a": decay, "_b": add})
    part = [*keys, "_chunk"]
    d = solve_chunk(d, part, order)
    # (A, B) of a chunk: value at its end is B + A * value carried in.
    tail = d.groupBy(*part).agg(
        F.max_by("_reach", F.struct(*order)).alias("_a"), F.max_by("_y", F.struct(*order)).alias("_b")
    )
    tail = solve_chunk(tail, keys, ["_chunk"])
    prev = _w(keys).orderBy("_chunk")
    carry = tail.select(*part, F.coalesce(F.lag("_y").over(prev), F.lit(0.0)).alias("_carry"))
    d = d.join(carry, part)
    d = d.withColumn(out, F.col("_y") + F.col("_reach") * F.col("_carry"))
    if before:
        inner = _w(part).orderBy(*order)
        d = d.withColumn(before, F.coalesce(F.lag(out).over(inner), F.col("_carry")))
    return d.drop("_y", "_reach", "_carry", *([] if keep else ["_chunk"]))


def solve_chunk(d: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Solve the recurrence from zero inside ``part``: ``_y`` and ``_reach``.

    ``_reach`` is the product of decays since the start (0 after a reset).
    Products are kept as running logs, cut into segments of 300 nats so that
    no scaled term over- or underflows; across a cut only the previous
    segment's end value still has weight.
    """
    run = _w(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_group", F.sum((F.col("_a") <= 0).cast("int")).over(run))
    step = F.when(F.col("_a") > 0, -F.ln("_a")).otherwise(F.lit(0.0))
    grun = _w([*part, "_group"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_log", F.sum(step).over(grun)).withColumn("_seg", F.floor(F.col("_log") / 300.0))
    srun = _w([*part, "_group", "_seg"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("_log") - F.col("_seg") * 300.0
    d = d.withColumn("_ys", F.exp(-rel) * F.sum(F.col("_b") * F.exp(rel)).over(srun))
    prev_seg = _w([*part, "_group"]).orderBy("_seg").rangeBetween(-1, -1)
    end = F.max(F.struct(F.struct(*order), "_ys", "_log")).over(prev_seg)
    d = d.withColumn("_end", end)
    handed = F.col("_end._ys") * F.exp(F.col("_end._log") - F.col("_log"))
    d = d.withColumn("_y", F.col("_ys") + F.coalesce(handed, F.lit(0.0)))
    reach = F.when(F.col("_group") > 0, F.lit(0.0)).otherwise(F.exp(-F.col("_log")))
    return d.withColumn("_reach", reach).drop("_ys", "_end", "_a", "_b", "_group", "_log", "_seg")


# -------------------------------------------------------------------- as-of


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    bucket: int = 32,
    strict: bool = False,
) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row, per key.

    Both sides are unioned and read in time order inside (key, bucket); the
    value carried into a bucket comes from a small per-bucket summary.  With
    ``strict`` a right row at the same instant does not count.  Ties on the
    right are settled by the largest values, so the result is repeatable.
    ``bucket`` is in days.
    """
    pick = F.struct(F.col(right_ts).alias(right_ts), *values)
    r = right.groupBy(*keys, F.col(right_ts).alias("_ts")).agg(F.max(pick).alias("_pick"))
    side_left, side_right = (0, 1) if strict else (1, 0)
    bare = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in keys]
    rs = r.select(*keys, *bare, "_ts", "_pick", F.lit(side_right).alias("_side"))
    none = F.lit(None).cast(r.schema["_pick"].dataType)
    ls = left.select(
        *keys,
        *[c for c in left.columns if c not in keys],
        F.col(left_ts).alias("_ts"),
        none.alias("_pick"),
        F.lit(side_left).alias("_side"),
    )
    u = ls.unionByName(rs).withColumn("_bkt", calendar_chunk("_ts", bucket))
    part = [*keys, "_bkt"]
    run = _w(part).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_hit", F.last("_pick", ignorenulls=True).over(run)).filter(F.col("_side") == side_left)
    # Every bucket that occurs on either side, with the last pick before it.
    ends = r.withColumn("_bkt", calendar_chunk("_ts", bucket)).groupBy(*part).agg(F.max("_pick").alias("_pick"))
    seen = left.select(*keys, calendar_chunk(left_ts, bucket).alias("_bkt")).distinct()
    grid = seen.join(ends, part, "full")
    back = _w(keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = grid.select(*part, F.last("_pick", ignorenulls=True).over(back).alias("_carry"))
    u = u.join(carry, part, "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    got = [F.col(f"_hit.{c}").alias(c) for c in dict.fromkeys([right_ts, *values])]
    return u.select(*left.columns, *got)


def first_after(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    bucket: int = 32,
) -> DataFrame:
    """Earliest ``right`` row strictly after each ``left`` row, per key."""
    pick = F.struct(F.col(right_ts).alias(right_ts), *values)
    r = right.groupBy(*keys, F.col(right_ts).alias("_ts")).agg(F.max(pick).alias("_pick"))
    bare = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in keys]
    rs = r.select(*keys, *bare, "_ts", "_pick", F.lit(0).alias("_side"))
    ls = left.select(
        *keys,
        *[c for c in left.columns if c not in keys],
        F.col(left_ts).alias("_ts"),
        F.lit(None).cast(r.schema["_pick"].dataType).alias("_pick"),
        F.lit(1).alias("_side"),
    )
    u = ls.unionByName(rs).withColumn("_bkt", calendar_chunk("_ts", bucket))
    part = [*keys, "_bkt"]
    ahead = _w(part).orderBy("_ts", "_side").rowsBetween(0, Window.unboundedFollowing)
    u = u.withColumn("_hit", F.first("_pick", ignorenulls=True).over(ahead)).filter(F.col("_side") == 1)
    starts = r.withColumn("_bkt", calendar_chunk("_ts", bucket)).groupBy(*part).agg(F.min("_pick").alias("_pick"))
    seen = left.select(*keys, calendar_chunk(left_ts, bucket).alias("_bkt")).distinct()
    fwd = _w(keys).orderBy("_bkt").rowsBetween(1, Window.unboundedFollowing)
    carry = seen.join(starts, part, "full").select(
        *part, F.first("_pick", ignorenulls=True).over(fwd).alias("_carry")
    )
    u = u.join(carry, part, "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    got = [F.col(f"_hit.{c}").alias(c) for c in dict.fromkeys([right_ts, *values])]
    return u.select(*left.columns, *got)
