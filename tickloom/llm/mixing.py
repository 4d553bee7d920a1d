"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with weight w owns block j (from 0) in the window from floor(j / w) to
ceil((j + 1) / w).  Earliest-deadline-first over released blocks then keeps each
source within one block of its target at every slot.  Weights are whole units
of a period, so the schedule repeats: one period is built, as one row of arrays
inside Spark, and each block finds its slot by its index modulo the source's
units.  No row is dropped or repeated: when a source ends, its later slots stay
empty and are skipped by the order.

Whole units round the weights and bound the number of sources.  Beyond that, or
on request, a schedule keeps the weights as they are, with a queue for each
source: sources are the leaves of a tree by weight (Shannon-Fano-Elias codes),
each fork deals its slots to its two sides in rounded proportion, and the slot
of a block follows in closed form along its source's path.  Nothing is built
slot by slot, so there is no period.  A fork is off by half a block at most,
of which a source bears its share of the side it is on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import spare, written

PERIOD = 1000
BLOCK_ROWS = 64


def root_share(n: Column) -> Column:
    """Default target: the square root of a source's rows, in thousandths (whole, so engines agree)."""
    return F.floor(F.sqrt(n.cast("double")) * 1000).cast("long")


def div(a: Column, b: Column) -> Column:
    """Whole division."""
    return F.call_function("div", a, b)


def units(counts: DataFrame, period: int, weight: Callable[[Column], Column]) -> DataFrame:
    """One row with ``ss``: structs (key, u) by key; u are the units of the period, by largest remainder.

    ``counts`` (key, n) has at most ``period`` rows; each source gets a unit at least.
    """
    one = counts.select("key", weight(F.col("n")).alias("w")).agg(F.sort_array(F.collect_list(F.struct("key", "w"))).alias("a"))
    free = F.lit(period) - F.size("a")
    one = one.select("a", F.greatest(F.aggregate("a", F.lit(0).cast("long"), lambda t, x: t + x["w"]), F.lit(1)).alias("total"), free.cast("long").alias("free"))
    share = lambda x: F.col("free") * x["w"]
    one = one.select("*", F.transform("a", lambda x: F.lit(1) + div(share(x), F.col("total"))).alias("u"))
    # The largest remainders, ties by key, get what is left of the period.
    order = F.array_sort(F.transform("a", lambda x, i: F.struct((-(share(x) % F.col("total"))).alias("r"), i.alias("i"))))
    one = one.select("*", (F.lit(period) - F.aggregate("u", F.lit(0).cast("long"), lambda t, x: t + x)).cast("int").alias("rest"), F.transform(order, lambda x: x["i"]).alias("order"))
    more = F.slice("order", F.lit(1), F.least(F.col("rest"), F.size("a")))
    return one.select(F.transform("a", lambda x, i: F.struct(x["key"].alias("key"), (F.element_at("u", i + 1) + F.array_contains(more, i).cast("long")).alias("u"))).alias("ss"))


def pattern(unit_row: DataFrame, period: int) -> DataFrame:
    """The period's schedule (key, u, k, slot): block k of the source's u goes to ``slot``."""
    late = F.lit(1 << 40)

    def job(x: Column, i: Column, done: Column, t: Column) -> Column:
        """(deadline, source) of the next block of source i, or a late one if none is released."""
        j = F.element_at(done, i + 1)
        ready = (j < x["u"]) & (div(j * period, x["u"]) <= t)
        due = div((j + 1) * period + x["u"] - 1, x["u"])
        return F.struct(F.when(ready, due).otherwise(late).alias("due"), i.alias("i"))

    def step(state: Column, t: Column) -> Column:
        done = state["done"]
        pick = F.array_min(F.transform("ss", lambda x, i: job(x, i, done, t)))
        at = pick["i"]
        return F.struct(
            F.transform(done, lambda d, i: F.when(i == at, d + 1).otherwise(d)).alias("done"),
            F.array_append(state["slots"], F.struct(at.alias("i"), F.element_at(done, at + 1).alias("k"), t.alias("slot"))).alias("slots"),
        )

    zero = F.struct(
        F.transform("ss", lambda x: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>").alias("slots"),
    )
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long")), zero, step, lambda s: s["slots"])
    flat = unit_row.filter(F.size("ss") > 0).select("ss", F.explode(run).alias("p"))
    s = F.element_at("ss", F.col("p.i") + 1)
    return flat.select(s["key"].alias("key"), s["u"].alias("u"), F.col("p.k").alias("k"), F.col("p.slot").alias("slot"))


def paths(counts: DataFrame, weight: Callable[[Column], Column]) -> DataFrame:
    """(key, w, total, path) of every source; the path has the forks from the source up.

    A fork is a struct (d, right, own, all): whether its side is the right one,
    the weight of its side, and of both.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    w = counts.select("key", F.greatest(weight(F.col("n")), F.lit(1)).cast("long").alias("w"))
    # One row a source, numbers only.
    upto = Window.orderBy(F.desc("w"), F.col("key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    w = w.select("*", F.sum("w").over(upto).alias("upto")).crossJoin(w.agg(F.sum("w").alias("total")))
    # The shortest code whose dyadic interval lies within the source's own.
    enough = lambda i: F.col("w") >= F.ceil(F.col("total") / F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))
    w = w.withColumn("length", F.array_min(F.filter(F.sequence(F.lit(1), F.lit(62)), enough)))
    middle = wide(2 * F.col("upto") - F.col("w"))
    code = div(middle * F.expr("CAST(shiftleft(1L, length) AS DECIMAL(19,0))"), wide(2 * F.col("total")))
    w = written(w.withColumn("code", code.cast("long")).select("key", "w", "total", "length", "code"), "codes")
    forks = w.select("key", "w", F.explode(F.sequence(F.lit(0), F.col("length"))).alias("d"), "length", "code")
    forks = forks.select("key", "w", "d", F.expr("shiftright(code, length - d)").alias("prefix"))
    sums = forks.groupBy("d", "prefix").agg(F.sum("w").alias("own"))
    above = sums.select((F.col("d") + 1).alias("d"), F.col("prefix").alias("up"), F.col("own").alias("all"))
    sides = sums.withColumn("up", F.shiftright("prefix", 1)).join(above, ["d", "up"]).filter("own < all")
    steps = forks.join(sides, ["d", "prefix"]).select("key", F.struct((-F.col("d")).alias("d"), (F.col("prefix") % 2 == 1).alias("right"), "own", "all").alias("s"))
    steps = steps.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("path"))
    p = steps.withColumnRenamed("key", "key_")
    none = F.array().cast(p.schema["path"].dataType)
    return w.join(p, F.col("key").eqNullSafe(F.col("key_")), "left").select("key", "w", "total", F.coalesce("path", none).alias("path"))


def along(path: Column, block: Column) -> Column:
    """The slot of a source's ``block``: its place among the blocks of each fork above, up to the whole.

    In t slots of a fork its left side has round(t * own / all), its right one the rest.
    """
    wide = lambda c: c.cast("decimal(19,0)")

    def up(k: Column, s: Column) -> Column:
        own, all_, half = s["own"], s["all"], div(s["all"], F.lit(2))
        ceil = lambda x: div(x + (wide(own) - 1), wide(own))
        left = ceil(wide(k + 1) * wide(all_) - wide(half))
        right = ceil(wide(k) * wide(all_) + wide(half + 1))
        return F.when(s["right"], right).otherwise(left).cast("long") - 1

    return F.aggregate(path, block.cast("long"), up)


def scheduled(
    df: DataFrame,
    *,
    source: str = "source",
    id_: str = "doc_id",
    ties: list[str] | None = None,
    period: int = PERIOD,
    block_rows: int = BLOCK_ROWS,
    weight: Callable[[Column], Column] = root_share,
    exact: bool | None = None,
) -> DataFrame:
    """Append block, release, deadline, slot and place (all long) to every row.

    Rows of a source go in the order of a hash of their id, cut into blocks of
    ``block_rows``; ``place`` orders the whole mixture.  Every source, and the rows
    without one, has a queue of its own.  Weights are in units of the period, or
    ``exact``; if that is None, they are exact from ``period`` sources on.  A slot
    of the exact schedule may be outside its block's window, which tells the
    ideal times.  Rows that agree in id and in ``ties`` are
    interchangeable.  The new columns take free names if those are taken (see
    ``names``).

    A source is numbered in hash ranges, four to a shuffle partition, whose
    counts give each range its start; so a hot source is spread over all tasks.
    """
    n = names(df)
    key, chunk, hashed = (spare(df, c) for c in ("key", "chunk", "hash"))
    counts = df.groupBy(F.col(source).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    if exact is None:
        counts = written(counts, "sources")
        exact = counts.filter("key IS NOT NULL").count() >= period
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn(key, F.col(source))
    d = d.withColumn(hashed, F.md5(F.coalesce(F.col(id_).cast("string"), F.lit(""))))
    d = d.withColumn(chunk, F.shiftright(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") * parts, 32))
    sizes = d.groupBy(F.col(key).alias("__mix_k"), F.col(chunk).alias("__mix_c")).agg(F.count(F.lit(1)).alias("__mix_n"))
    before = Window.partitionBy("__mix_k").orderBy("__mix_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__mix_k", "__mix_c", F.coalesce(F.sum("__mix_n").over(before), F.lit(0)).alias("__mix_from"))
    w = Window.partitionBy(key, chunk).orderBy(hashed, id_, *(ties or []))
    d = d.withColumn(n["place"], F.row_number().over(w).cast("long") - 1)
    d = d.join(sizes, d[key].eqNullSafe(sizes["__mix_k"]) & (d[chunk] == sizes["__mix_c"])).withColumn(n["place"], F.col(n["place"]) + F.col("__mix_from"))
    d = d.withColumn(n["block"], div(F.col(n["place"]), F.lit(block_rows)))

    block, u = F.col(n["block"]), F.col("__mix_u")
    if exact:
        # Written, so that its size is known: few sources are broadcast, many are not.
        own = written(paths(counts, weight), "paths").select(F.col("key").alias("__mix_k1"), F.col("w").alias("__mix_u"), F.col("total").alias("__mix_w"), F.col("path").alias("__mix_p"))
        d = d.join(own, d[key].eqNullSafe(F.col("__mix_k1"))).withColumn("__mix_s", along(F.col("__mix_p"), block))
        wide = lambda c: c.cast("decimal(19,0)")
        slot, total = F.col("__mix_s"), F.col("__mix_w")
        return d.select(
            *df.columns, block.alias(n["block"]),
            div(wide(block) * wide(total), wide(u)).cast("long").alias(n["release"]),
            div(wide(block + 1) * wide(total) + wide(u - 1), wide(u)).cast("long").alias(n["deadline"]),
            slot.alias(n["slot"]), (slot * block_rows + F.col(n["place"]) % block_rows).alias(n["place"]),
        )
    slots = pattern(units(counts, period, weight), period)
    first = slots.filter("k = 0").select(F.col("key").alias("__mix_k1"), F.col("u").alias("__mix_u"))
    d = d.join(F.broadcast(first), d[key].eqNullSafe(F.col("__mix_k1"))).drop("__mix_k1")
    slots = slots.select(F.col("key").alias("__mix_k2"), F.col("k").alias("__mix_j"), F.col("slot").alias("__mix_s"))
    d = d.join(F.broadcast(slots), d[key].eqNullSafe(F.col("__mix_k2")) & (block % u == F.col("__mix_j")))
    slot = div(block, u) * period + F.col("__mix_s")
    return d.select(
        *df.columns, block.alias(n["block"]),
        div(block * period, u).alias(n["release"]),
        div((block + 1) * period + u - 1, u).alias(n["deadline"]),
        slot.alias(n["slot"]), (slot * block_rows + F.col(n["place"]) % block_rows).alias(n["place"]),
    )


def names(df: DataFrame) -> dict[str, str]:
    """The names of the appended columns, beside those of ``df``."""
    return {c: spare(df, c) for c in ("block", "release", "deadline", "slot", "place")}


def placed(df: DataFrame, **how) -> DataFrame:
    """``df`` with its ``place`` appended, laid out in that order: partitions by ranges, sorted within.

    A place depends on the rows alone, not on how they are stored.
    """
    out, place = scheduled(df, **how), names(df)["place"]
    return out.select(*df.columns, place).repartitionByRange(place).sortWithinPartitions(place)


def mixed(df: DataFrame, **how) -> DataFrame:
    """All rows of ``df`` in mixture order."""
    return placed(df, **how).select(*df.columns)


def oracle_sql(period: int = PERIOD, block_rows: int = BLOCK_ROWS) -> str:
    """The query of this operator as DuckDB SQL."""
    return f"""WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    top AS (SELECT source FROM c WHERE source IS NOT NULL ORDER BY n DESC, source LIMIT {period - 1}),
    p AS (SELECT top.source AS key, CAST(floor(sqrt(CAST(sum(n) AS DOUBLE)) * 1000) AS BIGINT) AS w FROM c LEFT JOIN top USING (source) GROUP BY 1),
    q AS (SELECT *, ({period} - count(*) OVER ()) * w AS s, CAST(sum(w) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY key NULLS FIRST) AS i FROM p),
    r AS (SELECT *, 1 + s // total AS u0, row_number() OVER (ORDER BY -(s % total), i) AS ord FROM q),
    s AS (SELECT key, i, CAST(u0 + CASE WHEN ord <= {period} - (SELECT sum(u0) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS u FROM r),
    a AS (SELECT list(u ORDER BY i) AS us, CAST(count(*) AS BIGINT) AS ns FROM s),
    e(t, done, pick) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN us], CAST(0 AS BIGINT) FROM a
      UNION ALL SELECT t + 1, [CASE WHEN x = m % 10000 THEN done[x] + 1 ELSE done[x] END FOR x IN range(1, ns + 1)], m % 10000 FROM (
        SELECT t, done, ns, list_min([CASE WHEN done[x] < us[x] AND done[x] * {period} // us[x] <= t THEN ((done[x] + 1) * {period} + us[x] - 1) // us[x] * 10000 + x END FOR x IN range(1, ns + 1)]) AS m
        FROM e, a WHERE t < {period})),
    z AS (SELECT pick AS i, done[pick] - 1 AS k, t - 1 AS slot FROM e WHERE pick > 0),
    d AS (SELECT doc_id, source, key, i, u, row_number() OVER (PARTITION BY key ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rn
      FROM documents LEFT JOIN top USING (source) JOIN s ON key IS NOT DISTINCT FROM top.source),
    b AS (SELECT *, rn // {block_rows} AS block FROM d)
    SELECT doc_id, b.source, block, block * {period} // u AS release, ((block + 1) * {period} + u - 1) // u AS deadline, block // u * {period} + slot AS slot,
      (block // u * {period} + slot) * {block_rows} + rn % {block_rows} AS place FROM b JOIN z ON z.i = b.i AND z.k = block % u"""
