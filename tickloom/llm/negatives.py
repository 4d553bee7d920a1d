"""Hard negatives by exact scores: matrix products in a residue number system.

Integer inner products are worked out modulo several primes below 1,024.  With
centred residues, 64 products of two residues stay below 2^24, so a float32
matrix product is exact; longer vectors are cut into runs of 64.  Mixed-radix
digits (the Chinese remainder theorem) give the signed score back.  As many
primes are taken as the largest possible score needs.

Anchors are packed into blocks and all rows into blocks; rows are dealt into
groups, each group gets every block of anchors, and a pair of blocks is one
matrix product in a task, which passes on the few best of each anchor.  The work
is anchors times rows, by definition of the query; nothing else grows faster than
the input, nothing is broadcast, and the driver sees only counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written
from tickloom.llm.vectors import longest, matrix, packed

RUN = 64
LARGEST_PRIME = 1024
ANCHORS, ROWS = 512, 2048
#: Stands below every score, in places that must not be chosen.
NEVER = np.iinfo(np.int64).min + 1


def primes_for(bound: int, most: int = LARGEST_PRIME) -> list[int]:
    """The largest primes below ``most`` whose product is over twice ``bound``, so that signed scores fit."""
    out, product = [], 1
    for p in range(most - 1, 2, -1):
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
            if product > 2 * bound + 1:
                return out
    raise OverflowError("the primes do not reach this bound")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers in -(p-1)/2 .. (p-1)/2, as float32."""
    r = x % p
    return (r - p * (r > p // 2)).astype(np.float32)


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(x, p) for p in primes]


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a bᵀ modulo ``p``, of centred residues; every float32 sum is below 2^24."""
    total = 0
    for i in range(0, a.shape[1], RUN):
        total = total + (a[:, i : i + RUN] @ b[:, i : i + RUN].T).astype(np.int64) % p
    return total % p


def rebuilt(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed numbers from their residues, by mixed-radix digits; the product of the primes stays below 2^63."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        d = parts[i]
        for j, q in enumerate(primes[:i]):
            d = (d - digits[j]) * pow(q, -1, p) % p
        digits.append(d)
    value, weight = np.zeros_like(digits[0]), 1
    for d, p in zip(digits, primes, strict=True):
        value, weight = value + d * weight, weight * p
    return value - weight * (value > weight // 2)


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    return rebuilt([product_mod(x, y, p) for x, y, p in zip(a, b, primes, strict=True)], primes)


def _ranked(s: np.ndarray) -> np.ndarray:
    """Places of each row's scores from the highest; ties in the order they stand."""
    return np.argsort(-s, axis=1, kind="stable")


def _pairs(anchors: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
    """Every block of anchors with every block of rows: rows are dealt into ``groups``, which all get the anchors."""
    left = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g")
    right = rows.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).repartition(groups, "g")
    return left.join(right, "g").drop("g")


def _in_tasks(pairs: DataFrame, schema: str, choose: Callable[..., Iterator[tuple[np.ndarray, ...]]], columns: list[str], width: int, primes: list[int]) -> DataFrame:
    """Score each pair of blocks; ``choose`` gets the scores and the columns and returns what it keeps."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cells = [batch.column(k)[i] for k in range(len(columns) + 2)]
                a, b = (residues(matrix(c, width), primes) for c in cells[:2])
                kept = choose(scores(a, b, primes), *(c.values for c in cells[2:]))
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in kept], names)

    return pairs.select("ax", "x", *columns).mapInArrow(run, schema)


def _best(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` of each group by score, then id; Spark keeps ``n`` a task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def mined(
    df: DataFrame, key: str, vec: str, label: str, anchors: Column, scale: float = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Entries become floor(scale * entry); scores are exact inner products.  An
    anchor's positives are its ``positives`` best other rows of its label, and for
    each, the ``negatives`` best rows of another label whose score lies between
    ``low`` and ``high`` hundredths of the positive's are returned, ranked from 1.
    Ties go to the smaller key.

    Rows with a null key or label take no part, nor do those whose vector is null,
    shorter than the longest one, or holds a null or an entry that isn't finite.
    Keys are whole numbers.  Repeated rows count as often as they stand: a repeated
    anchor is answered each time, and rows with the anchor's key are not its
    positives.  An anchor without positives, or a positive without negatives, gives
    no row; an empty table gives none.  Other columns are not read.  Scores that
    could need over 62 bits are an error.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    nothing = df.sparkSession.createDataFrame([], out)
    rows = df.select(F.col(key).cast("long").alias("ids"), F.col(label).cast("long").alias("labels"), F.col(vec).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.filter("ids is not null and labels is not null")
    width, n_anchors = longest(rows, "v"), rows.filter("asks").count()
    if not width or not n_anchors:
        return nothing
    keep = ["ids", "labels"]
    base = written(packed(rows.drop("asks"), "v", keep, width, ROWS, scale), "negatives-rows")
    top, n_blocks = base.agg(F.max("top"), F.count("*")).first()
    if not n_blocks:
        return nothing
    primes = primes_for(width * top * top)
    if np.prod([float(p) for p in primes]) >= 2.0**62:
        raise OverflowError("scores could need over 62 bits")
    asked = packed(rows.filter("asks").drop("asks").repartition(-(-n_anchors // ANCHORS)), "v", keep, width, ANCHORS, scale)
    asked = written(asked.select(F.monotonically_increasing_id().alias("block"), F.col("x").alias("ax"), F.col("ids").alias("aids"), F.col("labels").alias("alabels")), "negatives-anchors")
    groups = min(n_blocks, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def nearest(s, block, aids, alabels, ids, labels):
        aids, alabels, ids, labels = (np.asarray(c) for c in (aids, alabels, ids, labels))
        by = np.argsort(ids, kind="stable")
        s, ids, labels = s[:, by], ids[by], labels[by]
        s = np.where((alabels[:, None] == labels) & (aids[:, None] != ids), s, NEVER)
        at = _ranked(s)[:, :positives]
        got = np.take_along_axis(s, at, 1)
        a, k = np.nonzero(got > NEVER)
        return np.full(len(a), np.asarray(block)[0]), a, aids[a], got[a, k], ids[at[a, k]]

    first = _in_tasks(
        _pairs(asked.withColumn("block", F.array("block")), base.drop("top"), groups), "block long, a long, anchor_id long, score long, id long",
        nearest, ["block", "aids", "alabels", "ids", "labels"], width, primes,
    )
    # An anchor's positives as lists, numbered by its place in its block.
    mine = _best(first, ["block", "a"], positives).groupBy("block").agg(
        F.collect_list("a").alias("pa"), F.collect_list("id").alias("pid"), F.collect_list("score").alias("pscore"), F.collect_list("rank").alias("prank")
    )
    asked = written(asked.join(mine, "block"), "negatives-positives")

    def within(s, block, aids, alabels, pa_, pid, pscore, prank, ids, labels):
        aids, alabels, ids, labels, a, pid, ps, rank = (np.asarray(c) for c in (aids, alabels, ids, labels, pa_, pid, pscore, prank))
        by = np.argsort(ids, kind="stable")
        s, ids, labels = s[:, by], ids[by], labels[by]
        s = np.where(alabels[:, None] != labels, s, NEVER)
        at = _ranked(s)
        s = np.take_along_axis(s, at, 1)
        down = -s
        # A list is sorted downwards: skip what is above the window, then take the next.
        least, most = -(-ps * low // 100), ps * high // 100
        start = np.array([np.searchsorted(down[r], -m, "left") for r, m in zip(a, most, strict=True)], np.int64)
        place = start[:, None] + np.arange(negatives)
        inside = place < s.shape[1]
        place = np.minimum(place, s.shape[1] - 1)
        got = s[a[:, None], place]
        p, k = np.nonzero(inside & (got >= least[:, None]) & (got > NEVER))
        return np.full(len(p), np.asarray(block)[0]), a[p], aids[a[p]], rank[p], pid[p], ps[p], got[p, k], ids[at[a[p], place[p, k]]]

    second = _in_tasks(
        _pairs(asked.withColumn("block", F.array("block")), base.drop("top"), groups),
        "block long, a long, anchor_id long, prank int, positive_id long, positive_score long, score long, id long",
        within, ["block", "aids", "alabels", "pa", "pid", "pscore", "prank", "ids", "labels"], width, primes,
    )
    best = _best(second, ["block", "a", "prank"], negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle_sql() -> str:
    """The query over ``embeddings`` in DuckDB."""
    return """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM (SELECT * FROM r WHERE vec_id % 50 = 0) a JOIN r b ON a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
