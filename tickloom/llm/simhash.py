"""Near-duplicates by SimHash, searched with the generalised pigeonhole principle.

A fingerprint has the bits that more than half of a text's shingle hashes have.
Two fingerprints within ``radius`` bits agree, on at least one of ``m`` bit
partitions, up to that partition's threshold, whenever the thresholds sum to
radius - m + 1 (a threshold of -1 leaves a partition out).  Correlated bits share
a partition.  The number of partitions and their unequal thresholds come from a
dynamic program over estimated costs: signatures to emit, and candidate pairs,
from the bit and bit-pair frequencies of all fingerprints.  The allocation only
moves work; the result is exact for any of them.

A partition with threshold t emits a signature for each way to leave out t of
its bits, so fingerprints within t of each other meet in a bucket.  Buckets are
compared in tasks, block by block, and leave a forest of their links instead of
all pairs.

For a large radius a second fingerprint with another hash seed can verify what
the search finds: unrelated texts among very many then don't link by chance.

A fingerprint tells a similarity only roughly.  Where the similarity itself
decides (``jaccard``), candidates come from the fingerprints and from bands of
least shingle hashes, and a link is a pair whose shingle sets are that similar,
counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import append_arrow, components, texts_of, written

BITS = 64
PIECE = 1 << 16
# Cost of a signature row that is shuffled and sorted, in comparisons of two fingerprints.
ROW_COST = 300.0
# Rows of a bucket that one task compares among themselves.
BUCKET_ROWS = 20_000
# Shingle hashes of the sets that one task compares among themselves, at most twice as many.
CELL_HASHES = 1_000_000
# Bands of least hashes and hashes in each: a pair of similarity 0.8 shares one with 0.992.
BANDS, BAND_ROWS = 16, 6
_MIX = np.random.default_rng(8).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number; 0 without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
        n = len(found) - words + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, PIECE):
        part = np.fromiter(hashes, np.uint64, min(PIECE, n - i)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(part[:, k], minlength=256) @ _ONES
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprinted(df: DataFrame, text: str = "text", out: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """Append the fingerprint as a long (the unsigned bits); null text is empty."""

    def make():
        def fn(column: pa.Array):
            v = np.array([fingerprint(t, words, seed) for t in texts_of(column)], np.uint64)
            return [pa.array(v.view(np.int64))]

        return fn

    return append_arrow(df, [text], [(out, T.LongType())], make)


def shingle_set(text: str, words: int, seed: int = 44) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; none without words."""
    found = text.encode().lower().split()
    shingles = {b" ".join(x) for x in zip(*(found[i:] for i in range(words)))} if len(found) >= words else {b" ".join(found)} if found else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in shingles), np.uint64, len(shingles)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A number for each band of least hashes, as signed 64-bit; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _MIX[0] + _MIX[1]).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return [x - (1 << 64) if x >> 63 else x for x in keys]


def marked(df: DataFrame, words: int, verify: bool, text: str = "text") -> DataFrame:
    """Append ``fp``, ``second`` (a fingerprint with another seed, or 0), ``sig`` (the name of
    the text's shingle set) and ``bands``, in one pass over the texts."""

    def make():
        def fn(column: pa.Array):
            texts = texts_of(column)
            fps = [[fingerprint(t, words, seed) for t in texts] if seed else [0] * len(texts) for seed in (42, 43 if verify else 0)]
            sets = [shingle_set(t, words) for t in texts]
            sig, bands = [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], [band_keys(x) for x in sets]
            return [*(pa.array(np.array(v, np.uint64).view(np.int64)) for v in fps), pa.array(sig, pa.string()), pa.array(bands, pa.list_(pa.int64()))]

        return fn

    fields = [("fp", T.LongType()), ("second", T.LongType()), ("sig", T.StringType()), ("bands", T.ArrayType(T.LongType()))]
    return append_arrow(df, [text], fields, make)


# ---------------------------------------------------------------- statistics


@dataclass(frozen=True)
class BitStats:
    """How many fingerprints there are, and how often each pair of bits is set together."""

    n: int
    both: np.ndarray  # 64 x 64, the diagonal counts single bits


def bit_stats(fps: DataFrame, fp: str = "fp") -> BitStats:
    """Over all rows; each task sends one 64 x 64 sum, added up before the driver sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
        flat = np.concatenate([[n], total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = fps.select(fp).mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + BITS * BITS, np.int64)
    for r in rows:
        flat[r["i"]] = r["v"]
    return BitStats(int(flat[0]), flat[1:].reshape(BITS, BITS))


# ------------------------------------------------------------------- plan


@dataclass(frozen=True)
class Plan:
    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float

    def masks(self) -> list[int]:
        """The bits each signature keeps, as signed 64-bit numbers."""
        out = []
        for bits, t in zip(self.parts, self.thresholds):
            if t >= 0:
                out += [sum(1 << b for b in set(bits) - set(gone)) for gone in combinations(bits, t)]
        return [m - (1 << 64) if m >> 63 else m for m in out]


def group_bits(s: BitStats, m: int) -> tuple[tuple[int, ...], ...]:
    """``m`` partitions of near-equal size, each grown by the bit most correlated with it."""
    p = np.diag(s.both) / max(1, s.n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(s.both / max(1, s.n) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        first = max(free, key=lambda b: (corr[b][free].max(), -b))
        part = [first]
        free.remove(first)
        while len(part) < size:
            b = max(free, key=lambda b: (corr[b][part].sum(), -b))
            part.append(b)
            free.remove(b)
        out.append(tuple(sorted(part)))
    return tuple(out)


def meeting(s: BitStats, bits: tuple[int, ...], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most t of ``bits``, for t = 0..most.

    Equality goes along a chain of bits, each given the one before it that it
    depends on most; differences beyond that are taken as independent.
    """
    n = max(1, s.n)
    p1 = np.diag(s.both) / n
    same1 = p1**2 + (1 - p1) ** 2
    chain = 1.0
    for i, b in enumerate(bits):
        best = same1[b]
        for a in bits[:i]:
            p11 = s.both[a, b] / n
            cells = np.array([p11, p1[a] - p11, p1[b] - p11, 1 - p1[a] - p1[b] + p11])
            best = max(best, float((cells**2).sum() / same1[a]))
        chain *= min(1.0, best)
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for b in bits:
        q = 1 - same1[b]
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return [min(1.0, float(x)) for x in np.cumsum(dist) * chain / max(dist[0], 1e-300)]


def plan(s: BitStats, radius: int, most_parts: int = 10) -> Plan:
    """The cheapest number of partitions and thresholds for ``radius``."""
    best: Plan | None = None
    for m in range(1, min(most_parts, radius + 1) + 1):
        parts, total = group_bits(s, m), radius - m + 1
        # state: sum of (threshold + 1) so far -> (cost, thresholds)
        state = {0: (0.0, ())}
        for bits in parts:
            chance = meeting(s, bits, radius)
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, ts) in state.items():
                for t in range(-1, min(len(bits) - 1, total + m - used - 1) + 1):
                    c = cost
                    if t >= 0:
                        ways = math.comb(len(bits), t)
                        c += s.n * ways * ROW_COST + s.n * s.n / 2 * min(1.0, chance[t]) * 2**t
                    key = used + t + 1
                    if key not in step or c < step[key][0]:
                        step[key] = (c, (*ts, t))
            state = step
        cost, ts = state[total + m]
        if best is None or cost < best.cost:
            best = Plan(parts, ts, cost)
    return best


# ------------------------------------------------------------------- links


def forest(bucket: np.ndarray, fps: np.ndarray, second: np.ndarray, radius: int, verify: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted rows within their buckets, as (row, its root).

    Row i meets row i + 1, i + 2, ... of its bucket, all buckets at once; what is
    linked already isn't linked again, so there are fewer links than rows.
    """
    n = len(fps)
    last = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]), n - 1)
    end = np.repeat(last, np.diff(np.append(-1, last)))
    label, at, d = np.arange(n), np.flatnonzero(end > np.arange(n)), 1
    while len(at):
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= radius]
        near = near[np.bitwise_count(second[near] ^ second[near + d]) <= verify]
        while len(near):
            a, b = label[near], label[near + d]
            open_ = a != b
            if not open_.any():
                break
            near, a, b = near[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        d += 1
        at = at[end[at] >= at + d]
    linked = np.flatnonzero((fps[label] != fps) | (second[label] != second))
    return linked, label[linked]


def links(fps: DataFrame, radius: int, p: Plan, verify: int = BITS) -> DataFrame:
    """Edges (a, b) between nodes (fp, second), whose components are those of all pairs
    within ``radius`` bits by fp and ``verify`` bits by second.

    ``fps`` (fp, second) holds distinct rows and is read more than once.
    """
    masks = p.masks()
    if not masks:
        raise ValueError("no partition is probed")
    kept = F.array(*[F.lit(m) for m in masks])
    rows = fps.select("fp", "second", F.posexplode(kept).alias("j", "mask")).select("fp", "second", "j", F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
    rows = _split(fps, rows, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(x: np.ndarray):
            number = np.cumsum(np.append(False, (x[1:, :3] != x[:-1, :3]).any(axis=1)))
            ends = forest(number, x[:, 3].copy().view(np.uint64), x[:, 4].copy().view(np.uint64), radius, verify)
            return pa.RecordBatch.from_arrays([pa.array(x[i, c]) for i in ends for c in (3, 4)], ["a", "a2", "b", "b2"])

        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(x):
                continue
            held.append(x)
            size += len(x)
            if size < 2 * BUCKET_ROWS:
                continue
            x = np.concatenate(held)
            # The last bucket may go on in the next batch.
            starts = np.flatnonzero((x[1:, :3] != x[:-1, :3]).any(axis=1)) + 1
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield out(x[:cut])
            held, size = [x[cut:]], len(x) - cut
        if size:
            yield out(np.concatenate(held))

    keys = ["j", "v", "c"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
    found = dealt.select(*keys, "fp", "second").mapInArrow(run, "a long, a2 long, b long, b2 long")
    return found.select(node(F.col("a"), F.col("a2")).alias("a"), node(F.col("b"), F.col("b2")).alias("b"))


def node(fp: Column, second: Column) -> Column:
    """The name of a pair of fingerprints."""
    return F.concat(F.lpad(F.hex(fp), 16, "0"), F.lpad(F.hex(second), 16, "0"))


def _split(fps: DataFrame, rows: DataFrame, p: Plan) -> DataFrame:
    """Add the cell ``c`` of each row: 0, but in buckets over BUCKET_ROWS one cell
    for each pair of blocks, a row going to all cells of its block.

    A bucket that leaves out t bits joins 2^t values of its partition, so the
    most frequent value of each partition tells whether any bucket can be that
    large; only then are the buckets themselves counted.
    """
    used = [(sum(1 << b for b in bits), t) for bits, t in zip(p.parts, p.thresholds) if t >= 0]
    whole = F.array(*[F.struct(F.lit(m - (1 << 64) if m >> 63 else m).alias("m"), F.lit(1 << t).alias("k")) for m, t in used])
    value = fps.select("fp", F.posexplode(whole).alias("i", "s")).groupBy("i", "s.k", F.col("fp").bitwiseAND(F.col("s.m")).alias("v"))
    top = value.agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.col("n") * F.col("k"))).first()[0] or 0
    if top <= BUCKET_ROWS:
        return rows.withColumn("c", F.lit(0).cast("long"))
    hot = rows.groupBy("j", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_ROWS)
    hot = hot.select("j", "v", F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("k"))
    own = F.pmod(F.xxhash64("fp", "second"), F.col("k"))

    def cell(x: Column) -> Column:
        return F.least(x, own) * F.col("k") + F.greatest(x, own)

    cells = F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), cell))
    return rows.join(hot, ["j", "v"], "left").select("fp", "second", "j", "v", F.explode(cells).alias("c"))


# ------------------------------------------------------------------- groups


def fp_links(low: DataFrame, radius: int, verify: int | None) -> DataFrame | None:
    """(node, root) of the distinct (fp, second) of ``low`` that link to any other; None for a single one."""
    s = bit_stats(low)
    if s.n > 1:
        return components(links(low, radius, plan(s, radius), BITS if verify is None else verify).distinct())
    return None


def grouped(
    df: DataFrame, id_: str = "doc_id", text: str = "text", *, words: int = 3, radius: int = 2, verify: int | None = None, jaccard: float | None = None
) -> DataFrame:
    """(id, fp, component_id) for every row: the least id reachable over links of ``radius`` bits.

    With ``verify``, a link also needs at most so many differing bits of a second
    fingerprint.  With ``jaccard``, those links and shared bands are candidates,
    and a link is a candidate whose shingle sets are at least so similar.
    Repeated rows and ids give repeated rows.  Null text is empty;
    texts without words share the fingerprint 0, which links like any other.
    Null ids don't name a component; where a component has no other, its id is null.
    """
    seen = df.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    if jaccard is not None:
        seen = marked(seen, words, verify is not None).withColumn("digest", digest(F.col("text")))
        seen = written(seen.drop("text"), "fp")
        low = _similar(df.select(F.col(id_).alias("id"), F.col(text).alias("text")), seen, words, radius, verify, jaccard)
        return seen.join(low, "sig").select(F.col("id").alias(id_), "fp", F.col("low").alias("component_id"))
    seen = fingerprinted(seen, words=words)
    seen = seen.withColumn("second", F.lit(0).cast("long")) if verify is None else fingerprinted(seen, out="second", words=words, seed=43)
    seen = written(seen.drop("text"), "fp")
    low = written(seen.groupBy("fp", "second").agg(F.min("id").alias("low")), "low")
    parts = fp_links(low, radius, verify)
    if parts is not None:
        low = _least(low.withColumn("node", node(F.col("fp"), F.col("second"))), parts)
    return seen.join(low.select("fp", "second", "low"), ["fp", "second"]).select(F.col("id").alias(id_), "fp", F.col("low").alias("component_id"))


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _least(low: DataFrame, parts: DataFrame) -> DataFrame:
    """``low`` (node, low, ...) with the least ``low`` of each node's component."""
    member = low.select("node", "low").join(parts, "node")
    least = member.groupBy("root").agg(F.min("low").alias("least"))
    named = member.join(least, "root").select("node", "least")
    return low.join(named, "node", "left").withColumn("low", F.coalesce("least", "low")).drop("least")


def _similar(texts: DataFrame, seen: DataFrame, words: int, radius: int, verify: int | None, jaccard: float) -> DataFrame:
    """(sig, low): the least id of each shingle set's component over verified links.

    Each candidate group (the sets of a fingerprint component, or of a band) is
    first a star at its least member, so there are about as many pairs as sets.
    Where a band still has several components, its sets are compared in tasks.
    """
    nodes = written(seen.groupBy("sig").agg(F.min("id").alias("low"), F.min("digest").alias("digest"), F.any_value("bands").alias("bands")), "sets")
    in_bands = nodes.select("sig", F.explode("bands").alias("group"))
    several = in_bands.groupBy("group").agg(F.min("sig").alias("b"), F.max("sig").alias("last")).filter("b != last").select("group", "b")
    in_bands = written(in_bands.join(several, "group"), "bands")
    stars = in_bands.filter("sig != b").select(F.col("sig").alias("a"), "b")
    prints = seen.select("fp", "second").distinct()
    parts = fp_links(written(prints, "prints"), radius, verify)
    if parts is not None:
        named = seen.select("sig", node(F.col("fp"), F.col("second")).alias("node")).distinct().join(parts, "node", "left")
        stars = stars.unionByName(_star(named.select("sig", F.coalesce("root", "node").alias("group"))))
    stars = written(stars.distinct(), "stars")
    ends = stars.select(F.col("a").alias("sig")).unionByName(stars.select(F.col("b").alias("sig"))).distinct()
    need = nodes.join(ends, "sig").select("sig", "digest", "low")
    # One row of each set: by id as well, so copies of one text are dealt to many tasks.
    named = texts.select("text", F.col("id").alias("low"), digest(F.col("text")).alias("digest")).alias("t")
    mine = named.join(need.alias("n"), (F.col("t.digest") == F.col("n.digest")) & F.col("t.low").eqNullSafe(F.col("n.low"))).select("sig", "text")
    held = mine.groupBy("sig").agg(F.min("text").alias("text"))

    def make():
        def fn(column: pa.Array):
            return [pa.array([shingle_set(t, words).view(np.int64) for t in texts_of(column)], pa.list_(pa.int64()))]

        return fn

    sets = written(append_arrow(held, ["text"], [("set", T.ArrayType(T.LongType()))], make).drop("text"), "shingles")
    x = stars.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    good = written(x.filter(both / (F.size("x") + F.size("y") - both) >= jaccard).select("a", "b"), "good")
    own = in_bands.select("group", "sig").join(components(good).withColumnRenamed("node", "sig"), "sig", "left").withColumn("own", F.coalesce("root", "sig")).drop("root")
    own = written(own, "own")
    # A group of one component has nothing to compare.
    more = own.groupBy("group").agg(F.min("own").alias("p"), F.max("own").alias("q")).filter("p != q").select("group")
    good = good.unionByName(_linked(own.join(more, "group", "left_semi"), sets, jaccard))
    return _least(nodes.select(F.col("sig").alias("node"), "low"), components(good)).withColumnRenamed("node", "sig")


def cell_links(own: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, jaccard: float) -> list[tuple[int, int]]:
    """Links (i, j) of sets of at least ``jaccard``, enough to connect all that are; ``own`` has the components known before.

    Set i is compared at once with all later sets of other components: its hashes
    are marked, and each other set counts its marks.
    """
    ids = np.unique(hashes, return_inverse=True)[1]
    sizes = np.diff(offsets)
    label = np.unique(own, return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
    out = []
    for i in range(len(own) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= jaccard * np.maximum(sizes[rest], sizes[i])]
        if not len(rest):
            continue
        mine = ids[offsets[i] : offsets[i + 1]]
        mark[mine] = 1
        ends = np.cumsum(sizes[rest])
        at = np.arange(ends[-1]) + np.repeat(offsets[rest] - (ends - sizes[rest]), sizes[rest])
        both = np.add.reduceat(mark[ids[at]], ends - sizes[rest])
        mark[mine] = 0
        for j in rest[both >= jaccard * (sizes[rest] + sizes[i] - both)]:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _linked(own: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Links (a, b) inside groups (group, sig, own) between sets of different components.

    A group whose sets hold over CELL_HASHES hashes is cut into blocks, and a task
    compares two blocks; it sends out fewer links than it has sets.
    """
    sized = own.join(sets.select("sig", F.size("set").alias("m")), "sig").groupBy("group").agg(F.ceil(F.sum("m") / CELL_HASHES).cast("long").alias("k"))
    at = F.pmod(F.xxhash64("sig"), F.col("k"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda x: F.least(x, at) * F.col("k") + F.greatest(x, at))
    dealt = own.join(sized, "group").withColumn("c", F.explode(cells)).drop("k").join(sets, "sig")
    dealt = dealt.repartition("group", "c").sortWithinPartitions("group", "c").select("group", "c", "sig", "own", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            sig, lists = t.column("sig").combine_chunks(), t.column("set").combine_chunks()
            sizes = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            found = cell_links(np.array(t.column("own").to_pylist()), sizes, lists.flatten().to_numpy(), jaccard)
            return pa.RecordBatch.from_arrays([sig.take(pa.array([p[k] for p in found], pa.int64())) for k in (0, 1)], ["a", "b"])

        last = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            start = 0
            for i, key in enumerate([*keys, None]):
                if key == last and key is not None:
                    continue
                if i > start:
                    held.append(batch.slice(start, i - start))
                if key is not None:
                    if held:
                        yield out()
                    held, last = [], key
                start = i
        if held:
            yield out()

    return dealt.mapInArrow(run, "a string, b string")


def _star(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member (sig) of a group and the group's least."""
    least = groups.groupBy("group").agg(F.min("sig").alias("b"), F.max("sig").alias("last")).filter("b != last").select("group", "b")
    return groups.join(least, "group").filter("sig != b").select(F.col("sig").alias("a"), "b").distinct()


def deduplicated(df: DataFrame, id_: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` with one row of each group, that of the least id; of rows with one id, one stays.

    Rows without an id stay, as nothing can name them.  ``how`` goes to ``grouped``.
    """
    g = written(grouped(df, id_, text, **how), "groups")
    gone = g.filter(F.col(id_) != F.col("component_id")).select(id_).distinct()
    again = g.filter(F.col(id_).isNotNull()).groupBy(id_).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_)
    kept = df.join(gone, id_, "left_anti").select(*df.columns)
    once = kept.join(again, id_, "left_anti").select(*df.columns)
    return once.unionByName(kept.join(again, id_, "left_semi").select(*df.columns).dropDuplicates([id_]))
