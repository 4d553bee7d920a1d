"""Pfair mixing: windows, deviation below one block, whole results, odd rows."""

from collections import Counter, defaultdict
from math import ceil, floor

from pyspark.sql import functions as F

from tickloom.llm import mixing as M


def test_every_slot_is_within_one_block_of_the_target(spark):
    counts = spark.createDataFrame([("a", 9000), ("b", 400), ("c", 400), (None, 3), ("d", 1)], "key string, n long")
    units = M.units(counts, 100, M.root_share)
    us = {r.key: r.u for r in units.select(F.explode("ss").alias("s")).select("s.*").collect()}
    rows = sorted((r.slot, r.key, r.k, r.u) for r in M.pattern(units, 100).collect())
    assert sum(us.values()) == 100 and min(us.values()) >= 1 and [r[0] for r in rows] == list(range(100))
    done = Counter()
    for t, key, k, u in rows:
        assert k == done[key] and floor(k * 100 / u) <= t < ceil((k + 1) * 100 / u)
        done[key] += 1
        assert all(abs(done[s] - (t + 1) * u_ / 100) < 1 for s, u_ in us.items())


def test_whole_mixture(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "x") for i in range(700)] + [(5, "hot", "x"), (5, "hot", "x"), (None, None, "y"), (9, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    out = M.scheduled(df, block_rows=4, period=50)
    assert out.columns == ["doc_id", "source", "slot", "block", "release", "deadline", "slot_", "place"]
    got = out.collect()
    assert Counter((r.doc_id, r.source, r.slot) for r in got) == Counter(rows)
    assert len({r.place for r in got}) == len(got)
    blocks = defaultdict(set)
    for r in got:
        assert r.release <= r.slot_ < r.deadline
        blocks[r.source].add(r.block)
    assert all(b == set(range(max(b) + 1)) for b in blocks.values())
    mixed = M.mixed(df, block_rows=4, period=50)
    assert mixed.columns == df.columns and mixed.count() == len(rows)


def test_more_sources_than_units_share_a_queue(spark):
    df = spark.createDataFrame([(i, f"s{i % 30:02d}") for i in range(300)], "doc_id long, source string")
    got = M.scheduled(df, period=10, block_rows=2).collect()
    assert len(got) == 300 and len({r.place for r in got}) == 300


def test_exact_weights_over_a_thousand_sources(spark):
    """Every source has a queue and keeps its requested weight, far below a thousandth and far above."""
    sizes = {f"s{i:04d}": 3 + i % 9 for i in range(1500)} | {"hot": 3000, None: 40}
    ids = iter(range(10**6))
    df = spark.createDataFrame([(next(ids), s) for s, n in sizes.items() for _ in range(n)], "doc_id long, source string")
    weights = {s: n for s, n in sizes.items()}  # all sources end together, so the whole order counts
    got = M.scheduled(df, block_rows=1, weight=lambda n: n).collect()
    total = sum(weights.values())
    assert len(got) == total and sorted(r.slot for r in got) == list(range(total))
    blocks, worst = defaultdict(list), 0
    for r in sorted(got, key=lambda r: r.slot):
        t, j, w = r.slot, len(blocks[r.source]), weights[r.source]
        assert (r.block, r.release, r.deadline) == (j, j * total // w, -(-(j + 1) * total // w))
        worst = max(worst, abs(j - t * w / total), abs(j + 1 - (t + 1) * w / total))
        blocks[r.source].append(t)
    print("worst deviation", worst)
    assert {s: len(b) for s, b in blocks.items()} == sizes and worst < 2


def test_exact_rows_and_one_source(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(700)] + [(None, None), (9, None), (5, "hot")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = M.scheduled(df, block_rows=4, exact=True).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows) and len({r.place for r in got}) == len(got)
    one = M.scheduled(df.filter("source = 'hot'"), block_rows=4, exact=True).collect()
    assert sorted(r.place for r in one) == list(range(len(one)))
    assert M.scheduled(df.filter("false"), exact=True).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert M.scheduled(df).count() == 0 and M.mixed(df).count() == 0
